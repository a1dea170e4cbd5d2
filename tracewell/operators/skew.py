"""Lookups that stay even when one key holds much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def even_lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hint: str | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``; hot keys of ``left`` are salted.

    Bytes tell a hot key badly, as its rows compress well, so rows are counted: first per task, then
    per key. A key is hot when it holds more rows than half an even share of a task; there are at
    most two of them per task, so naming them is bounded. Rows of a hot key are dealt to as many
    salts as they fill even shares, and its rows of ``right`` are copied to each. Rows of ``left`` with a
    null key meet nothing, as in any join. Read ``left`` from a
    written table: it is read twice.
    """
    spark = left.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    # one job: the rows are added up on the way to the keys of most rows, which any hot key is among
    seen = Observation()
    most = per.observe(seen, F.sum("_n").alias("n")).orderBy(F.col("_n").desc()).limit(2 * tasks).collect()
    share = max(1, (seen.get.get("n") or 0) // tasks)
    hot = [(r["_k"], -(-2 * r["_n"] // share)) for r in most if r["_n"] > max(share // 2, 1)]
    if hint:
        right = right.hint(hint)
    if not hot:
        return left.join(right, key, how)
    kind = left.schema[key].dataType.simpleString()
    named = F.broadcast(spark.createDataFrame(hot, f"`{key}` {kind}, _salts bigint"))  # at most two rows per task, whatever the size
    dealt = left.join(named, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")), F.lit(0))).drop("_salts")
    copied = right.join(named, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_salts")
    if hint:
        copied = copied.hint(hint)
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
