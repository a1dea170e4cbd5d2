"""Agreement, spread, stability, slices and verdicts over runs and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gate import rate

SPARSE = 5  # a slice of fewer is reported as counts


def confusion(pairs: DataFrame) -> DataFrame:
    """``a, b, n`` over ``pairs(a, b)``; pairs with a null aren't counted."""
    return pairs.where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def kappa(pairs: DataFrame, scale: list, quadratic: bool = False) -> DataFrame:
    """One row: ``n, observed, expected, kappa`` of two raters on a declared scale.

    Weights are 1 on the diagonal and else 0, or with ``quadratic`` 1 - (i - j)^2 / (k - 1)^2 by the
    places on the scale; of a scale of one value all is agreement. Pairs outside of the scale aren't
    counted. Undefined (null) without pairs and where agreement is expected to be complete.

    The pairs are folded to at most k * k counts first; the rest is arithmetic on these.
    """
    spark, k = pairs.sparkSession, len(scale)
    place = {v: i for i, v in enumerate(scale)}
    kind = pairs.schema["a"].dataType.simpleString()
    weight = lambda i, j: (1.0 if k == 1 else 1 - (i - j) ** 2 / (k - 1) ** 2) if quadratic else float(i == j)
    cells = F.broadcast(spark.createDataFrame([(a, b, weight(i, j)) for a, i in place.items() for b, j in place.items()], f"a {kind}, b {kind}, w double"))  # k * k rows
    counts = confusion(pairs).join(cells, ["a", "b"])
    total = counts.agg(F.sum("n").alias("total"))
    rows, cols = counts.groupBy("a").agg(F.sum("n").alias("na")), counts.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = cells.join(rows, "a").join(cols, "b").agg(F.sum(F.col("w") * F.col("na") * F.col("nb")).alias("e"))
    seen = counts.agg(F.sum(F.col("w") * F.col("n")).alias("o"))
    one = total.crossJoin(seen).crossJoin(chance)  # one row each
    o, e = rate(F.col("o"), F.col("total")), F.try_divide(F.col("e"), F.col("total").cast("double") * F.col("total"))
    return one.select(F.coalesce("total", F.lit(0)).alias("n"), o.alias("observed"), e.alias("expected"), F.when(F.abs(1 - e) >= 1e-12, (o - e) / (1 - e)).alias("kappa"))


def strength(k: Column) -> Column:
    """The customary name of a kappa's size; null where it is undefined."""
    bands = ((0.81, "almost perfect"), (0.61, "substantial"), (0.41, "moderate"), (0.21, "fair"), (0.0, "slight"))
    return F.when(k.isNotNull(), F.coalesce(*[F.when(k >= low, F.lit(name)) for low, name in bands], F.lit("poor")))


def spread(values: DataFrame) -> DataFrame:
    """Per ``metric`` of ``values(run_id, metric, value)``: runs, undefined ones, least, most, range, mean, sample deviation.

    Null values are undefined and only counted; the deviation needs two defined ones.
    """
    return values.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.col("value").isNull()).alias("n_undefined"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        (F.max("value") - F.min("value")).alias("spread"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("stdev"),
    )


def unpivoted(wide: DataFrame, key: str, metrics: dict[str, Column]) -> DataFrame:
    """``key, metric, value``: named expressions over one wide row each, as rows. Metrics are added by naming one more."""
    return wide.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()])))


def stability(results: DataFrame) -> DataFrame:
    """Per case of ``results(run_id, case_id, correct, refused, claims)``: whether runs agree, and how far claims swing."""
    return results.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_runs"),
        ((F.min("correct") == F.max("correct")) & (F.min("refused") == F.max("refused"))).alias("stable"),
        F.bool_and("correct").alias("always_correct"),
        (~F.bool_or("correct")).alias("always_wrong"),
        (F.max("claims") - F.min("claims")).cast("bigint").alias("claim_swing"),
    )


def sliced(items: DataFrame, dimensions: list[str], hit: str) -> DataFrame:
    """``dimension, value, hits, total, shown`` for each dimension by itself (grouping sets, one pass).

    Null values of a dimension are 'unknown'. ``shown`` is a percentage, or the counts where the slice
    has fewer than ``SPARSE`` items.
    """
    long = items.select(F.col(hit).alias("_hit"), F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.nullif(F.col(d), F.lit("")), F.lit("unknown")).alias("value")) for d in dimensions])))
    per = long.groupBy("dimension", "value").agg(F.count_if("_hit").alias("hits"), F.count(F.lit(1)).alias("total"))
    return per.withColumn("shown", F.when(F.col("total") < SPARSE, F.concat_ws("/", F.col("hits").cast("string"), F.col("total").cast("string"))).otherwise(F.concat(F.floor(100 * F.col("hits") / F.col("total") + 0.5).cast("string"), F.lit("%"))))


def floor_verdict(value: Column, least: Column) -> Column:
    """PASS, FAIL or N/A: no floor is N/A, an undefined value fails its floor."""
    return F.when(least.isNull(), "N/A").when(value.isNull(), "FAIL").when(value >= least, "PASS").otherwise("FAIL")


def incomparable(runs: DataFrame, fields: list[str]) -> DataFrame:
    """``field, value, n`` of fields on which the runs differ: a row per value, with the rows that hold it; null is a value. Runs may be pooled when there are none."""
    long = runs.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("<null>")).alias("value")) for f in fields])))
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy("field").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("field")
    return counts.join(several, "field", "left_semi").select("field", "value", "n")


def case_sets(results: DataFrame) -> DataFrame:
    """``run_id, n_cases, case_set``: a digest of the distinct cases of each run, whatever their order; runs over the same cases have the same."""
    one = results.where("case_id is not null").select("run_id", "case_id").distinct()
    h = F.conv(F.substring(F.md5("case_id"), 1, 15), 16, 10).cast("bigint")
    return one.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_cases"), F.bit_xor(h).alias("case_set"))
