"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import version_key


def snapshot_changes(rows: DataFrame, keys: list[str], version: str, delivered: str, compare: list[str]) -> DataFrame:
    """``from_version, to_version, *keys, change_kind, changed_columns`` between consecutive versions.

    Versions are ordered by the numbers in them. A key that a version holds more than once stands
    with the row delivered last (of several delivered at once, the one with the greatest compared
    values, nulls lowest). ``change_kind`` is ``added``, ``removed`` or ``changed``; a null differs from
    every value and equals null. Rows with a null version or a null in a key are left out. With
    fewer than two versions nothing changes.

    The snapshots travel once: they are range-partitioned by key, and within a range sorted by key and
    version. There, without another shuffle, a key's deliveries within a version are folded, and one
    pass merges all neighbouring snapshots at once: where the next row of the order is the same key in
    the next version the two are compared, else the key came or went. A range is cut by whole keys,
    of which each holds its own deliveries only, whatever shares the values of one key column have.
    """
    held = rows.where(" and ".join(f"`{c}` is not null" for c in [*keys, version]))
    numbered = F.broadcast(_numbered(held.select(F.col(version).alias("_version"))).withColumnRenamed("_version", version))
    ranged = held.select(*keys, version, delivered, *[c for c in compare if c not in keys]).join(numbered, version).repartitionByRange(*keys)
    ranged = ranged.groupBy(*keys, "_i", "_n", version).agg(F.max(F.struct(F.col(delivered).alias("_t"), *[F.col(c) for c in compare])).alias("_row"))
    w = W.partitionBy(*keys).orderBy("_i")
    values = F.struct(*[F.col(f"_row.{c}").alias(c) for c in compare])
    seen = ranged.select(*keys, "_i", "_n", version, values.alias("_now")).select(
        "*", F.lag("_i").over(w).alias("_pi"), F.lag("_now").over(w).alias("_was"), F.lead("_i").over(w).alias("_ni")
    )
    differing = F.filter(F.array(*[F.when(~F.col(f"_now.{c}").eqNullSafe(F.col(f"_was.{c}")), F.lit(c)) for c in compare]), lambda x: x.isNotNull())
    follows = F.col("_pi") == F.col("_i") - 1
    come = F.when(F.col("_i") == 0, None).when(F.coalesce(follows, F.lit(False)), F.when(F.size(differing) > 0, F.struct(F.lit("changed").alias("change_kind"), differing.alias("changed_columns"), F.col("_i").alias("_to")))).otherwise(
        F.struct(F.lit("added").alias("change_kind"), F.array().cast("array<string>").alias("changed_columns"), F.col("_i").alias("_to"))
    )
    go = F.when((F.col("_i") < F.col("_n") - 1) & ~F.coalesce(F.col("_ni") == F.col("_i") + 1, F.lit(False)), F.struct(F.lit("removed").alias("change_kind"), F.array().cast("array<string>").alias("changed_columns"), (F.col("_i") + 1).alias("_to")))
    changes = seen.select(*keys, F.explode(F.filter(F.array(come, go), lambda x: x.isNotNull())).alias("_c")).select(*keys, "_c.*")
    names = F.broadcast(numbered.select(F.col("_i").alias("_to"), F.col(version).alias("to_version"), F.col("_before").alias("from_version")))
    return changes.join(names, "_to").select("from_version", "to_version", *keys, "change_kind", "changed_columns")


MOST_VERSIONS = 100_000


def _numbered(versions: DataFrame) -> DataFrame:
    """``_version, _i, _n, _before``: versions in order. There are as many as full deliveries were made.

    That number is checked before it is kept on the driver; more than ``MOST_VERSIONS`` is an error,
    as each of them is a full copy of the table.
    """
    names = [r[0] for r in versions.distinct().select("_version", version_key(F.col("_version")).alias("k")).orderBy("k", "_version").limit(MOST_VERSIONS + 1).collect()]
    if len(names) > MOST_VERSIONS:
        raise ValueError(f"more than {MOST_VERSIONS} versions: is this column a version?")
    rows = [(v, i, len(names), names[i - 1] if i else None) for i, v in enumerate(names)]
    return versions.sparkSession.createDataFrame(rows, "_version string, _i int, _n int, _before string")
