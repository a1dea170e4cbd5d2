"""References to records that don't exist.

References and parent keys are partitioned alike, sorted and merged as two streams (a sort-merge
join of the references with one row per parent), and the parent's intervals of validity tell the
causes apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .skew import even_lookup

NEVER = (1 << 63) - 1  # restored at no time


def parent_intervals(parents: DataFrame, removals: DataFrame) -> DataFrame:
    """``key, born, gone`` in microseconds: one row per key of ``parents(key, seen)``.

    A key seen several times is born at the earliest; one without any time was there always.
    ``gone`` is the sorted array of the intervals (``removed``, ``restored``) in which it was away, a
    null ``restored`` for one that never ended, null for a key never removed. ``removals(key, removed,
    restored)`` of keys that aren't parents are ignored; those of one key that overlap or touch are one
    interval, and one restored before it was removed was never away. Null keys are ignored.
    """
    born = parents.where("key is not null").groupBy("key").agg(F.min("seen").alias("born"))
    away = removals.where("key is not null and removed is not null and (restored is null or restored > removed)").select("key", "removed", F.coalesce("restored", F.lit(NEVER)).alias("restored")).distinct()
    before = W.partitionBy("key").orderBy("removed", "restored")
    starts = F.coalesce(F.col("removed") > F.max("restored").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    numbered = away.withColumn("_new", starts.cast("int")).withColumn("_i", F.sum("_new").over(before.rowsBetween(W.unboundedPreceding, 0)))
    merged = numbered.groupBy("key", "_i").agg(F.min("removed").alias("removed"), F.nullif(F.max("restored"), F.lit(NEVER)).alias("restored"))
    gone = merged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("removed", "restored"))).alias("gone"))
    return born.join(gone, "key", "left")


def orphans(refs: DataFrame, intervals: DataFrame) -> DataFrame:
    """The rows of ``refs(key, at, ...)`` that find no parent at their time, with ``cause``.

    ``missing``: no such parent. ``late``: it is born after ``at``. ``deleted``: removed at or before
    ``at`` and not restored by then, in any of its absences. Late goes before deleted. Null keys refer to nothing and are left
    out; with a null ``at`` only ``missing`` can be told. All other columns pass through, but one that
    is called ``cause`` already, which is replaced.

    The merge hint asks for the sorted merge even where one side would fit a broadcast. The
    references are written once and counted per key, so the rows of a hot key are dealt to several
    tasks and its parent goes to each.
    """
    held = Scratch(refs.sparkSession, "references").keep(refs.where("key is not null").drop("cause"))
    parents = intervals.select("key", F.lit(True).alias("_found"), F.col("born").alias("_born"), F.col("gone").alias("_gone"))
    met = even_lookup(held, parents, "key", "left", "merge")
    away = F.exists("_gone", lambda x: (x["removed"] <= F.col("at")) & ~F.coalesce(x["restored"] <= F.col("at"), F.lit(False)))
    cause = (
        F.when(F.col("_found").isNull(), "missing")
        .when(F.col("_born") > F.col("at"), "late")
        .when(away, "deleted")
    )
    return met.withColumn("cause", cause).where("cause is not null").drop("_born", "_gone", "_found")
