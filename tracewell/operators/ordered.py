"""Operators whose meaning rests on order: budgets, limits, turns, last writes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def within_budget(items: DataFrame, run: str, order: str, cost: str, budget: int) -> DataFrame:
    """Adds ``spent_before`` and ``admitted``: an item is begun only while what was spent before is below the budget.

    Null costs are 0. Runs are ordered and added up on their own.
    """
    before = W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.coalesce(F.col(cost), F.lit(0))).over(before), F.lit(0)).cast("bigint")
    return items.withColumn("spent_before", spent).withColumn("admitted", F.col("spent_before") < budget)


def recent_arrivals(items: DataFrame, key: str, seconds_col: str, window: int = 60) -> DataFrame:
    """Adds ``recent``: arrivals of the key in the ``window`` seconds up to and with each one."""
    w = W.partitionBy(key).orderBy(seconds_col).rangeBetween(-window, 0)
    return items.withColumn("recent", F.count(F.lit(1)).over(w))


def granted(items: DataFrame, key: str, at: str, order: str, most: int, window: float) -> DataFrame:
    """Adds ``grant``: when a limiter of ``most`` requests in ``window`` lets each arrival pass.

    A grant is the latest of the arrival, the grant before it and the grant ``most`` places before it
    plus the window. That feeds back on its own result, so it isn't a window function: sorted
    partitions are passed through once, holding the last ``most`` grants of one key. Rows with a null
    key form a key; a null arrival is granted with the one before it.
    """
    schema = items.schema.add("grant", "double")
    names = [f.name for f in schema.fields]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = object(), deque(maxlen=most)
        for batch in batches:
            out = []
            for k, a in zip(batch[key].tolist(), batch[at].tolist(), strict=True):
                if k != current and not (k is None and current is None):
                    current, last = k, deque(maxlen=most)
                g = float("-inf") if a is None or a != a else float(a)
                if last:
                    g = max(g, last[-1])
                if len(last) == most:
                    g = max(g, last[0] + window)
                last.append(g)
                out.append(g)
            yield batch.assign(grant=out)[names]

    return items.repartition(key).sortWithinPartitions(key, at, order).mapInPandas(walk, schema)


def round_robin(items: DataFrame, group: str, order: str, seed: str) -> DataFrame:
    """Adds ``round``, from 0: every group once before any twice; within a group by a hash of seed and ``order``.

    Sorting by (round, md5 of seed and order) gives the sampling order; its first n rows are a sample.
    """
    h = F.md5(F.concat(F.lit(seed), F.col(order).cast("string")))
    return items.withColumn("round", (F.row_number().over(W.partitionBy(group).orderBy(h, order)) - 1).cast("bigint")).withColumn("turn", h)


def consecutive(items: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``group, a, b``: each value with the next of its group."""
    nxt = F.lead(value).over(W.partitionBy(group).orderBy(order))
    return items.select(group, order, F.col(value).alias("a"), nxt.alias("b")).where("b is not null").select(group, "a", "b")


def first_seen(items: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``group, values``: distinct values of a group in the order they were first seen, joined by ' | '.

    Values are folded per group first, so what is gathered is as long as a group has distinct values.
    """
    first = items.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(order).alias("_o"))
    return first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]), " | ").alias("values"))


def stop_reasons(turns: DataFrame, run: str, order: str, tokens: str, most_turns: int, most_tokens: int) -> DataFrame:
    """``run, turns, tokens, stop_reason``: max_tokens when the running sum crosses before the last turn, max_turns when there are as many, else complete."""
    w = W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    r = turns.withColumn("_sum", F.sum(F.coalesce(F.col(tokens), F.lit(0))).over(w)).withColumn("_n", F.row_number().over(W.partitionBy(run).orderBy(order)))
    cut = r.groupBy(run).agg(F.min(F.when(F.col("_sum") >= most_tokens, F.col("_n"))).alias("_cut"), F.max("_n").alias("_all"), F.max("_sum").alias("_total"), F.max(F.when(F.col("_n") == most_turns, F.col("_sum"))).alias("_at_most"))
    by_tokens = F.col("_cut").isNotNull() & (F.col("_cut") <= most_turns) & (F.col("_cut") < F.col("_all"))
    return r.join(cut, run).groupBy(run).agg(
        F.max(F.when(by_tokens, F.col("_cut")).otherwise(F.least(F.col("_all"), F.lit(most_turns)))).cast("bigint").alias("turns"),
        F.max(F.when(F.col("_n") <= F.when(by_tokens, F.col("_cut")).otherwise(F.least(F.col("_all"), F.lit(most_turns))), F.col("_sum"))).cast("bigint").alias("tokens"),
        F.max(F.when(by_tokens, "max_tokens").when(F.col("_all") > most_turns, "max_turns").otherwise("complete")).alias("stop_reason"),
    )


def latest(items: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` rows of the greatest ``order`` (a top-k, kept per task before it travels)."""
    return items.orderBy(F.col(order).desc()).limit(n)


def backoff(attempt_col: str, base: float = 5.0, cap: float = 60.0):
    """The delay before a retry, doubling from ``base``, at most ``cap``."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.col(attempt_col)))


def tumbling(events: DataFrame, at: str, width: str, by: list[str], value: str) -> DataFrame:
    """``start, by..., n, total`` per window of event time; rows without a time are left out.

    The same expression serves a stream: with a watermark on ``at`` a window is given out when it has
    passed, and what comes later is dropped (``streaming.events.late_windows``).
    """
    held = events.where(F.col(at).isNotNull())
    per = held.groupBy(F.window(at, width).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total"))
    return per.select(F.col("_w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, by: list[str]) -> DataFrame:
    """``by..., start, stop, n``: runs of events of which each follows the one before within less than ``gap``; a session stops a gap behind its last event."""
    held = events.where(F.col(at).isNotNull())
    per = held.groupBy(*by, F.session_window(at, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select(*by, F.col("_w.start").alias("start"), F.col("_w.end").alias("stop"), "n")
