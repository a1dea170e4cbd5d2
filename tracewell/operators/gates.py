"""Gates that hold a run against recorded bounds: each passes, fails or doesn't apply."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PASS, FAIL, NOT_APPLICABLE = "PASS", "FAIL", "N/A"
BOUNDS = "set_name string, dataset string, provider string, ord int, case_count bigint, bounds map<string,map<string,double>>"


class MalformedBounds(ValueError):
    """A file of bounds that is there and can't be read as such."""


def read_bounds(spark: SparkSession, path: str) -> DataFrame | None:
    """The sets of bounds in a JSON file, in their order; None where there is no file. A broken file is an error."""
    if not Path(path).exists():
        return None
    try:
        sets = json.loads(Path(path).read_text())["sets"]
        rows = []
        for i, s in enumerate(sets):
            bounds = {g: {k: float(v) for k, v in b.items()} for g, b in s["bounds"].items()}
            rows.append((s["name"], s["applies_to"]["dataset"], s["applies_to"]["provider"], i, int(s["case_count"]), bounds))
    except (json.JSONDecodeError, KeyError, TypeError, ValueError, AttributeError) as e:
        raise MalformedBounds(f"{path}: {e!r}") from e
    if not rows:
        raise MalformedBounds(f"{path}: no sets")
    return spark.createDataFrame(rows, BOUNDS)


def with_bounds(runs: DataFrame, sets: DataFrame) -> DataFrame:
    """``runs(dataset, provider, ...)`` with the first of ``sets`` of the same dataset and provider; its columns are null for runs that no set is for."""
    first = sets.groupBy("dataset", "provider").agg(F.min_by(F.struct("set_name", "case_count", "bounds"), "ord").alias("_s"))
    return runs.join(first, ["dataset", "provider"], "left").select(*runs.columns, "_s.set_name", F.col("_s.case_count").alias("set_cases"), "_s.bounds")


def bound(gate: str, name: str) -> Column:
    """One number of a gate's bounds; null where the set has none."""
    return F.try_element_at(F.try_element_at(F.col("bounds"), F.lit(gate)), F.lit(name))


def refusal_gate(true: Column, false: Column, expected_refusals: Column, expected_answers: Column, gate: str = "refusal_accuracy") -> Column:
    """Counts against counts: without a bound, or where the denominators moved, they don't apply."""
    moved = (expected_refusals != bound(gate, "expected_refusals")) | (expected_answers != bound(gate, "expected_answers"))
    holds = (true >= bound(gate, "minimum_true_refusals")) & (false <= bound(gate, "maximum_false_refusals"))
    return F.when(F.coalesce(moved, F.lit(True)), NOT_APPLICABLE).when(F.coalesce(holds, F.lit(False)), PASS).otherwise(FAIL)


def injection_gate(induced: Column, scored: Column, gate: str = "injection_resistance") -> Column:
    """Where nothing was planted it doesn't apply, whatever the bound; fewer planted cases than recorded fail."""
    least, most = bound(gate, "minimum_scored_cases"), bound(gate, "maximum_induced")
    return F.when((scored == 0) | least.isNull() | most.isNull(), NOT_APPLICABLE).when((scored >= least) & (induced <= most), PASS).otherwise(FAIL)


def required_cases(required: DataFrame, results: DataFrame, least: float, scripted: DataFrame | None = None) -> DataFrame:
    """``run_id, n_required, n_missing, n_regressed, verdict`` of each run against its required cases.

    ``required(run_id, case_id)`` are met with ``results(run_id, case_id, recall)`` by an outer join: a
    case without a result is missing, one whose recall is undefined or below ``least`` has regressed; of
    several results the lowest counts. Either fails the run. Runs in ``scripted(run_id)`` walk a script,
    so the gate doesn't apply to them.
    """
    worst = results.groupBy("run_id", "case_id").agg(F.min(F.coalesce("recall", F.lit(-1.0))).alias("_r"))
    met = required.select("run_id", "case_id").distinct().join(worst, ["run_id", "case_id"], "left")
    per = met.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_required"), F.count_if(F.col("_r").isNull()).alias("n_missing"), F.count_if(F.col("_r") < least).alias("n_regressed")
    )
    verdict = F.when((F.col("n_missing") == 0) & (F.col("n_regressed") == 0), PASS).otherwise(FAIL)
    if scripted is not None:
        per = per.join(scripted.select("run_id", F.lit(True).alias("_s")).distinct(), "run_id", "left")
        verdict = F.when(F.col("_s"), NOT_APPLICABLE).otherwise(verdict)
    return per.select("run_id", "n_required", "n_missing", "n_regressed", verdict.alias("verdict"))


def reported(verdicts: DataFrame, gated: Column) -> DataFrame:
    """``run_id, n_pass, n_fail, n_na, banner, blocks`` from ``verdicts(run_id, gate, verdict, ...)``.

    A run blocks when it is gated and a gate fails. ``gated`` gives null, or why a run isn't gated: no
    set of bounds for it, an incomplete run, another number of cases. Such a run has a banner and
    doesn't block.
    """
    per = verdicts.withColumn("_why", gated).groupBy("run_id").agg(
        *[F.count_if(F.col("verdict") == v).alias(n) for n, v in (("n_pass", PASS), ("n_fail", FAIL), ("n_na", NOT_APPLICABLE))], F.max("_why").alias("_why")
    )
    banner = F.when(F.col("_why").isNotNull(), F.concat(F.lit("NOT GATED: "), F.col("_why")))
    return per.select("run_id", "n_pass", "n_fail", "n_na", banner.alias("banner"), (F.col("_why").isNull() & (F.col("n_fail") > 0)).alias("blocks"))


def tolerances(spreads: DataFrame, least_runs: int, candidate: float) -> DataFrame:
    """``metric, tolerance, provisional, wider`` from ``stats.spread``.

    The tolerance is the spread measured; it is null, with the reason in ``provisional``, for fewer than
    ``least_runs`` runs or a metric undefined in all. ``wider``: a gate of ``candidate`` would fire on
    noise alone.
    """
    reason = F.when(F.col("n_runs") < least_runs, "too few runs").when(F.col("spread").isNull(), "undefined in every run")
    return spreads.select("metric", F.when(reason.isNull(), F.col("spread")).alias("tolerance"), reason.alias("provisional"), F.coalesce(F.col("spread") > candidate, F.lit(False)).alias("wider"))
