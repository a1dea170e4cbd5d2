"""Proposed claims held against a graph, and measures of what was claimed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Why a proposal is rejected, the first that applies.
REASONS = ("duplicate", "unsupported_predicate", "unknown_subject", "unknown_object", "cross_axis", "not_in_graph", "unresolvable_source")


def cited_subject(uri: Column, prefix: str) -> Column:
    """The id that a statement's address names, in upper case; null for other addresses."""
    return F.when(uri.startswith(prefix), F.upper(F.substring_index(F.substring(uri, len(prefix) + 1, 1 << 20), "-", 1)))


def gated(proposals: DataFrame, nodes: DataFrame, edges: DataFrame, prefix: str, predicates: tuple[str, ...] = ("influenced_by",)) -> DataFrame:
    """``proposals(run_id, ord, subject_id, predicate, object_id)`` with ``status, reason, source_id, verification``.

    Within a run every repeat of a triple is a duplicate, also when the first was rejected. Approved
    claims take source and verification from the edge (the first of several in edge order), which a
    proposal can't bring along. Nulls in a triple are values of their own and are unknown nodes.

    Nodes and edges have one row per key after folding, so each join keeps the proposals' rows.
    """
    key = ["subject_id", "predicate", "object_id"]
    known = nodes.groupBy("id").agg(F.min_by("kind", "ord").alias("kind"))
    first = edges.groupBy(*key).agg(F.min_by(F.struct("source_id", "verification"), "ord").alias("_edge"))
    seen = proposals.withColumn("_rn", F.row_number().over(W.partitionBy("run_id", *key).orderBy("ord")))
    met = (
        seen.join(known.select(F.col("id").alias("subject_id"), F.col("kind").alias("_sk"), F.lit(True).alias("_s")), "subject_id", "left")
        .join(known.select(F.col("id").alias("object_id"), F.col("kind").alias("_ok"), F.lit(True).alias("_o")), "object_id", "left")
        .join(first, key, "left")
    )
    tests = [F.col("_rn") > 1, ~F.coalesce(F.col("predicate").isin(*predicates), F.lit(False)), F.col("_s").isNull(), F.col("_o").isNull(), ~F.col("_sk").eqNullSafe(F.col("_ok")), F.col("_edge").isNull(), ~cited_subject(F.col("_edge.source_id"), prefix).eqNullSafe(F.col("subject_id"))]
    reason = F.coalesce(*[F.when(t, F.lit(r)) for r, t in zip(REASONS, tests, strict=True)])
    ok = reason.isNull()
    return met.select("run_id", "ord", *key, F.when(ok, "approved").otherwise("rejected").alias("status"), reason.alias("reason"), F.when(ok, F.col("_edge.source_id")).alias("source_id"), F.when(ok, F.col("_edge.verification")).alias("verification"))


def grounded(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``claims(.., subject_id, predicate, object_id, source_ids)`` with ``is_grounded``: an edge of the triple holds every cited address."""
    key = ["subject_id", "predicate", "object_id"]
    held = edges.groupBy(*key).agg(F.collect_set("source_id").alias("_held"))
    met = claims.join(held, key, "left")
    cited = F.coalesce(F.col("source_ids"), F.array().cast("array<string>"))
    return met.select(*claims.columns, (F.col("_held").isNotNull() & (F.size(F.array_except(cited, F.coalesce("_held", F.array().cast("array<string>")))) == 0)).alias("is_grounded"))


def citations_resolve(source_ids: Column, subject_id: Column, prefix: str) -> Column:
    """True when there is a citation and all of them name the subject."""
    return F.coalesce(F.size(source_ids), F.lit(0)).__gt__(0) & F.coalesce(F.forall(source_ids, lambda x: F.coalesce(cited_subject(x, prefix) == subject_id, F.lit(False))), F.lit(False))


def rate(hits: Column, of: Column) -> Column:
    """hits / of as a DOUBLE; undefined (null) where of is 0."""
    return F.try_divide(hits.cast("double"), of.cast("double"))


def refusals(cases: DataFrame) -> DataFrame:
    """One row from ``cases(refused, expected)``: the four counts and both rates; rows with a null in either aren't counted."""
    c = cases.where("refused is not null and expected is not null")
    return c.agg(
        F.count_if(F.col("refused") & F.col("expected")).alias("true_refusals"),
        F.count_if(F.col("refused") & ~F.col("expected")).alias("false_refusals"),
        F.count_if(~F.col("refused") & F.col("expected")).alias("missed_refusals"),
        F.count_if(~F.col("refused") & ~F.col("expected")).alias("correct_answers"),
    ).select("*", F.round(rate(F.col("true_refusals"), F.col("true_refusals") + F.col("missed_refusals")), 9).alias("true_refusal_rate"), F.round(rate(F.col("false_refusals"), F.col("false_refusals") + F.col("correct_answers")), 9).alias("false_refusal_rate"))


def traversal(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``run_id, subject_id, hits, n_gold, n_visited``: of each subject that a run claims about, its objects in the graph and in the claims, as sets.

    A subject that the graph has no edge of has nothing to find, so all its counts are 0 and both rates
    undefined. Claims without a subject are left out; null objects aren't counted. Pairs are joined and
    counted, so no list grows with a subject's degree.
    """
    gold = edges.select("subject_id", "object_id").where("object_id is not null").distinct()
    visited = claims.where("subject_id is not null").select("run_id", "subject_id", "object_id").distinct()
    met = visited.join(gold.withColumn("_hit", F.lit(1)), ["subject_id", "object_id"], "left")
    per = met.groupBy("run_id", "subject_id").agg(F.count("_hit").alias("hits"), F.count("object_id").alias("_visited"))
    sizes = gold.groupBy("subject_id").agg(F.count(F.lit(1)).alias("_gold"))
    both = per.join(sizes, "subject_id", "left")
    return both.select("run_id", "subject_id", "hits", F.coalesce("_gold", F.lit(0)).alias("n_gold"), F.when(F.col("_gold") > 0, F.col("_visited")).otherwise(0).alias("n_visited"))


def breaches(approved: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Rows of ``approved(case_id, subject_id, predicate, object_id)`` that their case forbids."""
    return approved.join(forbidden.select("case_id", "subject_id", "predicate", "object_id").distinct(), ["case_id", "subject_id", "predicate", "object_id"], "left_semi")


def resistance(breach: DataFrame, cases: DataFrame, forbidden: DataFrame) -> DataFrame:
    """One row: breaches made, cases that could breach (they forbid something), cases that couldn't, and whether it holds (null when none could)."""
    scored = cases.select("case_id").distinct().join(forbidden.select("case_id").distinct().withColumn("_f", F.lit(1)), "case_id", "left").agg(F.count("_f").alias("scored_cases"), F.count_if(F.col("_f").isNull()).alias("unscored_cases"))
    return breach.agg(F.count(F.lit(1)).alias("induced")).crossJoin(F.broadcast(scored)).select("induced", "scored_cases", "unscored_cases", F.when(F.col("scored_cases") > 0, F.col("induced") == 0).alias("holds"))  # one row


def mirrored_edges(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``run_id, subject_id, object_id``: claims that the graph has only the other way round."""
    e = edges.select("subject_id", "object_id").distinct()
    back = e.select(F.col("object_id").alias("subject_id"), F.col("subject_id").alias("object_id"))
    return claims.select("run_id", "subject_id", "object_id").distinct().join(e, ["subject_id", "object_id"], "left_anti").join(back, ["subject_id", "object_id"], "left_semi").select("run_id", "subject_id", "object_id")
