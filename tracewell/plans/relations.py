"""The graph and evaluation relations that the reference queries read, as DataFrames and as SQL.

``SQL`` holds the same definitions as common table expressions, so a query and its SQL start from
one meaning: ids and predicates in their plain form, one node per id (seed nodes first, then the
first in order), one edge per triple (the last in order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import plain_id, plain_predicate
from ..operators import corpus, nested
from ..sources.tables import read_table

STATEMENT = "http://graph.example.org/entity/statement/"
AFTER_SEEDS = 1_000_000_000  # added to the order of nodes that aren't seeds


def raw_nodes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    seeds = read_table(spark, sf_dir, "seed_nodes").withColumn("id", plain_id(F.col("id")))
    return [seeds, read_table(spark, sf_dir, "nodes").withColumn("id", plain_id(F.col("id"))).withColumn("ord", F.col("ord") + AFTER_SEEDS)]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.merge_nodes(*raw_nodes(spark, sf_dir))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "edges")
    return e.withColumns({"subject_id": plain_id(F.col("subject_id")), "object_id": plain_id(F.col("object_id")), "predicate": plain_predicate(F.col("predicate"))})


def edges(spark: SparkSession, sf_dir: str, predicate: str | None = "influenced_by") -> DataFrame:
    e = raw_edges(spark, sf_dir)
    return corpus.merge_edges(e if predicate is None else e.where(F.col("predicate") == predicate))


def asked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated set of starting points: every node whose number is divisible by 100."""
    return nodes(spark, sf_dir).where("cast(substring(id, 2) as bigint) % 100 = 0").select("id")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per claim of a transcript: ``run_id`` (the transcript), ``ord`` (its place), the triple in plain form, its sources."""
    t = read_table(spark, sf_dir, "transcripts", ["transcript_id", "case_id", "loaded_at", "claims"])
    one = nested.latest_records(t, "transcript_id", "loaded_at").select("transcript_id", "case_id", F.posexplode("claims").alias("pos", "c"))
    return one.select(
        F.col("transcript_id").alias("run_id"), "case_id", F.col("pos").cast("bigint").alias("ord"), plain_id(F.col("c.subject_id")).alias("subject_id"), plain_predicate(F.col("c.predicate")).alias("predicate"), plain_id(F.col("c.object_id")).alias("object_id"), F.col("c.source_ids").alias("source_ids"), F.col("c.verification").alias("verification")
    )


def transcripts(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Transcripts, each once, with only these columns."""
    t = read_table(spark, sf_dir, "transcripts", ["transcript_id", "loaded_at", *[c for c in columns if c not in ("transcript_id", "loaded_at")]])
    return nested.latest_records(t, "transcript_id", "loaded_at")


def cases(spark: SparkSession, sf_dir: str, paths: list[str]) -> DataFrame:
    return nested.latest_records(read_table(spark, sf_dir, "adversarial_cases", ["case_id", "added_at", *paths]), "case_id", "added_at")


def pid(c: str) -> str:
    return rf"upper(regexp_replace(regexp_replace({c}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g'), '^.*/', ''))"


def ppred(c: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({c}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g'), '^.*:', ''))"


_NODE = "id, label, source, source_id, retrieved_at, kind, revision_id, inception_year, inception_precision, countries, ord"
_PLAIN_NODE = f"{pid('id')} id, label, source, source_id, retrieved_at, kind, revision_id, inception_year, inception_precision, countries"
SQL = {
    "nn": f"nn as (select {_PLAIN_NODE}, ord, 0 axis from seed_nodes union all select {_PLAIN_NODE}, ord + {AFTER_SEEDS} ord, 1 axis from nodes)",
    "n": f"n as (select {_NODE} from nn qualify row_number() over (partition by id order by axis, ord) = 1)",
    "ee": f"ee as (select {pid('subject_id')} subject_id, {ppred('predicate')} predicate, {pid('object_id')} object_id, source, source_id, retrieved_at, prose_tier, verification, ord from edges)",
    "ea": "ea as (select * from ee qualify row_number() over (partition by subject_id, predicate, object_id order by ord desc) = 1)",
    "e": "e as (select * from ea where predicate = 'influenced_by')",
    "q": "q as (select id from n where cast(substring(id, 2) as bigint) % 100 = 0)",
    "t": "t as (select * from transcripts qualify row_number() over (partition by transcript_id order by loaded_at desc) = 1)",
    "c": f"c as (select run_id, case_id, ord, {pid('x.subject_id')} subject_id, {ppred('x.predicate')} predicate, {pid('x.object_id')} object_id, x.source_ids source_ids, x.verification verification from (select transcript_id run_id, case_id, unnest(claims) x, unnest(range(len(claims))) ord from t))",
    "a": "a as (select * from adversarial_cases qualify row_number() over (partition by case_id order by added_at desc) = 1)",
}
_NEEDS = {"n": ["nn"], "ea": ["ee"], "e": ["ea"], "q": ["n"], "c": ["t"]}


def with_(*names: str) -> str:
    """``with recursive`` and the named relations, each after those it reads."""
    out: list[str] = []

    def add(x: str) -> None:
        for y in _NEEDS.get(x, []):
            add(y)
        if x not in out:
            out.append(x)

    for x in names:
        add(x)
    return "with recursive " + ", ".join(SQL[x] for x in out)
