"""The problems on texts, bound to the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from ..plans.scratch import Scratch
from ..sources.tables import read_table
from . import lookalikes, mixing, oracles, packing, pairs, tokens

# 2. defective pairs


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["transcript_id", "query", "prose", "refused", "refusal_reason", "claims[].subject", "claims[].object", "loaded_at"]
    once = nested.latest_records(read_table(spark, sf_dir, "transcripts", paths), "transcript_id", "loaded_at")
    return once.select(F.col("transcript_id").alias("id"), "query", "prose", "refused", F.col("refusal_reason").alias("reason"), F.col("claims.subject").alias("names_a"), F.col("claims.object").alias("names_b"))


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]).where("doc_id is not null").withColumnRenamed("doc_id", "id")
    return pairs.defects(_pairs(spark, sf_dir), docs)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defects(spark, sf_dir).select(F.col("id").alias("transcript_id"), "defect")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs per defect and the evidence it was found by."""
    return _defects(spark, sf_dir).groupBy("defect", "evidence").agg(F.count(F.lit(1)).alias("n_pairs"))


def p2_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose fields alone tell the defect (marked as refused, prose of blanks), and how many of these ``p2_found`` gives."""
    reason = F.coalesce(F.lower(F.regexp_replace("reason", r"(?U)[^\p{L}\p{N}]+", "")), F.lit(""))
    blank = F.coalesce("prose", F.lit("")).rlike(r"^[\s\p{Z}]*$")
    marked = F.coalesce("refused", F.lit(False))
    sure = _pairs(spark, sf_dir).where(marked | blank).select(F.col("id").alias("transcript_id"), F.when(marked | ~reason.isin(pairs.NO_REASONS), "refusal").otherwise("empty").alias("defect"))
    both = sure.join(p2_found(spark, sf_dir).withColumn("found", F.lit(1)), ["transcript_id", "defect"], "left")
    return both.groupBy("defect").agg(F.count(F.lit(1)).alias("n_pairs"), F.count("found").alias("n_found"))


# 7. packing


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).where("doc_id is not null")
    # counted once: the statistics, the ranges' sample and the packing all read it
    return packing.along_curve(Scratch(spark, "tokens").keep(tokens.with_tokens(docs, "doc_id", "text", vectors=True)))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a container."""
    return packing.packed(_curve(spark, sf_dir), "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(p7_pack(spark, sf_dir))


def p7_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for every document: its pieces are all of it, its containers aren't overfull, it is split only if longer than one."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).where("doc_id is not null")
    counted = Scratch(spark, "tokens").keep(tokens.with_tokens(docs, "doc_id", "text", vectors=True))
    pieces = Scratch(spark, "pieces").keep(packing.packed(packing.along_curve(counted), "doc_id"))
    full = pieces.groupBy("container_id").agg(F.sum("n_tokens").alias("held"))
    met = pieces.join(full, "container_id").groupBy("doc_id").agg(
        F.sum("n_tokens").alias("in_pieces"), F.min("from_token").alias("low"), F.max("to_token").alias("high"), F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("n_kinds"), F.max("held").alias("held")
    )
    return counted.select("doc_id", "n_tokens").join(met, "doc_id", "left").select(
        "doc_id",
        F.coalesce((F.col("in_pieces") == F.col("n_tokens")) & (F.col("low") == 0) & (F.col("high") == F.col("n_tokens")) & (F.col("n") == F.col("n_kinds")), F.lit(False)).alias("whole"),
        (F.col("held") <= packing.CAPACITY).alias("fits"),
        ((F.col("n") == 1) | (F.col("n_tokens") > packing.CAPACITY)).alias("split_only_if_longer"),
    )


# 8. mixing

# the top level of the tree: what kind of text a source gives
P8_DOMAINS = {"wikitext": "reference", "archive_card": "reference", "concert_log": "reference", "press_review": "press", "liner_notes": "press", "festival_program": "press", "interview": "speech", "radio_script": "speech", "forum": "web"}


def _source(col: Column) -> Column:
    """Sources in one spelling: lower case, no outer blanks, words joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s-]+", "_")


def _mixed(spark: SparkSession, sf_dir: str, total: Callable[[list[mixing.Leaf]], float]) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"]).where("doc_id is not null")
    plain = docs.select("doc_id", "text", F.coalesce(F.lower(F.trim("lang")), F.lit("und")).alias("lang"), _source(F.col("source")).alias("source"))
    counted = Scratch(spark, "tokens").keep(tokens.with_tokens(plain, "doc_id", "text", "lang", "source"))
    targets = read_table(spark, sf_dir, "mixture_targets").select(_source(F.col("source")).alias("source"), "target_weight", "max_repeats")
    leaves = mixing.leaf_table(counted, targets, P8_DOMAINS)
    mixing.allot(leaves, total(leaves))
    return mixing.mixture(counted, "doc_id", leaves), targets


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in a mixture of as many tokens as the sources hold; what a short source lacks its siblings give."""
    return _mixed(spark, sf_dir, mixing.corpus_total)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares wanted and reached by ``p8_mixture``."""
    return mixing.shares(*_mixed(spark, sf_dir, mixing.corpus_total))


def p8_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached by the largest mixture in which every source with documents holds its own."""
    held = mixing.shares(*_mixed(spark, sf_dir, mixing.holding_total))
    return held.select("source", F.round("target_share", 3).alias("target_share"), F.round("reached_share", 3).alias("reached_share"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"))


def p8_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ``p8_mixture`` per target source: documents that may be used, and how many break a rule."""
    mixed, targets = _mixed(spark, sf_dir, mixing.corpus_total)
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"]).where("doc_id is not null and text <> ''")
    known = docs.select("doc_id", _source(F.col("source")).alias("own"))
    wrong = mixed.join(mixing.targets_once(targets), "source").join(known, "doc_id", "left")
    broken = wrong.groupBy("source").agg(
        F.count_if(F.col("copies") > F.col("max_repeats")).alias("n_over_cap"),
        F.count_if((F.col("used_tokens") > F.col("copies") * F.col("n_tokens")) | (F.col("used_tokens") < 1)).alias("n_wrong_tokens"),
        F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("n_foreign"),
    )
    held = known.groupBy(F.col("own").alias("source")).agg(F.count(F.lit(1)).alias("n_documents"))
    both = mixing.targets_once(targets).select("source").join(held, "source", "left").join(broken, "source", "left")
    return both.na.fill(0)


# 9. look-alike texts


def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lookalikes.classes(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")
    return Scratch(spark, "looks").keep(known)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_alike_pairs(_looks(spark, sf_dir))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_classes(_looks(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p2_marks, p7_pack, p7_fill, p7_places, p8_mixture, p8_shares, p8_held, p8_caps, p9_found, p9_classes)}
ORACLES: dict[str, str] = oracles.oracles(P8_DOMAINS)
