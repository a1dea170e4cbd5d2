"""Candidates screened against the text of their subjects' articles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup

LOT = 200  # objects of a subject that are gathered in one row, about
_VERDICT = "tier string, hits int, names array<string>, sentences array<string>, assertion string, taxonomic_lead boolean, taxonomic_hits int"


def one_article(docs: DataFrame) -> DataFrame:
    """``subject_id, doc_id, title, text``: of ``docs`` with these columns the one of the smallest id per subject.

    Ids are compared first and only the chosen texts travel.
    """
    chosen = docs.where("subject_id is not null").groupBy("subject_id").agg(F.min("doc_id").alias("doc_id"))
    return docs.join(chosen, ["subject_id", "doc_id"], "left_semi").dropDuplicates(["doc_id"]).select("subject_id", "doc_id", "title", "text")


def prose(text: Column) -> Column:
    """The prose of wiki markup. Nested regions aren't regular, so it is an Arrow function, once per document."""

    @F.pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else markup.prose(x))

    return strip(text)


def assertion_of(text: Column) -> Column:
    """ASSERTS, EXPOSURE or NONE of a text, as a column expression."""
    return F.when(F.coalesce(text.rlike("(?i)" + markup.ASSERTS), F.lit(False)), "ASSERTS").when(F.coalesce(text.rlike("(?i)" + markup.EXPOSURE), F.lit(False)), "EXPOSURE").otherwise("NONE")


def screened(candidates: DataFrame, articles: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``subject_id, object_id`` of ``candidates`` with the verdict on each (see ``markup.verdict``).

    ``aliases(id, alias)`` are further names of nodes. Every article is stripped once, before it meets
    its candidates. Names meet the candidates first, and the objects of a subject are gathered in
    lots, so an article is met once per lot and not once per candidate. Subjects without an article
    and ends without a label are judged as such; no candidate is lost.
    """
    names = nodes.groupBy("id").agg(F.min_by("label", "ord").alias("label")).select("id", F.array("label").alias("names"))
    if aliases is not None:
        more = aliases.where("alias is not null").select("id", "alias").distinct().groupBy("id").agg(F.array_sort(F.collect_list("alias")).alias("more"))
        names = names.join(more, "id", "full").select("id", F.concat(F.coalesce("names", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))).alias("names"))
    named = candidates.select("subject_id", "object_id").join(names.select(F.col("id").alias("object_id"), "names"), "object_id", "left")
    many = candidates.groupBy("subject_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LOT)  # few subjects have so many
    lot = F.pmod(F.xxhash64("object_id"), F.coalesce(F.ceil(F.col("_n") / LOT), F.lit(1)))
    lots = named.join(many, "subject_id", "left").groupBy("subject_id", lot.alias("lot")).agg(F.collect_list(F.struct("object_id", "names")).alias("objects"))
    own = names.select(F.col("id").alias("subject_id"), F.col("names").alias("own"))
    ready = articles.withColumn("body", prose(F.col("text"))).select("subject_id", "title", "text", "body")
    met = lots.join(own, "subject_id", "left").join(ready, "subject_id", "left")
    columns = ["subject_id", "object_id", "tier", "hits", "names", "sentences", "assertion", "taxonomic_lead", "taxonomic_hits"]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for subject, own_names, title, text, body, objects in zip(*(b[c] for c in ("subject_id", "own", "title", "text", "body", "objects")), strict=True):
                mine = [] if own_names is None else list(own_names)
                for o in objects:
                    theirs = o["names"]
                    out.append({"subject_id": subject, "object_id": o["object_id"]} | markup.verdict(text, body, title, mine, [] if theirs is None else list(theirs)))
            yield pd.DataFrame(out, columns=columns)

    return met.select("subject_id", "own", "title", "text", "body", "objects").mapInPandas(judge, f"subject_id string, object_id string, {_VERDICT}")


def excluded(verdicts: DataFrame) -> DataFrame:
    """``subject_id, object_id, reason_code, reason`` of candidates that aren't borne out by prose."""
    text = {"NO_ARTICLE": "the subject has no article", "MISLINKED": "the article is about another subject", "INFOBOX_ONLY": "only the info box names the object", "ORPHAN": "the article doesn't name the object"}
    return verdicts.where("tier <> 'PROSE'").select("subject_id", "object_id", F.col("tier").alias("reason_code"), F.coalesce(*[F.when(F.col("tier") == k, F.lit(v)) for k, v in text.items()]).alias("reason"))


def masked_spans(objects: Column, subjects: Column) -> Column:
    """Spans of ``objects`` (array of start, end) that lie in none of ``subjects``: an interval anti-join within a row."""
    return F.filter(objects, lambda x: ~F.exists(subjects, lambda m: (m["start"] <= x["start"]) & (x["end"] <= m["end"])))
