"""Names folded for comparison, and searched for."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import even_lookup
from ..plans.scratch import Scratch


class _Shown(dict):
    """What each character adds to a folded name: letters and digits without case and accents, a blank for what separates words, nothing else. Filled as characters occur."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c.isspace() or c in SEPARATORS:
            out = " "
        else:
            out = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if x.isalnum())
        self[code] = out
        return out


# Signs that separate words as a blank does, the article and the suffix that names go without.
SEPARATORS = "-_/"
ARTICLE = "the "
SUFFIX = " music"


def _shown(col: Column) -> Column:
    # the decomposition of accents has no SQL function, hence Arrow batches
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _Shown()
        for s in batches:
            yield s.map(lambda x: None if x is None else x.translate(table))

    return run(col)


def _tidy(shown: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(shown, " +", " ")), f"^{ARTICLE}(?=.)", "")


def normalise(col: Column) -> Column:
    """Case, accents, hyphens and punctuation folded; one leading 'the' dropped. Null stays null."""
    return _tidy(_shown(col))


def without_suffix(folded: Column) -> Column:
    """A folded name without its optional suffix; a name that is the suffix alone stays."""
    return F.regexp_replace(folded, f"(?<=.){SUFFIX}$", "")


def label_key(col: Column) -> Column:
    return without_suffix(normalise(col))


def holds_words(text: Column, phrase: Column) -> Column:
    """True where the words of ``phrase`` stand next to each other in ``text``, whole; both folded."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def search(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, id, label, exact, rank`` for each of ``queries(query)``: exact names in node order, then names that hold the words, shorter first.

    Blank queries find nothing. Words lead from a query to names: each name is listed under each of
    its words once, and a query is looked up under its rarest word only, so no query meets all names.
    The names under a common word are dealt to several tasks. A query may find any part of all names:
    they are numbered by exactness and length first, and one by one only among those alike in both.
    """
    keyed = nodes.select("id", "label", "ord", normalise(F.col("label")).alias("_k"))
    asked = queries.select("query").distinct().withColumn("_q", normalise(F.col("query"))).where("_q <> ''")
    words = Scratch(nodes.sparkSession, "words").keep(keyed.select("id", "label", "ord", "_k", F.explode(F.array_distinct(F.split("_k", " "))).alias("_w")))
    common = words.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    by_word = asked.select("query", "_q", F.explode(F.array_distinct(F.split("_q", " "))).alias("_w")).join(common, "_w", "left")
    rarest = by_word.groupBy("query", "_q").agg(F.min_by("_w", F.struct(F.coalesce("_n", F.lit(0)), "_w")).alias("_w"))
    hits = even_lookup(words, rarest, "_w").where(holds_words(F.col("_k"), F.col("_q"))).withColumn("exact", F.col("_k") == F.col("_q"))
    hits = hits.withColumn("_length", F.when(F.col("exact"), -1).otherwise(F.length("label")))
    sizes = hits.groupBy("query", "_length").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("query", "_length", F.coalesce(F.sum("_n").over(W.partitionBy("query").orderBy("_length").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = W.partitionBy("query", "_length").orderBy(F.when(F.col("exact"), F.col("ord")), "label", "ord")
    ranked = hits.withColumn("_i", F.row_number().over(inside)).join(before, ["query", "_length"])
    return ranked.select("query", "id", "label", "exact", (F.col("_before") + F.col("_i")).cast("bigint").alias("rank"))


def resolve(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, status, node_id, suggestions``: resolved for one match by label key, ambiguous for more, near_miss for none.

    Only what a search finds can match, so a query with the optional suffix doesn't reach a name
    without it. Suggestions are the first five labels found, for what didn't resolve.
    """
    found = search(nodes, queries).withColumn("_hit", label_key(F.col("label")) == label_key(F.col("query")))
    per = found.groupBy("query").agg(
        F.count_if("_hit").alias("n"), F.min(F.when(F.col("_hit"), F.col("id"))).alias("node_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "label")))), lambda x: x["label"]), " | ").alias("suggestions")
    )
    asked = queries.select("query").distinct().join(per, "query", "left")
    n = F.coalesce("n", F.lit(0))
    return asked.select("query", F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("near_miss").alias("status"), F.when(n == 1, F.col("node_id")).alias("node_id"), F.when(n != 1, F.coalesce("suggestions", F.lit(""))).alias("suggestions"))
