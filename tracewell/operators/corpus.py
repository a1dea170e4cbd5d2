"""Building a corpus: screening candidates, merging axes, overrides, constraints, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import is_blank
from ..plans.scratch import Scratch

# The eras, with their first and last year.
ERAS = (("pre-1900", -9999, 1899), ("1900-1949", 1900, 1949), ("1950-1969", 1950, 1969), ("1970-1989", 1970, 1989), ("1990-2009", 1990, 2009), ("2010-", 2010, 9999))
# The places that count as the English-speaking core, and a place that lies in one.
CORE = ("United States", "United Kingdom")
PLACE_IN = {"Brixton": "United Kingdom"}
YEAR = 9  # the precision code of a year; smaller codes are coarser
# Closed domains.
VERIFICATIONS = ("HAND", "PROSE_AUTO", "ASSERTS_AUTO", "EXPOSURE_AUTO")
PROSE_TIERS = ("PROSE", "INFOBOX_ONLY", "ORPHAN")
KINDS = ("genre", "artist")


def era(year: Column) -> Column:
    """The era of a year; null and years outside of all give 'unknown'."""
    return F.coalesce(*[F.when(year.between(lo, hi), F.lit(name)) for name, lo, hi in ERAS], F.lit("unknown"))


def region(countries: Column) -> Column:
    """anglophone_core, elsewhere, or unstated for a null or empty list."""
    home = F.transform(countries, lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in PLACE_IN.items()], c))
    return F.when(F.coalesce(F.size(countries), F.lit(0)) <= 0, "unstated").when(F.arrays_overlap(home, F.array(*map(F.lit, CORE))), "anglophone_core").otherwise("elsewhere")


def zero_filled(df: DataFrame, column: str, domain: tuple[str, ...], name: str = "n") -> DataFrame:
    """``column, name``: rows per value of a closed domain, zeros included; values outside of it aren't counted."""
    spark = df.sparkSession
    every = F.broadcast(spark.createDataFrame([(v,) for v in domain], f"`{column}` string"))  # as many rows as the domain has values
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name)).join(every, column, "right").na.fill(0, [name])


def first_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One whole row per key: that of the smallest ``order``. Keys of null count as equal."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def last_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One whole row per key: that of the greatest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def merge_nodes(*axes: DataFrame) -> DataFrame:
    """Nodes of several axes, one per id: the first axis and the smallest ``ord`` win."""
    every = _stacked(axes)
    return first_per(every, ["id"], "_rank").drop("_rank")


def merge_edges(*axes: DataFrame) -> DataFrame:
    """Edges of several axes, one per triple: the last axis and the greatest ``ord`` win."""
    every = _stacked(axes)
    return last_per(every, ["subject_id", "predicate", "object_id"], "_rank").drop("_rank")


def _stacked(axes: tuple[DataFrame, ...]) -> DataFrame:
    ranked = [a.withColumn("_rank", F.struct(F.lit(i).alias("axis"), F.col("ord"))) for i, a in enumerate(axes)]
    return reduce(lambda x, y: x.unionByName(y), ranked)


def kind_conflicts(*axes: DataFrame) -> DataFrame:
    """``id, kinds`` of ids that stand under more than one kind; a merge is sound when there are none."""
    every = reduce(lambda x, y: x.unionByName(y), [a.select("id", "kind") for a in axes])
    return every.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.countDistinct("kind").alias("n")).where("n > 1").select("id", "kinds")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``side, id, n_edges``: ends of edges that are no nodes."""
    ends = edges.select(F.inline(F.array(F.struct(F.lit("subject").alias("side"), F.col("subject_id").alias("id")), F.struct(F.lit("object").alias("side"), F.col("object_id").alias("id")))))
    return ends.groupBy("side", "id").agg(F.count(F.lit(1)).alias("n_edges")).join(nodes.select("id").distinct(), "id", "left_anti").select("side", "id", "n_edges")


def node_violations(nodes: DataFrame) -> DataFrame:
    """``id, ord, rule`` for each broken rule: blank provenance, unknown kind. A sound table gives no row."""
    rules = [F.when(is_blank(F.col(c)), F.lit(f"blank {c}")) for c in ("id", "label", "source", "source_id", "retrieved_at")]
    rules.append(F.when(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS), "unknown kind"))
    return _broken(nodes, ["id", "ord"], rules)


def edge_violations(edges: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``subject_id, object_id, ord, rule`` (or ``keep..., rule``): blank fields, values outside of the closed domains."""
    rules = [F.when(is_blank(F.col(c)), F.lit(f"blank {c}")) for c in ("subject_id", "predicate", "object_id", "source", "source_id", "retrieved_at")]
    rules.append(F.when(F.col("prose_tier").isNull() | ~F.col("prose_tier").isin(*PROSE_TIERS), "unknown prose_tier"))
    rules.append(F.when(F.col("verification").isNull() | ~F.col("verification").isin(*VERIFICATIONS), "unknown verification"))
    return _broken(edges, keep or ["subject_id", "object_id", "ord"], rules)


def _broken(df: DataFrame, keep: list[str], rules: list[Column]) -> DataFrame:
    return df.select(*keep, F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("rule"))


def type_split(candidates: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """``candidates`` with ``kept`` and, for the rest, ``reason`` naming the object by label where known.

    A candidate is kept when its object is a node of the kind; an object that is no node isn't kept.
    """
    o = nodes.select(F.col("id").alias("object_id"), F.col("label").alias("_l"), F.col("kind").alias("_k"))
    met = candidates.join(o, "object_id", "left")
    kept = F.coalesce(F.col("_k") == kind, F.lit(False))
    return met.select(*candidates.columns, kept.alias("kept"), F.when(~kept, F.concat(F.coalesce("_l", "object_id"), F.lit(f" is not of kind {kind}"))).alias("reason"))


def tally(df: DataFrame, reason: str) -> DataFrame:
    """``reason, n`` with three more rows: discovered, accepted (null reason) and excluded, which add up."""
    per = df.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    both = df.agg(F.count(F.lit(1)).alias("discovered"), F.count(reason).alias("excluded"))
    more = both.select(F.expr("stack(2, 'discovered', discovered, 'excluded', excluded) as (reason, n)"))
    return per.unionByName(more)


def overridden(auto: DataFrame, hand: DataFrame, rejects: DataFrame) -> DataFrame:
    """``subject_id, object_id, origin``: automatic pairs but the rejected, and all by hand; a pair of both is by hand.

    A pair in ``hand`` and ``rejects`` both is an error of the lists; it comes out with origin 'contradicted'.
    """
    key = ["subject_id", "object_id"]
    ranked = auto.select(*key).distinct().join(rejects.select(*key).distinct(), key, "left_anti").withColumn("origin", F.lit("auto")).unionByName(hand.select(*key).distinct().withColumn("origin", F.lit("hand")))
    best = ranked.groupBy(*key).agg(F.max("origin").alias("origin"))
    bad = rejects.select(*key).distinct().withColumn("_bad", F.lit(True))
    return best.join(bad, key, "left").select(*key, F.when(F.col("_bad"), "contradicted").otherwise(F.col("origin")).alias("origin"))


def overruled(auto: DataFrame, rejects: DataFrame) -> DataFrame:
    """Automatic pairs that the list of rejects took out."""
    key = ["subject_id", "object_id"]
    return auto.select(*key).distinct().join(rejects.select(*key).distinct(), key, "left_semi")


def fold_facts(rows: DataFrame) -> DataFrame:
    """``id, year, precision, countries``: of rows ``(id, year, precision, country, ord)`` the first dated one and all countries, sorted."""
    dated = F.when(F.col("year").isNotNull(), F.col("ord"))
    return rows.groupBy("id").agg(F.min_by("year", dated).alias("year"), F.min_by("precision", dated).alias("precision"), F.array_sort(F.collect_set("country")).alias("countries"))


def enrich(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Genre nodes take year, precision and countries from their facts; other nodes, and genres without facts, stay."""
    met = nodes.join(facts.select("id", F.col("year").alias("_y"), F.col("precision").alias("_p"), F.col("countries").alias("_c"), F.lit(True).alias("_f")), "id", "left")
    use = (F.col("kind") == "genre") & F.col("_f")
    return met.select(*[F.when(use, F.col(x)).otherwise(F.col(c)).alias(c) if (x := {"inception_year": "_y", "inception_precision": "_p", "countries": "_c"}.get(c)) else F.col(c) for c in nodes.columns])


def coverage(nodes: DataFrame) -> DataFrame:
    """One row of what the genre axis can speak about; zeros and a null top country for an empty one."""
    g = nodes.where("kind = 'genre'").select("id", "inception_year", "inception_precision", "countries", "ord", (F.coalesce(F.size("countries"), F.lit(0)) > 0).alias("placed"))
    base = g.agg(
        F.count(F.lit(1)).alias("genres"),
        F.count_if(F.col("inception_year").isNull()).alias("without_inception"),
        F.count_if(~F.col("placed")).alias("without_country"),
        F.count_if(F.col("inception_year").isNotNull() & (F.col("inception_precision") < YEAR)).alias("coarser_than_year"),
        F.count_if(F.col("placed") & (region(F.col("countries")) != "anglophone_core")).alias("genres_without_us_or_uk"),
    )
    per = countries(nodes)
    top = per.agg(F.count(F.lit(1)).alias("distinct_countries"), F.max_by("country", F.struct("n", -F.col("first_ord"))).alias("top_country"), F.max("n").alias("_top"))
    return base.crossJoin(F.broadcast(top)).select("genres", "without_inception", "without_country", "coarser_than_year", "genres_without_us_or_uk", "distinct_countries", "top_country", F.round(F.try_divide("_top", F.col("genres") - F.col("without_country")), 3).alias("top_country_share"))  # one row


def countries(nodes: DataFrame) -> DataFrame:
    """``country, n, first_ord``: genres per country as delivered; a genre of two counts for each."""
    return nodes.where("kind = 'genre'").select("ord", F.explode("countries").alias("country")).groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


def eras(nodes: DataFrame) -> DataFrame:
    """``era, n`` over the genre axis, all eras and 'unknown', zeros included."""
    return zero_filled(nodes.where("kind = 'genre'").select(era(F.col("inception_year")).alias("era")), "era", (*[e[0] for e in ERAS], "unknown"))


def drift_warning(n: Column, expected: int, tolerance: float = 0.25) -> Column:
    """True for a population of nothing or further from the expected size than the tolerance."""
    return (n == 0) | (F.abs(n - expected) / F.lit(float(expected)) > tolerance)


def batches(df: DataFrame, key: str, size: int = 40) -> DataFrame:
    """Adds ``batch``: rows in key order, ``size`` to a batch, for sources that are asked batchwise.

    Ranks come from sorted ranges with their counts added up, so no task sees more than a range. The
    ranges are written once: their numbers must be the same where they are ranked and where counted.
    """
    ordered = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    w = W.partitionBy("_part").orderBy("_at")
    ranked = Scratch(df.sparkSession, "batches").keep(ordered.withColumn("_r", F.row_number().over(w)))
    counts = ranked.groupBy("_part").agg(F.max("_r").alias("_n"))
    ahead = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return ranked.join(ahead, "_part").withColumn("batch", F.floor((F.col("_ahead") + F.col("_r") - 1) / size).cast("bigint")).drop("_part", "_at", "_r", "_ahead")
