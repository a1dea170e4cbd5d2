"""Edges, cases and items chosen, drawn and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import is_blank, plain_id

# What the names of sealed datasets contain.
SEALED = ("heldout", "held-out", "held_out", "sealed")
# The levels of support, and the least and greatest quality, of a judgement.
SUPPORT, QUALITY = ("SUPPORTED", "OVERSTATED", "UNSUPPORTED"), (1, 5)


def build_reasons(edges: DataFrame, nodes: DataFrame, prefix: str) -> DataFrame:
    """``edges`` with ``reason_code``: why an edge isn't built, null for one that is.

    The first that fits: NONE (its tier is NONE or null), UNCITABLE (its statement, an address under
    ``prefix``, names another subject), NO_LABEL (either end has a blank label or is unknown).
    """
    label = nodes.groupBy("id").agg(F.min_by("label", "ord").alias("_l"))
    s, o = label.select(F.col("id").alias("subject_id"), F.col("_l").alias("_sl")), label.select(F.col("id").alias("object_id"), F.col("_l").alias("_ol"))
    met = edges.join(s, "subject_id", "left").join(o, "object_id", "left")
    cited = plain_id(F.regexp_extract(F.col("source_id"), f"^{prefix}([^-]+)-", 1))
    reason = (
        F.when(F.coalesce("prose_tier", F.lit("NONE")) == "NONE", "NONE")
        .when(~cited.eqNullSafe(F.col("subject_id")), "UNCITABLE")
        .when(is_blank(F.col("_sl")) | is_blank(F.col("_ol")), "NO_LABEL")
    )
    return met.select(*edges.columns, reason.alias("reason_code"))


def ends_of(edges: DataFrame) -> DataFrame:
    """``id`` of every node that an edge has as an end: a node exists only on a kept edge."""
    return edges.select(F.explode(F.array("subject_id", "object_id")).alias("id")).where("id is not null").distinct()


def first_kept(rows: DataFrame, kept: Column, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows in ``order`` of those that are ``kept``: the limit comes behind the filter."""
    return rows.where(kept).orderBy(*order).limit(most)


def is_sealed(dataset: Column) -> Column:
    """Whether a dataset's name contains the mark of a sealed one, in any case; false for null."""
    low = F.lower(F.coalesce(dataset, F.lit("")))
    return F.greatest(*[F.contains(low, F.lit(m)) for m in SEALED])


def is_pinnable(revision: Column) -> Column:
    """Whether a revision can be returned to: it is known and of a clean tree."""
    return F.coalesce((F.trim(revision) != "") & (F.lower(revision) != "unknown") & ~revision.endswith("-dirty"), F.lit(False))


def chosen(cases: DataFrame, ids: list[str]) -> DataFrame:
    """The cases of ``ids`` in the list's order as ``place``; an unknown id is an error, raised before anything runs on them."""
    spark = cases.sparkSession
    wanted = spark.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], "case_id string, place bigint")
    unknown = wanted.join(cases, "case_id", "left_anti").select("case_id").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown cases: {sorted(r[0] for r in unknown)}")
    return cases.join(wanted, "case_id")


def drawn(strata: DataFrame, quotas: dict[str, int], seed: int) -> DataFrame:
    """``id, stratum``: from ``strata(id, stratum)`` as many as each quota says, in the quotas' order, none twice.

    A stratum gives its members in the order of a seeded hash and leaves out those that an earlier one
    gave. A stratum that is short is an error. Quotas are of report size, so each draw is a top-k.
    """
    out = None
    for name, k in quotas.items():
        open_ = strata.where(F.col("stratum") == name).select("id", "stratum").distinct()
        if out is not None:
            open_ = open_.join(out.select("id"), "id", "left_anti")
        got = open_.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "id")), "id").limit(k)
        out = got if out is None else out.unionByName(got)
    counts = {r["stratum"]: r["count"] for r in out.groupBy("stratum").count().collect()}
    if short := [n for n, k in quotas.items() if counts.get(n, 0) < k]:
        raise ValueError(f"too few members: {short}")
    return out


def pool(items: DataFrame, key: str, group: str, per_group: int, seed: int) -> DataFrame:
    """``key, group, place, focus``: up to ``per_group`` of each group by a seeded hash, and which of an item's ``n_claims`` is looked at.

    An item's focus is hashed from the seed and its key; an item without claims has none.
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    w = W.partitionBy(group).orderBy(h, key)
    focus = F.when(F.col("n_claims") > 0, F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.col("n_claims"))
    return items.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_group).select(key, group, F.col("place").cast("bigint").alias("place"), focus.cast("bigint").alias("focus"))


def unlabelled(items: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The items that no label is for, and as ``is_next`` the first of them by ``ord``."""
    left = items.join(labels.select(key).distinct(), key, "left_anti")
    first = left.agg(F.min(F.struct("ord", key)).alias("_f"))  # one row
    return left.crossJoin(F.broadcast(first)).withColumn("is_next", F.struct("ord", key) == F.col("_f")).drop("_f")


def audited(expected: DataFrame, held: DataFrame) -> DataFrame:
    """``case_id, finding`` of cases whose expectation and graph disagree, from both sides.

    ``expected(case_id, node_id, refusal)`` and ``held(node_id, n_edges)``. UNRESOLVED: the case names a
    node that isn't held. REFUSAL_FLIP: a refusal is expected though the node has edges, or an answer
    though it has none. NO_CASE: a held node with edges that no case names; its ``case_id`` is null.
    """
    e = expected.where("node_id is not null").select("case_id", "node_id", "refusal")
    both = e.join(held.withColumn("_h", F.lit(True)), "node_id", "full")
    finding = (
        F.when(F.col("case_id").isNull(), F.when(F.col("n_edges") > 0, "NO_CASE"))
        .when(F.col("_h").isNull(), "UNRESOLVED")
        .when(F.col("refusal") == (F.col("n_edges") > 0), "REFUSAL_FLIP")
    )
    return both.select("case_id", "node_id", finding.alias("finding")).where("finding is not null")


def paired(items: DataFrame, labels: DataFrame, judgements: DataFrame, key: str) -> DataFrame:
    """``key, ord, label, judged``: items that have both a label and a judgement."""
    return items.select(key, "ord").join(labels.select(key, "label"), key).join(judgements.select(key, "judged"), key)


def judgement(text: Column) -> Column:
    """The judgement in a text as a struct ``support, quality, error``; ``error`` says why it isn't one.

    The outermost braces hold an object whose ``citation_support`` is one of ``SUPPORT``, in any case, and
    whose ``narrative_quality`` is an integer within ``QUALITY``. A text that breaks this has an error and no values.
    """
    doc = F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))
    support = F.upper(F.trim(F.try_variant_get(doc, "$.citation_support", "string")))
    quality = F.try_variant_get(doc, "$.narrative_quality", "int")
    error = (
        F.when(doc.isNull(), "no object")
        .when(~F.coalesce(support.isin(*SUPPORT), F.lit(False)), "support")
        .when(~F.coalesce(quality.between(*QUALITY), F.lit(False)), "quality")
    )
    return F.struct(F.when(error.isNull(), support).alias("support"), F.when(error.isNull(), quality).alias("quality"), error.alias("error"))


def divergences(runs: DataFrame) -> DataFrame:
    """``divergence, n, adhered``: how many of ``runs(planned, executed)`` did so many steps more (or fewer) than planned."""
    d = runs.select((F.col("executed") - F.col("planned")).cast("bigint").alias("divergence"))
    return d.groupBy("divergence").agg(F.count(F.lit(1)).alias("n")).withColumn("adhered", F.col("divergence") == 0)


def leading_year(text: Column) -> Column:
    """The year that a timestamp's text begins with, its sign included; null where it begins with none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)-", 1), F.lit("")).try_cast("int")
