"""Sources mixed to target weights.

Weights go down a tree of domains, languages and sources. A leaf that hasn't enough tokens, however
often it may be repeated, leaves its shortage to its siblings, and only what they can't take goes to
the siblings of its ancestors. Each leaf then gives whole epochs and a prefix of the tokens of one
more, each epoch in an order of its own seed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_LEAVES = 100_000  # pairs of language and source whose totals the driver holds
SEED = 17
NO_LANGUAGE = "\0"  # of a source without documents: no language's leaves are its siblings before the domain's


@dataclass
class Leaf:
    path: tuple[str, ...]  # from the top of the tree down
    weight: float  # of the whole
    tokens: int
    repeats: int
    docs: int = 0
    budget: float = field(default=0.0, init=False)

    @property
    def most(self) -> int:
        return self.tokens * self.repeats


def allot(leaves: list[Leaf], total: float) -> float:
    """Sets each leaf's ``budget``; gives what no leaf could take.

    A leaf takes its weight of the total, as far as it has tokens. Shortages are handed out level by
    level from the leaves' parents up, each time among the leaves below that ancestor with room left,
    in proportion to their weights.
    """
    whole = sum(x.weight for x in leaves)
    for x in leaves:
        x.budget = min(float(x.most), total * x.weight / whole) if whole else 0.0
    owed = {x.path: (total * x.weight / whole if whole else 0.0) - x.budget for x in leaves}
    depth = len(leaves[0].path) if leaves else 0
    for level in range(depth - 1, -1, -1):
        groups: dict[tuple, list[Leaf]] = {}
        for x in leaves:
            groups.setdefault(x.path[:level], []).append(x)
        left: dict[tuple, float] = {}
        for top, group in groups.items():
            short = sum(v for k, v in owed.items() if k[:level] == top)
            while short > 1e-9:
                able = [x for x in group if x.most - x.budget > 1e-9 and x.weight > 0]
                if not able:
                    break
                w = sum(x.weight for x in able)
                given = 0.0
                for x in able:
                    more = min(x.most - x.budget, short * x.weight / w)
                    x.budget += more
                    given += more
                short -= given
            left[top] = short
        owed = left
    return sum(owed.values())


def holding_total(leaves: list[Leaf]) -> float:
    """The largest total at which only leaves without any tokens are short, so that all others hold their share."""
    some = [Leaf(x.path, x.weight, 0 if x.most == 0 else 1 << 60, 1) for x in leaves]
    allot(some, 1.0)
    return min((x.most / s.budget for x, s in zip(leaves, some, strict=True) if s.budget > 0), default=0.0)


def corpus_total(leaves: list[Leaf]) -> float:
    """The tokens that the sources hold, each document once: as much as is read without mixing."""
    return float(sum(x.tokens for x in leaves))


def targets_once(targets: DataFrame) -> DataFrame:
    """``source, target_weight, max_repeats``, one row per source: weights of repeated rows are added, the greater cap holds.

    Null and negative weights count as 0, a null cap as 1. Rows without a source are left out.
    """
    weight = F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))
    return targets.where("source is not null").groupBy("source").agg(F.sum(weight).alias("target_weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))


def leaf_table(docs: DataFrame, targets: DataFrame, domains: dict[str, str]) -> list[Leaf]:
    """The tree's leaves: one per language and source that occurs, and one per target source without documents.

    A source's weight is divided among its languages by their tokens. Sources that aren't targets
    have no leaf. There is one row per pair; their number is checked before they come to the driver.
    """
    wanted = {r["source"]: (r["target_weight"], r["max_repeats"]) for r in _few(targets_once(targets), "target sources")}
    held = docs.where("n_tokens > 0").groupBy("source", F.coalesce("lang", F.lit("")).alias("lang")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    rows = _few(held.join(targets.select("source"), "source", "left_semi"), "pairs of source and language")
    of_source: dict[str, int] = {}
    for r in rows:
        of_source[r["source"]] = of_source.get(r["source"], 0) + r["tokens"]
    out = []
    for r in rows:
        weight, repeats = wanted[r["source"]]
        path = (domains.get(r["source"], "other"), r["lang"], r["source"])
        out.append(Leaf(path, weight * r["tokens"] / of_source[r["source"]], r["tokens"], repeats, r["docs"]))
    out += [Leaf((domains.get(s, "other"), NO_LANGUAGE, s), w, 0, k) for s, (w, k) in wanted.items() if s not in of_source]
    return sorted(out, key=lambda x: x.path)


def _few(rows: DataFrame, what: str) -> list:
    got = rows.limit(MOST_LEAVES + 1).collect()
    if len(got) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} {what}")
    return got


def _key(epoch: Column, doc_id: str) -> Column:
    """A place in the epoch's seeded order, evenly spread over the BIGINTs."""
    return F.xxhash64(F.lit(SEED), epoch.cast("bigint"), F.col(doc_id))


def mixture(docs: DataFrame, doc_id: str, leaves: list[Leaf]) -> DataFrame:
    """``doc_id, source, lang, n_tokens, copies, used_tokens``: how often each document of ``docs`` is used.

    A leaf's budget of b tokens out of t gives floor(b / t) whole epochs, and of the next epoch, in
    its seeded order, the first b mod t tokens. The document in which this prefix ends gives its
    first tokens only, so a leaf gives its budget to the token, however long its documents are:
    ``copies`` counts that use as well, ``used_tokens`` is what all uses give. No document is used
    more often than its source may be. Documents without tokens, and of sources that aren't targets,
    aren't used; a null language is the language ''.
    """
    rows = []
    for x in leaves:
        budget = min(round(x.budget), x.most)
        if x.tokens and budget > 0:
            full, rest = divmod(budget, x.tokens)
            rows.append((x.path[2], x.path[1], full, rest, max(1, round(x.docs**0.5))))
    held = docs.select(doc_id, "source", F.coalesce("lang", F.lit("")).alias("lang"), F.col("n_tokens").cast("bigint").alias("n_tokens")).where("n_tokens > 0")
    plan = F.broadcast(docs.sparkSession.createDataFrame(rows, "source string, lang string, full bigint, rest bigint, slices bigint"))  # as many rows as leaves, checked
    placed = _ahead(held.join(plan, ["source", "lang"]).withColumn("at", _key(F.col("full"), doc_id)), doc_id)
    part = F.greatest(F.least(F.col("rest") - F.col("ahead"), F.col("n_tokens")), F.lit(0)).cast("bigint")
    used = placed.withColumn("_part", part).where("full > 0 or _part > 0")
    return used.select(
        doc_id,
        "source",
        "lang",
        "n_tokens",
        (F.col("full") + F.when(F.col("_part") > 0, 1).otherwise(0)).cast("bigint").alias("copies"),
        (F.col("full") * F.col("n_tokens") + F.col("_part")).cast("bigint").alias("used_tokens"),
    )


def _ahead(rows: DataFrame, doc_id: str) -> DataFrame:
    """Adds ``ahead``, the tokens that come before each row in its leaf's order ``at``.

    Found in two steps, so that a leaf may hold any part of all rows: sums per slice of the order are
    added up, and only within a slice are rows. A leaf of n documents has about sqrt(n) slices.
    """
    sliced = rows.withColumn("slice", F.floor(F.shiftrightunsigned("at", 11).cast("double") / F.lit(2.0**53) * F.col("slices")).cast("bigint"))
    sums = sliced.groupBy("source", "lang", "slice").agg(F.sum("n_tokens").alias("in_slice"))
    running = W.partitionBy("source", "lang").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("source", "lang", "slice", F.coalesce(F.sum("in_slice").over(running), F.lit(0)).alias("before"))
    inside = W.partitionBy("source", "lang", "slice").orderBy("at", doc_id).rowsBetween(W.unboundedPreceding, -1)
    within = sliced.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return within.join(before, ["source", "lang", "slice"]).withColumn("ahead", F.col("ahead") + F.col("before")).drop("before", "slice")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: wanted and reached share, tokens, documents and the most uses of one document."""
    got = mixed.groupBy("source").agg(F.sum("used_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    both = targets_once(targets).join(got, "source", "left").na.fill(0, ["tokens", "n_docs", "most_copies"])
    whole = both.agg(F.sum("tokens").alias("all_tokens"), F.sum("target_weight").alias("all_weight"))
    return both.crossJoin(F.broadcast(whole)).select(  # one row of sums
        "source",
        F.round(F.try_divide("target_weight", "all_weight"), 6).alias("target_share"),
        F.round(F.try_divide(F.col("tokens").cast("double"), F.col("all_tokens")), 6).alias("reached_share"),
        "tokens",
        "n_docs",
        "most_copies",
        F.col("max_repeats").cast("bigint").alias("max_repeats"),
    )
