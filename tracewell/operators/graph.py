"""Graph queries over an edge list ``subject_id, object_id, ord``.

An edge reads "subject was influenced by object": ``up`` walks from subject to object (to what came
before), ``down`` the other way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

UP, DOWN = "up", "down"


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """``a, b, ord``: steps from a to b in the given direction."""
    a, b = ("subject_id", "object_id") if direction == UP else ("object_id", "subject_id")
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b"), "ord")


def neighbours(edges: DataFrame, ids: DataFrame, direction: str) -> DataFrame:
    """The edges that leave each of ``ids(id)`` in the direction; an id without edges gives no row."""
    key = "subject_id" if direction == UP else "object_id"
    return edges.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``subject_label`` and ``object_label``; where a node is unknown or has no label, its id."""
    s = nodes.select(F.col("id").alias("subject_id"), F.col("label").alias("_sl"))
    o = nodes.select(F.col("id").alias("object_id"), F.col("label").alias("_ol"))
    met = edges.join(s, "subject_id", "left").join(o, "object_id", "left")
    return met.select(*edges.columns, F.coalesce("_sl", "subject_id").alias("subject_label"), F.coalesce("_ol", "object_id").alias("object_label"))


def shortest_paths(edges: DataFrame, sources: DataFrame, direction: str = UP, targets: DataFrame | None = None, most_hops: int | None = None) -> DataFrame:
    """``source, target, hops, steps, chain`` for each target that each of ``sources(id)`` reaches.

    ``steps`` are the ``ord`` of the edges walked, ``chain`` the nodes. Of several shortest paths the
    one whose steps come first in edge order is given (arrays compare from the left). A source isn't
    its own target. With ``targets(source, target)`` only these are given, and a source's walk ends
    when all its targets are found.

    All sources advance together, one level a round. A level's candidates are folded to one per
    source and node before they travel, so a node that much of a level meets in is one row per
    source. Each level is written to the shared folder.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    steps = oriented(edges, direction)
    ids = sources.select("id").distinct()
    if targets is not None:
        ids = ids.join(targets.select(F.col("source").alias("id")).distinct(), "id", "left_semi")
    front = scratch.keep(ids.select(F.col("id").alias("source"), F.col("id").alias("node"), F.array().cast("array<bigint>").alias("steps"), F.array("id").alias("chain")))
    levels = []
    seen = front.select("source", "node")
    hops = 0
    while most_hops is None or hops < most_hops:
        hops += 1
        tried = front.join(steps, front.node == steps.a).select("source", F.col("b").alias("node"), F.concat("steps", F.array("ord")).alias("steps"), F.concat("chain", F.array("b")).alias("chain"))
        new = tried.groupBy("source", "node").agg(F.min(F.struct("steps", "chain")).alias("p")).join(seen, ["source", "node"], "left_anti").select("source", "node", "p.steps", "p.chain")
        front, n = scratch.keep_counting(new, F.count(F.lit(1)))
        if not n:
            break
        levels.append(front)
        seen = seen.unionByName(front.select("source", "node"))
        if targets is not None:
            open_ = targets.select("source", F.col("target").alias("node")).join(seen, ["source", "node"], "left_anti").select("source").distinct()
            front = front.join(open_, "source", "left_semi")
    out = levels[0] if levels else front
    for x in levels[1:]:
        out = out.unionByName(x)
    out = out.select("source", F.col("node").alias("target"), F.size("steps").cast("bigint").alias("hops"), "steps", "chain")
    return out if targets is None else out.join(targets.select("source", "target").distinct(), ["source", "target"], "left_semi")


def trace(edges: DataFrame, pairs: DataFrame, with_chains: bool = True) -> DataFrame:
    """``source, target, direction, hops, chain`` for ``pairs(source, target)``: up, and only where that fails down.

    The chain runs from the descendant to the ancestor either way; of several shortest ones it is that
    of ``shortest_paths``. It is left out without ``with_chains``. Pairs without a path, of equal ends
    or with a null give no row.

    Each pair is searched from both ends, up and down at once. A round moves a search on by one level
    at the end from which fewer steps lead on, so a search ends with the end that reaches less, and no
    round walks all that a source reaches. Whole levels are walked, so where the ends first meet
    the path is a shortest one. The edges are read once; a round reads the table of the round before only,
    and a pair that is answered or has run dry is left out of it.
    """
    scratch = Scratch(edges.sparkSession, "trace")
    asked = scratch.keep(pairs.where("source <> target").select("source", "target").distinct().withColumn("p", F.monotonically_increasing_id()))
    one = scratch.keep(edges.where("subject_id is not null and object_id is not null").groupBy("subject_id", "object_id").agg(F.min("ord").alias("ord")))
    ways = one.select(F.lit(True).alias("up"), F.col("subject_id").alias("a"), F.col("object_id").alias("b"), "ord").unionByName(one.select(F.lit(False).alias("up"), F.col("object_id").alias("a"), F.col("subject_id").alias("b"), "ord"))
    degrees_ = ways.groupBy("up", F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("ahead"))
    steps = scratch.keep(ways.join(degrees_, ["up", "b"], "left").na.fill(0, ["ahead"]))
    # one row per node that a pair's search has met: its level from either end, and the steps ahead of
    # it at that end, 0 once they are walked
    ends = asked.select("p", F.explode(F.array(F.lit(False), F.lit(True))).alias("down"), "source", "target").select("p", "down", F.explode(F.array(F.struct(F.lit(True).alias("front"), F.col("source").alias("b")), F.struct(F.lit(False).alias("front"), F.col("target").alias("b")))).alias("x")).select("p", "down", "x.*")
    begun = ends.withColumn("up", F.col("front") != F.col("down")).join(degrees_, ["up", "b"], "left").na.fill(0, ["ahead"]).withColumn("level", F.lit(0))
    way = [F.array().cast("array<bigint>").alias("steps"), F.array("b").alias("chain")] if with_chains else []
    met = scratch.keep(_sides(begun.select("p", "down", "front", "b", "level", "ahead", *way), with_chains))
    stood = []
    while True:
        now, n = scratch.keep_counting(_standing(met, with_chains), F.count_if(F.col("up_open") | F.col("down_open")))
        stood.append(now)
        if not n:
            break
        is_open = F.when(F.col("down"), F.col("down_open")).otherwise(F.col("up_open"))
        held = met.join(now.where("up_open or down_open").select("p", "up_open", "down_open", "up_front", "down_front"), "p").withColumns({"open": is_open, "front": F.when(F.col("down"), F.col("down_front")).otherwise(F.col("up_front"))})
        onward = held.where(F.col("open") & (F.when(F.col("front"), F.col("f_ahead")).otherwise(F.col("b_ahead")) > 0))
        way = [F.when(F.col("front"), F.col("f_way")).otherwise(F.col("b_way")).alias("way")] if with_chains else []
        front = scratch.keep(onward.select("p", "down", "front", (F.col("front") != F.col("down")).alias("up"), F.col("node").alias("a"), F.when(F.col("front"), F.col("f")).otherwise(F.col("b")).alias("level"), *way))
        way = [F.when(F.col("front"), F.concat("way.steps", F.array("ord"))).otherwise(F.concat(F.array("ord"), "way.steps")).alias("steps"), F.when(F.col("front"), F.concat("way.chain", F.array("b"))).otherwise(F.concat(F.array("b"), "way.chain")).alias("chain")] if with_chains else []
        tried = front.join(steps, ["up", "a"]).select("p", "down", "front", "b", (F.col("level") + 1).alias("level"), "ahead", *way)
        walked = {"f_ahead": F.when(F.col("open") & F.col("front") & F.col("f_ahead").isNotNull(), 0).otherwise(F.col("f_ahead")), "b_ahead": F.when(F.col("open") & ~F.col("front") & F.col("b_ahead").isNotNull(), 0).otherwise(F.col("b_ahead"))}
        # a pair found down keeps where its ends met while its search up goes on
        old = held.where("open or f + b is not null").withColumns(walked).select(met.columns)
        every = old.unionByName(_sides(tried, with_chains))
        after = scratch.keep(every.groupBy("p", "down", "node").agg(*[F.min(c).alias(c) for c in met.columns if c not in ("p", "down", "node")]))
        scratch.drop(met)
        scratch.drop(front)
        met = after
    found = scratch.again(stood).where("not up_open and not down_open and (up_hops is not null or down_hops is not null)")
    chain = [F.coalesce("up_chain", F.reverse("down_chain")).alias("chain")] if with_chains else []
    return asked.join(found, "p").select("source", "target", F.when(F.col("up_hops").isNotNull(), UP).otherwise(DOWN).alias("direction"), F.coalesce("up_hops", "down_hops").cast("bigint").alias("hops"), *chain)


def _sides(reached: DataFrame, with_chains: bool) -> DataFrame:
    """``reached(p, down, front, b, level, ahead)`` with what belongs to the source's end as ``f`` and to the target's as ``b``."""
    front = F.col("front")
    way = F.struct("level", "steps", "chain") if with_chains else None
    more = [F.when(front, way).alias("f_way"), F.when(~front, way).alias("b_way")] if with_chains else []
    return reached.select("p", "down", F.col("b").alias("node"), F.when(front, F.col("level")).alias("f"), F.when(~front, F.col("level")).alias("b"), F.when(front, F.col("ahead")).alias("f_ahead"), F.when(~front, F.col("ahead")).alias("b_ahead"), *more)


def _standing(met: DataFrame, with_chains: bool) -> DataFrame:
    """How each pair's two searches stand: hops where the ends have met, whether a search goes on, and at which end."""
    hops, sums = F.col("f") + F.col("b"), []
    joined = F.struct(hops.alias("hops"), F.concat("f_way.steps", "b_way.steps").alias("steps"), F.concat("f_way.chain", F.expr("slice(b_way.chain, 2, size(b_way.chain))")).alias("chain")) if with_chains else hops
    for name, of in (("up", ~F.col("down")), ("down", F.col("down"))):
        sums += [F.min(F.when(of & hops.isNotNull(), joined)).alias(f"{name}_best"), *[F.coalesce(F.sum(F.when(of, F.col(f"{x}_ahead"))), F.lit(0)).alias(f"{name}_{x}") for x in "fb"]]
    out = met.groupBy("p").agg(*sums)
    for name in ("up", "down"):
        out = out.withColumns({f"{name}_hops": F.col(f"{name}_best.hops" if with_chains else f"{name}_best"), f"{name}_front": F.col(f"{name}_f") <= F.col(f"{name}_b")})
    more = [F.col(f"{name}_best.chain").alias(f"{name}_chain") for name in ("up", "down")] if with_chains else []
    runs = [F.col("up_hops").isNull() & (F.least(f"{name}_f", f"{name}_b") > 0) for name in ("up", "down")]
    return out.select("p", "up_hops", "down_hops", "up_front", "down_front", runs[0].alias("up_open"), (runs[1] & F.col("down_hops").isNull()).alias("down_open"), *more)


def distances(edges: DataFrame, sources: DataFrame, direction: str = UP) -> DataFrame:
    """``source, node, hops`` of everything each source reaches, itself at 0."""
    scratch = Scratch(edges.sparkSession, "distances")
    steps = oriented(edges, direction).select("a", "b").distinct()
    front = scratch.keep(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).cast("bigint").alias("hops")).distinct())
    seen, level = front, 0
    while True:
        level += 1
        tried = front.join(steps, front.node == steps.a).select("source", F.col("b").alias("node")).distinct()
        front, n = scratch.keep_counting(tried.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(level).cast("bigint")), F.count(F.lit(1)))
        if not n:
            return seen
        seen = seen.unionByName(front)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` for ``nodes(id)`` and the edges' ends, edges taken both ways; named by the smallest id.

    Every round a node takes the smallest name among its neighbours' and then the name that its name
    goes by (pointer jumping), so rounds grow as the logarithm of the widest component. Names are
    folded to a minimum before they travel, whatever a node's degree.
    """
    scratch = Scratch(edges.sparkSession, "components")
    one = edges.where("subject_id is not null and object_id is not null and subject_id <> object_id").select(F.col("subject_id").alias("u"), F.col("object_id").alias("v"))
    both = scratch.keep(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    every = nodes.select("id").unionByName(both.select(F.col("u").alias("id"))).where("id is not null").distinct()
    held = scratch.keep(every.withColumn("name", F.col("id")))
    names = held
    while True:
        heard = both.join(names.select(F.col("id").alias("v"), "name"), "v").groupBy(F.col("u").alias("id")).agg(F.min("name").alias("heard"))
        new = scratch.keep(names.join(heard, "id", "left").select("id", F.col("name").alias("was"), F.least("name", F.coalesce("heard", "name")).alias("name")))
        jump = new.select(F.col("id").alias("name"), F.col("name").alias("to"))
        after, fell = scratch.keep_counting(new.join(jump, "name").select("id", F.col("to").alias("name"), (F.col("to") < F.col("was")).alias("fell")), F.count_if("fell"))
        # a round reads the one before it only
        scratch.drop(new)
        scratch.drop(held)
        held, names = after, after.drop("fell")
        if not fell:
            return names.withColumnRenamed("name", "component")


def component_sizes(named: DataFrame) -> DataFrame:
    """``component, size``; the largest first is a matter of order, not of this table."""
    return named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node and edge counts, components, the largest, isolated nodes. Zeros for an empty graph."""
    sizes = component_sizes(components(nodes, edges))
    ends = edges.select(F.col("subject_id").alias("id")).unionByName(edges.select(F.col("object_id").alias("id"))).distinct()
    n = nodes.select("id").distinct().join(ends.withColumn("e", F.lit(1)), "id", "left").agg(F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("e").isNull()).alias("isolated"))
    c = sizes.agg(F.count(F.lit(1)).alias("component_count"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_component"))
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    return n.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(e)).select("node_count", "edge_count", "component_count", "largest_component", "isolated")  # one row each


def diameter(edges: DataFrame, ids: DataFrame) -> int:
    """The longest shortest path between any two of ``ids(id)``, edges taken both ways; 0 without edges.

    It compares all pairs, so it is for one component of bounded size.
    """
    both = edges.select("subject_id", "object_id", "ord").unionByName(edges.select(F.col("object_id").alias("subject_id"), F.col("subject_id").alias("object_id"), "ord"))
    return distances(both, ids, UP).join(ids.select(F.col("id").alias("node")), "node", "left_semi").agg(F.coalesce(F.max("hops"), F.lit(0))).first()[0]


def most_hops(edges: DataFrame, sources: DataFrame) -> int:
    """The longest directed shortest path from any of ``sources(id)``; 0 without edges."""
    return distances(edges, sources, UP).agg(F.coalesce(F.max("hops"), F.lit(0))).first()[0]


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, out_degree, in_degree, density``: density by what came before: isolated 0, sparse 1-2, connected more."""
    out = edges.groupBy(F.col("subject_id").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    in_ = edges.groupBy(F.col("object_id").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    met = nodes.select("id").distinct().join(out, "id", "left").join(in_, "id", "left").na.fill(0, ["out_degree", "in_degree"])
    return met.withColumn("density", density(F.col("out_degree")))


def density(degree: Column) -> Column:
    return F.when(degree.isNull(), "unknown").when(degree == 0, "isolated").when(degree <= 2, "sparse").otherwise("connected")


def strata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, stratum``: origins (two or more parents), descendants (two or more children), refusal (children only), path (any parent)."""
    d = degrees(nodes, edges)
    rules = [("origins", F.col("out_degree") >= 2), ("descendants", F.col("in_degree") >= 2), ("refusal", (F.col("out_degree") == 0) & (F.col("in_degree") > 0)), ("path", F.col("out_degree") >= 1)]
    return d.select("id", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())).alias("stratum"))


def seeded_walk(edges: DataFrame, starts: DataFrame, seed: int, most: int = 5) -> DataFrame:
    """``start, chain``: from each of ``starts(id)`` up to ``most`` hops, each to the neighbour that a seeded hash puts first; it ends before a node is met again."""
    scratch = Scratch(edges.sparkSession, "walk")
    steps = oriented(edges, UP)
    now = scratch.keep(starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("chain")).distinct())
    for _ in range(most):
        # the choice depends on start and place only, so it is the same in every run
        pick = now.join(steps, now.at == steps.a).groupBy("start").agg(F.min_by("b", F.struct(F.md5(F.concat(F.lit(f"{seed}|"), "start", F.lit("|"), "b")), "b")).alias("next"))
        moved = now.join(pick, "start", "left")
        going = F.col("next").isNotNull() & ~F.array_contains("chain", F.coalesce("next", F.lit("")))
        now = scratch.keep(moved.select("start", F.when(going, F.col("next")).alias("at"), F.when(going, F.concat("chain", F.array("next"))).otherwise(F.col("chain")).alias("chain")))
    return now.select("start", "chain")


def type_closure(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``id`` of everything at or below ``roots(id)`` by ``links(child, parent)``, loops allowed."""
    as_edges = links.select(F.col("child").alias("subject_id"), F.col("parent").alias("object_id"), F.lit(0).cast("bigint").alias("ord"))
    marked = distances(as_edges, roots.select("id"), DOWN)
    return marked.select(F.col("node").alias("id")).distinct()


def chain_breaks(chains: DataFrame, approved: DataFrame) -> DataFrame:
    """``chain_id, pos, a, b``: consecutive pairs of ``chains(chain_id, chain)`` that are no approved edge. A whole chain is admissible when it has none."""
    pairs = chains.select("chain_id", F.posexplode(F.arrays_zip(F.expr("slice(chain, 1, greatest(size(chain) - 1, 0))").alias("a"), F.expr("slice(chain, 2, greatest(size(chain) - 1, 0))").alias("b"))).alias("pos", "x")).select("chain_id", "pos", "x.a", "x.b")
    return pairs.join(approved.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")).distinct(), ["a", "b"], "left_anti").select("chain_id", "pos", "a", "b")


def reaches(claims: DataFrame) -> DataFrame:
    """``run_id, descendant, ancestor, hops`` of every two nodes that a run's ``claims(run_id, subject_id, object_id)`` connect, at any depth from 1.

    A claim steps from subject to object; a node doesn't reach itself. All runs advance together, a
    level a round, each within its own claims. The result is one row per pair that a run reaches.
    """
    scratch = Scratch(claims.sparkSession, "reaches")
    steps = scratch.keep(claims.where("subject_id is not null and object_id is not null and subject_id <> object_id").select("run_id", F.col("subject_id").alias("a"), F.col("object_id").alias("b")).distinct())
    front, n = scratch.keep_counting(steps.select("run_id", F.col("a").alias("descendant"), F.col("b").alias("ancestor"), F.lit(1).cast("bigint").alias("hops")), F.count(F.lit(1)))
    seen, key = front, ["run_id", "descendant", "ancestor"]
    level = 1
    while n:
        level += 1
        tried = front.join(steps.withColumnRenamed("a", "ancestor"), ["run_id", "ancestor"]).where("descendant <> b").select("run_id", "descendant", F.col("b").alias("ancestor")).distinct()
        front, n = scratch.keep_counting(tried.join(seen, key, "left_anti").withColumn("hops", F.lit(level).cast("bigint")), F.count(F.lit(1)))
        seen = seen.unionByName(front)
    return seen
