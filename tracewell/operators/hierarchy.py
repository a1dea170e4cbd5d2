"""Parent-child rows turned into full hierarchies.

Splitters are chosen by a hash of the id. Every node is walked to the next splitter or root above
it, the splitters' own pointers form a reduced graph that is solved the same way down to the roots,
and a node's answer is its own segment followed by its splitter's. Walks double their stride each
round, so a segment of length L takes log2(L) rounds. Loops that hold a splitter are loops of the
reduced graph and are solved there. Nodes whose walk never ends lie on a loop without a splitter or
below nothing but one; only these are solved apart, by where a long enough walk lands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .skew import even_lookup

SPLITTER_EVERY = 8  # one node in so many is a splitter
HUB = 64  # a node of so many children is a splitter, too
LOOP, INTO_LOOP = -1, -2


def is_splitter(node: Column, every: int = SPLITTER_EVERY) -> Column:
    return F.pmod(F.xxhash64(node, F.lit("splitter")), F.lit(every)) == 0


def hierarchy(links: DataFrame, every: int = SPLITTER_EVERY, with_paths: bool = True) -> DataFrame:
    """``node, root, depth, path`` for each node of ``links(child, parent)``.

    ``path`` runs from the root to the node. For a node on a loop ``depth`` is -1 and ``root`` the
    loop's smallest id; for one whose ancestors lead into a loop, -2 and that loop's smallest id;
    both have a null path. Rows with a null or blank end are ignored, repeated rows count once, and
    of several parents of a child the smallest counts (``further_parents`` gives the others). An
    empty input gives an empty result.

    Each round is one equi-join of the unended walks with the pointers and is written to the shared
    folder, so rounds neither recompute each other nor are lost with an executor. A node of many
    children is a splitter, so its children's walks end there and no round has it as a hot key; where
    walks meet their splitter's answer, those of a hot one are dealt to several tasks.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    ends = _ends(links)
    parents = ends.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent"))
    tops = ends.select(F.col("parent").alias("node")).distinct().join(parents, "node", "left_anti").withColumn("parent", F.lit(None).cast("string"))
    hubs = ends.distinct().groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_kids")).where(F.col("_kids") >= HUB)
    marks = parents.unionByName(tops).join(hubs, "node", "left").withColumn("splits", is_splitter(F.col("node"), every) | F.col("_kids").isNotNull()).drop("_kids")
    pointers = scratch.keep(marks)
    stop = F.col("parent").isNull() | F.col("splits")
    none = F.array().cast("array<string>")
    # a walk ends at a root or at a splitter; a root's own walk has ended where it began
    walk = pointers.select(
        "node",
        F.coalesce("parent", "node").alias("at"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
        F.coalesce("parent", "node").alias("low"),
        F.when(F.col("parent").isNull(), none).otherwise(F.array("parent")).alias("path"),
    )
    stops = pointers.where(stop).select(F.col("node").alias("at"), F.lit(True).alias("ended"))
    ended, unended = _walk_on(scratch, _marked(walk, stops), True)  # segments are short: their nodes are kept
    # the reduced graph: splitters and roots, each pointing to the next one above. A splitter with no
    # stop above stands below a loop without a splitter; there the reduced walk ends, too
    nodes = pointers.where(stop).select("node")
    in_place = unended.join(nodes, "node", "left_semi").select("node", F.col("node").alias("at"), F.lit(0).cast("bigint").alias("dist"), F.col("node").alias("low"), none.alias("path"))
    reduced = scratch.keep(ended.join(nodes, "node", "left_semi").drop("ended").unionByName(in_place))
    sinks = unended.join(nodes, "node", "left_semi").select(F.col("node").alias("at"), F.lit(True).alias("ended"))
    tops_at = pointers.where(F.col("parent").isNull()).select(F.col("node").alias("at"), F.lit(True).alias("ended"))
    onward = reduced if with_paths else reduced.drop("path")
    solved, circling = _walk_on(scratch, _marked(onward, tops_at.unionByName(sinks)), with_paths)
    start, n = scratch.keep_counting(_unsolved(pointers, unended, circling, reduced), F.count(F.lit(1)))
    more = ["path"] if with_paths else []
    top = solved.select("node", F.col("at").alias("root"), "dist", *more)
    if not n:
        answers, apart, on = top.withColumn("lost", F.lit(False)), None, None
    else:
        # the two graphs share no node, so their loops are solved in the same rounds
        looped = scratch.keep(_loops(scratch, start.drop("reduced")).join(start.select("node", "reduced"), "node"))
        apart, ring = looped.where("not reduced").drop("reduced"), looped.where("reduced")
        # the nodes between two splitters of a loop are those of the first one's segment
        segments = ring.where(F.col("depth") == LOOP).select("node", "root").join(reduced.select("node", "path"), "node")
        on = scratch.keep(segments.select(F.explode("path").alias("node"), "root").distinct())
        into = top.join(apart.select(F.col("node").alias("root"), F.col("root").alias("loop")), "root", "left")
        lost = F.col("loop").isNotNull()
        answers = into.select("node", F.coalesce("loop", "root").alias("root"), "dist", *more, lost.alias("lost"))
        bare = ring.select("node", "root", F.lit(0).cast("bigint").alias("dist"), *([none.alias("path")] if with_paths else []), F.lit(True).alias("lost"))
        answers = scratch.keep(answers.unionByName(bare))
    # every node takes its splitter's answer; of these rows many may stand at one splitter
    above = answers.select(F.col("node").alias("at"), "root", F.col("dist").alias("more"), "lost", *([F.col("path").alias("above")] if with_paths else []))
    met = even_lookup(ended.drop("ended", "low", *([] if with_paths else ["path"])), above, "at")
    depth = F.when(F.col("lost"), F.lit(INTO_LOOP).cast("bigint")).otherwise(F.col("dist") + F.col("more")).alias("depth")
    path = [F.when(~F.col("lost"), F.reverse(F.concat(F.array("node"), "path", "above"))).alias("path")] if with_paths else []
    out = met.select("node", "root", depth, *path)
    if on is None:
        return out
    ends_ = apart.unionByName(on.withColumn("depth", F.lit(LOOP).cast("bigint")))
    if with_paths:
        ends_ = ends_.withColumn("path", F.lit(None).cast("array<string>"))
    return out.join(on.select("node"), "node", "left_anti").unionByName(ends_)


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent")).where("trim(child) <> '' and trim(parent) <> ''")


def further_parents(links: DataFrame) -> DataFrame:
    """``child, parent`` of the links that ``hierarchy`` doesn't follow: all parents of a child but the smallest."""
    ends = _ends(links).distinct()
    first = ends.groupBy("child").agg(F.min("parent").alias("first"))
    return ends.join(first, "child").where("parent <> first").select("child", "parent")


def _unsolved(pointers: DataFrame, unended: DataFrame, circling: DataFrame, reduced: DataFrame) -> DataFrame:
    """``node, at, low, reduced``: the pointers of nodes whose walk never ends, and the reduced graph's pointers of splitters whose walk never ends.

    The first lie on loops without a splitter or lead into one, the second on or into loops with one;
    a reduced pointer knows the least id on its way.
    """
    bare = unended.select("node").join(pointers, "node").select("node", F.col("parent").alias("at"), F.least("node", "parent").alias("low"), F.lit(False).alias("reduced"))
    return bare.unionByName(circling.select("node").join(reduced, "node").select("node", "at", "low", F.lit(True).alias("reduced")))


def _marked(walk: DataFrame, stops: DataFrame) -> DataFrame:
    return walk.join(stops, "at", "left").withColumn("ended", F.coalesce("ended", F.lit(False)))


def _walk_on(scratch: Scratch, walk: DataFrame, with_paths: bool) -> tuple[DataFrame, DataFrame]:
    """Doubles the stride of all unended walks until a round ends none of them: (ended, never ending).

    Distances to the next stop have no gaps along a walk, so a round that ends nothing shows that
    what remains never ends. ``path`` holds the nodes after the start up to ``at``, ``low`` is the
    least of these.
    """
    walk, n = scratch.keep_counting(walk, F.count_if(~F.col("ended")))
    done, left = [walk.where("ended")], walk.where("not ended")
    while n:
        # a step goes on from any node: from one whose walk has ended, too
        steps = _union([*done, left])
        to = steps.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("dist").alias("more"), F.col("low").alias("lower"), *([F.col("path").alias("further")] if with_paths else []), "ended")
        step = left.drop("ended").join(to, "at").select(
            "node", F.col("to").alias("at"), (F.col("dist") + F.col("more")).alias("dist"), F.least("low", "lower").alias("low"), *([F.concat("path", "further").alias("path")] if with_paths else []), "ended"
        )
        before = n
        moved, n = scratch.keep_counting(step, F.count_if(~F.col("ended")))
        done.append(moved.where("ended"))
        left = moved.where("not ended")
        if n == before:
            break
    return _union(done), left


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _loops(scratch: Scratch, walk: DataFrame) -> DataFrame:
    """Nodes on loops and nodes above which there is only a loop: ``node, root, depth``.

    ``walk(node, at, low)``: nodes whose ancestors never end, one step on, and the least id passed.
    Strides double until the nodes stood on are no fewer than the round before, which shows that
    only loop nodes are left, and no least id has changed, which shows that whole loops were passed.
    """
    stood, last = None, None
    while True:
        to = walk.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("low").alias("low2"))
        step = walk.join(to, "at").select("node", F.col("to").alias("at"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("fell"))
        moved, fell = scratch.keep_counting(step, F.count_if("fell"))
        was, stood = stood, None if fell else moved.select("at").distinct().count()
        if last is not None:
            scratch.drop(last)
        last, walk = moved, moved.drop("fell")
        if not fell and stood == was:
            break
    on = walk.join(walk.select(F.col("at").alias("node")).distinct(), "node", "left_semi").select("node", F.col("low").alias("root"))
    into = walk.join(on.select("node"), "node", "left_anti").join(on.select(F.col("node").alias("at"), "root"), "at").select("node", "root")
    return on.withColumn("depth", F.lit(LOOP).cast("bigint")).unionByName(into.withColumn("depth", F.lit(INTO_LOOP).cast("bigint")))


def descendants(tree: DataFrame) -> DataFrame:
    """``ancestor, node, distance`` for each node and each of its proper ancestors, from ``hierarchy`` with paths.

    Nodes on or below loops have no path and give no rows. The result has as many rows as the
    depths add up to; it is made without a shuffle.
    """
    up = tree.where("path is not null").select("node", "depth", F.posexplode("path").alias("pos", "ancestor"))
    return up.where("pos < depth").select("ancestor", "node", (F.col("depth") - F.col("pos")).cast("bigint").alias("distance"))
