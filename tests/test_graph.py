import random
from collections import deque

import pytest

from tracewell.operators import graph

E = "subject_id string, object_id string, ord bigint"


def edges(spark, rows):
    return spark.createDataFrame([(s, o, i) for i, (s, o) in enumerate(rows)], E)


def ids(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "id string")


def bfs(rows, start):
    """First-found paths, edges tried in order."""
    out, todo = {start: []}, deque([start])
    while todo:
        at = todo.popleft()
        for i, (s, o) in enumerate(rows):
            if s == at and o not in out:
                out[o] = [*out[at], i]
                todo.append(o)
    return {k: v for k, v in out.items() if k != start}


@pytest.mark.parametrize("seed", range(6))
def test_paths_equal_an_ordered_search(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    rows = [(r.choice(nodes), r.choice(nodes)) for _ in range(30)]
    got = {(p["source"], p["target"]): list(p["steps"]) for p in graph.shortest_paths(edges(spark, rows), ids(spark, nodes)).collect()}
    assert got == {(s, t): p for s in nodes for t, p in bfs(rows, s).items()}


def test_trace_goes_up_then_down(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("x", "c")])
    pairs = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "x"), ("a", "a"), ("a", None), ("zz", "a")], "source string, target string")
    assert sorted((r["source"], r["target"], r["direction"], r["hops"], list(r["chain"])) for r in graph.trace(e, pairs).collect()) == [("a", "c", "up", 2, ["a", "b", "c"]), ("c", "a", "down", 2, ["a", "b", "c"])]


@pytest.mark.parametrize("seed", range(4))
def test_traces_equal_ordered_searches(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(24)]
    rows = [(r.choice(nodes), r.choice(nodes)) for _ in range(34)] + [(f"n{i:02}", f"n{i + 1:02}") for i in range(9)]
    asked = [(s, t) for s in nodes for t in nodes if s != t]
    up, down = {s: bfs(rows, s) for s in nodes}, {s: bfs([(b, a) for a, b in rows], s) for s in nodes}
    want = {}
    for s, t in asked:
        if t in up[s]:
            want[s, t] = ("up", len(up[s][t]), [s, *(rows[i][1] for i in up[s][t])])
        elif t in down[s]:
            want[s, t] = ("down", len(down[s][t]), [*(rows[i][0] for i in reversed(down[s][t])), s])
    pairs = spark.createDataFrame(asked, "source string, target string")
    e = edges(spark, rows)
    assert {(x["source"], x["target"]): (x["direction"], x["hops"], list(x["chain"])) for x in graph.trace(e, pairs).collect()} == want
    bare = graph.trace(e, pairs, with_chains=False)
    assert {(x["source"], x["target"]): (x["direction"], x["hops"]) for x in bare.collect()} == {k: v[:2] for k, v in want.items()}


def test_a_trace_reads_its_edges_once_however_deep(spark):
    def plan(length):
        e = edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(length)])
        pairs = spark.createDataFrame([("n0", f"n{length}"), ("n1", "n0"), ("n0", "x")], "source string, target string")
        got = graph.trace(e, pairs)
        assert sorted((r["source"], r["direction"], r["hops"]) for r in got.collect()) == [("n0", "up", length), ("n1", "down", 1)]
        return got._jdf.queryExecution().analyzed().toString().count("\n")

    assert plan(9) == plan(2)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i:03}" for i in range(90)]
    rows = [(r.choice(nodes), r.choice(nodes)) for _ in range(60)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    name = {n: n for n in [*nodes, *[x for e in rows for x in e]]}
    changed = True
    while changed:
        changed = False
        for s, o in rows:
            low = min(name[s], name[o])
            if name[s] != low or name[o] != low:
                name[s] = name[o] = low
                changed = True
    assert {r["id"]: r["component"] for r in graph.components(ids(spark, nodes), edges(spark, rows)).collect()} == name


def test_structure_of_small_and_empty_graphs(spark):
    one = graph.structure(ids(spark, ["a", "b", "c", "z"]), edges(spark, [("a", "b"), ("b", "c"), ("a", "b")])).first()
    assert one.asDict() == {"node_count": 4, "edge_count": 3, "component_count": 2, "largest_component": 3, "isolated": 1}
    none = graph.structure(ids(spark, []), edges(spark, [])).first()
    assert set(none.asDict().values()) == {0}


def test_diameter_and_hops(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("x", "c")])
    assert graph.diameter(e, ids(spark, ["a", "b", "c", "x"])) == 3 and graph.most_hops(e, ids(spark, ["a", "x"])) == 2
    assert graph.diameter(edges(spark, []), ids(spark, [])) == 0


def test_labels_fall_back_to_ids(spark):
    n = spark.createDataFrame([("a", "A"), ("b", None)], "id string, label string")
    got = graph.labelled(spark.createDataFrame([("a", "b"), ("q", None)], "subject_id string, object_id string"), n).collect()
    assert sorted((r["subject_label"], r["object_label"]) for r in got if r["object_id"]) == [("A", "b")]
    assert [r["subject_label"] for r in got if not r["object_id"]] == ["q"]


def test_closure_and_walk_end_on_loops(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("z", "y")], "child string, parent string")
    assert sorted(r["id"] for r in graph.type_closure(links, ids(spark, ["a"])).collect()) == ["a", "b", "c"]
    loop = edges(spark, [("a", "b"), ("b", "a")])
    assert [list(r["chain"]) for r in graph.seeded_walk(loop, ids(spark, ["a"]), 1).collect()] == [["a", "b"]]


def test_chains(spark):
    c = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, []), (4, None)], "chain_id int, chain array<string>")
    got = graph.chain_breaks(c, edges(spark, [("a", "b")])).collect()
    assert [(r["chain_id"], r["pos"], r["a"], r["b"]) for r in got] == [(1, 1, "b", "c")]


def test_strata(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("d", "b")])
    got = sorted((r["id"], r["stratum"]) for r in graph.strata(ids(spark, list("abcdz")), e).collect())
    assert got == [("a", "origins"), ("a", "path"), ("b", "descendants"), ("b", "refusal"), ("c", "refusal"), ("d", "path")]
