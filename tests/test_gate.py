from tracewell.operators import corpus, gate

P = "http://x/statement/"


def run(spark, proposals, nodes, edges):
    p = spark.createDataFrame(proposals, "run_id int, ord int, subject_id string, predicate string, object_id string")
    n = spark.createDataFrame(nodes, "id string, kind string, ord int")
    e = spark.createDataFrame(edges, "subject_id string, predicate string, object_id string, source_id string, verification string, ord int")
    return {(r["run_id"], r["ord"]): (r["status"], r["reason"], r["source_id"], r["verification"]) for r in gate.gated(p, n, e, P).collect()}


def test_every_reason_in_order_of_precedence(spark):
    nodes = [("A", "genre", 1), ("B", "genre", 2), ("Z", "artist", 3), ("A", "artist", 9)]
    edges = [("A", "influenced_by", "B", P + "a-1", "HAND", 1), ("A", "influenced_by", "B", P + "a-2", "PROSE_AUTO", 2), ("B", "influenced_by", "A", P + "zz-1", "HAND", 3)]
    asked = [("A", "influenced_by", "B"), ("A", "influenced_by", "B"), ("A", "likes", "Q"), ("Q", "influenced_by", "Q2"), ("A", "influenced_by", "Q"), ("A", "influenced_by", "Z"), ("B", "influenced_by", "B"), ("B", "influenced_by", "A"), ("Q", "influenced_by", "Q2"), (None, None, None)]
    got = run(spark, [(1, i, *a) for i, a in enumerate(asked)] + [(2, 0, *asked[0])], nodes, edges)
    assert [got[(1, i)][1] for i in range(10)] == [None, "duplicate", "unsupported_predicate", "unknown_subject", "unknown_object", "cross_axis", "not_in_graph", "unresolvable_source", "duplicate", "unsupported_predicate"]
    assert got[(1, 0)] == ("approved", None, P + "a-1", "HAND") and got[(2, 0)][0] == "approved"


def test_nothing_proposed(spark):
    assert run(spark, [], [], []) == {}


def test_grounding_and_citations(spark):
    e = spark.createDataFrame([("A", "p", "B", "u1"), ("A", "p", "B", "u2")], "subject_id string, predicate string, object_id string, source_id string")
    c = spark.createDataFrame([(1, "A", "p", "B", ["u1"]), (2, "A", "p", "B", ["u1", "u9"]), (3, "A", "p", "C", []), (4, "A", "p", "B", None), (5, None, None, None, ["u1"])], "i int, subject_id string, predicate string, object_id string, source_ids array<string>")
    assert {r["i"]: r["is_grounded"] for r in gate.grounded(c, e).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    d = spark.createDataFrame([(["http://x/statement/A-1"], "A"), ([], "A"), (None, "A"), (["http://x/statement/B-1"], "A"), ([None], "A")], "s array<string>, i string")
    assert [r[0] for r in d.select(gate.citations_resolve(d.s, d.i, P)).collect()] == [True, False, False, False, False]


def test_rates_are_undefined_without_a_denominator(spark):
    one = gate.refusals(spark.createDataFrame([(True, True), (False, True), (None, True)], "refused boolean, expected boolean")).first()
    assert (one["true_refusals"], one["missed_refusals"], one["true_refusal_rate"], one["false_refusal_rate"]) == (1, 1, 0.5, None)


def test_traversal_counts_sets(spark):
    c = spark.createDataFrame([(1, "s", "a"), (1, "s", "a"), (1, "s", "x"), (1, "s", None), (1, "lone", "a"), (1, None, "a"), (2, "s", None)], "run_id int, subject_id string, object_id string")
    e = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "b"), ("s", None), ("other", "a")], "subject_id string, object_id string")
    assert {tuple(r) for r in gate.traversal(c, e).collect()} == {(1, "s", 1, 2, 2), (1, "lone", 0, 0, 0), (2, "s", 0, 2, 0)}
    assert gate.traversal(c.limit(0), e).count() == 0


def test_resistance(spark):
    t = "case_id string, subject_id string, predicate string, object_id string"
    f = spark.createDataFrame([("c1", "a", "p", "b")], t)
    cases = spark.createDataFrame([("c1",), ("c2",)], "case_id string")
    assert gate.resistance(gate.breaches(spark.createDataFrame([("c1", "a", "p", "b"), ("c2", "a", "p", "b")], t), f), cases, f).first().asDict() == {"induced": 1, "scored_cases": 1, "unscored_cases": 1, "holds": False}
    none = spark.createDataFrame([], t)
    assert gate.resistance(gate.breaches(none, none), cases, none).first()["holds"] is None


def test_merge_keeps_first_nodes_and_last_edges(spark):
    n = "id string, kind string, ord int"
    a, b = spark.createDataFrame([("x", "genre", 5), ("x", "genre", 2)], n), spark.createDataFrame([("x", "artist", 1), ("y", "artist", 1)], n)
    assert sorted(tuple(r) for r in corpus.merge_nodes(a, b).collect()) == [("x", "genre", 2), ("y", "artist", 1)]
    assert [tuple(r) for r in corpus.kind_conflicts(a, b).collect()] == [("x", "artist,genre")]
    e = "subject_id string, predicate string, object_id string, v string, ord int"
    c, d = spark.createDataFrame([("s", "p", "o", "first", 9)], e), spark.createDataFrame([("s", "p", "o", "last", 1)], e)
    assert [r["v"] for r in corpus.merge_edges(c, d).collect()] == ["last"]


def test_constraints(spark):
    n = spark.createDataFrame([("i", "l", "s", "u", "t", "genre", 1), (" ", None, "s", "u", "t", "pet", 2)], "id string, label string, source string, source_id string, retrieved_at string, kind string, ord int")
    assert sorted(r["rule"] for r in corpus.node_violations(n).collect()) == ["blank id", "blank label", "unknown kind"]


def test_overrides(spark):
    p = "subject_id string, object_id string"
    auto, hand, no = (spark.createDataFrame(x, p) for x in ([("a", "b"), ("a", "c"), ("a", "b")], [("a", "b"), ("q", "r")], [("a", "c"), ("q", "r")]))
    assert sorted(tuple(r) for r in corpus.overridden(auto, hand, no).collect()) == [("a", "b", "hand"), ("q", "r", "contradicted")]
    assert [tuple(r) for r in corpus.overruled(auto, no).collect()] == [("a", "c")]


def test_facts_and_enrichment(spark):
    f = corpus.fold_facts(spark.createDataFrame([("g", None, 9, "B", 1), ("g", 1950, 8, "A", 2), ("g", 1960, 9, "B", 3), ("h", None, None, None, 1)], "id string, year int, precision int, country string, ord int"))
    assert {r["id"]: (r["year"], r["precision"], r["countries"]) for r in f.collect()} == {"g": (1950, 8, ["A", "B"]), "h": (None, None, [])}
    n = spark.createDataFrame([("g", "genre", 1, 9, ["Z"]), ("a", "artist", 1, 9, ["Z"]), ("k", "genre", 1, 9, ["Z"])], "id string, kind string, inception_year int, inception_precision int, countries array<string>")
    assert {r["id"]: (r["inception_year"], r["countries"]) for r in corpus.enrich(n, f.unionByName(f.where("false"))).collect()} == {"g": (1950, ["A", "B"]), "a": (1, ["Z"]), "k": (1, ["Z"])}


def test_coverage_of_places(spark):
    ddl = "id string, kind string, inception_year int, inception_precision int, countries array<string>, ord int"
    n = spark.createDataFrame([("a", "genre", 1899, 7, ["Brixton", "France"], 2), ("b", "genre", None, None, ["Ghana"], 1), ("c", "genre", -50, 9, [], 3), ("d", "genre", 2010, 8, None, 4), ("e", "artist", 1, 7, ["Ghana"], 0)], ddl)
    assert corpus.coverage(n).first().asDict() == {"genres": 4, "without_inception": 1, "without_country": 2, "coarser_than_year": 2, "genres_without_us_or_uk": 1, "distinct_countries": 3, "top_country": "Ghana", "top_country_share": 0.5}
    assert {r["era"]: r["n"] for r in corpus.eras(n).collect() if r["n"]} == {"pre-1900": 2, "2010-": 1, "unknown": 1}
    empty = corpus.coverage(n.where("false")).first()
    assert empty["genres"] == 0 and empty["top_country"] is None and corpus.eras(n.where("false")).count() == 7


def test_batches(spark):
    df = corpus.batches(spark.createDataFrame([(f"k{i:03}",) for i in range(101)], "id string"), "id")
    assert sorted((r["id"], r["batch"]) for r in df.collect()) == [(f"k{i:03}", i // 40) for i in range(101)]
