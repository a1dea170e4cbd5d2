import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tracewell.operators import gates, graph, ordered, selection, stats
from tracewell.streaming import events as ev


def test_bounds_are_read_or_refused(spark, tmp_path):
    assert gates.read_bounds(spark, str(tmp_path / "none.json")) is None
    good = {"sets": [{"name": "a", "applies_to": {"dataset": "d", "provider": "p"}, "case_count": 3, "bounds": {"g": {"minimum": 0.5}}}] * 2}
    for i, text in enumerate(["{", "[]", '{"sets": []}', json.dumps({"sets": [{"name": "a"}]}), json.dumps({"sets": [good["sets"][0] | {"bounds": {"g": {"minimum": "x"}}}]})]):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        with pytest.raises(gates.MalformedBounds):
            gates.read_bounds(spark, str(path))
    (tmp_path / "good.json").write_text(json.dumps(good))
    sets = gates.read_bounds(spark, str(tmp_path / "good.json"))
    runs = spark.createDataFrame([("r", "d", "p"), ("s", "d", None), ("t", None, None)], "run_id string, dataset string, provider string")
    got = {r["run_id"]: (r["set_name"], r["m"]) for r in gates.with_bounds(runs, sets).withColumn("m", gates.bound("g", "minimum")).collect()}
    assert got == {"r": ("a", 0.5), "s": (None, None), "t": (None, None)}


def test_gates_pass_fail_or_do_not_apply(spark):
    b = {"refusal_accuracy": {"expected_refusals": 3.0, "expected_answers": 2.0, "minimum_true_refusals": 2.0, "maximum_false_refusals": 0.0}, "injection_resistance": {"minimum_scored_cases": 2.0, "maximum_induced": 0.0}}
    rows = [(1, 2, 0, 3, 2, 0, 2, b), (2, 1, 0, 3, 2, 1, 2, b), (3, 3, 0, 4, 2, 0, 0, b), (4, 3, 0, 3, 2, 0, 1, b), (5, 3, 0, 3, 2, 0, 5, None), (6, 2, 1, 3, 2, 0, 2, {})]
    d = spark.createDataFrame(rows, "k int, t int, f int, er int, ea int, induced int, scored int, bounds map<string,map<string,double>>")
    got = {r[0]: (r[1], r[2]) for r in d.select("k", gates.refusal_gate(d.t, d.f, d.er, d.ea), gates.injection_gate(d.induced, d.scored)).collect()}
    assert got == {1: ("PASS", "PASS"), 2: ("FAIL", "FAIL"), 3: ("N/A", "N/A"), 4: ("PASS", "FAIL"), 5: ("N/A", "N/A"), 6: ("N/A", "N/A")}


def test_required_cases_missing_undefined_and_regressed(spark):
    required = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "b"), ("r", "c"), ("s", "a"), ("x", "a")], "run_id string, case_id string")
    results = spark.createDataFrame([("r", "a", 1.0), ("r", "a", 0.5), ("r", "b", None), ("s", "a", 1.0), ("s", "z", 0.0)], "run_id string, case_id string, recall double")
    got = {r[0]: tuple(r)[1:] for r in gates.required_cases(required, results, 1.0, spark.createDataFrame([("x",)], "run_id string")).collect()}
    assert got == {"r": (3, 1, 2, "FAIL"), "s": (1, 0, 0, "PASS"), "x": (1, 1, 0, "N/A")}


def test_a_report_blocks_only_gated_runs(spark):
    v = spark.createDataFrame([("r", "PASS", "s"), ("r", "FAIL", "s"), ("q", "FAIL", None), ("p", "N/A", "s")], "run_id string, verdict string, set_name string")
    got = {r["run_id"]: (r["n_fail"], r["banner"], r["blocks"]) for r in gates.reported(v, F.when(F.col("set_name").isNull(), "no set")).collect()}
    assert got == {"r": (1, None, True), "q": (1, "NOT GATED: no set", False), "p": (0, None, False)}


def test_tolerances(spark):
    values = spark.createDataFrame([("m", f"r{i}", 0.1 * i) for i in range(6)] + [("u", f"r{i}", None) for i in range(6)] + [("few", "r", 1.0)], "metric string, run_id string, value double")
    got = {r["metric"]: (r["tolerance"], r["provisional"], r["wider"]) for r in gates.tolerances(stats.spread(values), 5, 0.2).collect()}
    assert got == {"m": (0.5, None, True), "u": (None, "undefined in every run", False), "few": (None, "too few runs", False)}


def test_edges_are_built_or_not(spark):
    e = spark.createDataFrame([("Q1", "Q2", "s/Q1-a", "PROSE", 1), ("Q1", "Q2", "s/Q9-a", "PROSE", 2), ("Q1", "Q2", "s/Q1-a", None, 3), ("Q1", "Q3", "s/Q1-a", "PROSE", 4), ("Q1", "Q4", None, "NONE", 5)], "subject_id string, object_id string, source_id string, prose_tier string, ord int")
    n = spark.createDataFrame([("Q1", "one", 1), ("Q2", "two", 1), ("Q3", " ", 1)], "id string, label string, ord int")
    got = selection.build_reasons(e, n, "s/")
    assert {r["ord"]: r["reason_code"] for r in got.collect()} == {1: None, 2: "UNCITABLE", 3: "NONE", 4: "NO_LABEL", 5: "NONE"}
    assert {r["id"] for r in selection.ends_of(got.where("reason_code is null")).collect()} == {"Q1", "Q2"}
    assert [r["ord"] for r in selection.first_kept(got, F.col("reason_code").isNotNull(), ["ord"], 2).collect()] == [2, 3]


def test_guards_and_choices(spark):
    d = spark.createDataFrame([("HeldOut_v1",), ("my-sealed",), ("live",), (None,)], "x string")
    assert [r[0] for r in d.select(selection.is_sealed(d.x)).collect()] == [True, True, False, False]
    v = spark.createDataFrame([("abc",), ("abc-dirty",), ("unknown",), (" ",), (None,)], "x string")
    assert [r[0] for r in v.select(selection.is_pinnable(v.x)).collect()] == [True, False, False, False, False]
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    assert [r["case_id"] for r in selection.chosen(cases, ["c", "a", "c"]).orderBy("place").collect()] == ["c", "a"]
    with pytest.raises(ValueError, match="unknown"):
        selection.chosen(cases, ["a", "zz"])


def test_draws_pools_and_unlabelled(spark):
    s = spark.createDataFrame([(f"n{i}", "x") for i in range(9)] + [(f"n{i}", "y") for i in range(4)], "id string, stratum string")
    got = [(r["id"], r["stratum"]) for r in selection.drawn(s, {"y": 2, "x": 3}, 1).collect()]
    assert len({i for i, _ in got}) == 5 and sum(t == "y" for _, t in got) == 2
    with pytest.raises(ValueError, match="too few"):
        selection.drawn(s, {"y": 4, "x": 9}, 1)
    items = spark.createDataFrame([(i, "g" if i % 2 else None, i % 3) for i in range(10)], "k bigint, grp string, n_claims int")
    p = selection.pool(items, "k", "grp", 3, 1).collect()
    assert len(p) == 6 and all((r["focus"] is None) == (r["k"] % 3 == 0) for r in p)
    left = selection.unlabelled(spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "k string, ord int"), spark.createDataFrame([("b",), ("b",)], "k string"), "k")
    assert {(r["k"], r["is_next"]) for r in left.collect()} == {("a", False), ("c", True)}


def test_audit_judgement_divergence_and_years(spark):
    e = spark.createDataFrame([("c1", "Q1", False), ("c2", "Q2", False), ("c3", "Q1", True), ("c4", "Q9", True), ("c5", None, True), ("c6", "Q1", None)], "case_id string, node_id string, refusal boolean")
    h = spark.createDataFrame([("Q1", 2), ("Q2", 0), ("Q3", 1), ("Q4", 0)], "node_id string, n_edges bigint")
    assert {(r["case_id"], r["finding"]) for r in selection.audited(e, h).collect()} == {("c2", "REFUSAL_FLIP"), ("c3", "REFUSAL_FLIP"), ("c4", "UNRESOLVED"), (None, "NO_CASE")}
    t = ['x {"citation_support": " supported", "narrative_quality": 5} y', '{"citation_support": "no", "narrative_quality": 5}', '{"citation_support": "OVERSTATED", "narrative_quality": 6}', "{", "", None]
    j = [tuple(r[0]) for r in spark.createDataFrame([(x,) for x in t], "t string").select(selection.judgement(F.col("t"))).collect()]
    assert j == [("SUPPORTED", 5, None), (None, None, "support"), (None, None, "quality"), *[(None, None, "no object")] * 3]
    d = selection.divergences(spark.createDataFrame([(1, 3), (2, 2), (4, 2), (None, 1)], "planned int, executed int"))
    assert {(r["divergence"], r["n"], r["adhered"]) for r in d.collect()} == {(2, 1, False), (0, 1, True), (-2, 1, False), (None, 1, None)}
    y = spark.createDataFrame([("1999-01",), ("-0044-03-15",), ("+12020-1",), ("x",), ("",), (None,)], "x string")
    assert [r[0] for r in y.select(selection.leading_year(y.x)).collect()] == [1999, -44, 12020, None, None, None]


def test_reaching_within_a_run(spark):
    c = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "x", "x"), (2, "b", "d"), (2, None, "d"), (1, "a", "b")], "run_id int, subject_id string, object_id string")
    assert {tuple(r) for r in graph.reaches(c).select("run_id", "descendant", "ancestor", "hops").collect()} == {(1, "a", "b", 1), (1, "b", "c", 1), (1, "c", "a", 1), (1, "a", "c", 2), (1, "b", "a", 2), (1, "c", "b", 2), (2, "b", "d", 1)}
    assert graph.reaches(c.limit(0)).count() == 0


def test_values_and_case_sets_that_differ(spark):
    r = spark.createDataFrame([("r", "m", "x", "c1"), ("s", "m", None, "c1"), ("s", "m", "y", "c2"), ("t", "m", "y", "c2"), ("t", "m", "y", "c1"), ("t", "m", "y", None)], "run_id string, a string, b string, case_id string")
    assert {tuple(x) for x in stats.incomparable(r, ["a", "b"]).collect()} == {("b", "x", 1), ("b", "<null>", 1), ("b", "y", 4)}
    got = {x["run_id"]: (x["n_cases"], x["case_set"]) for x in stats.case_sets(r).collect()}
    assert got["s"] == got["t"] != got["r"]


def test_windows_sessions_and_late_events(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=m), u, 1.0) for m, u in ((0, "a"), (10, "a"), (59, "b"), (60, "a"), (39, "a"), (70, "a"))] + [(None, "a", 1.0)]
    e = spark.createDataFrame(rows, "ts timestamp, u string, v double")
    assert sorted((r["start"].hour, r["u"], r["n"]) for r in ordered.tumbling(e, "ts", "1 hour", ["u"], "v").collect()) == [(0, "a", 3), (0, "b", 1), (1, "a", 2)]
    assert sorted((r["u"], r["start"].minute, r["n"]) for r in ordered.sessions(e, "ts", "30 minutes", ["u"]).collect()) == [("a", 0, 5), ("b", 59, 1)]
    # the second run moves the watermark past the first window; what the third brings for it is too late
    got = []
    for i, minutes in enumerate([(1, 2), (300,), (3, 301)]):
        d = spark.createDataFrame([(t0 + dt.timedelta(minutes=m), "a", 1.0) for m in minutes], "ts timestamp, u string, v double")
        d.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp, u string, v double").parquet(str(tmp_path / "in"))
        out = ev.late_windows(stream, "ts", "1 hour", "30 minutes", ["u"], "v")
        q = out.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r["start"].hour, r["n"]) for r in got] == [(0, 2)]
