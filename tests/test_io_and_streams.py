import json
import os

import pytest
from pyspark.sql import functions as F

from tracewell.plans import tools
from tracewell.plans.scratch import Scratch, shared_folder
from tracewell.sources import snapshots
from tracewell.sources.tables import prune, read_table
from tracewell.streaming import events

NODES = [("Q1", "Jazz", "genre", 1950, 9, ["Ghana"], 1), ("Q2", "Blues", "genre", None, None, [], 2)]
NODE = "id string, label string, kind string, inception_year int, inception_precision int, countries array<string>, ord bigint"
EDGES = [("Q1", "influenced_by", "Q2", "u", "HAND", 1)]
EDGE = "subject_id string, predicate string, object_id string, source_id string, verification string, ord bigint"


def test_snapshots_are_immutable_and_verified(spark, tmp_path):
    n, e = spark.createDataFrame(NODES, NODE), spark.createDataFrame(EDGES, EDGE)
    m = snapshots.write_snapshot(n, e, str(tmp_path), "1").first()
    assert (m["node_count"], m["edge_count"], m["verification_counts"]) == (2, 1, {"HAND": 1})
    with pytest.raises(Exception, match="exist"):
        snapshots.write_snapshot(n, e, str(tmp_path), "1")
    assert snapshots.read_snapshot(spark, str(tmp_path), "1")[0].count() == 2
    n.limit(1).write.mode("append").parquet(str(tmp_path / "v1" / "nodes"))
    with pytest.raises(snapshots.DigestMismatch):
        snapshots.read_snapshot(spark, str(tmp_path), "1")


def test_digest_is_free_of_order_but_not_of_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    d = lambda x: snapshots.table_digest(x).first()["digest"]
    assert d(df) == d(df.orderBy(F.desc("i")).repartition(3)) and d(df) != d(df.union(df)) and d(df.where("false"))


def test_graph_files(spark, tmp_path):
    f = tmp_path / "graph.json"
    f.write_text(json.dumps({"nodes": [{"id": "a", "label": "A"}], "edges": [{"subject_id": "a", "object_id": "b"}]}, indent=2))
    n, e = snapshots.read_graph(spark, str(f))
    assert n.first()["label"] == "A" and e.first()["ord"] == 0
    digest = snapshots.file_digest(spark, str(f))
    assert snapshots.verified(spark, str(f), digest) == str(f)
    with pytest.raises(snapshots.DigestMismatch):
        snapshots.verified(spark, str(f), "0")


def test_histories_exclusions_and_cases(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"2025010{i}.json").write_text(json.dumps({"v": i}))
    assert sorted(r["v"] for r in snapshots.latest_runs(spark, f"{tmp_path}/*.json", 2, "v int").collect()) == [1, 2]
    ex = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y")], "id string, reason_code string")
    assert {r["reason_code"]: r["n"] for r in snapshots.write_exclusions(ex, str(tmp_path / "ex")).collect()} == {"X": 2, "Y": 1}
    snapshots.append_run(ex, str(tmp_path / "runs"), "r1")
    snapshots.append_run(ex, str(tmp_path / "runs"), "r2")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 6
    (tmp_path / "cases").mkdir()
    (tmp_path / "cases" / "c.json").write_text(json.dumps([{"case_id": "1", "shape": "odd"}]))
    with pytest.raises(Exception, match="unknown shape"):
        snapshots.read_cases(spark, str(tmp_path / "cases")).collect()


def test_sealing(spark):
    d = spark.createDataFrame([("secret",), (None,)], "x string")
    s = d.select(snapshots.sealed(d.x, F.lit("0123456789abcdef")).alias("s"))
    assert [r[0] for r in s.select(snapshots.unsealed(s.s, F.lit("0123456789abcdef"))).collect()] == ["secret", None]
    assert s.select(snapshots.unsealed(s.s, F.lit("fedcba9876543210"))).first()[0] is None


def test_pruned_scans(spark, tmp_path):
    spark.sql("select 1 i, array(named_struct('a', 1, 'b', 2)) xs, named_struct('c', 3, 'd', 4) s").write.parquet(f"{tmp_path}/t.parquet")
    df = read_table(spark, str(tmp_path), "t", ["xs[].b", "s.c"])
    assert df.schema.simpleString() == "struct<xs:array<struct<b:int>>,s:struct<c:int>>"
    assert prune(df.schema, ["s"]).simpleString() == "struct<s:struct<c:int>>"


def test_folds_agree(spark):
    runs = spark.createDataFrame([(1, "text", False), (2, "no", True), (3, None, None)], "run_id bigint, prose string, refused boolean")
    gated = spark.createDataFrame([(1, 0, "approved", None), (1, 1, "rejected", "duplicate"), (3, 0, "approved", None)], "run_id bigint, ord bigint, status string, reason string")
    scratch = Scratch(spark, "test")
    kept = scratch.keep(events.events_of(gated, runs).unionByName(spark.createDataFrame([(9, 0, "planned", None)], events.EVENT)))
    want = {r["run_id"]: tuple(r) for r in events.folded(kept).collect()}
    assert want[1][:6] == (1, 5, 1, 1, False, "text") and want[2][4] is True and want[9][6] is False
    got = {r["run_id"]: tuple(r) for r in events.run_stream(kept._scratch_path, scratch, spark).collect()}
    assert got == {k: v for k, v in want.items() if k != 9}
    assert events.frames(kept).where("run_id = 2 and seq = 0").first()["frame"] == 'event: planned\ndata: {"run_id":2,"seq":0,"text":null}\n\n'
    seen = []
    events.in_batches(spark.readStream.schema(events.EVENT).parquet(kept._scratch_path), lambda df, i: seen.append(df.count()), spark, scratch.root.rsplit("/", 1)[1] + "/sink")
    assert sum(seen) == kept.count()


def test_tools(spark):
    n, e = spark.createDataFrame(NODES, NODE), spark.createDataFrame(EDGES, EDGE)
    r = tools.default_registry(spark, n, e, "7")
    assert len(r.names) == 7 and "trace_lineage" in r and r.config()[0]["input"]["required"] == ["name"]
    assert r.invoke("nope").is_error and r.invoke("get_influences").is_error and r.invoke("get_influences", id=" ").is_error
    assert r.invoke("resolve_node", name="jazz").rows.first()["node_id"] == "Q1"
    assert r.invoke("get_influences", id="http://x/Q1").rows.first()["object_label"] == "Blues"
    assert r.invoke("get_descendants", id="q2").rows.first()["subject_label"] == "Jazz"
    assert list(r.invoke("trace_lineage", start="Q2", end="Q1").rows.first()["chain"]) == ["Q1", "Q2"]
    assert r.invoke("describe_node", id="Q1").rows.first()["era"] == "1950-1969"
    assert r.invoke("resolve_source", uri="http://x/statement/Q1-77").rows.first()["label"] == "Jazz"
    assert r.invoke("corpus_coverage").rows.first()["artifact_version"] == "7"
    with pytest.raises(ValueError):
        r.register("get_influences", (), None)
    tools.register_functions(spark)
    assert spark.sql("select * from cited_subject('http://x/statement/q5-ab-c')").first()[0] == "Q5"


def test_scratch_is_in_the_named_folder(spark):
    s = Scratch(spark, "where")
    df = s.keep(spark.range(3))
    assert df._scratch_path.startswith(shared_folder(spark)) and os.path.isdir(df._scratch_path)
    s.drop(df)
    assert not os.path.isdir(df._scratch_path)
