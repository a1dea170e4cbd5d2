import datetime as dt
import json
import random

from tracewell.operators import drift

FIELDS = [drift.Field("notes", ("notes", "remarks"), words=("summary",)), drift.Field("c.n", ("c.n", "c.deep.n", "cn"), canonical="count")]


def files(spark, rows):
    return spark.createDataFrame([(f, i, dt.datetime(2025, 1, 1) + dt.timedelta(hours=h), b) for f, i, h, b in rows], "feed string, file_id bigint, written_at timestamp_ntz, body string")


def read(spark, rows, opaque=()):
    return drift.read_paths(files(spark, rows), ["feed", "written_at", "file_id"], opaque=opaque)


def kinds(spark, rows):
    cells = drift.located(read(spark, rows), FIELDS, ["feed", "written_at", "file_id"])
    return sorted((r["file_id"], r["field_name"], r["change_kind"]) for r in drift.changes(cells, "feed", "written_at", "file_id").collect())


def test_each_kind_of_change(spark):
    rows = [("f", 1, 0, '{"notes": "a"}'), ("f", 2, 1, '{"remarks": "a"}'), ("f", 3, 2, '{"remarks": ["a"]}'), ("f", 4, 30, '{"remarks": null}'), ("f", 5, 60, '{"remarks": ["b"]}'), ("f", 6, 90, "{}"), ("f", 7, 91, '{"notes": {"summary": "x"}, "cn": 2}'), ("f", 8, 91, '{"notes": {"summary": "x"}, "c": {"deep": {"n": 2.0}}}')]
    assert kinds(spark, rows) == [(2, "notes", "renamed"), (3, "notes", "retyped"), (6, "notes", "removed"), (7, "c.n", "added"), (7, "notes", "added"), (8, "c.n", "renamed"), (8, "c.n", "retyped")]


def test_first_files_unreadable_files_and_null_feeds(spark):
    assert kinds(spark, [("f", 1, 0, '{"notes": 1}'), ("g", 2, 0, "{bad"), (None, 3, 0, "{}"), (None, 4, 1, '{"notes": 1}'), ("g", 5, 1, None)]) == [(4, "notes", "added")]
    assert kinds(spark, []) == []


def test_random_feeds_against_a_walk(spark):
    r = random.Random(5)
    rows, want, state = [], [], {}
    shapes = ['{"notes": "a"}', '{"remarks": 1}', '{"notes": null}', "{}", '{"remarks": [1]}', '{"notes": 1.5}']
    tags = {str: "s", int: "i", float: "d", list: "l"}
    for i in range(300):
        f = r.choice("ab")
        body = r.choice(shapes)
        rows.append((f, i, i * 5, body))
        o = json.loads(body)
        path = next((p for p in ("notes", "remarks") if p in o), None)
        tag = tags.get(type(o[path])) if path else None
        if f in state:
            was, seen = state[f]
            want += [(i, "notes", k) for k, hit in (("added", was is None and path), ("removed", was and path is None), ("renamed", was and path and was != path), ("retyped", was and path and tag and seen and tag != seen)) if hit]
            state[f] = (path, tag or seen)
        else:
            state[f] = (path, tag)
    assert kinds(spark, rows) == sorted(want)


def test_one_table(spark):
    rows = [("f", 1, 0, '{"notes": ["a", "b"], "cn": "7"}'), ("f", 2, 0, '{"notes": {"summary": "s"}, "c": {"n": {"n": 3, "of": 9}}}'), ("f", 3, 0, '{"notes": "t", "c": {"n": 2.5}}'), ("f", 4, 0, "[]")]
    t = {r["file_id"]: r for r in drift.consistent_table(drift.parsed(files(spark, rows)), FIELDS, ["file_id"]).collect()}
    assert [t[i]["notes"]["canonical"] for i in (1, 2, 3, 4)] == ["a b", "s", "t", None]
    assert [t[i]["c_n"]["canonical"] for i in (1, 2, 3, 4)] == [7, 3, None, None]
    assert t[1]["notes"]["list"] == '["a","b"]' and t[1]["notes"]["string"] is None and t[3]["c_n"]["decimal"] == 2.5
    assert t[2]["c_n_tag"] == "object" and t[1]["c_n_path"] == "cn"


def test_fused_schema(spark):
    tags = drift.path_tags(read(spark, [("f", 1, 0, '{"a": {"b": 1, "x.y": true}, "m": {"Q1": 1}}'), ("f", 2, 0, '{"a": {"b": "s"}}')], ("m",)), ["file_id"])
    got = {(r["path"], r["tag"]): r["n"] for r in drift.fused_schema(tags).collect()}
    assert got == {("a", "object"): 2, ("a.b", "integer"): 1, ("a.b", "string"): 1, ("a.x\\.y", "boolean"): 1, ("m", "object"): 1}


def test_paths_of_any_depth_and_in_lists(spark):
    deep = '{"a":{"b":{"c":{"d":{"e":1}}}},"l":[{"x":1},{"x":null},2,[3.5]],"o":{},"v":[]}'
    got = [(r["path"], r["tag"]) for r in drift.path_tags(read(spark, [("f", 1, 0, deep), ("f", 2, 0, "[1]"), ("f", 3, 0, '{"a":1,"a":2}'), ("f", 4, 0, '{"a":NaN}'), ("f", 5, 0, None)]), ["file_id"]).collect()]
    want = [("a", "object"), ("a.b", "object"), ("a.b.c", "object"), ("a.b.c.d", "object"), ("a.b.c.d.e", "integer"), ("l", "list"), ("l[]", "object"), ("l[].x", "integer"), ("l[].x", "null"), ("l[]", "integer"), ("l[]", "list"), ("l[][]", "decimal"), ("o", "object"), ("v", "list")]
    assert sorted(got) == sorted(want)


def test_names_are_told_from_the_files(spark):
    rows, i = [], 0
    for feed in range(12):
        n, c = '"notes": "a"', '"c": {"n": 1}'
        n2, c2 = [('"log": ["a"]', '"c": {"m": {"n": 2}}'), ('"log": {"summary": "s"}', '"cc": 3')][feed % 2]
        for h, parts in enumerate([(n, c), (n2, c), (n2, c2), (n, c2), (n, c), ()]):
            rows.append((f"f{feed}", i, h * 9, "{" + ", ".join([*parts, '"always": 1']) + "}"))
            i += 1
    known = [drift.Field("notes", ("notes",)), drift.Field("c.n", ("c.n",))]
    got = {f.name: f.paths for f in drift.other_names(read(spark, rows), known, "feed", "written_at", "file_id")}
    assert got == {"notes": ("notes", "log"), "c.n": ("c.n", "c.m.n", "cc")}
    assert [f.paths for f in drift.other_names(read(spark, rows[:12]), known, "feed", "written_at", "file_id")] == [("notes",), ("c.n", "c.m.n")]
    assert [f.paths for f in drift.other_names(read(spark, []), known, "feed", "written_at", "file_id")] == [("notes",), ("c.n",)]


def test_names_taken_once_for_good_deep_and_one_after_another(spark):
    rows, i = [], 0
    for feed in range(3):
        for h in range(24):
            n = '"notes": "a"' if h < 8 else '"log": "b"' if h < 16 else '"text": "c"'
            c = '"c": {"n": 1}' if h < 12 else '"c": {"p": {"q": {"r.s": 2}}}'
            late = ', "late": 1' if h > 18 else ""
            rows.append((f"f{feed}", i, h * 9, "{" + f'{n}, {c}, "always": 1{late}' + "}"))
            i += 1
    # a feed of its own in which both names stand in one file
    rows += [("g", i, 0, '{"notes": "a", "log": "b"}'), ("g", i + 1, 1, '{"notes": "a"}')]
    known = [drift.Field("notes", ("notes",)), drift.Field("c.n", ("c.n",))]
    names = drift.other_names(read(spark, rows), known, "feed", "written_at", "file_id")
    assert {f.name: f.paths for f in names} == {"notes": ("notes", "log", "text"), "c.n": ("c.n", "c.p.q.r\\.s")}
    cells = drift.located(read(spark, rows), names, ["feed", "written_at", "file_id"])
    got = sorted((r["file_id"], r["field_name"], r["change_kind"]) for r in drift.changes(cells, "feed", "written_at", "file_id").collect() if r["feed"] != "g")
    assert got == sorted((24 * feed + h, name, "renamed") for feed in range(3) for h, name in ((8, "notes"), (12, "c.n"), (16, "notes")))
