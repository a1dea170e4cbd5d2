from pyspark.sql import functions as F

from tracewell.operators import nested

DDL = "rec string, note string, loaded bigint, kids array<struct<name:string,age:int,toys:array<string>>>, grid array<array<string>>, deep struct<a:struct<b:string>>"


def tables(spark, rows, paths=None, loaded="loaded"):
    return nested.flat_tables(spark.createDataFrame(rows, DDL), "rec", paths, loaded)


def values(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_children_keep_their_parents_and_places(spark):
    t = tables(spark, [("r", "n", 1, [("x", 3, ["t0", None, "t2"]), None, ("y", None, None), (None, None, [])], None, None)])
    assert values(t["kids[]"], "rec", "pos_0", "name", "age") == [("r", 0, "x", 3), ("r", 1, None, None), ("r", 2, "y", None), ("r", 3, None, None)]
    assert values(t["kids[].toys[]"], "pos_0", "pos_1", "value") == [(0, 0, "t0"), (0, 1, None), (0, 2, "t2")]


def test_lists_of_lists_and_structs(spark):
    t = tables(spark, [("r", None, 1, None, [["a", ""], None, [], ["b"]], (("deep",),)), ("s", None, 1, [], [], None)])
    assert values(t["grid[][]"], "pos_0", "pos_1", "value") == [(0, 0, "a"), (0, 1, ""), (3, 0, "b")]
    assert values(t[""], "rec", "note", "deep_a_b") == [("r", None, "deep"), ("s", None, None)]
    assert values(t["grid[]"], "rec", "pos_0") == [("r", 0), ("r", 1), ("r", 2), ("r", 3)]


def test_the_last_load_of_a_record_counts(spark):
    t = tables(spark, [("r", "old", 1, [("x", 1, None)], None, None), ("r", "new", 2, [("y", 2, None)], None, None), ("r", "new", 2, [("y", 2, None)], None, None), (None, "lost", 9, None, None, None)])
    assert values(t["kids[]"], "rec", "name") == [("r", "y")]
    assert values(t[""], "rec", "note") == [("r", "new")]


def test_empty_input_gives_empty_tables(spark):
    t = tables(spark, [])
    assert all(df.count() == 0 for df in t.values()) and t["kids[]"].columns == ["rec", "pos_0", "name", "age"]


def test_clashing_names_and_long_values(spark):
    df = spark.createDataFrame([("k", [("long " * 50_000, "p")])], "path string, value array<struct<pos_0:string,path:string>>")
    t = nested.flat_tables(df, "path")
    row = t["value[]"].first()
    assert t["value[]"].columns == ["path", "pos_0", "pos_0_", "path_"] and len(row["pos_0_"]) == 250_000 and row["path_"] == "p"


def test_triples_name_path_and_place(spark):
    df = spark.createDataFrame([("r", None, 1, [("x", 3, ["t"])], None, None)], DDL)
    got = [(r["path"], list(r["ordinals"]), r["value"]) for r in nested.triples(df, "rec", ["kids[].name", "kids[].toys[]"]).collect()]
    assert sorted(got) == [("kids[].name", [0], "x"), ("kids[].toys[]", [0, 0], "t")]


def test_pivot_takes_one_shuffle(spark):
    df = spark.createDataFrame([("r", None, 1, [("x", 3, ["t"])], None, None)], DDL)
    t = nested.flat_tables(df, "rec", ["kids[].toys[]"], "loaded")["kids[].toys[]"]
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert t.where(F.col("value") == "t").count() == 1
