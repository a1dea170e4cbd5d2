import random

from tracewell.operators import references


def intervals(spark, parents, removals):
    return references.parent_intervals(spark.createDataFrame(parents, "key string, seen bigint"), spark.createDataFrame(removals, "key string, removed bigint, restored bigint"))


def test_causes_and_passed_columns(spark):
    i = intervals(spark, [("a", 10), ("a", 5), ("b", None), ("c", 1), (None, 1)], [("a", 20, 30), ("c", 5, None), ("z", 1, None), (None, 1, 1)])
    refs = spark.createDataFrame([("a", 4, 0), ("a", 5, 1), ("a", 20, 2), ("a", 30, 3), ("b", -9, 4), ("c", 6, 5), ("z", 6, 6), (None, 6, 7), ("q", None, 8), ("c", None, 9), ("a", 4, 0)], "key string, at bigint, born int")
    got = sorted((r["born"], r["key"], r["cause"]) for r in references.orphans(refs, i).collect())
    assert got == [(0, "a", "late"), (0, "a", "late"), (2, "a", "deleted"), (5, "c", "deleted"), (6, "z", "missing"), (8, "q", "missing")]


def test_empty_sides(spark):
    i = intervals(spark, [], [])
    assert references.orphans(spark.createDataFrame([], "key string, at bigint"), i).count() == 0
    assert [r["cause"] for r in references.orphans(spark.createDataFrame([("a", 1)], "key string, at bigint"), i).collect()] == ["missing"]


def test_random_with_a_hot_key(spark):
    r = random.Random(3)
    parents = [(f"k{r.randrange(40)}", r.randrange(100)) for _ in range(60)]
    removals = [(f"k{i}", r.randrange(100), r.choice([None, 60])) for i in range(0, 40, 3)]
    refs = [("k1" if r.random() < 0.4 else f"k{r.randrange(60)}", r.randrange(120), i) for i in range(2000)]
    born = {}
    for k, s in parents:
        born[k] = min(s, born.get(k, s))
    gone = {k: (a, b) for k, a, b in removals}
    want = []
    for k, at, i in refs:
        if k not in born:
            want.append((i, "missing"))
        elif born[k] > at:
            want.append((i, "late"))
        elif k in gone and gone[k][0] <= at and not (gone[k][1] is not None and gone[k][1] <= at):
            want.append((i, "deleted"))
    got = references.orphans(spark.createDataFrame(refs, "key string, at bigint, i int"), intervals(spark, parents, removals))
    assert sorted((r["i"], r["cause"]) for r in got.collect()) == sorted(want)


def test_it_is_a_sorted_merge(spark):
    i = intervals(spark, [("a", 1)], [])
    plan = references.orphans(spark.createDataFrame([("a", 1)], "key string, at bigint"), i)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_several_absences_of_one_parent(spark):
    gone = [("k", 10, 20), ("k", 30, 40), ("k", 35, 38), ("k", 60, 50), ("k", 70, None), ("k", 80, 90)]
    parents = spark.createDataFrame([("k", 1)], "key string, seen bigint")
    removals = spark.createDataFrame(gone, "key string, removed bigint, restored bigint")
    refs = spark.createDataFrame([("k", t) for t in (5, 10, 15, 20, 25, 36, 39, 40, 55, 65, 70, 95)], "key string, at bigint")
    got = {x["at"] for x in references.orphans(refs, references.parent_intervals(parents, removals)).collect()}
    assert got == {t for t in (5, 10, 15, 20, 25, 36, 39, 40, 55, 65, 70, 95) if any(a <= t and not (b is not None and b <= t) for _, a, b in gone)}
