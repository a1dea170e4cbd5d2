import random

from tracewell.operators.snapshots import snapshot_changes

DDL = "v string, k string, k2 string, t bigint, a string, b string, change_kind string"


def changes(spark, rows):
    df = snapshot_changes(spark.createDataFrame([(*r, "extra") for r in rows], DDL), ["k", "k2"], "v", "t", ["a", "b"])
    return sorted((r["from_version"], r["to_version"], r["k"], r["change_kind"], ",".join(r["changed_columns"])) for r in df.collect())


def test_versions_in_number_order_and_late_corrections(spark):
    rows = [("0.9.0", "x", "1", 1, "p", None), ("0.10.0", "x", "1", 2, "p", None), ("0.10.0", "x", "1", 3, "p", "q"), ("0.10.0", "y", "1", 1, "p", None), ("0.11.0", "y", "1", 1, None, None), ("0.11.0", "y", "1", 1, None, None)]
    assert changes(spark, rows) == [("0.10.0", "0.11.0", "x", "removed", ""), ("0.10.0", "0.11.0", "y", "changed", "a"), ("0.9.0", "0.10.0", "x", "changed", "b"), ("0.9.0", "0.10.0", "y", "added", "")]


def test_gaps_nulls_and_ties(spark):
    rows = [("1", "x", "1", 1, "p", "q"), ("2", "z", "1", 1, "p", "q"), ("3", "x", "1", 1, "p", "q"), (None, "x", "1", 1, "p", "q"), ("1", None, "1", 1, "p", "q"), ("3", "z", "1", None, "a", "q"), ("3", "z", "1", None, "b", "q")]
    assert changes(spark, rows) == [("1", "2", "x", "removed", ""), ("1", "2", "z", "added", ""), ("2", "3", "x", "added", ""), ("2", "3", "z", "changed", "a")]


def test_one_version_or_none(spark):
    assert changes(spark, [("1", "x", "1", 1, "p", "q")]) == [] and changes(spark, []) == []


def test_random_against_sets(spark):
    r = random.Random(9)
    rows = [(str(v), f"k{r.randrange(40)}", "s", r.randrange(5), r.choice(["a", "b", None]), r.choice(["c", None])) for v in range(1, 12) for _ in range(40)]
    held = {}
    for v, k, _, t, a, b in rows:
        best = held.setdefault(int(v), {})
        rank = (t, a or "", b or "")
        if k not in best or rank > best[k][0]:
            best[k] = (rank, (a, b))
    want = []
    for v in range(1, 11):
        x, y = held[v], held[v + 1]
        for k in set(x) | set(y):
            kind = "added" if k not in x else "removed" if k not in y else "changed" if x[k][1] != y[k][1] else None
            if kind:
                want.append((str(v), str(v + 1), k, kind))
    assert sorted(c[:4] for c in changes(spark, rows)) == sorted(want)
