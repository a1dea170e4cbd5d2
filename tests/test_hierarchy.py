import random

import pytest

from tracewell.operators.hierarchy import descendants, further_parents, hierarchy


def brute(pairs):
    up = {}
    for c, p in pairs:
        if c and p and c.strip() and p.strip():
            up[c] = min(p, up.get(c, p))
    out = {}
    for n in set(up) | set(up.values()):
        way, at = [], n
        while at in up and at not in way:
            way.append(at)
            at = up[at]
        if at in way:
            loop = way[way.index(at) :]
            out[n] = (min(loop), -1 if n in loop else -2, None)
        else:
            out[n] = (at, len(way), [at, *reversed(way)])
    return out


def got(spark, pairs, **kw):
    df = hierarchy(spark.createDataFrame(pairs, "child string, parent string"), **kw)
    return {r["node"]: (r["root"], r["depth"], r["path"] if "path" in df.columns else None) for r in df.collect()}


@pytest.mark.parametrize("seed,every", [(1, 8), (2, 2), (3, 1000), (4, 1)])
def test_random_forests_with_loops(spark, seed, every):
    r = random.Random(seed)
    pairs = [(f"Q{i}", f"Q{r.randrange(max(1, i))}") for i in range(1, 160)] + [(f"L{i}", f"L{(i + 1) % 7}") for i in range(7)] + [(f"T{i}", f"T{i - 1}" if i else "L3") for i in range(20)] + [("S", "S"), ("S1", "S")]
    assert got(spark, pairs, every=every) == brute(pairs)


def test_a_long_chain(spark):
    pairs = [(f"C{i}", f"C{i + 1}") for i in range(300)]
    assert got(spark, pairs, with_paths=False)["C0"] == ("C300", 300, None)


def test_nulls_blanks_repeats_and_several_parents(spark):
    pairs = [("a", "b"), ("a", "b"), (None, "b"), ("x", None), (" ", "b"), ("a", "c"), ("c", "r")]
    assert got(spark, pairs) == brute(pairs)


def test_a_hot_parent(spark):
    pairs = [(f"k{i}", "hub") for i in range(2000)] + [("hub", "root")]
    assert got(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert got(spark, []) == {}


def test_descendants_and_extra_columns(spark):
    df = spark.createDataFrame([("a", "b", 1, 2), ("b", "c", 1, 2)], "child string, parent string, node int, path int")
    assert sorted(tuple(r) for r in descendants(hierarchy(df)).collect()) == [("b", "a", 1), ("c", "a", 2), ("c", "b", 1)]


def test_further_parents(spark):
    df = spark.createDataFrame([("a", "c"), ("a", "b"), ("a", "b"), ("a", "d"), ("b", "d"), (None, "x"), ("e", " ")], "child string, parent string")
    assert sorted(tuple(r) for r in further_parents(df).collect()) == [("a", "c"), ("a", "d")]
