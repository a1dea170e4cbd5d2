import random
from collections import deque

import pytest

from tracewell.operators import ordered, stats


def kappa_of(pairs, scale, quadratic):
    n = len(pairs)
    k = len(scale)
    w = lambda a, b: 1 - (scale.index(a) - scale.index(b)) ** 2 / (k - 1) ** 2 if quadratic else float(a == b)
    o = sum(w(a, b) for a, b in pairs) / n
    e = sum(w(a, b) * sum(x == a for x, _ in pairs) * sum(y == b for _, y in pairs) for a in scale for b in scale) / n / n
    return (o - e) / (1 - e)


@pytest.mark.parametrize("quadratic", [False, True])
def test_kappa(spark, quadratic):
    r = random.Random(4)
    scale = ["1", "2", "3", "4", "5"]
    pairs = [(r.choice(scale), r.choice(scale[:4])) for _ in range(40)] + [("5", "5")] * 9
    one = stats.kappa(spark.createDataFrame([*pairs, (None, "1"), ("9", "1")], "a string, b string"), scale, quadratic).first()
    assert one["n"] == 49 and one["kappa"] == pytest.approx(kappa_of(pairs, scale, quadratic))


def test_kappa_undefined(spark):
    assert stats.kappa(spark.createDataFrame([("x", "x")] * 3, "a string, b string"), ["x", "y"]).first()["kappa"] is None
    none = stats.kappa(spark.createDataFrame([], "a string, b string"), ["x"], True).first()
    assert (none["n"], none["observed"], none["kappa"]) == (0, None, None)


def test_spread_counts_undefined_values(spark):
    v = spark.createDataFrame([(1, "m", 1.0), (2, "m", 3.0), (3, "m", None), (1, "u", None), (1, "s", 2.0)], "run_id int, metric string, value double")
    got = {r["metric"]: r.asDict() for r in stats.spread(v).collect()}
    assert got["m"]["spread"] == 2 and got["m"]["n_undefined"] == 1 and got["m"]["stdev"] == pytest.approx(2**0.5)
    assert got["u"]["low"] is None and got["s"]["stdev"] is None


def test_stability(spark):
    c = spark.createDataFrame([(1, "a", True, False, 1), (2, "a", True, False, 4), (1, "b", True, False, 0), (2, "b", False, True, 0), (1, "c", False, None, 0)], "run_id int, case_id string, correct boolean, refused boolean, claims int")
    got = {r["case_id"]: (r["stable"], r["always_correct"], r["always_wrong"], r["claim_swing"]) for r in stats.stability(c).collect()}
    assert got["a"] == (True, True, False, 3) and got["b"] == (False, False, False, 0) and got["c"][2] is True


def test_slices_and_verdicts(spark):
    d = spark.createDataFrame([("x", "", True)] * 4 + [("y", None, False)] * 7, "p string, q string, hit boolean")
    got = {(r["dimension"], r["value"]): (r["hits"], r["total"], r["shown"]) for r in stats.sliced(d, ["p", "q"], "hit").collect()}
    assert got == {("p", "x"): (4, 4, "4/4"), ("p", "y"): (0, 7, "0%"), ("q", "unknown"): (4, 11, "36%")}
    v = spark.createDataFrame([(None, None), (None, 0.5), (0.5, 0.5), (0.4, 0.5)], "v double, m double")
    assert [r[0] for r in v.select(stats.floor_verdict(v.v, v.m)).collect()] == ["N/A", "FAIL", "PASS", "FAIL"]
    runs = spark.createDataFrame([(1, "a", None), (2, "a", "z")], "run_id int, x string, y string")
    assert sorted(tuple(r) for r in stats.incomparable(runs, ["x", "y"]).collect()) == [("y", "<null>", 1), ("y", "z", 1)]


def simulated(arrivals, most, window):
    out, recent, now = [], deque(), float("-inf")
    for a in arrivals:
        now = max(now, a)
        while True:
            while recent and recent[0] <= now - window:
                recent.popleft()
            if len(recent) < most:
                break
            now = recent[0] + window
        recent.append(now)
        out.append(now)
    return out


def test_limiter_equals_a_simulation(spark):
    r = random.Random(2)
    rows, want = [], {}
    for k in ["a", "b", None]:
        times = sorted(float(r.randrange(400)) for _ in range(120))
        rows += [(k, t, i) for i, t in enumerate(times)]
        want |= {(k, i): g for i, g in enumerate(simulated(times, 5, 30.0))}
    got = ordered.granted(spark.createDataFrame(rows, "k string, at double, i int"), "k", "at", "i", 5, 30.0)
    assert {(r["k"], r["i"]): r["grant"] for r in got.collect()} == want
    assert ordered.granted(spark.createDataFrame([], "k string, at double, i int"), "k", "at", "i", 5, 30.0).count() == 0


def test_budget_admits_while_anything_is_left(spark):
    d = spark.createDataFrame([("r", 1, 5), ("r", 2, None), ("r", 3, 6), ("r", 4, 1), ("s", 1, 99)], "run string, i int, c int")
    got = {(r["run"], r["i"]): (r["spent_before"], r["admitted"]) for r in ordered.within_budget(d, "run", "i", "c", 10).collect()}
    assert got == {("r", 1): (0, True), ("r", 2): (5, True), ("r", 3): (5, True), ("r", 4): (11, False), ("s", 1): (0, True)}


def test_stop_reasons(spark):
    rows = [("t", i, 10) for i in range(5)] + [("m", i, 1) for i in range(9)] + [("c", 0, 5)]
    got = {r["run"]: (r["turns"], r["tokens"], r["stop_reason"]) for r in ordered.stop_reasons(spark.createDataFrame(rows, "run string, i int, c int"), "run", "i", "c", 8, 30).collect()}
    assert got == {"t": (3, 30, "max_tokens"), "m": (8, 8, "max_turns"), "c": (1, 5, "complete")}


def test_round_robin_gives_every_group_a_turn(spark):
    d = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 9)], "g string, i int")
    got = ordered.round_robin(d, "g", "i", "seed").orderBy("round", "turn").collect()
    assert {r["g"] for r in got[:2]} == {"a", "b"} and [r["round"] for r in got] == [0, 0, 1, 2]


def test_first_seen_and_consecutive(spark):
    d = spark.createDataFrame([("g", 3, "x"), ("g", 1, "y"), ("g", 2, "x"), ("g", 4, None)], "g string, i int, v string")
    assert ordered.first_seen(d, "g", "i", "v").first()["values"] == "y | x"
    assert [(r["a"], r["b"]) for r in ordered.consecutive(d, "g", "i", "v").collect()] == [("y", "x"), ("x", "x")]


def test_backoff(spark):
    d = spark.createDataFrame([(i,) for i in range(5)], "n int")
    assert [r[0] for r in d.select(ordered.backoff("n")).collect()] == [5, 10, 20, 40, 60]
