import os
import random

import numpy as np
import pytest

from tracewell.llm import mixing, packing, tokens

needs_tokenizer = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_TOKENIZER), reason="no tokenizer here")


def test_the_curve_visits_every_cell_next_to_the_last():
    bits = 3
    cells = np.array(np.meshgrid(*[range(1 << bits)] * 3)).reshape(3, -1).T
    keys = packing.hilbert(cells, bits)
    assert sorted(keys) == list(range(1 << 3 * bits))
    way = cells[np.argsort(keys)]
    assert (np.abs(np.diff(way, axis=0)).sum(axis=1) == 1).all()


def checked(items, rows, capacity):
    held, per = {}, {}
    for r in rows:
        held.setdefault(r["doc_id"], []).append(r)
        per.setdefault(r["container_id"], []).append(r)
    assert all(sum(x["n_tokens"] for x in c) <= capacity for c in per.values())
    for doc, n in items:
        mine = sorted(held[doc], key=lambda x: x["piece"])
        assert sum(x["n_tokens"] for x in mine) == n and len(mine) == max(1, -(-n // capacity))
        assert [x["from_token"] for x in mine] == [i * capacity for i in range(len(mine))] and mine[-1]["to_token"] == n
    assert len(held) == len(items)
    return len(per)


def test_every_item_lies_in_one_container(spark):
    r = random.Random(1)
    items = [(i, r.choice([0, 5, 30, 99, 100, 101, 250, r.randrange(1, 60)])) for i in range(2000)]
    df = spark.createDataFrame([(i, n, r.randrange(50), "x") for i, n in items], "doc_id bigint, n_tokens bigint, curve bigint, piece string")
    n = checked(items, packing.packed(df, "doc_id", 100).collect(), 100)
    assert n <= 1.03 * sum(x for _, x in items) / 100 + 8


def test_one_hot_place_on_the_curve_and_repeats(spark):
    items = [(i, 40) for i in range(500)]
    df = spark.createDataFrame([(i, n, 7) for i, n in items], "doc_id bigint, n_tokens bigint, curve bigint")
    checked(items, packing.packed(df, "doc_id", 100).collect(), 100)
    one = packing.packed(df.limit(1).unionByName(df.limit(1)), "doc_id", 100)
    assert one.count() == 2


def test_packing_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint, curve bigint")
    p = packing.packed(df, "doc_id")
    assert p.count() == 0 and packing.fill(p).first()["n_containers"] == 0


@needs_tokenizer
def test_tokens_of_any_text(spark):
    long = "word " * 100_000
    docs = spark.createDataFrame([(1, "hello world", "a"), (2, "", "b"), (3, None, None), (4, long, "c"), (5, "<|endoftext|>", "d"), (6, "é漢🎵", "e")], "doc_id bigint, text string, tag string")
    got = {r["doc_id"]: r for r in tokens.with_tokens(docs, "doc_id", "text", "tag", vectors=True).collect()}
    assert got[1]["n_tokens"] == 2 and got[2]["n_tokens"] == got[3]["n_tokens"] == 0 and got[5]["n_tokens"] > 1 and got[3]["tag"] is None
    assert got[4]["n_tokens"] == len(tokens.encoder(tokens.DEFAULT_TOKENIZER).encode_ordinary(long)) and got[3]["x_0"] == 0
    enc = tokens.encoder(tokens.DEFAULT_TOKENIZER)
    assert enc.decode(enc.encode_ordinary("é漢🎵 x")) == "é漢🎵 x" and "".join(tokens.pieces_of(long)) == long
    curve = packing.along_curve(tokens.with_tokens(docs, "doc_id", "text", vectors=True))
    assert curve.count() == 6 and curve.where("curve < 0 or curve >= 1 << 30").count() == 0


def leaves(*rows):
    return [mixing.Leaf(tuple(p.split("/")), w, t, k, 10) for p, w, t, k in rows]


def test_budgets_are_met_and_capped():
    x = leaves(("a/en/s1", 0.5, 100, 1), ("a/en/s2", 0.25, 1000, 1), ("b/en/s3", 0.25, 1000, 2))
    assert mixing.allot(x, 100) == pytest.approx(0) and [v.budget for v in x] == pytest.approx([50, 25, 25])
    assert mixing.allot(x, 400) == pytest.approx(0)
    assert [v.budget for v in x] == pytest.approx([100, 200, 100])  # the sibling takes it, the other domain nothing
    assert mixing.allot(x, 2000) == pytest.approx(0) and [v.budget for v in x] == pytest.approx([100, 1000, 900])
    assert mixing.allot(x, 5000) == pytest.approx(5000 - 3100)


def test_shortages_go_to_siblings_before_ancestors():
    x = leaves(("a/en/s1", 0.2, 10, 2), ("a/en/s2", 0.2, 300, 1), ("a/de/s3", 0.2, 500, 1), ("b/en/s4", 0.4, 5000, 1))
    assert mixing.allot(x, 1000) == pytest.approx(0)
    # s1 lacks 180: its sibling s2 takes 100 and is full, the rest stays in the domain with s3
    assert [v.budget for v in x] == pytest.approx([20, 300, 280, 400])
    assert mixing.allot(x, 1500) == pytest.approx(0)
    # s1 and s2 lack 280: s3 takes 200, the other domain 80
    assert [v.budget for v in x] == pytest.approx([20, 300, 500, 680])


def test_the_total_at_which_no_leaf_is_short():
    x = leaves(("a/en/s1", 0.5, 100, 2), ("b/en/s2", 0.5, 1000, 1), ("b//s3", 0.2, 0, 4))
    total = mixing.holding_total(x)
    assert mixing.allot(x, total) == pytest.approx(0) and x[0].budget == pytest.approx(200)
    assert mixing.holding_total(leaves(("a/en/s", 1.0, 0, 1))) == 0 and mixing.corpus_total(x) == 1100


def mixed_of(docs, targets, total):
    x = mixing.leaf_table(docs, targets, {})
    mixing.allot(x, total if isinstance(total, (int, float)) else total(x))
    return mixing.mixture(docs, "doc_id", x)


DOC = "doc_id bigint, lang string, source string, n_tokens bigint"
TARGET = "source string, target_weight double, max_repeats int"


def test_mixture_reaches_its_shares(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["en", "de", None]), "big" if i % 3 else "small" if i % 2 else "other", r.choice([0, 1, 20, 50, 300])) for i in range(3000)] + [(9000, "en", "small", 20_000)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], f"{DOC}, full int, copies int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("small", 0.2, None), ("none", 0.1, 2), (None, 3.0, 1)], TARGET)
    mixed = mixed_of(docs, targets, mixing.holding_total)
    got = mixed.collect()
    assert len({g["doc_id"] for g in got}) == len(got) and {g["source"] for g in got} == {"big", "small"}
    assert max(g["copies"] for g in got if g["source"] == "big") <= 1 and max(g["copies"] for g in got) <= 3
    assert all(0 < g["used_tokens"] <= g["copies"] * g["n_tokens"] for g in got)
    # at most one document of a leaf is cut
    assert sum(g["used_tokens"] < g["copies"] * g["n_tokens"] for g in got) <= 6
    reached = {s["source"]: s["reached_share"] for s in mixing.shares(mixed, targets).collect()}
    assert reached["big"] == pytest.approx(0.5, abs=1e-4) and reached["small"] == pytest.approx(0.5, abs=1e-4) and reached["none"] == 0
    again = mixed_of(docs.repartition(5), targets, mixing.holding_total).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_one_document_longer_than_its_source_may_give(spark):
    docs = spark.createDataFrame([(1, "en", "long", 10_000)] + [(i, "en", "rest", 100) for i in range(2, 102)], DOC)
    targets = spark.createDataFrame([("long", 0.1, 6), ("rest", 0.9, 1)], TARGET)
    mixed = mixed_of(docs, targets, 5000)
    assert {s["source"]: (s["reached_share"], s["tokens"]) for s in mixing.shares(mixed, targets).collect()} == {"long": (0.1, 500), "rest": (0.9, 4500)}


def test_repeats_are_used_before_a_source_is_short(spark):
    docs = spark.createDataFrame([(i, "en", "small", 10) for i in range(10)] + [(100 + i, "en", "large", 100) for i in range(100)], DOC)
    targets = spark.createDataFrame([("small", 0.5, 4), ("large", 0.5, 1)], TARGET)
    got = {s["source"]: (s["tokens"], s["most_copies"]) for s in mixing.shares(mixed_of(docs, targets, 2000), targets).collect()}
    assert got == {"small": (400, 4), "large": (1600, 1)}
    assert {s["source"]: s["tokens"] for s in mixing.shares(mixed_of(docs, targets, 500), targets).collect()} == {"small": 250, "large": 250}


def test_mixing_nothing(spark):
    docs = spark.createDataFrame([], DOC)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGET)
    mixed = mixed_of(docs, targets, mixing.corpus_total)
    assert mixed.count() == 0 and mixing.shares(mixed, targets).first()["reached_share"] is None
    assert mixing.shares(mixed, targets.limit(0)).count() == 0


@needs_tokenizer
def test_pieces_change_no_token(monkeypatch):
    r = random.Random(3)
    text = "".join(r.choice(["a", "bc", " ", "  ", "\n", "1", "é", ".", "'s", " x"]) for _ in range(5000))
    enc = tokens.encoder(tokens.DEFAULT_TOKENIZER)
    monkeypatch.setattr(tokens, "PIECE", 7)
    parts = list(tokens.pieces_of(text))
    assert len(parts) > 100 and "".join(parts) == text
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert list(tokens.pieces_of("x" * 50)) == ["x" * 50]
