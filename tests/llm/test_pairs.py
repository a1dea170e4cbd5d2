import pytest

from tracewell.llm import pairs, voices

DDL = "id bigint, query string, prose string, refused boolean, reason string, names_a array<string>, names_b array<string>, defect string"
Q = "What did The Sable Rooks lead to?"
N = (["Late Ember", "The Iron Plums"], ["The Sable Rooks", None])


# what the models are fitted on: answers in four languages, declined ones that are mostly marked
ANSWERS = {
    "en": ("What did {} lead to?", ["{} led to {}.", "{} led to {}. Every link rests on one cited statement.", "Recorded links:\n- {}", "Sorry for the short list; {} led to {}.", "The rumours about {} are confirmed, but {} stands.", "I can't say that I know the rumours, but {} led to {}."]),
    "de": ("Was ist aus {} hervorgegangen?", ["{} geht auf {} zurück.", "Aus {} ist {} hervorgegangen.", "Verzeichnet:\n- {}", "{} wurde von {} beeinflusst."]),
    "es": ("¿Qué surgió a partir de {}?", ["{} desciende de {}.", "{} surgió a partir de {}.", "{} dio lugar a {}."]),
    "pt": ("O que nasceu de {}?", ["{} descende de {}.", "{} nasceu de {}.", "{} deu origem a {}."]),
}
REFUSED = ["I can't answer that: nothing is known.", "Nothing in these papers settles it, so the matter stays closed."]
FIRST = 1_000_000


def background():
    rows = []
    for lang, (query, proses) in ANSWERS.items():
        for k in range(40):
            a, b = f"Tarn{lang}{k} Orv", f"Osk{lang}{k} Hal"
            rows += [(query.format(a), p.format(a, b), False, "", [a], [b]) for p in proses]
    rows += [(ANSWERS["en"][0].format("Tarnen1 Orv"), p, k % 3 > 0, "", ["Tarnen1 Orv"], None) for k in range(12) for p in REFUSED]
    return [(FIRST + i, *r, None) for i, r in enumerate(rows)]


def documents(spark):
    texts = [(lang.upper() + " ", " ".join([query.format("x"), *(p.format("y", "z") for p in proses)])) for lang, (query, proses) in ANSWERS.items() for _ in range(5)]
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)] + [(99, None, "en"), (98, "x", None)], "id bigint, text string, lang string")


def found(spark, rows, evidence=False):
    full = [(i, *r, None) for i, r in enumerate(rows)] + background()
    got = pairs.defects(spark.createDataFrame(full, DDL), documents(spark)).where(f"id < {FIRST}").collect()
    return {r["id"]: (r["defect"], r["evidence"]) if evidence else r["defect"] for r in got}


def row(prose, query=Q, refused=False, reason="", names=N):
    return (query, prose, refused, reason, *names)


CASES = [
    ("The Sable Rooks led to Late Ember.", None),
    ("The Sable Rooks led to Late Ember and", "truncated"),
    ("The Sable Rooks led to Late Ember,", "truncated"),
    ("The Sable Rooks led to Late Emb", "truncated"),
    ("The Sable Rooks led to Late Ember. Every link rests on one ci", "truncated"),
    ("The Sable Rooks led to Late Ember. [S3]", None),
    ("Late Ember", None),
    ("Late Ember and The Iron Plums", None),
    ("Recorded links:\n- Late Ember\n- The Iron Plums", None),
    ("The Sable Rooks led to two.\n- Late Ember\n- Th", "truncated"),
    ("Verzeichnet:\n- Late Ember", "other_language"),
    ("The Sable Rooks geht auf Late Ember zurück.", "other_language"),
    ("Все они выросли из этого.", "other_language"),
    ("The Iron Plums", None),
    (Q, "copy"),
    ("Answer: what did the sable rooks LEAD TO", "copy"),
    (f"{Q} {Q}", "copy"),
    (f"{Q} The Sable Rooks led to Late Ember.", None),
    ("I can't answer that: nothing is known.", "refusal"),
    ("I can't confirm the rumours, but The Sable Rooks led to Late Ember.", None),
    ("Sorry for the short list; The Sable Rooks led to Late Ember.", None),
    ("No puedo responder a esto.", "refusal"),
    ("", "empty"),
    (None, "empty"),
    ("  ​\n", "empty"),
    ("<p></p>", "empty"),
    ("N/A", "empty"),
    ("...", "empty"),
]


def test_one_pair_of_each_kind(spark):
    got = found(spark, [row(p) for p, _ in CASES])
    assert {CASES[i][0]: got.get(i) for i in range(len(CASES))} == dict(CASES)


def test_flags_and_reasons(spark):
    rows = [row("The Sable Rooks led to Late Ember.", refused=True), row("", reason="name unknown"), row("", reason="n/a"), row("The Sable Rooks led to Late Ember.", reason="name unknown"), row(None, refused=None, reason=None), row("Late Ember.", query=None), row(None, query=None, names=(None, None))]
    assert found(spark, rows) == {0: "refusal", 1: "refusal", 2: "empty", 4: "empty", 6: "empty"}


def test_queries_of_other_languages(spark):
    rows = [row("Late Ember descende de The Sable Rooks.", query="O que nasceu de The Sable Rooks?"), row("Late Ember desciende de The Sable Rooks.", query="O que nasceu de The Sable Rooks?"), row("Aus The Sable Rooks ist Late Ember hervorgegangen.", query="Was ist aus The Sable Rooks hervorgegangen?")]
    assert found(spark, rows) == {1: "other_language"}


def test_a_neighbour_shows_a_cut_name(spark):
    none = (None, None)
    rows = [row("Umber Hol", names=none), row("Umber Hollow", names=none), row("Umber Hollow led to Late Ember.", names=none), row("Umber Hollow", names=none)]
    assert found(spark, rows) == {0: "truncated"}


def test_a_text_between_hides_no_cut_name(spark):
    none = (None, None)
    texts = ["Umber Hol", "Umber Hol [S1]", "Umber Hol\n", "Umber Hol, Sable", "Umber Hollow"]
    got = found(spark, [row(t, names=none) for t in texts], evidence=True)
    assert got[0] == ("truncated", "neighbour") and 4 not in got and 3 not in got


def test_what_a_neighbour_shows(spark):
    rows = [row("The Sable Rooks led to Late Ember. Every link re"), row("The Sable Rooks led to Late Ember the"), row("The Sable Rooks led to Late Em"), row("The Sable Rooks led")]
    assert found(spark, rows, evidence=True) == {i: ("truncated", "neighbour") for i in range(4)}
    # no other text begins like this one: only the text itself shows that it breaks off
    assert found(spark, [row("Sorry, Sorry, the cited list about")], evidence=True) == {0: ("truncated", "itself")}


def test_marks_teach_what_declines(spark):
    assert found(spark, [row("Nothing in these papers settles it, so the matter stays closed.")]) == {0: "refusal"}


def test_few_marks_among_many_pairs_teach(spark):
    many = spark.range(200_000).selectExpr("id", f"'{Q}' query", "'The Sable Rooks led to Late Ember.' prose", "false refused", "'' reason", "array('The Sable Rooks') names_a", "array('Late Ember') names_b", "null defect")
    few = spark.createDataFrame([(-1 - i, Q, "Kept shut by the archive.", i > 0, "", *N, None) for i in range(4)], DDL)
    got = pairs.defects(many.unionByName(few), documents(spark)).collect()
    assert {r["id"]: r["defect"] for r in got} == dict.fromkeys((-1, -2, -3, -4), "refusal")


def test_all_documents_are_counted(spark):
    docs = spark.range(700).selectExpr("id", "if(id < 2, 'Rare word', 'word') text", "if(id % 7 = 0, 'De ', 'en') lang")
    got = {(r["lang"], r["word"]): r["n"] for r in voices.document_words(docs, "id", "text", "lang").collect()}
    assert got == {("en", ""): 600, ("en", "word"): 600, ("de", ""): 100, ("de", "word"): 100}


def test_common_prefixes_against_all_others(spark):
    import random

    r = random.Random(4)
    texts = sorted({"".join(r.choice(["a", "b", "c ", ", ", "é", "𝒳", "1"]) for _ in range(r.randrange(1, 7))) for _ in range(600)}) + ["", None, "a", "a"]
    asked = [t for t in texts[:-2:3] if t]
    df, few = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in asked], "text string")

    def shared(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    others = {t for t in texts if t}
    want = {t: (max(shared(t, o) for o in others - {t}), any(o.startswith(t) and o != t and t[-1].isalpha() and o[len(t)].isalpha() for o in others)) for t in asked}
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = pairs.common_prefixes(df, few).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert len(got) == len(want) and {x["text"]: (x["shared"], x["inside"]) for x in got} == want


def test_a_limit_on_length(spark):
    df = spark.createDataFrame([(i % 50,) for i in range(500)] + [(80,)] * 150 + [(81,)] * 3, "length int")
    assert [r["length"] for r in pairs.limit_lengths(df).collect()] == [80]


def test_a_limit_shows_cut_lists(spark):
    names = [f"{a}{b} {c}{d}" for a in ("Um", "Sel", "Harro", "Tif") for b in ("ber", "do", "kin") for c in ("Hol", "Tarn", "Ri") for d in ("low", "ven", "a")]
    pairs_of = [(a, b) for a in names for b in names if a != b]
    spread = [f"{a}, {b}" for a, b in pairs_of if len(a + b) < 25][:60]
    cut = [t for a, b in pairs_of if len(t := f"{a}, {b}, Late Ember") == 40][:40]
    items = [t for a, b in pairs_of if len(t := f"Recorded:\n- {a}\n- {b}") == 40][:10]
    same = [", ".join(names[:4]) + ", Late Ember"] * 200
    bare = [n for n in names if len(n) == 11]
    texts = spread + cut + items + same + bare
    lengths = [len(t) for t in spread]
    assert len(cut) == 40 and len(items) == 10 and max(lengths) < 35
    got = found(spark, [row(t, names=(["Late Ember"], names)) for t in texts])
    first = len(spread)
    assert got == {i: "truncated" for i in range(first, first + len(cut) + len(items))}
    # without the pile nothing shows a cut
    assert found(spark, [row(t, names=(["Late Ember"], names)) for t in spread + cut[:4] + items[:3] + same]) == {}


def test_bare_names_of_one_length_are_whole(spark):
    rows = [row(f"Ember Tarn {i:03d}", names=(None, None)) for i in range(100)] + [row(f"Umber Tarn {i:04d}", names=([f"Umber Tarn {i:04d}"], None)) for i in range(100)]
    assert found(spark, rows) == {}


def test_no_pairs_and_null_ids(spark):
    docs = documents(spark)
    assert pairs.defects(spark.createDataFrame([], DDL), docs).count() == 0
    assert pairs.defects(spark.createDataFrame([(None, *row(""), None)], DDL), docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [100_000])
def test_very_long_texts(spark, size):
    long = "The Sable Rooks led to Late Ember. " * (size // 35)
    assert found(spark, [row(long), row(long + "Every link re"), row("x" * size)]) == {1: "truncated"}
