from tracewell.llm import lookalikes
import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import lookalikes as la

NORM = la.Normaliser(la.mapping())


def plain(text):
    return unicodedata.normalize("NFC", "".join(la._shown(ord(c)) for c in text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=8))
def test_batches_equal_one_text_at_a_time(texts):
    assert NORM(texts) == [plain(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_the_form_is_stable(text):
    once = NORM([text])
    assert NORM(once) == once


def test_what_looks_the_same_and_what_doesnt():
    same = [("ｆｕｌｌ", "full"), ("a​b", "ab"), ("a b　c", "a b c"), ("é", "é"), ("раrаdоx", "paradox"), ("\u212bngstr\u00f6m", "A\u030angstro\u0308m"), ("q̣̇", "q̣̇"), ("ﬁn", "fin"), (";", ";"), ("so­ft", "soft"), ("ё", "ë")]
    for a, b in same:
        assert NORM([a]) == NORM([b]), (a, b)
    different = [("m²", "m2"), ("e", "é"), ("A", "a"), ("1", "7"), ("a b", "a  b"), ("a\nb", "a b"), ("ß", "ss"), ("я", "r"), ("́a", "a")]
    for a, b in different:
        assert NORM([a]) != NORM([b]), (a, b)


def test_pairs_against_all_pairs(spark):
    r = random.Random(1)
    base = ["note one", "note two", "café", "Bach", "", "x" * 70_000]

    def disguise(t):
        return "".join(r.choice([c, c, c, "​" + c, {"a": "а", "o": "о", "e": "е", " ": " "}.get(c, c)]) for c in t[:20]) + t[20:]

    docs = [(i, disguise(r.choice(base)) if r.random() < 0.5 else r.choice(base)) for i in range(150)] + [(900, None), (None, "café")]
    known = la.classes(spark.createDataFrame([(i, t, "doc") for i, t in docs], "id bigint, text string, doc string"), "id", "text")
    held = [(i, t) for i, t in docs if i is not None and t is not None]
    form = {t: plain(t) for _, t in held}
    want = {(a, b) for a, t in held for b, u in held if a < b and t != u and form[t] == form[u]}
    got = [tuple(x) for x in la.look_alike_pairs(known).collect()]
    assert set(got) == want and len(got) == len(want)
    classes = {x["doc_id"]: x for x in la.look_classes(known).collect()}
    assert len(classes) == len(held)
    for i, t in held:
        alike = [j for j, u in held if form[u] == form[t]]
        assert classes[i]["class_id"] == min(alike) and classes[i]["n_alike"] == sum(u != t for j, u in held if j in alike)


def test_many_copies_make_no_pairs(spark):
    known = la.classes(spark.createDataFrame([(i, "same") for i in range(3000)] + [(5000, "sаme")], "id bigint, text string"), "id", "text")
    pairs = la.look_alike_pairs(known)
    assert pairs.count() == 3000 and pairs.where("doc_id_b <> 5000").count() == 0


def test_empty(spark):
    known = la.classes(spark.createDataFrame([], "id bigint, text string"), "id", "text")
    assert la.look_alike_pairs(known).count() == 0 and la.look_classes(known).count() == 0


def test_letters_of_many_scripts_and_fonts():
    n = lookalikes.Normaliser(lookalikes.mapping())
    shown = {"ρν": "pv", "α": "a", "ѵ": "v", "ı": "i", "𝐫𝟗": "r9", "ⅼⅣ": "lIV", "ᴏ": "o", "ꓚ": "C", "Ꭰ": "D", "П": "Π", "фΦФ": "φΦΦ", "µ": "μ"}
    assert dict(zip(shown, n(list(shown)), strict=True)) == shown
    for a, b in [("²", "2"), ("é", "e"), ("ʀ", "r"), ("ⓐ", "a"), ("Л", "Λ"), ("O", "0")]:
        assert n([a]) != n([b])


def test_copies_of_hot_variants(spark):
    rows = [(i, "Tarn 1") for i in range(400)] + [(1000 + i, "Tаrn\u00a01") for i in range(3)] + [(2000 + i, f"lone {i}") for i in range(20)]
    known = lookalikes.Scratch(spark, "looks").keep(lookalikes.classes(spark.createDataFrame(rows, "d bigint, t string"), "d", "t"))
    got = {tuple(r) for r in lookalikes.look_alike_pairs(known).collect()}
    assert got == {(i, 1000 + j) for i in range(400) for j in range(3)}
    by = {r["doc_id"]: r["n_alike"] for r in lookalikes.look_classes(known).collect()}
    assert by[0] == 3 and by[1000] == 400 and by[2000] == 0 and len(by) == 423
