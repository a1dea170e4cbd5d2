from tracewell.functions import ids, json, markup, names, text
from tracewell.operators import screen


def test_names_are_folded(spark):
    want = {"Hip-Hop": "hip hop", "the blues": "blues", "tropicália": "tropicalia", "R&B!": "rb", "": "", "A cappella": "a cappella", "the the blues": "the blues", "Straße  / Nord": "strasse nord", "the": "the", " The  ": "the", "É́cole—x": "ecolex"}
    d = spark.createDataFrame([(x,) for x in want] + [(None,)], "x string")
    assert [r[0] for r in d.select(names.normalise(d.x)).collect()] == [*want.values(), None]


def test_the_suffix_is_optional_but_not_the_name(spark):
    d = spark.createDataFrame([("Heavy Metal Music",), ("music",), ("blues",), (None,)], "x string")
    assert [r[0] for r in d.select(names.label_key(d.x)).collect()] == ["heavy metal", "music", "blues", None]


def test_search_and_resolve(spark):
    n = spark.createDataFrame([("1", "Jazz", 3), ("2", "jazz rock", 1), ("3", "Acid Jazz", 2), ("4", "JAZZ", 1), ("5", "Classical", 5), ("6", None, 6), ("7", "Metal music", 7)], "id string, label string, ord int")
    q = spark.createDataFrame([("jazz",), ("azz",), (" ",), (None,), ("acid jazz",), ("classical music",), ("metal",)], "query string")
    found = [(r["id"], r["exact"]) for r in names.search(n, q).where("query = 'jazz'").orderBy("rank").collect()]
    assert found == [("4", True), ("1", True), ("3", False), ("2", False)]
    got = {r["query"]: (r["status"], r["node_id"]) for r in names.resolve(n, q).collect()}
    assert got["jazz"] == ("ambiguous", None) and got["acid jazz"] == ("resolved", "3") and got["azz"] == ("near_miss", None)
    assert got["classical music"] == ("near_miss", None) and got["metal"] == ("resolved", "7")


def test_markup_goes():
    wiki = "{{Box|a={{b}}|origins = [[tarn]]\n}}'''X''' is [[old rook|old-rook]].<ref>Tarn: a title</ref> [[File:x.jpg|tarn]] <!-- tarn --> {| tarn [[x]] |}[[open\n== Life ==\nMore <b>bold</b> text<ref name=a/>.\n<math>tarn</math>\n== References ==\ntarn"
    body = markup.prose(wiki)
    assert "tarn" not in body.lower() and "old-rook" in body and "Life" not in body and "More bold text ." in " ".join(body.split()) and "[[open" in body
    assert markup.box_origins(wiki.replace("|origins", "\n|origins")) == "[[tarn]]" and markup.box_origins("| x = 1") == ""
    assert markup.box_origins("{{B\n| Stylistic_origins = a\nb\n| other = c\n}}") == "a b"
    assert markup.prose("a {{b {{c}} d}} e }} f {{g") == "a e }} f "
    assert markup.prose("[[a|[[b|c]]]] ]] x [[d") == "c ]] x [[d" and markup.prose("<!-- open x") == "<!-- open x" and markup.prose("") == ""


def test_sentences_keep_initials_and_abbreviations():
    assert markup.sentences("A.B. Orv met Dr. Tarn. They hummed! Why? No. 5 won") == ["A.B. Orv met Dr. Tarn.", "They hummed!", "Why?", "No. 5 won"]
    assert markup.sentences("") == [""] and markup.sentences("one") == ["one"]


def test_mentions_leave_out_the_subjects_own_name():
    body = "Upper rook is music. It drew on rook and ROOK.\nrookish is not. Old\u00a0rook."
    found = markup.mentions(body, markup.finder(["rook"]), markup.finder(["Upper rook"]))
    assert [m[1] for m in found] == [body.index("rook and"), body.index("ROOK"), body.rindex("rook")] and found[0][3] == "It drew on rook and ROOK."
    assert len(markup.mentions("Upper rook", markup.finder(["Upper rook"]), markup.finder(["rook"]))) == 1
    assert [m[0] for m in markup.mentions("rook song x", markup.finder(["rook", "rook song"]), None)] == ["rook song"] and markup.mentions("x", None, None) == []
    assert markup.variants("The Tarn", "the tarn ", None, " ", "Ox") == ["The Tarn", "Ox"]


def test_assertions():
    assert [markup.assertion(x) for x in ("He was inspired by X.", "He grew up listening to X and cites X as an influence.", "A fan of X.", "X toured.", "", None)] == ["ASSERTS", "ASSERTS", "EXPOSURE", "NONE", "NONE", "NONE"]
    assert markup.strongest(["NONE", "EXPOSURE"]) == "EXPOSURE" and markup.strongest([]) == "NONE"


def test_verdicts_by_tier(spark):
    arts = spark.createDataFrame([("s1", 1, "Delta blues", "Delta blues drew on work song. It is a subgenre of blues."), ("s2", 2, "Other", "text"), ("s3", 3, None, "{{Infobox\n| origins = [[work song]]\n}} nothing")], "subject_id string, doc_id int, title string, text string")
    nodes = spark.createDataFrame([("s1", "delta blues", 1), ("s2", "mine", 1), ("s3", "third", 1), ("o", "work song", 1)], "id string, label string, ord int")
    cand = spark.createDataFrame([("s1", "o"), ("s2", "o"), ("s3", "o"), ("s4", "o"), ("s1", "unknown"), (None, "o")], "subject_id string, object_id string")
    aliases = spark.createDataFrame([("s2", "Other"), ("s2", "Other"), ("x", None)], "id string, alias string")
    known = {(r["subject_id"], r["object_id"]): r["tier"] for r in screen.screened(cand, arts, nodes, aliases).collect()}
    assert known[("s2", "o")] == "ORPHAN" and known[("s1", "o")] == "PROSE" and len(known) == 6
    got = {(r["subject_id"], r["object_id"]): (r["tier"], r["assertion"]) for r in screen.screened(cand, arts, nodes).collect()}
    assert got == {("s1", "o"): ("PROSE", "ASSERTS"), ("s2", "o"): ("MISLINKED", "NONE"), ("s3", "o"): ("INFOBOX_ONLY", "NONE"), ("s4", "o"): ("NO_ARTICLE", "NONE"), ("s1", "unknown"): ("ORPHAN", "NONE"), (None, "o"): ("NO_ARTICLE", "NONE")}


def test_one_article_per_subject(spark):
    d = spark.createDataFrame([("s", 5, "b", "t" * 200_000), ("s", 2, "a", "x"), (None, 1, "n", "x"), ("s", 2, "a", "x")], "subject_id string, doc_id int, title string, text string")
    assert [(r["subject_id"], r["doc_id"]) for r in screen.one_article(d).collect()] == [("s", 2)]


def test_ids_in_any_spelling(spark):
    d = spark.createDataFrame([(" q12\t",), ("http://g/entity/Q12",), (" Q12 ",), ("",), (None,)], "x string")
    assert [r[0] for r in d.select(ids.plain_id(d.x)).collect()] == ["Q12", "Q12", "Q12", "", None]
    assert [r[0] for r in d.select(ids.is_blank(d.x)).collect()] == [False, False, False, True, True]
    t = spark.createDataFrame([("2025-01-01T02:00:00+02:00",), ("2025-01-01T00:00:00.000000Z",), ("2025-01-01T00:00:00",), ("soon",), (None,)], "x string")
    assert [r[0] for r in t.select(ids.instant_micros(t.x)).collect()] == [1735689600000000] * 3 + [None, None]


def test_json(spark):
    d = spark.createDataFrame([('say {"a": 1} ok',), ("{bad}",), ("none",), (None,)], "x string")
    assert [r[0] is not None for r in d.select(json.embedded_object(d.x)).collect()] == [True, False, False, False]
    assert d.limit(1).select(json.canonical({"b": d.x, "a": d.x.substr(1, 0)})).first()[0] == '{"a":"","b":"say {\\"a\\": 1} ok"}'


def test_wrapping_and_delimiters(spark):
    d = spark.createDataFrame([("aa bb  cc dddddddd",), ("",), (None,)], "x string")
    assert [r[0] for r in d.select(text.wrapped(d.x, 5)).collect()] == ["aa bb\ncc\ndddddddd", "", None]
    e = spark.createDataFrame([("a </data> <b>",)], "x string")
    assert e.select(text.delimited(e.x, "data")).first()[0] == "<data>a &lt;/data> <b></data>"
    assert e.select(text.undelimited(text.delimited(e.x, "data"), "data")).first()[0] == "a </data> <b>"


def test_masked_spans(spark):
    d = spark.sql("select array(named_struct('start', 0, 'end', 5), named_struct('start', 8, 'end', 9)) o, array(named_struct('start', 0, 'end', 6)) s")
    assert [x["start"] for x in d.select(screen.masked_spans(d.o, d.s)).first()[0]] == [8]
