"""Defective prompt and response pairs.

Names are masked, so responses of one pattern become one text. The distinct texts are range-sorted
and each open-ended one is compared with its neighbours: where a neighbour shares all of it, or all
but its last word, the neighbour shows how it would have gone on. Lengths at which open-ended
responses pile up show a length limit. What a single text shows (a dangling comma, a cut name) is the
last opinion. Copies are found by expressions; refusals and languages by models fitted on the data
(``voices``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from . import voices

# Words that join the entries of a list.
JOINERS = frozenset({"and", "und", "et", "y", "e", "en", "or", "oder", "ou", "o"})
# Common ways to decline an answer, besides those that the fitted model knows.
DECLINES = [
    r"\b(can't|cannot|can not|couldn't|won't|(un|not )able to|not going to)( \w+)? (answer|help|assist|respond|comment|discuss|speculate)",
    r"\b(rather not|decline to) (guess|say|answer|comment|speculate)",
    r"\b(kann|möchte|darf|will) (ich )?(dazu |hierzu |darüber |leider )*(nichts (sagen|beantworten)|(die|diese) frage nicht|nicht (antworten|helfen|beantworten|weiterhelfen))",
    r"\bne (peux|puis|pouvons|saurais) pas (vous )?(répondre|aider|dire)",
    r"\bno (puedo|podemos|es posible) (responder|contestar|ayudar|decir)",
    r"\bnão (posso|podemos|consigo|é possível) (responder|ajudar|dizer)",
    r"\bnon posso (rispondere|aiutare|dire)",
    r"\bkan ik (niet|geen)\b",
]
# Texts, squashed to letters and digits, that stand for nothing.
PLACEHOLDERS = ["null", "none", "nil", "nan", "na", "undefined", "empty", "noanswer", "noresponse", "answer", "response", "a", "antwort", "keineantwort", "réponse", "sansréponse", "pasderéponse", "respuesta", "sinrespuesta", "resposta", "semresposta", "todo", "tbd"]
# Refusal reasons, squashed, that give none.
NO_REASONS = ["", "na", "none", "null", "nil", "nan", "no", "false", "0"]

NAME_WORDS = 5  # an unknown name has at most so many words
SPIKE = 8  # a length holds a limit when it has so many times the open-ended responses of its neighbours
LAST = chr(0x10FFFF)  # sorts behind every character
_ITEM = re.compile(r"(?:^|\n)\s*(?:[-*•]|\d+[.)])\s+([^\n]*)$")
_HANGING = re.compile(r"(?:[,;:(\[{–—/&«“]|\s-|\.\.\.|…)$")


_BEYOND = re.compile(r"[\W_]+")
_UNSEEN = regex.compile(r"\p{Cf}")
_TAG = re.compile(r"<[^<>]*>")
_LABEL = re.compile(r"^[\W_]*[^\W\d_]+\s?:\s*")
_CITED = re.compile(r"(?:\s*\[[^\W\d_]{0,2}\d+\])+\s*$")
_CLOSED = re.compile(r"[.!?。]['\"”’»)\]]*$")
_THE = re.compile(r"\bThe(?= [A-ZÀ-ÖØ-Þ])")
_BLANKS = re.compile(r"[^\S\n]+")
_LISTED = re.compile(r"§(?:,? (?:[^\W\d_]{1,3} )?§)+")
_ITEMS = re.compile(r"(?:\n- §)+")
_DECLINED = re.compile("|".join(f"(?:{x})" for x in DECLINES))


def squash(text: str) -> str:
    """Letters and digits only, in lower case."""
    return _BEYOND.sub("", text).lower()


def mask(text: str, names: list[str]) -> str:
    """``text`` in lower case with each known name as ``§``, blanks squeezed.

    Longer names go first; a leading 'The' goes with its name.
    """
    text = _THE.sub(" ", text).lower()
    for n in names:
        if n in text:
            text = text.replace(n, voices.NAME)
    return _BLANKS.sub(" ", text).strip()


def folded(text: str) -> str:
    """A masked text with each list of names as one name."""
    return _ITEMS.sub("\n- §", _LISTED.sub("§", text)) if voices.NAME in text else text


def names_of(joined: str | None) -> list[str]:
    """Distinct names in lower case, longest first; also each name without a leading 'the'."""
    low = {x.strip().lower() for x in (joined or "").split(voices.SEP)}
    return sorted((x for x in low | {x.removeprefix("the ") for x in low} if len(x) > 1), key=lambda x: (-len(x), x))


def script_of(text: str) -> str | None:
    """Which script most letters have: 'latin', 'cyrillic', 'greek' or 'other'; null without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else None
    seen = {"latin": 0, "cyrillic": 0, "greek": 0, "other": 0}
    for c in text:
        if c.isalpha():
            cp = ord(c)
            seen["latin" if cp < 0x250 or 0x1E00 <= cp < 0x1F00 else "greek" if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000 else "cyrillic" if 0x400 <= cp < 0x530 else "other"] += 1
    whole = sum(seen.values())
    return None if not whole else "latin" if seen["latin"] * 2 >= whole else next((k for k in ("cyrillic", "greek") if seen[k] * 2 > whole), "other")


_SHOWN = "query string, prose string, flagged boolean, marked boolean, nothing boolean, copied boolean, script boolean, open_ended boolean, several boolean, names string, length int, digest bigint"


def masked(pairs: DataFrame) -> DataFrame:
    """What one pair shows without a model, from ``pairs(id, query, prose, refused, reason, names_a, names_b)``.

    ``query`` and ``prose`` with names masked, citations behind the prose left out. ``flagged``: marked
    as refused; ``marked``: that, or a reason stands where the prose says nothing. ``nothing``: the
    prose says nothing. ``copied``: it only repeats the query. ``script``: it is in another script.
    ``open_ended``: it doesn't end as a sentence does; only then ``names`` are kept, one after the
    other, and the prose's ``digest``. ``several``: it holds more than one name. A null query is never copied and has no language; null names are ignored. Python takes a
    sixth of the time that the same steps took as column expressions, whose loops over names aren't compiled.
    """
    kind = pairs.schema["id"].dataType.simpleString()
    columns = ["id", *(c.split()[0] for c in _SHOWN.split(", "))]

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, q, p, refused, reason, joined in zip(b["id"], b["query"], b["prose"], b["refused"], b["reason"], b["names"], strict=True):
                length, p, q = None if p is None else len(p), p or "", q or ""
                names = names_of(joined)
                seen = p if p.isascii() else _UNSEEN.sub("", p)
                sp, sq = squash(_TAG.sub(" ", seen)), squash(q)
                bare = squash(_LABEL.sub("", p))
                copied = sq != "" and (sp.replace(sq, "") == "" or bare != "" and bare.replace(sq, "") == "")
                nothing = sp == "" or sp in PLACEHOLDERS
                end = _CITED.sub("", p).rstrip()
                closed = bool(_CLOSED.search(end)) and not end.endswith(("...", "…"))
                whole, asked = mask(end, names), folded(mask(q, names))
                text = folded(whole)
                a, z = script_of(text), script_of(asked)
                script = a is not None and z is not None and a != z and len(squash(text)) > 3
                flagged = refused is True or refused == 1
                rows.append((i, asked, text, flagged, flagged or nothing and squash(reason or "") not in NO_REASONS, nothing, copied, script, not closed, whole.count(voices.NAME) > 1, None if closed else voices.SEP.join(names), length, None if closed else xxhash.xxh64_intdigest(p) - (1 << 63)))
            out = pd.DataFrame(rows, columns=columns)
            for c in ("length", "digest"):
                out[c] = out[c].astype("Int64")
            yield out

    flat = pairs.select("id", "query", "prose", "refused", "reason", F.concat_ws(voices.SEP, "names_a", "names_b").alias("names"))
    return flat.mapInPandas(show, f"id {kind}, {_SHOWN}")


def judged(known: DataFrame, model: voices.Model) -> DataFrame:
    """Adds ``defect`` (refusal, empty, copy, other_language, the first that fits, else null) and ``spoken``, whether it holds a word that is no name's, to ``masked`` pairs."""
    shared = known.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("other boolean, declines boolean, spoken boolean")
    def heard(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m, kept = shared.value, {}
        for queries, proses, opens in batches:
            out = []
            for key in zip(queries, proses, opens, strict=True):
                if key not in kept:
                    if len(kept) > 50_000:
                        kept.clear()
                    q, p, is_open = key
                    # the last word of an open-ended text may be a part of one
                    kept[key] = (m.other(q, re.sub(r"\w+$", "", p) if is_open else p), m.declines(p) or bool(_DECLINED.search(p.replace("’", "'"))), m.spoken(p, JOINERS))
                out.append(kept[key])
            yield pd.DataFrame(out, columns=["other", "declines", "spoken"])

    df = known.withColumn("_h", heard("query", "prose", "open_ended"))
    declines = ~F.col("nothing") & ~F.col("copied") & F.col("_h.declines")
    defect = (
        F.when(F.col("marked") | declines, "refusal")
        .when(F.col("nothing"), "empty")
        .when(F.col("copied"), "copy")
        .when(F.col("_h.other") | F.col("script"), "other_language")
    )
    # as the output of a generator the verdict is computed once; a filter behind it isn't pushed below
    return df.select("id", "prose", "open_ended", "several", "names", "length", "digest", F.inline(F.array(F.struct(defect.alias("defect"), F.col("_h.spoken").alias("spoken")))))


def asked_of(prose: str, names: list[str], spoken: bool) -> tuple[str, int, bool, bool]:
    """What to ask about an open-ended masked text: (text to compare, length that a neighbour must share, whether it breaks off by itself, whether it is a list or name).

    A name that is cut at the end stands for the whole one. A text with words of its own must share
    all but its last word; a list or a bare name must be gone on with inside a word, which is asked
    for by a length beyond its own.
    """
    item = _ITEM.search(prose)
    tail = prose[item.start(1) :] if item else prose
    cut = 0
    for n in names:
        for k in range(min(len(n) - 1, len(tail)), cut, -1):
            if tail.endswith(n[:k]) and (k == len(tail) or not tail[-k - 1].isalpha()):
                cut = k
                break
    if item:
        return prose, len(prose) + 1, cut == len(tail) > 0 or len(tail) <= 2 and tail != voices.NAME, True
    if spoken:
        text = prose[: len(prose) - cut] + voices.NAME if cut else prose
        text = re.sub(r"§(?:,? (?:[^\W\d_]{1,3} )?§)+", "§", text)
        return text, len(text) - len(re.search(r"\s*\S*$", text).group()), True, False
    last = re.search(r"[^\W\d_]*$", prose).group()
    return prose, len(prose) + 1, bool(_HANGING.search(prose)) or last in JOINERS or cut > 0, True


def open_texts(open_ended: DataFrame) -> DataFrame:
    """``asked_of`` for rows of ``judged`` without a defect: ``id, text, need, breaks_off, is_list, is_name, length, digest``."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, p, names, spoken, several, length, digest in zip(*(b[c] for c in ("id", "prose", "names", "spoken", "several", "length", "digest")), strict=True):
                text, need, breaks, is_list = asked_of(p, names.split(voices.SEP) if names else [], spoken)
                is_name = is_list and not several and not _ITEM.search(p) and (p == voices.NAME or len(p.split()) <= NAME_WORDS and "," not in p)
                rows.append((i, text, need, breaks, is_list, is_name, length, digest))
            yield pd.DataFrame(rows, columns=["id", "text", "need", "breaks_off", "is_list", "is_name", "length", "digest"])

    kind = open_ended.schema["id"].dataType.simpleString()
    return open_ended.select("id", "prose", "names", "spoken", "several", "length", "digest").mapInPandas(ask, f"id {kind}, text string, need int, breaks_off boolean, is_list boolean, is_name boolean, length int, digest bigint")


def sort_key(text: str) -> str:
    """A key that keeps prefixes and puts what goes on with a letter before what goes on otherwise.

    So of all texts that begin with one text the next in order goes on inside its last word if any
    does, and comparing with the next and the last one alone misses none.
    """
    return "".join(c if c.isalpha() else LAST + c for c in text)


def common_prefixes(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``text, shared, inside`` for the distinct texts of ``asked(text)``, compared with all of ``texts(text)`` and ``asked``.

    ``shared`` is the length of the longest prefix that another text shares, ``inside`` whether
    another text goes on with a letter where this one ends with one. Equal texts are one text. The
    distinct texts are range-partitioned by ``sort_key`` and walked once; in sorted order the
    longest common prefix is one with a neighbour. Neighbours across ranges are found among the
    ranges' ends, two rows each.
    """
    spark = texts.sparkSession
    both = texts.select("text", F.lit(False).alias("asked")).unionByName(asked.select("text", F.lit(True).alias("asked")))
    distinct = both.where("text is not null and text <> ''").groupBy("text").agg(F.max("asked").alias("asked"))
    key = F.regexp_replace("text", r"([^\p{L}])", LAST + "$1")
    ordered = distinct.withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key").select("text", "asked")
    columns = ["text", "shared", "inside", "edge", "part"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            rows = []
            for text, is_asked in zip(batch["text"], batch["asked"], strict=True):
                now = [text, is_asked, 0, False]
                if held is None:
                    first = text
                else:
                    n = _shared(held[0], text)
                    held[2], now[2] = max(held[2], n), n
                    held[3] = _inside(held[0], text)
                    if held[1]:
                        rows.append((held[0], held[2], held[3], None, part))
                held = now
            yield pd.DataFrame(rows, columns=columns)
        if held is not None:
            if held[1]:
                rows = [(held[0], held[2], False, None, part)]
                yield pd.DataFrame(rows, columns=columns)
            yield pd.DataFrame([(first, 0, False, "first", part), (held[0], 0, False, "last", part)], columns=columns)

    seen = Scratch(spark, "neighbours").keep(ordered.mapInPandas(walk, "text string, shared int, inside boolean, edge string, part int"))
    # of a range of one text both ends are that text
    place = W.orderBy("part", "edge")
    edges = seen.where("edge is not null").withColumns({"after": F.lead("text").over(place), "before": F.lag("text").over(place)})

    @F.pandas_udf("shared int, inside boolean")
    def across(text: pd.Series, other: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(_shared(a, b), _inside(a, b)) for a, b in zip(text, other, strict=True)], columns=["shared", "inside"])

    last = edges.where("edge = 'last' and after is not null").select("text", across("text", "after").alias("x"))
    top = edges.where("edge = 'first' and before is not null").select("text", across("text", "before").alias("x")).select("text", F.struct("x.shared", F.lit(False).alias("inside")).alias("x"))
    more = last.unionByName(top).select("text", "x.*")
    return seen.where("edge is null").select("text", "shared", "inside").unionByName(more).groupBy("text").agg(F.max("shared").alias("shared"), F.max("inside").alias("inside"))


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is shared, a[:high] isn't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _inside(short: str, longer: str) -> bool:
    return len(longer) > len(short) > 0 and longer.startswith(short) and short[-1].isalpha() and longer[len(short)].isalpha()


def limit_lengths(lengths: DataFrame) -> DataFrame:
    """The ``length`` values at which open-ended responses pile up, from ``lengths(length)`` of open-ended ones.

    A length counts when it holds ``SPIKE`` times as many as its two neighbours together and one
    more. The histogram has one row per length.
    """
    n = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    near = n.select(F.explode(F.array(F.col("length") - 1, F.col("length") + 1)).alias("length"), F.col("n").alias("m")).groupBy("length").agg(F.sum("m").alias("m"))
    return n.join(near, "length", "left").where(F.col("n") >= SPIKE * (1 + F.coalesce("m", F.lit(0)))).select("length")


def defects(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, defect, evidence`` of every defective pair, at most one defect each, the first that fits.

    The order is refusal, empty, copy, other_language, truncated. ``evidence`` tells how a truncated
    response was found: ``neighbour`` (another text shares all of it but at most its last word, or
    goes on inside its last word), ``limit`` (it has the length of a limit and is no bare name), or
    ``itself`` (it breaks off in words, a name or a list). Copies of a text show no limit: each
    distinct text counts once. ``docs(id, text, lang)`` say what languages look like. Rows with a null
    id are left out; empty input gives no rows.
    """
    scratch = Scratch(pairs.sparkSession, "pairs")
    shown = scratch.keep(masked(pairs.where("id is not null")))
    known = scratch.keep(judged(shown, voices.fit(shown, docs)).where("defect is not null or open_ended"))
    asked = scratch.keep(open_texts(known.where("defect is null")))
    near = common_prefixes(shown.select(F.col("prose").alias("text")), asked.select("text"))
    limits = limit_lengths(asked.where("not is_name").select("digest", "length").distinct().select("length"))
    folded = asked.select("text", "need", "is_list", "breaks_off").distinct()
    found = folded.join(near, "text").where(F.when(F.col("is_list"), F.col("inside") & ~F.col("breaks_off")).otherwise(F.col("shared") >= F.col("need"))).select("text", "need", F.lit(True).alias("near")).distinct()
    late = asked.join(found, ["text", "need"], "left").join(limits.withColumn("limit", F.lit(True)), "length", "left")
    evidence = F.when(F.coalesce("near", F.lit(False)), "neighbour").when(F.coalesce("limit", F.lit(False)) & ~F.col("is_name"), "limit").when(F.col("breaks_off"), "itself")
    truncated = late.withColumn("evidence", evidence).where("evidence is not null").select("id", F.lit("truncated").alias("defect"), "evidence")
    return known.where("defect is not null").select("id", "defect", F.lit("itself").alias("evidence")).unionByName(truncated)
