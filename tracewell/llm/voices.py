"""Which language a short text is in, and whether it declines to answer: models fitted on the data.

Both count words of texts whose names are masked (naive Bayes, and the mean lift of a text's words).
They are fitted on all pairs and documents: executors count, and what comes to the driver is counts
per known word, or pair of words, and language. Words of names are left out: a word counts only where it
stands in more masked texts than in names.

* Languages start from documents that say theirs, by the words and the parts of words in them, and
  are then fitted anew on pairs: a prompt and its response are mostly in one language, so each pair
  is given the language that fits it as a whole and the words are counted again, until no pair moves.
* Declining is fitted on the pairs marked as refused. The mark is often wrong either way, so texts
  whose words are marked far oftener than others are taken as declining, and it is fitted once more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

LEAST_SEEN = 3  # texts that must hold a word before it counts
LEAST_SHARE = 0.005  # of the pairs, what a language must have at first
SEP = "\x1f"  # between the names of a pair
NAME = "§"
ROUNDS = 12

_WORD = re.compile(r"[^\W\d_]+(?:'(?=[^\W\d_]))?|§")


def words_of(text: str) -> list[str]:
    """Words in lower case; an apostrophe stays with the word before it. A masked name is ``§``."""
    return _WORD.findall(text.lower())


def _parts(word: str) -> set[str]:
    w = f" {word} "
    return {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)}


@dataclass
class Model:
    """What words tell: log likelihoods per language, and the log lift of declining per word or pair of words."""

    languages: list[str] = field(default_factory=list)
    words: dict[str, np.ndarray] = field(default_factory=dict)
    declining: dict[str, float] = field(default_factory=dict)

    def language(self, text: str) -> np.ndarray | None:
        """The log likelihood per language; None where no word is known."""
        hits = [self.words[w] for w in set(words_of(text)) if w in self.words]
        return np.sum(hits, axis=0) if hits else None

    def other(self, query: str, prose: str) -> bool:
        """Whether the prose is in another language than the query, as far as known words tell."""
        q, p = self.language(query), self.language(prose)
        return q is not None and p is not None and int(np.argmax(q)) != int(np.argmax(p)) and p.max() - p[int(np.argmax(q))] > MARGIN

    def declines(self, prose: str) -> bool:
        hits = [self.declining[g] for g in grams(prose) if g in self.declining]
        return bool(hits) and sum(hits) > 0

    def spoken(self, text: str, joiners: frozenset[str]) -> bool:
        """Whether the text holds a known word besides those that join the entries of a list."""
        return any(w in self.words and w not in joiners for w in words_of(text))


MARGIN = 2.0  # log likelihood by which another language must fit better
LIFT = 0.7  # mean log lift of a text's words among marked pairs, from which they show that it declines


def grams(text: str) -> set[str]:
    ws = [w for w in words_of(text) if w != NAME]
    return {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))}


def _summed(df: DataFrame, count: Callable[[pd.DataFrame], dict], keys: str, sums: str) -> DataFrame:
    """Adds up, over all rows, what ``count`` gives for a batch: ``{key or keys: numbers}``, in columns named by the two DDL strings."""
    key, add = ([c.split()[0] for c in x.split(", ")] for x in (keys, sums))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(*(k if isinstance(k, tuple) else (k,)), *v) for k, v in count(b).items()], columns=[*key, *add])

    return df.mapInPandas(counted, f"{keys}, {sums}").groupBy(*key).agg(*[F.sum(c).alias(c) for c in add])


def document_words(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """``lang, word, n``: in how many documents of a language a word stands, from two on, and all its documents under the empty word.

    Documents without an id, a text or a language are left out; language names are compared in lower case without
    outer blanks.
    """
    named = docs.where(F.col(doc_id).isNotNull()).select(F.lower(F.trim(F.col(lang))).alias("lang"), F.col(text).alias("text")).where("lang <> '' and text is not null")
    tokens = F.array_distinct(F.filter(F.split(F.lower("text"), r"(?U)[^\p{L}]+"), lambda x: (x != "") & (F.length(x) <= 30)))
    return named.select("lang", F.explode(F.array_append(tokens, F.lit("")).alias("word")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2 or word = ''")


def fit(pairs: DataFrame, docs: DataFrame) -> Model:
    """The model from all of ``pairs(query, prose, flagged, names)`` with names masked, ``names`` joined by ``SEP``, and of ``docs(id, text, lang)``.

    Equal texts are counted once, with their number. The driver holds the known words, and the pairs
    of words among them, that ``LEAST_SEEN`` texts hold: the model itself.
    """
    scratch = Scratch(pairs.sparkSession, "voices")
    texts = scratch.keep(pairs.groupBy("query", "prose").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("k")))

    def heard(b: pd.DataFrame) -> dict:
        out: dict[str, list[int]] = {}
        for q, p, n in zip(b["query"], b["prose"], b["n"], strict=True):
            q, p = frozenset(words_of(q)), frozenset(words_of(p))
            for w in q | p:
                cell = out.setdefault(w, [0, 0, 0])
                cell[0] += n
                # words of unknown names stand alone; those of a language stand around names
                cell[1] += n * ((NAME in q and w in q) + (NAME in p and w in p))
        return out

    def named(b: pd.DataFrame) -> dict:
        out = Counter()
        for joined in b["names"]:
            out.update({w for n in joined.split(SEP) if not n.startswith("the ") for w in words_of(n)})
        return {w: (0, 0, n) for w, n in out.items()}

    sums = "seen bigint, around bigint, named bigint"
    both = _summed(texts.select("query", "prose", "n"), heard, "word string", sums).unionByName(_summed(pairs.where("names <> ''").select("names"), named, "word string", sums))
    known = both.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("seen", "around", "named")]).where((F.col("seen") >= LEAST_SEEN) & (F.col("seen") > 2 * F.col("named")) & (F.col("word") != NAME))
    vocabulary = scratch.keep(known)
    rows = vocabulary.collect()
    model = Model()
    if rows:
        around = (F.col("around") >= LEAST_SEEN) & (2 * F.col("around") > F.col("seen"))
        _fit_languages(model, vocabulary.where(around).select("word"), texts, scratch.keep(document_words(docs, "id", "text", "lang")), scratch)
        _fit_declining(model, texts, {r["word"] for r in rows})
    return model


def _priors(words: list[str], spoken: DataFrame, doc_words: DataFrame, scratch: Scratch) -> tuple[list[str], np.ndarray]:
    """The languages, and per word the share of each one's documents that hold it; of a word no document has, what its parts tell."""

    def parts_of(b: pd.DataFrame) -> dict:
        return {k: (n,) for k, n in Counter((lang, g) for lang, word in zip(b["lang"], b["word"], strict=True) for g in _parts(word)).items()}

    parts = scratch.keep(_summed(doc_words.where("word <> ''").select("lang", "word"), parts_of, "lang string, part string", "n bigint"))
    total = {r["lang"]: r["n"] for r in doc_words.where("word = ''").collect()}
    whole = {r["lang"]: r["n"] for r in parts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(whole)
    k = len(languages)
    if k < 2 or not words:
        return languages, np.zeros((len(words), 1))
    at = {lang: i for i, lang in enumerate(languages)}
    share: dict[str, np.ndarray] = {}
    for r in doc_words.join(spoken, "word").collect():
        share.setdefault(r["word"], np.zeros(k))[at[r["lang"]]] = r["n"] / total[r["lang"]]
    ours = _summed(spoken, lambda b: dict.fromkeys({g for w in b["word"] for g in _parts(w)}, (1,)), "part string", "m bigint").select("part")
    held: dict[str, np.ndarray] = {}
    for r in parts.join(ours, "part").collect():
        held.setdefault(r["part"], np.zeros(k))[at[r["lang"]]] = r["n"]
    sums = np.array([whole[lang] for lang in languages], dtype=float)
    prior = np.full((len(words), k), 1e-4)
    for i, w in enumerate(words):
        if w in share:
            prior[i] = share[w] + 1e-3
        hits = [np.log((held[g] + 0.5) / (sums + 1)) for g in sorted(_parts(w)) if g in held]
        if hits:
            fit_ = np.mean(hits, axis=0) * 2
            lean = np.exp(fit_ - fit_.max())
            prior[i] = prior[i] * lean / lean.max() + 1e-5 if w in share else 2e-3 * lean / lean.sum() + 1e-5
    return languages, prior


def _fit_languages(model: Model, spoken: DataFrame, texts: DataFrame, doc_words: DataFrame, scratch: Scratch) -> None:
    words = sorted(r["word"] for r in spoken.collect())
    languages, prior = _priors(words, spoken, doc_words, scratch)
    k = len(languages)
    if k < 2 or not words:
        model.words = {w: np.zeros(1) for w in words}
        return
    sc = texts.sparkSession.sparkContext
    index = sc.broadcast({w: i for i, w in enumerate(words)})

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = index.value
        for b in batches:
            held = [sorted({at[w] for w in (*words_of(q), *words_of(p)) if w in at}) for q, p in zip(b["query"], b["prose"], strict=True)]
            yield pd.DataFrame({"held": held, "n": b["n"]})

    numbers = texts.select("query", "prose", "n").mapInPandas(numbered, "held array<int>, n bigint").where("size(held) > 0")
    held = scratch.keep(numbers.groupBy("held").agg(F.sum("n").alias("n")))

    def told(table: np.ndarray, shut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that hold a word, by the language they fit best, and pairs of a language."""
        shared = sc.broadcast((table, shut))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, shut = shared.value
            counts = np.zeros((len(table) + 1, len(shut)))  # the last row: all pairs
            for b in batches:
                lists, times = b.column(0), b.column(1).to_numpy(zero_copy_only=False).astype(float)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(times)), lists.value_lengths().to_numpy(zero_copy_only=False))
                score = np.zeros((len(times), len(shut)))
                np.add.at(score, owner, table[flat])
                now = np.argmax(score + shut, axis=1)
                np.add.at(counts, (flat, now[owner]), times[owner])
                np.add.at(counts, (len(table), now), times)
            word, lang = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(lang, pa.int64()), pa.array(counts[word, lang], pa.float64())], ["word", "lang", "n"])

        got = held.mapInArrow(count, "word bigint, lang bigint, n double").groupBy("word", "lang").agg(F.sum("n").alias("n")).collect()  # words times languages
        shared.destroy()
        counts = np.zeros((len(words) + 1, k))
        for r in got:
            counts[r["word"], r["lang"]] = r["n"]
        return counts[:-1], counts[-1]

    table, before = np.log(prior), None
    # languages hardly any pair is in don't take part
    first = told(table, np.zeros(k))[1]
    shut = np.where(first >= LEAST_SHARE * first.sum(), 0.0, -np.inf)
    for _ in range(ROUNDS):
        counts, sizes = told(table, shut)
        if before is not None and (counts == before[0]).all() and (sizes == before[1]).all():
            break
        before = counts, sizes
        table = np.log((counts + 30 * prior + 0.02) / (sizes + 30))
    model.languages = languages
    table = np.where(np.isinf(shut), -1e6, table)
    model.words = {w: table[i] for i, w in enumerate(words)}


def _fit_declining(model: Model, texts: DataFrame, known: set[str]) -> None:
    sc = texts.sparkSession.sparkContext
    vocabulary = sc.broadcast(known)
    said = texts.select("prose", "n", "k")

    def marks(b: pd.DataFrame) -> dict:
        """Per word or pair of known words the texts that hold it and those of them that are marked; under the empty one all texts."""
        out: dict[str, list[float]] = {}
        for p, n, k in zip(b["prose"], b["n"], b["k"], strict=True):
            if p.strip():
                for g in ("", *(g for g in grams(p) if all(w in vocabulary.value for w in g.split()))):
                    cell = out.setdefault(g, [0.0, 0.0])
                    cell[0] += n
                    cell[1] += k
        return out

    def counts(of: Callable[[pd.DataFrame], dict]) -> dict[str, tuple[float, float]]:
        return {r["gram"]: (r["n"], r["k"]) for r in _summed(said, of, "gram string", "n double, k double").where(F.col("n") >= LEAST_SEEN).collect()}

    def lifts(seen: dict[str, tuple[float, float]], whole: tuple[float, float]) -> dict[str, float]:
        base = whole[1] / whole[0]
        return {g: float(np.clip(np.log((k + 5 * base) / (n + 5) / base), -2, 3)) for g, (n, k) in seen.items()}

    seen = counts(marks)
    whole = seen.pop("", (0.0, 0.0))
    if not seen or not whole[1]:
        return
    lift = sc.broadcast(lifts(seen, whole))

    def shows(b: pd.DataFrame) -> dict:
        """The same, where the mark, which is often wrong, is replaced by what the words of a text show."""
        found = lift.value
        out: dict[str, list[float]] = {}
        for p, n in zip(b["prose"], b["n"], strict=True):
            if p.strip():
                hits = sorted(g for g in grams(p) if g in found)
                side = n * (sum(found[g] for g in hits) / max(len(hits), 1) > LIFT)
                for g in ("", *hits):
                    cell = out.setdefault(g, [0.0, 0.0])
                    cell[0] += n
                    cell[1] += side
        return out

    seen = counts(shows)
    whole = seen.pop("", (0.0, 0.0))
    if whole[1]:
        model.declining = lifts(seen, whole)
