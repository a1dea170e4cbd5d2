"""Texts that look the same brought to one form.

A batch of texts is exploded into one array of code points with the text each belongs to. Code
points are joined with a broadcast mapping (canonical decomposition, width forms, kinds of space,
invisible characters, look-alike letters), combining marks are put in the order of their classes,
marks are recomposed with their letters, and the strings are rebuilt. The array operations run over
whole batches, and no row of a code point ever leaves its task, so normalising takes no shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import even_lookup
from ..plans.scratch import Scratch

# Letters drawn like another one, and that one. Most are drawn like a Latin letter; those
# behind the last Latin row are Cyrillic letters drawn like Greek ones.
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "ɡ": "g", "ı": "i", "ǃ": "!", "‐": "-", "‑": "-", "Օ": "O", "օ": "o", "Ս": "U", "հ": "h",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "П": "Π", "Г": "Γ", "Ф": "Φ", "Ѳ": "Θ", "Ѱ": "Ψ", "ф": "φ", "к": "κ", "ѳ": "θ", "ѱ": "ψ",
}
# Fixed value: Latin letters whose small form is drawn as the capital one, so small capitals look like small letters.
SAME_IN_BOTH = "COSUVWXZ"
# Format characters that are drawn, though of the category of invisible ones.
DRAWN_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
# Invisible characters outside of that category.
INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
LIGATURES = range(0xFB00, 0xFB07)
BREAK = 0x110000  # stands between two texts


def _shown(cp: int) -> str:
    """What a code point shows, decomposed: '' for an invisible one."""
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if cp in INVISIBLE or kind == "Cf" and cp not in DRAWN_FORMATS:
        return ""
    if kind == "Zs" or ch == "\t":
        return " "
    if kind in ("Zl", "Zp"):
        return "\n"
    tag = unicodedata.decomposition(ch).split(" ")[0]
    name = unicodedata.name(ch, "")
    if name.startswith("LATIN LETTER SMALL CAPITAL ") and name[-2] == " " and name[-1] in SAME_IN_BOTH:
        return name[-1].lower()
    # letters and digits in another font, Roman numerals, the micro sign: drawn as what they stand for
    if tag in ("<wide>", "<narrow>", "<noBreak>", "<font>") or cp in LIGATURES or "ROMAN NUMERAL" in name or cp == 0xB5:
        inner = unicodedata.normalize("NFKD", ch)
    else:
        inner = unicodedata.normalize("NFD", ch)
    return "".join(LOOK_ALIKE.get(c, c) if c == ch else (_shown(ord(c)) if c != ch else c) for c in inner)


@lru_cache(maxsize=1)
def mapping() -> dict:
    """The mapping as arrays: its size is fixed by Unicode (some 13,000 entries), whatever the data."""
    ranges = (range(0x80, 0xD800), range(0xE000, 0x30000), range(0xE0000, 0xE0200))
    shown = {9: " "}
    for r in ranges:
        for cp in r:
            s = _shown(cp)
            if s != chr(cp):
                shown[cp] = s
    keys = np.array(sorted(shown), dtype=np.uint32)
    lens = np.array([len(shown[k]) for k in keys], dtype=np.int64)
    flat = np.frombuffer("".join(shown[k] for k in keys).encode("utf-32-le"), dtype=np.uint32)
    classes = [(cp, c) for r in ranges for cp in r if (c := unicodedata.combining(chr(cp)))]
    return {"keys": keys, "lens": lens, "flat": flat, "marks": np.array([c[0] for c in classes], dtype=np.uint32), "classes": np.array([c[1] for c in classes], dtype=np.uint8)}


class Normaliser:
    """Brings batches of texts to the one form; made once per task from ``mapping()``."""

    def __init__(self, m: dict):
        top = 0x110001
        self.index = np.full(top, -1, dtype=np.int32)
        self.index[m["keys"]] = np.arange(len(m["keys"]), dtype=np.int32)
        self.lens = m["lens"]
        self.starts = np.concatenate([[0], np.cumsum(m["lens"])[:-1]])
        self.flat = m["flat"]
        self.ccc = np.zeros(top, dtype=np.uint8)
        self.ccc[m["marks"]] = m["classes"]
        self.composed: dict[int, int] = {}
        self.sequences: dict[str, str] = {}

    def __call__(self, texts: list[str]) -> list[str]:
        """The texts' one form. Texts of plain ASCII without tabs are in it already."""
        todo = [i for i, t in enumerate(texts) if not (t.isascii() and "\t" not in t)]
        out = list(texts)
        if todo:
            for i, t in zip(todo, self._batch([texts[i] for i in todo]), strict=True):
                out[i] = t
        return out

    def _batch(self, texts: list[str]) -> list[str]:
        # explode: code points of all texts, with a break before each text
        lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        body = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        cps = np.insert(body, np.cumsum(lens) - lens, BREAK)
        # join with the mapping: each code point gives none, one or several
        hit = self.index[cps]
        mapped = hit >= 0
        n = np.ones(len(cps), dtype=np.int64)
        n[mapped] = self.lens[hit[mapped]]
        first = np.cumsum(n) - n
        wide = np.repeat(cps, n)
        at = np.flatnonzero(mapped & (n > 0))
        k = n[at]
        inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        wide[np.repeat(first[at], k) + inner] = self.flat[np.repeat(self.starts[hit[at]], k) + inner]
        # order marks by class behind their letter
        ccc = self.ccc[wide]
        marks = np.flatnonzero(ccc)
        if len(marks):
            letter = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(wide)), 0))[marks]
            order = np.lexsort((marks, ccc[marks], letter))
            wide[marks] = wide[marks[order]]
            wide = self._compose(wide, marks, letter)
        # rebuild
        cuts = np.flatnonzero(wide == BREAK)
        whole = np.delete(wide, cuts).astype(np.uint32).tobytes().decode("utf-32-le")
        ends = np.append(cuts[1:], len(wide)) - np.arange(1, len(cuts) + 1)
        begins = cuts - np.arange(len(cuts))
        return [self._jamo(whole[b:e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]

    def _compose(self, wide: np.ndarray, marks: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Puts letters and their marks together where one code point shows them."""
        uniq, first, count = np.unique(letter, return_index=True, return_counts=True)
        gone = np.zeros(len(wide), dtype=bool)
        out = wide.copy()
        single = (count == 1) & (wide[uniq] != BREAK)
        base, mark = uniq[single], marks[first[single]]
        pairs = wide[base].astype(np.int64) << 21 | wide[mark]
        kinds, back = np.unique(pairs, return_inverse=True)
        one = np.fromiter((self._pair(int(p)) for p in kinds), dtype=np.int64, count=len(kinds))[back]
        good = one >= 0
        out[base[good]] = one[good]
        gone[mark[good]] = True
        for b, f, c in zip(*(x[(count > 1) & (wide[uniq] != BREAK)].tolist() for x in (uniq, first, count)), strict=True):
            seq = wide[b : b + c + 1].astype(np.uint32).tobytes().decode("utf-32-le")
            made = self.sequences.get(seq)
            if made is None:
                made = self.sequences[seq] = unicodedata.normalize("NFC", seq)
            new = np.frombuffer(made.encode("utf-32-le"), dtype=np.uint32)
            out[b : b + len(new)] = new
            gone[b + len(new) : b + c + 1] = True
        return out[~gone]

    def _pair(self, pair: int) -> int:
        got = self.composed.get(pair)
        if got is None:
            made = unicodedata.normalize("NFC", chr(pair >> 21) + chr(pair & 0x1FFFFF))
            got = self.composed[pair] = ord(made) if len(made) == 1 else -1
        return got

    @staticmethod
    def _jamo(text: str) -> str:
        """Letters that compose with letters (Hangul and a few others) are left to the library."""
        return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


BATCH_CHARS = 2_000_000


def one_form(spark, text: Column) -> Column:
    """The one form of a text column; null stays null, '' stays ''. Texts are taken whole, of any length."""
    shared = spark.sparkContext.broadcast(mapping())

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        norm = Normaliser(shared.value)
        for s in batches:
            texts = s.fillna("").tolist()
            out, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size >= BATCH_CHARS:
                    out += norm(part)
                    part, size = [], 0
            out += norm(part)
            yield pd.Series(out, index=s.index, dtype=object).where(s.notna(), None)

    return form(text)


def classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, look, variant``: digests of each text's one form and of the text itself.

    Texts of one ``look`` look the same, texts of one ``variant`` are the same. Rows with a null id or
    null text have no look and are left out; empty texts look like each other.
    """
    held = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    return held.select("doc", F.md5(one_form(docs.sparkSession, F.col("text"))).alias("look"), F.md5("text").alias("variant"))


def look_alike_pairs(known: DataFrame) -> DataFrame:
    """``doc_id_a, doc_id_b`` (smaller first) of each two documents of one look and different variants.

    Copies are folded to their variant first, and a document is led from its variant to the other
    variants of its look and on to their documents. So copies of one text never meet each other. The
    rows of a variant with many copies are dealt to several tasks at both steps. There are as many
    rows as documents that look alike in pairs, n * m for n and m copies of two variants:
    ``look_classes`` says the same in one row per document. Read ``known`` from a written table.
    """
    variants = known.groupBy("look", "variant").agg(F.count(F.lit(1)).alias("n"))
    several = variants.groupBy("look").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("look")
    scratch = Scratch(known.sparkSession, "variants")
    alive = scratch.keep(variants.join(several, "look", "left_semi").select("look", "variant"))
    other = alive.join(alive.withColumnRenamed("variant", "other"), "look").where("variant <> other").select("variant", "other")
    led = even_lookup(known.select(F.col("doc").alias("doc_id_a"), "variant"), other, "variant").select("doc_id_a", "other")
    b = known.select(F.col("doc").alias("doc_id_b"), F.col("variant").alias("other"))
    return even_lookup(scratch.keep(led), b, "other").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


def look_classes(known: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (the smallest id of its look), ``n_variants`` and ``n_alike``, the documents of another text that look the same.

    Documents of a variant with many copies are dealt to several tasks. Read ``known`` from a written table.
    """
    variants = known.groupBy("look", "variant").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"))
    looks = variants.groupBy("look").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("n_variants"), F.sum("n").alias("total"))
    both = variants.join(looks, "look").select("variant", "class_id", "n_variants", (F.col("total") - F.col("n")).alias("n_alike"))
    return even_lookup(known.select(F.col("doc").alias("doc_id"), "variant"), both, "variant").select("doc_id", "class_id", "n_variants", "n_alike")


def one_form_sql(text: str) -> str:
    """The one form of a text as an expression of DuckDB, made from the same rule."""
    single, gone, several = {}, [], {}
    for cp in map(int, mapping()["keys"]):
        ch, form = chr(cp), unicodedata.normalize("NFC", _shown(cp))
        if form == unicodedata.normalize("NFC", ch):
            continue
        if len(form) == 1:
            single[ch] = form
        elif form:
            several[ch] = form
        else:
            gone.append(ch)

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    out = f"translate({text}, {quoted(''.join(single) + ''.join(gone))}, {quoted(''.join(single.values()))})"
    for ch, form in several.items():
        out = f"replace({out}, {quoted(ch)}, {quoted(form)})"
    return f"nfc_normalize({out})"
