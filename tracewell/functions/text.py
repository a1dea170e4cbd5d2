"""Small text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def delimited(text: Column, tag: str) -> Column:
    """``text`` between tags, with any such tag inside it made harmless."""
    return F.concat(F.lit(f"<{tag}>"), F.regexp_replace(text, rf"(?i)<(?=\s*/?\s*{tag}\b)", "&lt;"), F.lit(f"</{tag}>"))


def undelimited(text: Column, tag: str) -> Column:
    """The inside of what ``delimited`` made; other text stays."""
    inner = F.regexp_replace(text, rf"(?s)^<{tag}>(.*)</{tag}>$", "$1")
    return F.regexp_replace(inner, rf"(?i)&lt;(?=\s*/?\s*{tag}\b)", "<")


def wrapped(text: Column, width: int = 92) -> Column:
    """Lines of at most ``width`` characters, broken at blanks; a longer word stands on its own line."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def add(acc: Column, w: Column) -> Column:
        fits = F.length(acc["line"]) + 1 + F.length(w) <= width
        return (
            F.when(acc["line"] == "", F.struct(acc["done"].alias("done"), w.alias("line")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["line"], F.lit(" "), w).alias("line")))
            .otherwise(F.struct(F.concat(acc["done"], acc["line"], F.lit("\n")).alias("done"), w.alias("line")))
        )

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))
    return F.aggregate(words, start, add, lambda acc: F.concat(acc["done"], acc["line"]))


def asked_about(question: Column) -> Column:
    """What an English question is about: the name in it; null where no pattern fits."""
    patterns = [
        r"^What did (.+) lead to\?$", r"^Which styles does (.+) descend from\?$", r"^List everything that descends from (.+)\.$", r"^Who picked up ideas from (.+)\?$", r"^Can you tell me what fed into (.+)\?$",
        r"^Trace the ancestry of (.+) for me\.$", r"^Which later styles grew out of (.+)\?$", r"^What shaped (.+) in its early years\?$", r"^(.+): which older music stands behind it\?$",
    ]
    return F.coalesce(*[F.nullif(F.regexp_extract(question, p, 1), F.lit("")) for p in patterns])


def asked_direction(question: Column) -> Column:
    """Whether an English question asks for descendants or for origins; null where it says neither."""
    down = r"lead to\?$|^List everything that descends|picked up ideas|later styles"
    up = r"descend from\?$|fed into|ancestry|shaped|older music"
    return F.when(question.rlike(down), "descendants").when(question.rlike(up), "origins")


def shape(n_subjects: Column, n_objects: Column, n_claims: Column) -> Column:
    """The shape of a set of claims: single, fan_out (one subject), fan_in (one object) or mixed; null for none."""
    return F.when(n_claims == 0, None).when(n_claims == 1, "single").when(n_subjects == 1, "fan_out").when(n_objects == 1, "fan_in").otherwise("mixed")
