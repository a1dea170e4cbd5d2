"""JSON read tolerantly, written canonically, and digested."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def embedded_object(text: Column) -> Column:
    """The VARIANT of the text from the first '{' to the last '}'; null where that isn't JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))


def canonical(fields: dict[str, Column]) -> Column:
    """A JSON object text with its keys in alphabetical order and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    """SHA-256 as hexadecimal digits."""
    return F.sha2(text, 256)


def running_digest(name: Column, body: Column) -> Column:
    """A digest of name, a zero byte and body, so that neither can pass for part of the other."""
    return F.sha2(F.concat(name.cast("binary"), F.lit(b"\0"), body.cast("binary")), 256)
