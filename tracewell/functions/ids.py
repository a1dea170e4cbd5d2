"""Node ids and times as the tables deliver them, brought to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_id(col: Column) -> Column:
    """The plain form of an id: no outer blanks, the tail of a URI, upper case. Null stays null, blank becomes ''."""
    return F.upper(F.substring_index(F.regexp_replace(col, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""), "/", -1))


def plain_predicate(col: Column) -> Column:
    """Predicates in lower case, without outer blanks and without a namespace prefix."""
    return F.lower(F.substring_index(F.regexp_replace(col, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""), ":", -1))


def is_blank(col: Column) -> Column:
    """True for null and for text of nothing but blanks."""
    return F.coalesce(~col.rlike(r"(?U)[^\s\p{Z}]"), F.lit(True))


def instant_micros(col: Column) -> Column:
    """Microseconds since 1970 UTC of ISO-8601 text with an offset (UTC where it has none); null where it can't be read."""
    has_zone = col.rlike(r"(Z|[+-]\d\d:?\d\d)\s*$")
    return F.unix_micros(F.when(has_zone, col).otherwise(F.concat(col, F.lit("Z"))).try_cast("timestamp"))


def local_micros(col: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col.cast("timestamp_ntz"))


def version_key(col: Column) -> Column:
    """An array of numbers that sorts versions such as 0.10.0 after 0.9.0."""
    return F.transform(F.regexp_extract_all(col, F.lit(r"(\d+)"), 1), lambda x: x.cast("bigint"))
