"""Schemas that drift between files: tagged-union inference over JSON records.

Every record is parsed once, on its own, into paths with a type tag each. Schemas are fused per
path, and per feed and path, by keeping every tag that occurs (a tagged union), so no record forces
its types on another; under which paths a field goes is told from the fused schemas. Where a
path has several tags its values go to one branch per tag and, beside them, to one canonical form.
Changes are found by walking each feed's records in order and comparing tag and path of a field
with those last seen.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

TAGS = ("string", "integer", "decimal", "list", "object", "boolean")
CHUNK = "day"  # records of one feed and chunk are walked in one task


@dataclass(frozen=True)
class Field:
    """A field of the consistent table: its name, and the paths under which it was delivered (dotted, a dot within a key as ``\\.``)."""

    name: str
    paths: tuple[str, ...]
    canonical: str = "text"  # or "count"
    words: tuple[str, ...] = field(default=("module", "args"))  # an object's parts that make up the text


def parsed(files: DataFrame, body: str = "body") -> DataFrame:
    """``files`` with ``_doc``, a VARIANT; null for text that isn't JSON (two equal keys in an object included)."""
    return files.withColumn("_doc", F.try_parse_json(F.col(body)))


def tag_of(value: Column) -> Column:
    """The type tag of a VARIANT: one of ``TAGS``, or 'null'."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.isNull() | (kind == "VOID"), "null")
        .when(kind == "STRING", "string")
        .when(kind == "BIGINT", "integer")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("decimal")
    )


PATHS = "array<struct<path:string,tag:string>>"


def read_paths(files: DataFrame, keep: list[str], body: str = "body", opaque: tuple[str, ...] = ()) -> DataFrame:
    """``keep..., paths``: every path of each record with its type tag, each pair once; null for text that isn't JSON.

    Paths are dotted, a dot within a key is written ``\\.``, the entries of a list are at ``[]``; they
    are followed to any depth. Objects at the paths ``opaque`` are maps whose keys are data; they are
    tagged and not entered. The tag is one of ``TAGS`` or 'null'. A record that is no object has no
    paths; one with two equal keys in an object isn't JSON. A record is parsed once, and all else is
    told from what this gives.
    """
    schema = ", ".join([*(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep), f"paths {PATHS}"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = json.JSONDecoder(object_pairs_hook=_once, parse_constant=_refuse)
        kind = pa.list_(pa.struct([("path", pa.string()), ("tag", pa.string())]))
        for batch in batches:
            found = []
            for text in batch.column(len(keep)).to_pylist():
                try:
                    doc = None if text is None else decoder.decode(text)
                except (ValueError, RecursionError):
                    doc = None
                if doc is None and (text is None or text.strip() != "null"):
                    found.append(None)
                    continue
                seen: dict[tuple[str, str], None] = {}
                if isinstance(doc, dict):
                    _enter(doc, "", frozenset(opaque), seen)
                found.append([{"path": p, "tag": t} for p, t in seen])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, kind)], names=[*keep, "paths"])

    return files.select(*keep, F.col(body).alias("_body")).mapInArrow(read, schema)


def _once(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("two equal keys")
    return out


def _refuse(name: str):
    raise ValueError(name)


_TAG_OF = {str: "string", int: "integer", float: "decimal", list: "list", dict: "object", bool: "boolean", type(None): "null"}


def _enter(value: dict | list, path: str, opaque: frozenset[str], seen: dict[tuple[str, str], None]) -> None:
    """Adds what lies below a record's object or list; a stack of its own, so depth is no limit."""
    stack = [(value, path)]
    while stack:
        value, path = stack.pop()
        if isinstance(value, dict):
            inner = [((f"{path}." if path else "") + (k.replace(".", "\\.") if "." in k else k), v) for k, v in value.items()]
        else:
            inner = [(f"{path}[]", v) for v in value]
        for p, v in inner:
            seen[p, _TAG_OF[type(v)]] = None
            if v and isinstance(v, (dict, list)) and p not in opaque:
                stack.append((v, p))


def path_tags(read: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., path, tag``: one row for each path of each record of ``read_paths``."""
    return read.select(*keys, F.inline("paths"))


def fused_schema(tags: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The tagged union: ``group..., path, tag, n``, counts of records per path and tag.

    Counting is associative, so schemas of parallel parts fuse in any order (partial aggregation).
    """
    return tags.groupBy(*(group or []), "path", "tag").agg(F.count(F.lit(1)).alias("n"))


def _at(path: str) -> Column:
    keys = [k.replace("\\.", ".") for k in re.split(r"(?<!\\)\.", path)]
    return F.try_variant_get(F.col("_doc"), "$" + "".join(f"['{k}']" if '"' in k else f'["{k}"]' for k in keys), "variant")


def located(read: DataFrame, fields: list[Field], keep: list[str]) -> DataFrame:
    """One row per record of ``read_paths`` and field: ``keep..., field_name, path, tag``.

    ``path`` is the first of the field's paths that the record has, null where it has none. ``tag`` is
    null for an absent and for a null value.
    """
    def cell(f: Field) -> Column:
        place = F.create_map(*[x for i, p in enumerate(f.paths) for x in (F.lit(p), F.lit(i))])
        known = F.filter("paths", lambda x: x["path"].isin(*f.paths))
        placed = F.transform(known, lambda x: F.struct(F.try_element_at(place, x["path"]).alias("place"), x["path"].alias("path"), x["tag"].alias("tag")))
        return F.struct(F.lit(f.name).alias("field_name"), F.array_min(placed).alias("cell"))

    cells = [cell(f) for f in fields]
    long = read.select(*keep, F.inline(F.array(*cells)))
    return long.select(*keep, "field_name", F.col("cell.path").alias("path"), F.nullif(F.col("cell.tag"), F.lit("null")).alias("tag"))


def changes(cells: DataFrame, feed: str, written: str, file_id: str) -> DataFrame:
    """``feed, file_id, field_name, change_kind, from_path, to_path, from_tag, to_tag`` of every change.

    Each record is compared with the one before it in its feed (by ``written``, then ``file_id``).
    ``added``, ``removed``: present only now, only before. ``renamed``: at another path. ``retyped``:
    another tag than the one last seen in the feed; a null value is present and has no tag of its
    own. Records with a null feed form a feed; those with a null ``written`` come first.

    A feed may hold any part of all records: it is walked in chunks of one day, each chunk leaving
    its last state, and only these states are walked feed by feed. Both walks stream over sorted
    rows and keep one row at a time.
    """
    chunk = F.coalesce(F.date_trunc(CHUNK, F.col(written)).cast("string"), F.lit(""))
    rows = cells.select(F.col(feed).alias("feed"), F.col(written).alias("_w"), F.col(file_id).alias("file_id"), "field_name", "path", "tag", chunk.alias("_chunk"), F.coalesce(F.col(feed), F.lit("")).alias("_f"), F.col(feed).isNull().alias("_fn"))
    part = ["_f", "_fn", "field_name"]
    inside = W.partitionBy(*part, "_chunk").orderBy("_w", "file_id")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    walked = rows.select(
        "*",
        F.lag(F.lit(True)).over(inside).alias("_has"),
        F.lag("path").over(inside).alias("_path"),
        F.last("tag", ignorenulls=True).over(before).alias("_tag"),
    )
    place = F.struct("_w", "file_id")
    states = rows.groupBy(*part, "_chunk").agg(F.max_by("path", place).alias("_last_path"), F.max_by(F.col("tag"), F.when(F.col("tag").isNotNull(), place)).alias("_last_tag"))
    across = W.partitionBy(*part).orderBy("_chunk")
    carried = states.select(
        *part,
        "_chunk",
        F.lag(F.lit(True)).over(across).alias("_had"),
        F.lag("_last_path").over(across).alias("_path_in"),
        F.last("_last_tag", ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1)).alias("_tag_in"),
    )
    met = walked.join(carried, [*part, "_chunk"])
    met = met.where("_has or _had").withColumn("_from", F.when(F.col("_has"), F.col("_path")).otherwise(F.col("_path_in"))).withColumn("_was", F.coalesce("_tag", "_tag_in"))
    kinds = F.array(
        F.when(F.col("_from").isNull() & F.col("path").isNotNull(), "added"),
        F.when(F.col("_from").isNotNull() & F.col("path").isNull(), "removed"),
        F.when(F.col("_from") != F.col("path"), "renamed"),
        F.when(F.col("_from").isNotNull() & F.col("path").isNotNull() & (F.col("_was") != F.col("tag")), "retyped"),
    )
    return met.select("feed", "file_id", "field_name", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("change_kind"), F.col("_from").alias("from_path"), F.col("path").alias("to_path"), F.col("_was").alias("from_tag"), F.col("tag").alias("to_tag"))


LEAST_RENAMES = 5  # files that show a path before it counts as another name of a field
LEAST_ALIKE = 1  # the same, of a path that shares a word with the field's name
LEAST_SHARE = 0.1  # of the times that a path comes up in a feed, those in which the field vanishes


def words_in(path: str) -> set[str]:
    """The words of a path's last key: ``coarserThanYear`` and ``coarser_than_year`` have the same."""
    last = re.split(r"(?<!\\)\.", path)[-1]
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", last)}


def other_names(read: DataFrame, fields: list[Field], feed: str, written: str, file_id: str, least: int = LEAST_RENAMES) -> list[Field]:
    """``fields`` with the paths added under which they go on where they vanish, told from ``read_paths``.

    Schemas are fused per feed: for each path, the files that hold it, the times that it comes up from
    one file to the next, and, for each field, the times that it comes up where the field vanishes
    and the files that hold both. A path stands for a field in a feed where no file holds both and
    where the field vanishes in at least ``LEAST_SHARE`` of the times that the path comes up. It is
    another name when at least ``least`` files of such feeds hold it (``LEAST_ALIKE`` where it shares a
    word with the field's name) and more than hold both elsewhere. Of an object and its members the one seen more often is taken, of both as often the
    member. A path that fits several fields is the one's that it follows most often, or none's. Names
    found count as known in the next round, until none is added, so a name that follows another is
    found too. Paths within lists are no names. What comes to the driver is one row per candidate.
    """
    scratch = Scratch(read.sparkSession, "names")
    files = read.select(F.col(file_id).alias("file_id"), F.coalesce(F.col(feed), F.lit("")).alias("_f"), F.col(feed).isNull().alias("_fn"), F.col(written).alias("_w"), F.col("paths.path").alias("paths"))
    both = _with_before(files)
    now = F.array_distinct(F.coalesce("paths", F.array().cast("array<string>")))
    came = F.when(F.col("was").isNotNull(), F.array_except(now, "was")).otherwise(F.array().cast("array<string>"))
    pairs = scratch.keep(both.select("_f", "_fn", now.alias("now"), came.alias("came"), "was"))
    while (more := _names_once(pairs, fields, least)) != fields:
        fields = more
    return fields


def _with_before(files: DataFrame) -> DataFrame:
    """Adds ``was`` to ``files(_f, _fn, _w, file_id, paths)``: the paths of the file before it in its feed, null for the first; walked in chunks as in ``changes``."""
    place = F.struct("_w", "file_id")
    held = F.coalesce("paths", F.array().cast("array<string>"))
    rows = files.withColumn("_chunk", F.coalesce(F.date_trunc(CHUNK, "_w").cast("string"), F.lit("")))
    walked = rows.withColumn("_inside", F.lag(held).over(W.partitionBy("_f", "_fn", "_chunk").orderBy("_w", "file_id")))
    ends = rows.groupBy("_f", "_fn", "_chunk").agg(F.max_by(held, place).alias("_last"))
    carried = ends.withColumn("_carried", F.lag("_last").over(W.partitionBy("_f", "_fn").orderBy("_chunk"))).drop("_last")
    return walked.join(carried, ["_f", "_fn", "_chunk"]).withColumn("was", F.coalesce("_inside", "_carried"))


def _names_once(pairs: DataFrame, fields: list[Field], least: int) -> list[Field]:
    known = [p for f in fields for p in f.paths]

    def has(paths: str, f: Field) -> Column:
        return F.arrays_overlap(F.col(paths), F.array(*[F.lit(p) for p in f.paths]))

    def gone(f: Field) -> Column:
        return F.coalesce(has("was", f), F.lit(False)) & ~has("now", f)

    free = F.filter("came", lambda p: ~p.isin(*known) & ~p.contains("[]") & ~F.greatest(*[p.startswith(k + ".") for k in known], F.lit(False)))
    likely = [r[0] for r in pairs.where(F.greatest(*[gone(f) for f in fields], F.lit(False))).select(F.explode(free).alias("path")).distinct().collect()]
    if not likely:
        return fields
    # only these are counted, file by file: those that come up where a field vanishes
    seen = F.transform(F.filter("now", lambda p: p.isin(*likely)), lambda p: F.struct(p.alias("path"), F.array_contains("came", p).alias("starts")))
    flags = [x for i, f in enumerate(fields) for x in (has("now", f).alias(f"_now{i}"), gone(f).alias(f"_gone{i}"))]
    held = pairs.where(F.exists("now", lambda p: p.isin(*likely))).select("_f", "_fn", *flags, seen.alias("seen"))
    sums = [F.count(F.lit(1)).alias("n"), F.count_if("starts").alias("n_starts")]
    for i in range(len(fields)):
        sums += [F.count_if(f"_now{i}").alias(f"both{i}"), F.count_if(F.col(f"_gone{i}") & F.col("starts")).alias(f"after{i}")]
    rest = [c for c in held.columns if c != "seen"]
    fused = held.select(*rest, F.inline("seen")).groupBy("_f", "_fn", "path").agg(*sums)  # one row per path and feed, whatever the number of files
    per = []
    for i, f in enumerate(fields):
        fits = (F.col(f"both{i}") == 0) & (F.col(f"after{i}") > 0) & (F.col(f"after{i}") >= LEAST_SHARE * F.col("n_starts"))
        per.append(F.struct(F.lit(f.name).alias("field_name"), F.when(fits, F.col("n")).otherwise(0).alias("n"), F.when(fits, F.col(f"after{i}")).otherwise(0).alias("n_after"), F.col(f"both{i}").alias("n_both")))
    long = fused.select("path", F.inline(F.array(*per))).groupBy("field_name", "path").agg(F.sum("n").alias("n"), F.sum("n_after").alias("n_after"), F.sum("n_both").alias("n_both"))
    words = {f.name: words_in(f.paths[0]) for f in fields}
    rows = [r for r in long.where((F.col("n") > 0) & (F.col("n") > F.col("n_both"))).collect() if r["n"] >= (LEAST_ALIKE if words_in(r["path"]) & words[r["field_name"]] else least)]
    found: dict[str, dict[str, int]] = {}
    for r in rows:
        if all(r["n_after"] > o["n_after"] for o in rows if o["path"] == r["path"] and o["field_name"] != r["field_name"]):
            found.setdefault(r["field_name"], {})[r["path"]] = r["n"]

    every = {p: n for names in found.values() for p, n in names.items()}

    def beaten(path: str, n: int, all_: dict[str, int]) -> bool:
        return any(q.startswith(path + ".") and m >= n or path.startswith(q + ".") and m > n for q, m in all_.items())

    return [Field(f.name, (*f.paths, *sorted(p for p, n in found.get(f.name, {}).items() if not beaten(p, n, every))), f.canonical, f.words) for f in fields]


def consistent_table(docs: DataFrame, fields: list[Field], keep: list[str]) -> DataFrame:
    """One row per document: ``keep`` and, per field, a struct of one branch per tag and the canonical form.

    The branches of a field are ``string, integer, decimal, list, object, boolean``; exactly the one
    of the value's tag is set. ``canonical`` is text (a list's entries joined by blanks, an object's
    named parts likewise) or, for a field of counts, a BIGINT (an integer, a decimal without
    fraction, a number in a string, the member ``n`` of an object), null where neither applies.
    """
    out = []
    for f in fields:
        first = F.get(F.filter(F.array(*[_at(p) for p in f.paths]), lambda x: x.isNotNull()), F.lit(0))
        path = F.get(F.filter(F.array(*[F.when(_at(p).isNotNull(), F.lit(p)) for p in f.paths]), lambda x: x.isNotNull()), F.lit(0))
        name = f.name.replace(".", "_")
        out.append((name, f, first, path))
    df = docs.select(*keep, *[x for n, _, v, p in out for x in (v.alias(f"_{n}"), p.alias(f"{n}_path"))])
    for n, f, _, _ in out:
        v = F.col(f"_{n}")
        tag = tag_of(v)
        text = v.try_cast("string")
        parts = v.try_cast("array<string>")
        if f.canonical == "count":
            number = F.when(tag.isin("integer", "decimal", "string"), F.trim(text)).when(tag == "object", F.expr(f"try_variant_get(_{n}, '$.n', 'string')"))
            whole = number.try_cast("decimal(38,10)")
            canonical = F.when(whole == F.floor(whole), whole.try_cast("bigint"))
        else:
            named = [F.coalesce(F.array_join(F.expr(f"try_variant_get(_{n}, '$.{w}', 'array<string>')"), " "), F.expr(f"try_variant_get(_{n}, '$.{w}', 'string')")) for w in f.words]
            canonical = F.when(tag == "list", F.array_join(parts, " ")).when(tag == "object", F.trim(F.concat_ws(" ", *named))).when(tag != "null", text)
        branches = [F.when(tag == "string", text).alias("string"), F.when(tag == "integer", v.try_cast("bigint")).alias("integer"), F.when(tag == "decimal", v.try_cast("double")).alias("decimal"), F.when(tag == "list", F.to_json(v)).alias("list"), F.when(tag == "object", F.to_json(v)).alias("object"), F.when(tag == "boolean", v.try_cast("boolean")).alias("boolean")]
        df = df.withColumn(n, F.struct(*branches, canonical.alias("canonical"))).withColumn(f"{n}_tag", F.when(v.isNotNull(), tag))
    return df.drop(*[f"_{n}" for n, *_ in out])
