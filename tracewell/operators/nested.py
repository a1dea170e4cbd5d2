"""Deeply nested records turned into related flat tables.

A record is walked once into (path, ordinals, value) triples. Paths that share their innermost list
form one group, and each group is pivoted into one table whose rows carry the record's key and the
ordinals that lead to their place in it. The parent of a row is the row of the enclosing group with
the ordinals but the last, so every table joins to its parent on the leading key columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TRIPLES = "array<struct<path:string,ordinals:array<bigint>,value:string>>"


@dataclass(frozen=True)
class Leaf:
    """A path that holds a value. ``group`` is the path of its innermost list, '' outside of any."""

    path: str
    kind: T.DataType

    @property
    def group(self) -> str:
        return self.path[: self.path.rindex("[]") + 2] if "[]" in self.path else ""

    @property
    def column(self) -> str:
        """The name within its table: what follows the group, or 'value' for a list of plain values."""
        return self.path[len(self.group) :].strip(".").replace(".", "_") or "value"


def leaves(kind: T.DataType, path: str = "") -> list[Leaf]:
    """All value-holding paths of a type, lists written as ``[]``; a map is a list of key and value."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in leaves(f.dataType, f"{path}.{f.name}".strip("."))]
    if isinstance(kind, T.ArrayType):
        return leaves(kind.elementType, f"{path}[]")
    if isinstance(kind, T.MapType):
        return leaves(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]), f"{path}[]")
    return [Leaf(path, kind)]


def latest_records(df: DataFrame, key: str, loaded: str | None = None) -> DataFrame:
    """One row per key: the one loaded last; of several, the one that a hash of the row puts first.

    Rows without a key are dropped, as nothing could refer to them. One key's copies meet in one
    task; they are loads of one record, and only the columns given travel.
    """
    plain = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.name != loaded]
    newest = [] if loaded is None else [F.col(loaded).desc_nulls_last()]
    w = W.partitionBy(key).orderBy(*newest, F.xxhash64(*plain))
    return df.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def triples(df: DataFrame, key: str, paths: list[str] | None = None) -> DataFrame:
    """``key, path, ordinals, value``: one row for each value of ``paths`` (default: all but the key).

    Values are given as text. A list entry that is null or an object without values still gives a
    row with the list's path and a null value, so its place isn't lost. Null and missing lists,
    objects and values outside of lists give none. Where values outside of lists are wanted, each
    record gives one row with an empty path, so its own table holds every record.
    """
    wanted = [x for x in leaves(df.schema) if x.path != key and (paths is None or x.path in paths)]
    if paths is not None and (missing := set(paths) - {x.path for x in wanted}):
        raise ValueError(f"no such paths: {sorted(missing)}")
    keep = {x.path for x in wanted}
    parts = [_walk(F.col(f"`{f.name}`"), f.dataType, f.name, [], keep) for f in df.schema.fields if f.name != key]
    parts = [p for p in parts if p is not None]
    if any(not x.group for x in wanted):
        parts.append(F.array(F.struct(F.lit("").alias("path"), F.array().cast("array<bigint>").alias("ordinals"), F.lit(None).cast("string").alias("value"))).cast(_TRIPLES))
    whole = parts[0] if len(parts) == 1 else F.concat(*parts)
    return df.select(F.col(key), F.inline(whole))


def _walk(col: Column, kind: T.DataType, path: str, ordinals: list[Column], keep: set[str]) -> Column | None:
    """The triples of ``col`` as an array, or None if no wanted path lies at or below ``path``."""
    if not any(x.path in keep for x in leaves(kind, path)):
        return None
    none = F.array().cast(_TRIPLES)
    at = F.array(*ordinals).cast("array<bigint>")

    def triple(value: Column) -> Column:
        return F.array(F.struct(F.lit(path).alias("path"), at.alias("ordinals"), value.cast("string").alias("value"))).cast(_TRIPLES)

    if isinstance(kind, T.StructType):
        parts = [p for f in kind.fields if (p := _walk(col.getField(f.name), f.dataType, f"{path}.{f.name}".strip("."), ordinals, keep)) is not None]
        below = parts[0] if len(parts) == 1 else F.concat(*parts)
        if path.endswith("[]"):
            below = F.when(F.size(below) > 0, below).otherwise(triple(F.lit(None)))
        return F.when(col.isNotNull(), below).otherwise(triple(F.lit(None)) if path.endswith("[]") else none)
    if isinstance(kind, T.MapType):
        pair = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return _walk(F.map_entries(col), T.ArrayType(pair), path, ordinals, keep)
    if isinstance(kind, T.ArrayType):
        inner = F.transform(col, lambda x, i: _walk(x, kind.elementType, f"{path}[]", [*ordinals, i], keep))
        below = F.coalesce(F.flatten(inner), none)
        if path.endswith("[]"):
            below = F.when(F.size(below) > 0, below).otherwise(triple(F.lit(None)))
        return below
    return triple(col) if path.endswith("[]") else F.when(col.isNotNull(), triple(col)).otherwise(none)


def flat_tables(df: DataFrame, key: str, paths: list[str] | None = None, loaded: str | None = None) -> dict[str, DataFrame]:
    """One DataFrame per repeated ancestor, keyed by its path ('' is the record itself).

    Columns: ``key``, ``pos_0`` .. ``pos_k`` (places from 0, outermost first), then the group's
    values under their names below it, in their own types. A repeated key counts once
    (``latest_records``). An input without rows gives empty tables of the same columns. Column
    names that would clash with the key or a position get a trailing underscore.

    One shuffle, on the key: triples of one record are then in one task already, and the pivot's
    grouping by key and place is satisfied by it. No record's triples are gathered in memory.
    """
    wanted = [x for x in leaves(df.schema) if x.path != key and (paths is None or x.path in paths)]
    roots = list(dict.fromkeys(x.path.split(".")[0].split("[")[0] for x in wanted))
    slim = df.select(key, *[F.col(f"`{r}`") for r in roots], *([loaded] if loaded and loaded not in roots else []))
    once = latest_records(slim, key, loaded)
    if loaded and loaded not in roots:
        once = once.drop(loaded)
    # the key goes by a name of its own meanwhile, as it may be called like a column of the triples
    rows = triples(once.withColumnRenamed(key, "_record"), "_record", [x.path for x in wanted])
    groups = dict.fromkeys(g for x in wanted for g in _enclosing(x.group))
    out = {}
    for group in groups:
        mine = [x for x in wanted if x.group == group]
        depth = group.count("[]")
        at = [F.col("ordinals")[i].alias(f"pos_{i}") for i in range(depth)]
        if not mine:  # a list of lists: its rows are known from what lies in them
            out[group] = rows.where(F.col("path").startswith(group)).select(F.col("_record").alias(key), *at).distinct()
            continue
        fields, used = [], {key, *[f"pos_{i}" for i in range(depth)]}
        for x in mine:
            name = x.column
            while name in used:
                name += "_"
            used.add(name)
            fields.append(F.max(F.when(F.col("path") == x.path, F.col("value"))).cast(x.kind).alias(name))
        own = [group, *[x.path for x in mine]]
        out[group] = rows.where(F.col("path").isin(own)).groupBy("_record", *at).agg(*fields).withColumnRenamed("_record", key)
    return out


def _enclosing(group: str) -> list[str]:
    """The group and the lists around it, outermost first."""
    parts = group.split("[]")[:-1]
    return ["[]".join(parts[: i + 1]) + "[]" for i in range(len(parts))] if group else [""]
