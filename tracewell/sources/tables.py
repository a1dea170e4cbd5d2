"""Reading the Parquet tables of a data directory, with nested columns cut down to what a query uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str, paths: list[str] | None = None) -> DataFrame:
    """Table ``name``; with ``paths`` (dotted, lists as ``[]``) the scan reads only these leaves.

    Parquet reads each leaf on its own, so a cut-down schema saves the bytes of the rest even where
    an expression over a list of structs would hide from the optimizer which fields it uses.
    """
    path = f"{sf_dir}/{name}.parquet"
    whole = spark.read.parquet(path)
    if paths is None:
        return whole
    return spark.read.schema(prune(whole.schema, paths)).parquet(path)


def prune(schema: T.StructType, paths: list[str]) -> T.StructType:
    """The part of ``schema`` that holds ``paths``; a path to a struct or list keeps all below it."""
    return _prune(schema, [p.replace("[]", ".[]").strip(".").split(".") for p in paths])


def _prune(kind: T.DataType, paths: list[list[str]]) -> T.DataType:
    if any(not p for p in paths):
        return kind
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_prune(kind.elementType, [p[1:] for p in paths]), kind.containsNull)
    fields = []
    for f in kind.fields:
        below = [p[1:] for p in paths if p[0] == f.name]
        if below:
            fields.append(T.StructField(f.name, _prune(f.dataType, below), f.nullable))
    return T.StructType(fields)
