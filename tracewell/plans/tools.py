"""Named table functions over one graph, for callers that ask by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import names
from ..functions.ids import plain_id
from ..operators import corpus, graph


@dataclass(frozen=True)
class Result:
    """What a call gives: rows, or why it couldn't."""

    rows: DataFrame | None
    error: str | None = None

    @property
    def is_error(self) -> bool:
        return self.error is not None


class Registry:
    """Functions by name with the arguments they take. Unknown names and wrong arguments give an error result."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {}

    def register(self, name: str, arguments: tuple[str, ...], f: Callable[..., DataFrame]) -> None:
        if name in self._known:
            raise ValueError(f"{name} is registered already")
        self._known[name] = (f, arguments)

    def __contains__(self, name: str) -> bool:
        return name in self._known

    @property
    def names(self) -> list[str]:
        return list(self._known)

    def config(self) -> list[dict]:
        """Each function's name and arguments as a JSON schema."""
        return [{"name": n, "input": {"type": "object", "properties": {a: {"type": "string"} for a in args}, "required": list(args)}} for n, (_, args) in self._known.items()]

    def invoke(self, name: str, /, **arguments: str) -> Result:
        if name not in self._known:
            return Result(None, f"no function {name}")
        f, wanted = self._known[name]
        if set(arguments) != set(wanted) or not all(isinstance(v, str) and v.strip() for v in arguments.values()):
            return Result(None, f"{name} takes {', '.join(wanted) or 'no arguments'}")
        return Result(f(**arguments))


def default_registry(spark: SparkSession, nodes: DataFrame, edges: DataFrame, version: str = "") -> Registry:
    """The seven functions over one graph of nodes and influence edges."""

    def ids(*xs: str) -> DataFrame:
        return spark.createDataFrame([(x,) for x in xs], "id string").select(plain_id(F.col("id")).alias("id"))

    def described(id: str) -> DataFrame:
        p = F.col("inception_precision")
        return nodes.join(ids(id), "id").select("id", "label", "kind", corpus.era(F.col("inception_year")).alias("era"), corpus.region(F.col("countries")).alias("region"), F.when(p == 7, "century").when(p == 8, "decade").when(p == 9, "year").alias("precision"))

    def sourced(uri: str) -> DataFrame:
        asked = spark.createDataFrame([(uri,)], "uri string").select("uri", F.upper(F.regexp_extract("uri", r"([Qq]\d+)[^/]*$", 1)).alias("id"))
        met = asked.join(nodes.select("id", "label"), "id", "left")
        return met.select("uri", F.nullif("id", F.lit("")).alias("id"), "label", F.when(F.col("id") == "", "names no node").when(F.col("label").isNull(), "unknown node").alias("unresolved"))

    pair = lambda a, b: spark.createDataFrame([(a, b)], "source string, target string").select(plain_id(F.col("source")).alias("source"), plain_id(F.col("target")).alias("target"))
    r = Registry()
    r.register("resolve_node", ("name",), lambda name: names.resolve(nodes, spark.createDataFrame([(name,)], "query string")))
    r.register("get_influences", ("id",), lambda id: graph.labelled(graph.neighbours(edges, ids(id), graph.UP), nodes))
    r.register("get_descendants", ("id",), lambda id: graph.labelled(graph.neighbours(edges, ids(id), graph.DOWN), nodes))
    r.register("trace_lineage", ("start", "end"), lambda start, end: graph.trace(edges, pair(start, end)))
    r.register("describe_node", ("id",), described)
    r.register("resolve_source", ("uri",), sourced)
    r.register("corpus_coverage", (), lambda: corpus.coverage(nodes).withColumn("artifact_version", F.lit(version)))
    return r


@udtf(returnType="subject_id string, statement string")
class CitedSubject:
    """``cited_subject(uri)`` in SQL: the id and the rest of a statement's address, one row, or none for other addresses."""

    def eval(self, uri: str):
        head, _, tail = (uri or "").rpartition("/")
        node, dash, rest = tail.partition("-")
        if head.endswith("/statement") and dash:
            yield node.upper(), rest


def register_functions(spark: SparkSession) -> None:
    """Makes the table functions known to SQL."""
    spark.udtf.register("cited_subject", CitedSubject)
