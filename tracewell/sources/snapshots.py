"""Graph snapshots, run histories and sealed sets on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = "id string, label string, source string, source_id string, retrieved_at string, kind string, revision_id bigint, inception_year int, inception_precision int, countries array<string>"
EDGE = "subject_id string, predicate string, object_id string, source string, source_id string, retrieved_at string, prose_tier string, verification string"


class DigestMismatch(ValueError):
    """The bytes read aren't those whose digest was recorded."""


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a JSON file ``{"nodes": [...], "edges": [...]}``, each with its place as ``ord``."""
    schema = f"nodes array<struct<{_typed(NODE)}>>, edges array<struct<{_typed(EDGE)}>>"
    whole = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)

    def rows(name: str) -> DataFrame:
        return whole.select(F.posexplode(name).alias("ord", "x")).select("x.*", F.col("ord").cast("bigint").alias("ord"))

    return rows("nodes"), rows("edges")


def _typed(ddl: str) -> str:
    return ", ".join(": ".join(f.split(" ", 1)) for f in ddl.split(", "))


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def verified(spark: SparkSession, path: str, digest: str) -> str:
    """``path``, after its bytes were found to have the digest; else ``DigestMismatch``."""
    found = file_digest(spark, path)
    if found != digest:
        raise DigestMismatch(f"{path}: {found} instead of {digest}")
    return path


def table_digest(df: DataFrame) -> DataFrame:
    """``n_rows, digest``: a digest of a table's rows that doesn't depend on their order or partitions.

    Each row's canonical JSON is hashed, and the leading 60 bits of the hashes are folded by xor and
    by sum, so a repeated row doesn't cancel another.
    """
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.bit_xor("h").cast("string"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string")), 256).alias("digest"))


def write_snapshot(nodes: DataFrame, edges: DataFrame, root: str, version: str) -> DataFrame:
    """Writes an immutable version under ``root`` and gives its manifest; an existing version is an error.

    All of the manifest is derived from the tables: counts, digests and verification counts.
    """
    spark = nodes.sparkSession
    base = f"{root}/v{version}"
    nodes.write.mode("errorifexists").parquet(f"{base}/nodes")
    edges.write.mode("errorifexists").parquet(f"{base}/edges")
    kept = manifest(spark.read.parquet(f"{base}/nodes"), spark.read.parquet(f"{base}/edges"), version)
    kept.write.mode("errorifexists").json(f"{base}/manifest")
    return spark.read.schema(kept.schema).json(f"{base}/manifest")


def manifest(nodes: DataFrame, edges: DataFrame, version: str) -> DataFrame:
    """One row: version, counts, digests, and edges per verification as a map."""
    n, e = table_digest(nodes).toDF("node_count", "node_digest"), table_digest(edges).toDF("edge_count", "edge_digest")
    v = edges.groupBy("verification").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("verification", F.lit("")), "n")))).alias("verification_counts"))
    return n.crossJoin(e).crossJoin(v).select(F.lit(version).alias("artifact_version"), "node_count", "edge_count", "node_digest", "edge_digest", "verification_counts")  # one row each


def read_snapshot(spark: SparkSession, root: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a version, after both were found to have the digests in its manifest."""
    base = f"{root}/v{version}"
    nodes, edges = spark.read.parquet(f"{base}/nodes"), spark.read.parquet(f"{base}/edges")
    kept = spark.read.json(f"{base}/manifest").first()
    for name, df in (("node", nodes), ("edge", edges)):
        if table_digest(df).first()["digest"] != kept[f"{name}_digest"]:
            raise DigestMismatch(f"{base}/{name}s")
    return nodes, edges


def write_exclusions(excluded: DataFrame, path: str) -> DataFrame:
    """Writes exclusions by reason and gives the histogram ``reason_code, n``."""
    excluded.write.mode("errorifexists").partitionBy("reason_code").parquet(path)
    return excluded.sparkSession.read.parquet(path).groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))


def append_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Adds one run's rows to a history; what is there stays."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def latest_runs(spark: SparkSession, path: str, n: int, schema: T.StructType | str) -> DataFrame:
    """The rows of the newest ``n`` JSON files of a folder, newest by name, with the file's name as ``file``."""
    every = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    newest = every.select("file").distinct().orderBy(F.col("file").desc()).limit(n)
    return every.join(F.broadcast(newest), "file", "left_semi")  # n names


def sealed(text, key):
    """A text column encrypted under a key column or literal (AES-GCM, which tells tampering)."""
    return F.base64(F.aes_encrypt(text.cast("binary"), key, F.lit("GCM")))


def unsealed(text, key):
    """What ``sealed`` hid; null where the key or the text isn't right."""
    return F.try_aes_decrypt(F.unbase64(text), key, F.lit("GCM")).cast("string")


def read_cases(spark: SparkSession, path: str, shapes: tuple[str, ...] = ("origins", "descendants", "path")) -> DataFrame:
    """Cases from JSON; a case of an unknown shape is an error when the rows are read."""
    df = spark.read.option("multiLine", True).json(path)
    ok = F.coalesce(F.col("shape").isin(*shapes), F.lit(False))
    return df.withColumn("shape", F.when(ok, F.col("shape")).otherwise(F.raise_error(F.concat(F.lit("unknown shape "), F.coalesce("shape", F.lit("null"))))))
