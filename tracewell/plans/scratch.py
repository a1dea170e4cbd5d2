"""Tables that iterative operators write between rounds.

They live in the shared folder named by ``spark.checkpoint.dir``, so a lost executor costs a task
retry and not the lineage. A written table also carries exact sizes, which lets Catalyst choose
the join of the next round from facts.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is made only where none is set and the master is local."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tracewell-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(SETTING, folder)
    return folder


class Scratch:
    """Written tables of one operator call. ``keep`` writes a DataFrame and gives it back as a scan.

    ``drop`` removes a table that no later plan reads. What is still there when the Python process
    ends is removed then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tracewell-{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._remove, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def keep_counting(self, df: DataFrame, what: Column) -> tuple[DataFrame, int]:
        """As ``keep``, with an aggregate that is taken while the rows are written."""
        seen = Observation()
        kept = self.keep(df.observe(seen, what.alias("n")))
        return kept, seen.get.get("n") or 0

    def again(self, kept: list[DataFrame]) -> DataFrame:
        """Written tables of one schema as one scan, whatever their number."""
        return self.spark.read.schema(kept[0].schema).parquet(*[df._scratch_path for df in kept])

    def drop(self, df: DataFrame) -> None:
        self._remove(df._scratch_path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone at exit; a local folder can be removed without it
            if path.removeprefix("file://").startswith("/"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
