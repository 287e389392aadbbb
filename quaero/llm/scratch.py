"""Shared scratch tables: lineage is cut by writing Parquet to the folder in ``spark.checkpoint.dir``.

Every executor can read such a table again, so the loss of an executor costs
the running stage only.  Where the session names no folder, a local master gets
a private one, made and set once; any other is an error.  Tables that a result
may still read are deleted when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a private local one only on a local master where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":  # executors elsewhere would each write to their own disk
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quaero-scratch-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Drop a query's shuffle files when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Scratch:
    """A set of intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        root = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(root)
        files.deleteOnExit(root)
        self.count = 0
        self.paths: dict[int, str] = {}

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads the written rows."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        with shuffle_cleanup(self.spark):
            df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def counted(self, df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
        """As :meth:`table`, and aggregates of the rows, taken while they are written: no job reads them for it."""
        seen = Observation()
        out = self.table(df.observe(seen, *[c.alias(k) for k, c in sums.items()]))
        return out, seen.get

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
            path.getFileSystem(conf).delete(path, True)
