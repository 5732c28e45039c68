"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of this machine only where none is named and all runs in this JVM (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='skerry-')}"
    sc.setCheckpointDir(own)
    return own


class Workspace:
    """Parquet tables in the shared folder: they survive lost executors, and go when the JVM ends.

    ``write`` runs the plan and returns a frame that reads the written table, so
    later steps neither recompute nor depend on executor-local blocks.  Keys that many
    rows share stay harmless in joins of written tables: adaptive execution splits
    partitions of a plain scan, but not those that an aggregate needs whole.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/skerry-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: list[DataFrame] = []
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def write(self, df: DataFrame, *folders: str) -> DataFrame:
        """``df`` as a written table, with a folder for each value of the columns ``folders`` (the last ones of ``df``)."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._skerry_path = path
        self._tables.append(out)
        return out

    def finish(self, df: DataFrame) -> DataFrame:
        """``df`` written, and all other tables of this workspace deleted."""
        out = self.write(df)
        self.drop(*(t for t in self._tables if t is not out))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that no later plan reads."""
        for df in frames:
            if path := getattr(df, "_skerry_path", None):
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        self._tables = [t for t in self._tables if not any(t is df for df in frames)]
