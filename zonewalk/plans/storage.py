"""Tables between the rounds of an iteration, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session names none, a temporary one is set, but only if the driver is the only machine; else ValueError.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="zonewalk-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Growing:
    """A table that rounds append to: one folder, read as one relation."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.schema = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", None
        self._all = None

    def add(self, df: DataFrame) -> DataFrame:
        """Appends `df`; gives back just its rows."""
        own = f"{self.path}/part={uuid.uuid4().hex}"
        df.write.parquet(own)
        self.schema, self._all = self.schema or df.schema, None
        return self.spark.read.schema(self.schema).parquet(own)

    def all(self) -> DataFrame:
        """All rows so far; the folder is listed once after each `add`."""
        if self._all is None:
            self._all = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
        return self._all
