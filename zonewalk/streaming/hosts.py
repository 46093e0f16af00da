"""A stream of host lists through the same steps as a batch: an extension for sources that keep growing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def host_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """(query) from text files as they arrive in `path`."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files).text(path)
    return lines.select(F.col("value").alias("query")).where(F.trim("query") != "")


def crawl_stream(hosts: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's reports under target/batch=N, written over if the batch is run again."""

    def each(batch: DataFrame, number: int) -> None:
        step(batch.select("query").distinct()).write.mode("overwrite").json(f"{target}/batch={number}")

    return hosts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
