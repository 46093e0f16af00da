"""Answers as a table of Spark, recorded or live, of the domains, servers and record types that its options name.

`dns_responses(spark, path, ...)` reads what `write_responses` recorded: servers are spread over buckets by hash, only the
buckets of the servers named are opened, and all is filtered where a file is read. Without a path the servers are asked.

Names are options and not filters that Spark pushes down: Spark 4.1.2 keeps what was pushed into a Python source with the
loaded table, so one DataFrame that is read twice with different filters gives the rows of one of them.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from zonewalk.sources import live
from zonewalk.sources.readers import TIMED

#: The columns of the table: those of an answer and the type of its record, null where there is none.
COLUMNS = f"{TIMED}, type string"
ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]]) for c in COLUMNS.split(", ")])
#: Columns that options name values of, and buckets of servers.
NAMED, BUCKETS = ("domain", "nameserver", "type"), 64


def write_responses(responses: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Record answers (readers.TIMED, or RESPONSES without the time) under `path` for `dns_responses`.

    Spark splits a bucket that holds much, as that of a registry's server does, over several tasks and files.
    """
    took = F.col("elapsed") if "elapsed" in responses.columns else F.lit(None).cast("double")
    rows = responses.withColumns({"elapsed": took, "type": F.split("rr_text", " ")[3]}).select(*ARROW.names)
    bucket = F.crc32(F.coalesce("nameserver", F.lit("")).cast("binary")) % buckets
    spread = rows.withColumns({"buckets": F.lit(buckets), "bucket": bucket}).hint("rebalance", F.col("bucket"))
    spread.write.partitionBy("buckets", "bucket").parquet(path)


class Share(InputPartition):
    """What one task reads: a file, or questions to one server."""

    def __init__(self, path: str = "", server: str = "", domains: tuple[str, ...] = ()) -> None:
        super().__init__((path, server, domains))
        self.path, self.server, self.domains = path, server, domains


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


class ResponseReader(DataSourceReader):
    def __init__(self, path: str | None, port: int, wanted: dict[str, set[str]]) -> None:
        self.path, self.port, self.wanted = path, port, wanted

    def partitions(self) -> list[Share]:
        servers = self.wanted.get("nameserver")
        if self.path is None:
            if servers is None or "domain" not in self.wanted:
                raise ValueError("without a path, domain and nameserver must be named")
            domains = sorted(self.wanted["domain"])
            return [Share(server=s, domains=tuple(domains[i : i + live.PER_TASK])) for s in sorted(servers) for i in range(0, len(domains), live.PER_TASK)]
        files, root = _place(self.path)
        out = []
        for top in files.get_file_info(fs.FileSelector(root)):
            if not top.base_name.startswith("buckets="):
                continue
            buckets = int(top.base_name.split("=")[1])
            chosen = range(buckets) if servers is None else {zlib.crc32(s.encode()) % buckets for s in servers}
            for b in sorted(chosen):
                found = files.get_file_info(fs.FileSelector(f"{top.path}/bucket={b}", allow_not_found=True))
                out += [Share(path=f.path) for f in found if f.base_name.endswith(".parquet")]
        return out

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is nothing to read
            return
        if partition.path:
            test = None
            for name, values in self.wanted.items():
                one = ds.field(name).isin(pa.array(sorted(values), pa.string()))
                test = one if test is None else test & one
            files, _ = _place(self.path)
            for batch in ds.dataset(partition.path, filesystem=files, format="parquet").to_batches(columns=ARROW.names, filter=test):
                yield pa.Table.from_batches([batch]).cast(ARROW).combine_chunks().to_batches()[0] if batch.num_rows else pa.RecordBatch.from_pylist([], ARROW)
            return
        types = self.wanted.get("type")
        with ThreadPoolExecutor(live.AT_ONCE) as pool:
            for rows in pool.map(lambda d: live.timed_ask(d, partition.server, port=self.port), partition.domains):
                typed = [(*r, r[7].split()[3] if r[7] else None) for r in rows]
                kept = [r for r in typed if types is None or r[-1] in types]
                yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, r)) for r in kept], ARROW)


class ResponseSource(DataSource):
    """`spark.read.format("dns_responses")`. Options: path, of recorded answers (without it, servers are asked); port of the servers; NAMED, lists of strings as JSON."""

    @classmethod
    def name(cls) -> str:
        return "dns_responses"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> ResponseReader:  # noqa: ANN001
        wanted = {name: set(json.loads(self.options[name])) for name in NAMED if name in self.options}
        return ResponseReader(self.options.get("path"), int(self.options.get("port", 53)), wanted)


def dns_responses(spark: SparkSession, path: str | None = None, domains: list[str] | None = None, nameservers: list[str] | None = None, types: list[str] | None = None, port: int = 53) -> DataFrame:
    """Answers (COLUMNS) recorded under `path`, or live ones, of those domains, nameservers and record types that are given.

    Live, domains and nameservers must be given, and each server is asked for each domain whenever the table is read.
    """
    spark.dataSource.register(ResponseSource)
    reader = spark.read.format("dns_responses").option("port", port)
    for name, values in zip(NAMED, (domains, nameservers, types)):
        reader = reader if values is None else reader.option(name, json.dumps(sorted(values)))
    return reader.load(path) if path else reader.load()
