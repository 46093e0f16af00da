"""Token counts of documents in flat token files that have no index.

A token file is a plain sequence of fixed-width ids in which an end-of-document id closes each document. It is read by byte
ranges, its blocks, each searched for that id on its own; a prefix scan over the blocks' summaries (tokens, separators,
place of the last one) then gives each block its offset, the number of documents before it and where the document that
reaches into it began.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonewalk.llm.bpe import vocabulary
from zonewalk.llm.common import chunks, materialise, remove, shared_dir

#: Tokens of a block.
BLOCK_TOKENS = 1 << 17
#: Bytes that one task reads, about.
TASK_BYTES = 1 << 27
#: Blocks that are scanned together before their sums are: two levels keep any one scan short.
SCAN_BLOCKS = 4096
BLOCKS = "file string, block long, tokens binary"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def read_flat(spark: SparkSession, path: str, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, tokens) of the token files at `path`, of any size: each block is read by its own byte range.

    Blocks begin and end between ids. A file whose size is not a whole number of ids of `dtype` raises ValueError; an
    empty file has no block.
    """
    width, size = np.dtype(dtype).itemsize, np.dtype(dtype).itemsize * block_tokens
    # The content column is not read here, just names and sizes.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    torn = files.where(F.col("length") % width != 0).first()
    if torn:
        raise ValueError(f"{torn.path} holds {torn.length} bytes, not a whole number of {width}-byte ids")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    last = F.floor((F.col("length") - 1) / size)
    ranges = files.select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for name, block in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                system, where = _opened(name)
                with system.open_input_file(where) as f:
                    f.seek(block * size)
                    data = f.read(size)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "tokens"])

    return ranges.repartition(max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES)), "file", "block").mapInArrow(run, BLOCKS)


def id_type(path: str, eod: int) -> str:
    """The narrowest type that holds every id of the tokenizer at `path` and `eod`."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    most = max(eod, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]))
    return "<u2" if most < 1 << 16 else "<u4"


def write_flat(docs: DataFrame, path: str, eod: int, folder: str, dtype: str = "<u2") -> DataFrame:
    """Encode `docs` (doc_id, text) with the tokenizer at `path` into one flat token file per task in the shared `folder`.

    Gives the order of documents as runs (file, first, doc_ids): the ids from the file's document number `first` on.
    Strings of special tokens in a text are ordinary text. A file appears under its name when it is complete, so a task
    that is run again replaces it by the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = vocabulary(path), np.array([eod], dtype=dtype).tobytes()
        task = TaskContext.get()
        name, first, out = f"part-{task.partitionId():06d}", 0, None
        system, where = _opened(folder)
        begun = f"{where}/_{name}-{task.taskAttemptId()}"  # readers skip names that begin so
        for part, texts in chunks(batches):
            if out is None:
                system.create_dir(where, recursive=True)
                out = system.open_output_stream(begun)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([part.column(0).cast(pa.int64()).to_pylist()], pa.list_(pa.int64()))], names=["file", "first", "doc_ids"])
            first += len(texts)
            for t in texts:
                ids = np.frombuffer(words.encode(t.decode("utf-8", "replace"), special=False), dtype="<u4")
                out.write(ids.astype(dtype).tobytes() + end)
        if out is not None:
            out.close()
            system.move(begun, f"{where}/{name}")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, first long, doc_ids array<long>")
    return materialise(rows, "token-order")


def count_tokens(blocks: DataFrame, eod: int, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, n_tokens) for every document in blocks (file, block, tokens): its tokens without the separator.

    Documents are numbered from 0 in each file. Two separators in a row close an empty document. Tokens after a file's
    last separator are an open document and count as one more. Null or empty blocks hold nothing; an empty table gives
    an empty result. Each (file, block) is taken once: repeated rows of a block are counted as one.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for file, block, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                ids = np.frombuffer(data.as_buffer(), dtype=dtype) if data.is_valid else np.zeros(0, dtype)
                at = np.flatnonzero(ids == eod)
                out.append((file, block, len(ids), len(at), int(at[-1]) if len(at) else -1, at.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["file", "block", "n", "seps", "last", "at"]) if out else part.slice(0, 0)

    found = materialise(blocks.mapInArrow(scan, "file string, block long, n long, seps long, last long, at binary"), "separators").dropDuplicates(["file", "block"])
    short = found.select("file", "block", "n", "seps", "last", F.floor(F.col("block") / SCAN_BLOCKS).alias("part"))

    def scanned(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
        """Sums of n and seps and the last separator, over the rows before each."""
        before = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        base = F.coalesce(F.sum("n").over(before), F.lit(0))
        placed = rows.withColumns({"base": base, "docs": F.coalesce(F.sum("seps").over(before), F.lit(0))})
        placed = placed.withColumn("here", F.when(F.col("last") >= 0, F.col("last") + F.col("base")))
        return placed.withColumn("prev", F.max("here").over(before)).drop("here")

    inner = scanned(short, ["file", "part"], "block")
    upper = inner.groupBy("file", "part").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.coalesce(F.max(F.when(F.col("last") >= 0, F.col("last") + F.col("base"))), F.lit(-1)).alias("last"))
    upper = scanned(upper, ["file"], "part").select("file", "part", F.col("base").alias("base_0"), F.col("docs").alias("docs_0"), F.col("prev").alias("prev_0"))
    offsets = inner.join(upper, ["file", "part"]).select("file", "block", (F.col("base") + F.col("base_0")).alias("base"), (F.col("docs") + F.col("docs_0")).alias("docs"), F.coalesce(F.col("prev") + F.col("base_0"), "prev_0", F.lit(-1)).alias("prev"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for file, at, base, docs, prev in zip(*(c.to_pylist() for c in part.columns)):
                ends = np.frombuffer(at, dtype="<i8") + base
                sizes = np.diff(np.concatenate(([prev], ends))) - 1
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(ends), pa.string()), pa.array(np.arange(len(ends)) + docs, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "ordinal", "n_tokens"])

    closed = found.where("seps > 0").join(offsets, ["file", "block"]).select("file", "at", "base", "docs", "prev").mapInArrow(lengths, "file string, ordinal long, n_tokens long")
    whole = upper_totals(offsets.join(short.select("file", "block", "n", "seps", "last"), ["file", "block"]))
    return closed.union(whole.where("open > 0"))


def upper_totals(placed: DataFrame) -> DataFrame:
    """(file, ordinal, open): the tokens after each file's last separator."""
    last = F.coalesce(F.max(F.when(F.col("last") >= 0, F.col("last") + F.col("base"))), F.lit(-1))
    return placed.groupBy("file").agg(F.sum("seps").alias("ordinal"), (F.sum("n") - 1 - last).alias("open"))


def document_counts(docs: DataFrame, path: str, eod: int) -> DataFrame:
    """(doc_id, n_tokens) for every row of `docs` (doc_id, text), counted in the flat token files that they make.

    Null text is an empty document: 0 tokens. A row without doc_id has null for it; repeated rows each get one; an empty
    table gives an empty result; further columns are ignored. A text of any length is one document.
    """
    spark = docs.sparkSession
    folder, dtype = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}", id_type(path, eod)
    order = write_flat(docs, path, eod, folder, dtype)
    if order.isEmpty():
        return order.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"))
    counts = count_tokens(read_flat(spark, folder, dtype), eod, dtype)
    remove(spark, folder)  # the separators found are written
    placed = order.select("file", "first", F.posexplode("doc_ids").alias("at", "doc_id")).select("file", (F.col("first") + F.col("at")).alias("ordinal"), "doc_id")
    return placed.join(counts.withColumn("file", F.regexp_extract("file", "[^/]+$", 0)), ["file", "ordinal"]).select("doc_id", "n_tokens")
