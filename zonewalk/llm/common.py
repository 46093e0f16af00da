"""Pieces that the training-data operators share: shared folders, folds, bounded samples, text chunks."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewalk.plans.storage import remove, shared_dir  # noqa: F401

#: A filter has bitmaps of 32,768 bits, about 16 bits for each key, so that 6 in 100 others pass; at most so many are broadcast (64 MB).
BITMAP_BITS, KEY_BITS, MOST_BITMAPS = 32768, 16, 1 << 14
#: Bytes of text that a Python worker holds as words at once; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage, and lost executors cost no recomputation.

    `partition`: a column by which it is written, so that a part can be read alone.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition) if partition else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Let go of what finished steps hold: the driver removes broadcasts and shuffle files when their handles are collected as garbage."""
    spark.sparkContext._jvm.System.gc()


@dataclass
class Filter:
    """Bitmaps (map, bits) of keys: the columns `names` of a table."""

    names: list[str]
    maps: DataFrame
    bitmaps: int

    @staticmethod
    def of(keys: DataFrame, rows: int) -> Filter | None:
        """The filter of `keys`, of which there are `rows`; None if they need more bitmaps than are broadcast."""
        bitmaps = 1
        while bitmaps * BITMAP_BITS < rows * KEY_BITS:
            bitmaps *= 2
        if bitmaps > MOST_BITMAPS:
            return None
        made = Filter(keys.columns, keys, bitmaps)
        maps = keys.select(F.floor(made.slot() / BITMAP_BITS).cast("int").alias("_map"), (made.slot() % BITMAP_BITS).alias("_bit")).groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
        made.maps = materialise(maps, "key-filter")
        return made

    def slot(self) -> Column:
        return F.pmod(F.xxhash64(*self.names), F.lit(self.bitmaps * BITMAP_BITS))

    def flagged(self, rows: DataFrame) -> DataFrame:
        """`rows` with `_may`: whether their key may be among those of the filter; all others are told apart without a shuffle."""
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        own = rows.withColumns({"_map": F.floor(self.slot() / BITMAP_BITS).cast("int"), "_at": self.slot() % BITMAP_BITS}).join(F.broadcast(self.maps), "_map", "left")
        may = F.call_function("shiftright", byte, (F.col("_at") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
        return own.withColumn("_may", F.coalesce(may, F.lit(False))).drop("_map", "_at", "_bits")

    def passed(self, rows: DataFrame) -> DataFrame:
        return self.flagged(rows).where("_may").drop("_may")


def semi_join(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is in `keys` (written, its columns are the key), of which only those that a filter passes move."""
    chosen = Filter.of(keys, keys.count())
    return (chosen.passed(rows) if chosen else rows).join(keys.hint("merge"), keys.columns, "left_semi")


def drop_rows(docs: DataFrame, key: dict[str, Column], gone: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of `docs` whose `key` (columns by name) is not in `gone`, and of those whose key is in `again` one; a null key is in neither.

    gone and again are written tables. Rows that their filter does not pass stay where they are. A row is carried as one
    value beside its key, so columns of `docs` may have any names.
    """
    names, rows = list(key), docs.select(*[v.alias(k) for k, v in key.items()], F.struct("*").alias("row"))
    both = gone.select(*names).union(again.select(*names))
    chosen = Filter.of(both, both.count())
    flagged = chosen.flagged(rows) if chosen else rows.withColumn("_may", F.lit(True))
    left = flagged.where("_may").join(gone.hint("merge"), names, "left_anti")
    out = flagged.where("not _may").select("row")
    if again.isEmpty():
        return out.union(left.select("row")).select("row.*")
    repeated = left.join(again, names, "left_semi").groupBy(*names).agg(F.first("row").alias("row"))
    return out.union(left.join(again, names, "left_anti").select("row")).union(repeated.select("row")).select("row.*")


def fold(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def sample_by_label(df: DataFrame, label: str, cap: int, seed: int = 1, total: int | None = None, key: Column | None = None) -> tuple[DataFrame, dict]:
    """Rows with a label, about `cap` of each label and `total` of all at most, and how many rows each label has.

    They are picked by a hash of `key` (doc_id if none is given), which must tell rows apart; then the sample is so small
    that it can be broadcast, however large the input.
    """
    counts = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    cap = min(cap, total // max(len(counts), 1)) if total else cap
    draw = F.pmod(F.xxhash64(F.col("doc_id") if key is None else key, F.lit(seed)), F.lit(1 << 30))
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (draw < int((1 << 30) * min(1.0, cap / max(n, 1)))))
    return df.where(keep), counts


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their `text` column as UTF-8 bytes (null: empty), at most `limit` bytes or one row each."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
        ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at), [x or b"" for x in column.slice(at, to - at).to_pylist()]
            at = to


def release() -> None:
    """Give back to the system what this process has freed: Arrow's pool and the C library keep it, and Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in glibc
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """`run` for mapInArrow; when a task is through with it, what it has freed goes back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator:
        yield from run(batches)
        release()

    return whole


def starts_of(lengths: list[int] | np.ndarray) -> np.ndarray:
    """Offsets 0, l0, l0 + l1, ... with the total at the end."""
    return np.concatenate(([0], np.cumsum(np.asarray(lengths, dtype=np.int64))))


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i+1]]; empty segments give 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[starts[1:]] - total[starts[:-1]]


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 4 * CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with their `text` column as large strings (null: empty), at most `limit` bytes or one row each."""
    for batch in batches:
        column = pc.fill_null(batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at), column.slice(at, to - at)
            at = to


def lower_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of all texts end to end, A-Z in lower case, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():  # white space at an end of a text gives an empty word there
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[full.to_numpy(zero_copy_only=False)], minlength=len(counts))
        flat = flat.filter(full)
    return flat.cast(pa.large_binary()), counts


def values_of(column: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    data = column.buffers()[2]
    data = data.to_pybytes() if data is not None else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def flat_values(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column end to end, and how many each row holds; a null holds none."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    width = np.dtype(dtype).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    if data is None or ends[0] == ends[-1]:
        return np.zeros(0, dtype), np.diff(ends) // width
    return np.frombuffer(data, dtype, (ends[-1] - ends[0]) // width, ends[0]), np.diff(ends) // width


def sum_blocks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], blocks: int, sent: str = "<f4", code: Callable[[np.ndarray], np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """Sums of arrays by block: `run` gives (block, numbers) of one task's rows of `df`; the sums of `blocks` blocks come to the driver.

    Arrays travel as they are, as numbers of type `sent`, and are added in as many tasks as there are blocks, so what the
    driver gets does not grow with `df`; `code` turns sums into bytes before they go there.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, numbers in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([numbers.astype(sent).tobytes()], pa.binary())], names=["block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(part.as_buffer(), sent)
                total[block] = total[block] + own if block in total else own.astype(np.float64)
        for block, numbers in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([(code(numbers).astype("u1") if code else numbers.astype("<f4")).tobytes()], pa.binary())], names=["block", "part"])

    schema = "block long, part binary"
    return {r.block: np.frombuffer(r.part, "u1" if code else "<f4") for r in df.mapInArrow(emit, schema).repartition(blocks, "block").mapInArrow(add, schema).collect()}
