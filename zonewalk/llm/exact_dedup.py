"""Exact duplicates through a log-structured merge index of digests, with DataFrame operations only.

Rows are digested into a log; each memtable is a part of it. Flushed, a memtable is a run: one row for each digest with
the row that stays and the count, bucketed by digest and sorted in each bucket, with a filter of bitmaps. When a level has
two runs they are compacted into one of the level above: a merge join of equal buckets, without a shuffle, in which of
equal digests the row that stays is kept. A look-up reads only the runs whose filter passes one of its digests.
Digests found more than once are hits; their filter picks the rows whose texts are then compared byte by byte.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewalk.llm.common import Filter, drop_rows, forget, materialise, remove, shared_dir

#: Memtables of one table.
MEMTABLES = 4
#: Digests of a bucket, about, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 4_000_000, 4
#: Of equal texts the one with the most code points, then the smallest doc_id stays.
BEST = "struct<less:bigint,doc_id:bigint>"


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", "")


def log(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """(digest, sha, n_chars, doc_id, memtable), written by memtable; the rows of one task are in one memtable."""
    sha = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    rows = docs.select(sha.alias("sha"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.col("doc_id").cast("long").alias("doc_id"))
    digest = F.when(F.col("doc_id").isNotNull(), F.substring("sha", 1, digest_bytes)).alias("digest")
    return materialise(rows.select(digest, "sha", "n_chars", "doc_id", (F.spark_partition_id() % MEMTABLES).alias("memtable")), "digest-log", partition="memtable")


def merge(older: DataFrame, newer: DataFrame) -> DataFrame:
    """(digest, best, size) of both; a digest is in each at most once."""
    mine, theirs = (r.select("digest", F.col("best").alias(f"best_{i}"), F.col("size").alias(f"size_{i}")) for i, r in enumerate((older, newer)))
    size = F.coalesce("size_0", F.lit(0)) + F.coalesce("size_1", F.lit(0))
    return mine.join(theirs, "digest", "full").select("digest", F.least("best_0", "best_1").alias("best"), size.alias("size"))


@dataclass
class Run:
    table: str
    path: str
    level: int
    rows: int
    filter: Filter | None


@dataclass
class MergeIndex:
    """Runs of (digest, best, size) by level, newest last."""

    spark: SparkSession
    buckets: int
    runs: list[Run] = field(default_factory=list)

    @staticmethod
    def empty(rows: DataFrame) -> MergeIndex:
        """An index with as many buckets as the log `rows` needs."""
        return MergeIndex(rows.sparkSession, max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS)))

    def _write(self, rows: DataFrame, level: int) -> Run:
        table = f"digest_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{table}"
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", path).saveAsTable(table)
        held = self.spark.table(table)
        n = held.count()
        return Run(table, path, level, n, Filter.of(held.select("digest"), n))

    def insert(self, rows: DataFrame) -> None:
        """Flush the memtable `rows` (digest, n_chars, doc_id) and compact full levels; null digests are left out."""
        best = F.struct((-F.col("n_chars")).alias("less"), "doc_id")
        own = rows.where("digest is not null").groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("size"))
        self.runs.append(self._write(own.repartition(self.buckets, "digest"), 0))
        while len(self.runs) > 1 and self.runs[-1].level == self.runs[-2].level:
            self._compact()

    def _compact(self) -> None:
        """Merge the last two runs: their buckets are joined where they lie."""
        older, newer = self.runs[-2:]
        merged = self._write(merge(self.spark.table(older.table), self.spark.table(newer.table)), older.level + 1)
        self._drop([older, newer])
        self.runs.append(merged)

    def _drop(self, runs: list[Run]) -> None:
        for r in runs:
            self.spark.sql(f"DROP TABLE {r.table}")
            remove(self.spark, r.path)
        self.runs = [r for r in self.runs if r not in runs]

    def whole(self) -> DataFrame:
        """All digests, after all runs were merged into one."""
        while len(self.runs) > 1:
            self._compact()
        return self.spark.table(self.runs[0].table)

    def readable(self, digests: DataFrame) -> list[Run]:
        """The runs that may hold one of `digests` (digest)."""
        return [r for r in self.runs if r.rows and (r.filter is None or not r.filter.passed(digests).isEmpty())]

    def look_up(self, digests: DataFrame) -> DataFrame:
        """(digest, best, size) of the `digests` (digest) that the index holds; runs whose filter passes none are not read."""
        found = [self.spark.table(r.table).join((r.filter.passed(digests) if r.filter else digests).distinct(), "digest", "left_semi") for r in self.readable(digests)]
        none = self.spark.createDataFrame([], f"digest binary, best {BEST}, size long")
        return reduce(DataFrame.unionByName, found, none).groupBy("digest").agg(F.min("best").alias("best"), F.sum("size").alias("size"))

    def clear(self) -> None:
        self._drop(list(self.runs))


def fill(made: MergeIndex, rows: DataFrame) -> None:
    """Insert a log, memtable by memtable."""
    for m in range(MEMTABLES):
        made.insert(rows.where(F.col("memtable") == m))


def index(rows: DataFrame) -> MergeIndex:
    """The index of a log."""
    made = MergeIndex.empty(rows)
    fill(made, rows)
    return made


def verify(docs: DataFrame, hits: DataFrame, digest_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The rows that may be hits (doc_id, n_chars, digest, norm) and, of the hits, the digests that several texts share."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    digested = texts.withColumn("digest", F.substring(F.unhex(F.sha2(F.col("norm").cast("binary"), 256)), 1, digest_bytes))
    chosen = Filter.of(hits.select("digest"), hits.count())
    rows = chosen.passed(digested) if chosen else digested.join(hits.select("digest"), "digest", "left_semi")
    # Equal bytes throughout a group: its smallest and largest text are the same.
    bytes_equal = rows.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high").select("digest")
    return rows, materialise(bytes_equal.join(hits, "digest", "left_semi"), "digest-clashes")


def exact_groups(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of `docs` (doc_id, text).

    Texts are equal when identical after deleting [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts the row with
    the most code points, then the smallest doc_id stays. Digests are the first `digest_bytes` bytes of SHA-256; texts
    that share a digest without being equal are told apart by their bytes. An empty table gives an empty result;
    further columns are ignored; rows equal in doc_id and text each count and get the same verdict, rows of one doc_id
    with other texts their own. A row without doc_id belongs to no group: it is kept, with a null keep_id. A text of
    any length is digested and compared whole.
    """
    return _verdicts(docs, digest_bytes).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _verdicts(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """(doc_id, sha, n_chars, keep_id, group_size, kept) for every row."""
    rows = log(docs, digest_bytes)
    made = MergeIndex.empty(rows)
    try:
        fill(made, rows)
        hits = materialise(made.whole().where("size > 1"), "digest-hits")
    finally:
        made.clear()
    forget(rows.sparkSession)
    found, clashes = verify(docs, hits, digest_bytes)
    light = rows.drop("memtable")
    if clashes.isEmpty():
        out = light.join(hits, "digest", "left")
    else:
        apart = found.join(clashes, "digest", "left_semi").withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
        told = apart.groupBy("digest", "sha", "norm").agg(F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id")).alias("best"), F.count(F.lit(1)).alias("size")).drop("norm")
        clear = light.join(hits.join(clashes, "digest", "left_anti"), "digest", "left")
        settled = clear.join(clashes, "digest", "left_anti")
        out = settled.unionByName(light.join(told, ["digest", "sha"]))
    keep = F.coalesce("best.doc_id", "doc_id")
    stays = F.col("best").isNull() | ((F.col("best.doc_id") == F.col("doc_id")) & (F.col("best.less") == -F.col("n_chars")))
    return out.select("doc_id", "sha", "n_chars", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"))


def drop_copies(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """The rows of `docs` that stay, one of each group of equal texts; all columns stay.

    Each row has its own verdict, by doc_id and text. Of rows equal in both one stays; a row without doc_id stays. Further
    columns may have any names; an empty table gives an empty result.
    """
    verdicts = materialise(_verdicts(docs.select("doc_id", "text"), digest_bytes).where("doc_id is not null and group_size > 1"), "digest-verdicts")
    key = {"id": F.col("doc_id").cast("long"), "sha": F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)), "n": F.length(F.coalesce("text", F.lit(""))).cast("long")}
    of = lambda rows: rows.select(F.col("doc_id").alias("id"), "sha", F.col("n_chars").alias("n"))
    again = materialise(verdicts.where("kept").groupBy("doc_id", "sha", "n_chars").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "digest-repeats")
    return drop_rows(docs, key, of(verdicts.where("not kept")), of(again))
