"""SimHash near-duplicates with pigeonring filtering of the candidates.

The 64 bits of a fingerprint are cut into m = 2k + 1 segments on a ring. If two fingerprints differ in at most two bits,
there is a segment from which every chain of l consecutive segments differs in at most 2l/m bits (the pigeonring principle):
the first k segments are then equal, the first 2k differ in one bit at most. The k equal segments are the key of the
candidate index; the budgets of the longer chains prune candidates before the full Hamming check.

Buckets of the index with more than `bucket_cap` fingerprints are keyed again by longer chains: the first 2k segments
differ in one bit at most, so all of them but one are equal. What is crowded even then, 38 bits being equal, is linked
exactly through midpoints: two fingerprints that differ in at most two bits have a midpoint within one bit of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewalk.llm.common import chunks, materialise
from zonewalk.llm.components import connected

SEGMENTS = 5
BUDGET = 2
#: For a byte, its bits in eight lanes of eight bits.
LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each segment of `hashes`, the bits that are set in over half of it. Sizes are 1 or more."""
    ends = np.cumsum(sizes)
    blocks = (sizes + 254) // 255  # lanes of eight bits hold sums of up to 255
    first = np.repeat(ends - sizes, blocks)
    own = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at, of = first + own * 255, np.cumsum(blocks) - blocks
    out, raw = np.zeros(len(sizes), dtype=np.uint64), hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(LANES[raw[:, byte]], at)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of, axis=0)
        for bit in range(8):
            out |= (2 * sums[:, bit] > sizes).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprint_batch(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """Fingerprints of UTF-8 texts; a text without words gives zero."""
    digest, hashes, sizes, full = xxhash.xxh64_intdigest, [], [], []
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        full.append(i)
        joined = b" ".join(words)
        n = len(words) - shingle + 1
        if n < 1:
            hashes.append(digest(joined, 42))
            sizes.append(1)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        at = [0, *ends[: n - 1].tolist()]
        to = (ends[shingle - 1 :] - 1).tolist()
        hashes.extend([digest(joined[a:b], 42) for a, b in zip(at, to)])
        sizes.append(n)
    out = np.zeros(len(texts), dtype=np.uint64)
    if full:
        out[full] = majority(np.array(hashes, dtype="<u8"), np.array(sizes, dtype=np.int64))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. Null text counts as empty and gets fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            fp = pa.array(fingerprint_batch(texts, shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), fp], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _cuts(segments: int) -> list[int]:
    return [round(64 * i / segments) for i in range(segments + 1)]


def _arc(segments: int, first: int, count: int) -> int:
    """Mask of `count` consecutive segments of the ring from `first`, as a signed long."""
    cuts, mask = _cuts(segments), 0
    for s in range(first, first + count):
        s %= segments
        mask |= ((1 << (cuts[s + 1] - cuts[s])) - 1) << cuts[s]
    return mask - (1 << 64) if mask >> 63 else mask


def chain_keys(fp: Column, segments: int = SEGMENTS) -> Column:
    """For each start on the ring, (start, the equal part of the chain)."""
    k = (segments - 1) // 2
    return F.array(*[F.struct(F.lit(i).alias("start"), fp.bitwiseAND(F.lit(_arc(segments, i, k)).cast("long")).alias("arc")) for i in range(segments)])


def chain_fits(diff: Column, start: Column, segments: int = SEGMENTS, budget: int = BUDGET) -> Column:
    """Whether every chain from `start` keeps to its share of the budget; `diff` is the exclusive or of two fingerprints."""
    fits = F.lit(False)
    for i in range(segments):
        chain = F.lit(True)
        for length in range(1, segments + 1):
            chain = chain & (F.bit_count(diff.bitwiseAND(F.lit(_arc(segments, i, length)).cast("long"))) <= budget * length // segments)
        fits = fits | ((start == i) & chain)
    return fits


def _equal(segments: int, start: int, without: int | None) -> int:
    """Mask of the part that is equal for pairs keyed at `start`: the first k segments, or the first 2k but one."""
    k = (segments - 1) // 2
    if without is None:
        return _arc(segments, start, k)
    return _arc(segments, start, 2 * k) & ~_arc(segments, start + without, 1)


def longer_keys(fp: Column, start: Column, segments: int = SEGMENTS) -> Column:
    """For a fingerprint keyed at `start`, (without, the longer equal part): of the k segments after the key one bit may differ, so all but one of them are equal."""
    k = (segments - 1) // 2
    own = [F.array(*[F.struct(F.lit(j).alias("without"), fp.bitwiseAND(F.lit(_equal(segments, i, j)).cast("long")).alias("arc")) for j in range(k, 2 * k)]) for i in range(segments)]
    return F.element_at(F.array(*own), start + 1)


def _sized(keyed: DataFrame, name: str) -> DataFrame:
    """The rows of keys that several have, with the size of their bucket."""
    sizes = keyed.groupBy("start", "without", "arc").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return materialise(keyed.join(sizes, ["start", "without", "arc"]), name)


def _pairs(few: DataFrame, segments: int) -> DataFrame:
    a, b = few.alias("a"), few.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    near = (F.col("a.start") == F.col("b.start")) & (F.col("a.without") == F.col("b.without")) & (F.col("a.arc") == F.col("b.arc")) & (F.col("a.node") < F.col("b.node"))
    return a.join(b, near & chain_fits(diff, F.col("a.start"), segments) & (F.bit_count(diff) <= BUDGET)).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def links(classes: DataFrame, segments: int = SEGMENTS, bucket_cap: int = 256) -> DataFrame:
    """Edges (u, v) between classes (fp, node) such that fingerprints within two bits are connected; u and v are within two bits.

    Buckets up to `bucket_cap` give each link by itself. Larger ones are keyed again by longer chains, which the budgets
    allow one differing segment; those that are still larger give links to the smallest node at each midpoint.
    """
    once = classes.select("fp", "node", F.explode(chain_keys(F.col("fp"), segments)).alias("k")).select("fp", "node", "k.start", F.lit(-1).alias("without"), "k.arc")
    found = _sized(materialise(once, "ring"), "candidates")
    crowded = found.where(F.col("size") > bucket_cap).select("fp", "node", "start", F.explode(longer_keys(F.col("fp"), F.col("start"), segments)).alias("k"))
    again = _sized(crowded.select("fp", "node", "start", "k.without", "k.arc"), "longer-candidates")
    # A bit within the equal part cannot differ, so midpoints lie outside it.
    k = (segments - 1) // 2
    outside = [[F.array(F.lit(0).cast("long"), *[F.lit(x).cast("long") for x in _bits(~_equal(segments, i, j))]) for j in range(k, 2 * k)] for i in range(segments)]
    free = F.element_at(F.element_at(F.array(*[F.array(*own) for own in outside]), F.col("start") + 1), F.col("without") - k + 1)
    many = again.where(F.col("size") > bucket_cap).select("start", "without", "arc", "node", F.explode(F.transform(free, lambda x: F.col("fp").bitwiseXOR(x))).alias("mid"))
    low = many.groupBy("start", "without", "arc", "mid").agg(F.min("node").alias("low"))
    hubs = many.join(low, ["start", "without", "arc", "mid"]).where("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v"))
    small = F.col("size") <= bucket_cap
    return _pairs(found.where(small), segments).union(_pairs(again.where(small), segments)).union(hubs).distinct()


def _bits(mask: int) -> list[int]:
    return [x - (1 << 64) if x >> 63 else x for x in (1 << j for j in range(64)) if mask & x]


def near_groups(docs: DataFrame, shingle: int = 3, segments: int = SEGMENTS, bucket_cap: int = 256) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text): fingerprints within two bits are linked.

    component_id is the smallest doc_id reachable, the row's own included. Null and empty texts share fingerprint zero
    and are linked like any other; rows with equal fingerprints form one class before candidates are sought, so copies
    cost one row each. An empty table gives an empty result; further columns are ignored. Rows that repeat a doc_id
    each get a row. A row without doc_id is in no group: its component_id is null.
    """
    marks = materialise(fingerprints(docs, shingle), "fingerprints")
    classes = marks.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    groups = connected(links(classes, segments, bucket_cap))
    of_class = classes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marks.join(of_class, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
