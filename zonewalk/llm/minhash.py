"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard verification on the whole sets.

Two permutations of the positions 0 .. 2^32 - 1 make all coordinates of a signature: the first scatters the shingles, the
second, shifted by k on the circle, orders them for coordinate k; the coordinate is the least place of a set's shingles.
Each is a rule (multiplications by odd numbers and shifts, all of them reversible), so no table travels.

BANDS bands of ROWS coordinates are the candidate keys. Two sets of Jaccard similarity s share one with probability
1 - (1 - s^8)^96: all but 2 in 10^8 pairs at 0.8, the least that counts, all but 5 in 10^14 at 0.85.

Pairs of a bucket are not listed. Documents with equal sets are one node. A node is compared first with the most central
one that it shares a key with: of many copies of a text, all with the text itself. Where buckets still hold several groups,
nodes outside the largest one are compared with its most central member, and only what then is left apart with the nodes of
other groups. There sizes and bitmaps are compared within the join: pairs that they rule out never become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewalk.llm.common import Filter, flat_values, forget, lower_words, materialise, pieces, released, semi_join, starts_of, values_of
from zonewalk.llm.components import connected
from zonewalk.llm.simhash import majority, word_hashes

#: Words of a shingle.
SHINGLE = 2
#: Least similarity, as a fraction.
PART, WHOLE = 4, 5
#: Bands of a signature and coordinates of a band.
BANDS, ROWS = 96, 8
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose shingles a Python worker holds at once; one longer text makes a piece of its own.
PIECE_BYTES = 1 << 20
#: Longs of the bitmap of the smallest sets, as a power of two. A bitmap has two bits a shingle at least.
LEAST_LEVEL = 2


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the shingles of each text, sorted, end to end, and how many each has.

    A text with fewer words is one shingle, the whole sequence; one without words has none.
    """
    flat, sizes = lower_words(texts)
    held = flat.dictionary_encode()
    h = word_hashes(values_of(held.dictionary))[held.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    starts, out = starts_of(sizes), []
    rolled = h[: max(len(h) - shingle + 1, 0)].copy()
    for i in range(1, shingle):
        rolled = rolled * FACTOR + h[i : len(rolled) + i]
    none = np.zeros(0, np.uint64)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(rolled[a : b - shingle + 1]))
        elif b == a:
            out.append(none)
        else:
            short = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                short = short * FACTOR + h[i : i + 1]
            out.append(short)
    return np.concatenate(out) if out else none, np.array([len(x) for x in out], dtype=np.int64)


def scattered(hashes: np.ndarray) -> np.ndarray:
    """The first permutation: where the shingles lie on the circle."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signatures(hashes: np.ndarray, sizes: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """Sets x `count`: coordinate k is the least place of a set under the second permutation shifted by k. Sizes are 1 or more."""
    at, starts = scattered(hashes), starts_of(sizes)[:-1]
    out, place, half = np.empty((count, len(sizes)), np.uint32), np.empty_like(at), np.empty_like(at)
    for k in range(count):
        np.add(at, np.uint32(k), out=place)
        np.right_shift(place, np.uint32(16), out=half)
        np.bitwise_xor(place, half, out=place)
        np.multiply(place, np.uint32(0x7FEB352D), out=place)
        np.right_shift(place, np.uint32(15), out=half)
        np.bitwise_xor(place, half, out=place)
        np.multiply(place, np.uint32(0x846CA68B), out=place)
        out[k] = np.minimum.reduceat(place, starts)
    return np.ascontiguousarray(out.T)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Sets x bands: a 64-bit key of each band, that of its number and its coordinates."""
    halves = signature.view(np.uint64).reshape(len(signature), -1, rows // 2)
    key = np.broadcast_to(np.arange(1, halves.shape[1] + 1, dtype=np.uint64) * FACTOR, halves.shape[:2]).copy()
    for j in range(rows // 2):
        key = (key ^ halves[:, :, j]) * FACTOR
        key ^= key >> np.uint64(31)
    return key * FACTOR


def level_of(sizes: np.ndarray) -> np.ndarray:
    """The least power of two, LEAST_LEVEL at least, of longs that hold two bits a shingle."""
    return np.maximum(LEAST_LEVEL, np.ceil(np.log2(np.maximum(sizes, 1) / 32)).astype(np.int64))


def bitmap(hashes: np.ndarray, level: int) -> np.ndarray:
    """2^level longs: a bit is 1 if an odd number of shingles fall on it."""
    bits = 64 << level
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def row_key() -> Column:
    """A row by its doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


SEEN = "row long, doc_id long, node long, n int, fp long, keys array<long>, shingles binary, level int, odd array<long>, finer array<long>"


def marks(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: SEEN of rows (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, PIECE_BYTES):
            hashes, sizes = shingle_sets(texts, shingle)
            cuts, full = starts_of(sizes).tolist(), np.flatnonzero(sizes)
            sets = [hashes[cuts[i] : cuts[i + 1]] for i in full]
            data = [x.tobytes() for x in sets]
            node, fp = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            node[full] = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in data), np.uint64, len(data)).view(np.int64)
            keys, levels = [None] * len(sizes), level_of(sizes)
            shingles, odd, finer = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
            if len(full):
                fp[full] = majority(hashes, sizes[full]).view(np.int64)
                banded = band_keys(signatures(hashes, sizes[full])).view(np.int64)
                for j, i in enumerate(full):
                    keys[i], shingles[i] = banded[j], data[j]
                    odd[i], finer[i] = bitmap(sets[j], int(levels[i])), bitmap(sets[j], int(levels[i]) + 1)
            empty = sizes == 0
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(node, mask=empty), pa.array(sizes.astype(np.int32)), pa.array(fp, mask=empty), pa.array(keys, longs), pa.array(shingles, pa.binary()), pa.array(levels.astype(np.int32)), pa.array(odd, longs), pa.array(finer, longs)],
                names=["row", "doc_id", "node", "n", "fp", "keys", "shingles", "level", "odd", "finer"],
            )

    return released(run)


def marked(docs: DataFrame, shingle: int) -> DataFrame:
    """SEEN of the rows of `docs` (doc_id, text), written once: all later steps read columns of it and no text again.

    node: the set as a number; rows of equal sets have the same. fp: SimHash of the set. keys: band keys. odd, finer: bitmaps
    of the set at its level and the next one. A text without words has node null and n 0; rows without doc_id are in no group.
    """

    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(rows.mapInArrow(marks(shingle), SEEN), "near-sets")


def buckets(seen: DataFrame) -> DataFrame:
    """(key, node, size): nodes by the keys that several share, written; size is how many rows have the key.

    Counts are combined before they move, and of the keys only those that a filter of the shared ones passes are moved.
    """
    keyed = seen.where("node is not null and doc_id is not null").select("node", F.explode("keys").alias("key"))
    own = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size"))
    shared = materialise(own.where("low < high").select("key", "size"), "near-keys")
    chosen = Filter.of(shared.select("key"), shared.count())
    return materialise((chosen.passed(keyed) if chosen else keyed).join(shared.hint("merge"), "key").distinct(), "near-buckets")


def central(found: DataFrame) -> DataFrame:
    """`found` with `score`: how many rows a node meets in its buckets, and a smaller node first, for comparison."""
    own = found.groupBy("node").agg(F.sum("size").alias("met")).select("node", F.struct("met", (-F.col("node")).alias("less")).alias("score"))
    return materialise(found.select("key", "node").join(own, "node"), "near-scored")


def best_hubs(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """(u, v): each of `members` (key, node) with the most central of the hubs (key, hub, score) of its keys, once."""
    pairs = members.join(hubs, "key").where("node <> hub").groupBy("node").agg(F.max_by("hub", "score").alias("hub"))
    return pairs.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v"))


def bitmaps_fit(a: str, b: str) -> Column:
    """Whether sizes and bitmaps of rows `a` and `b` allow similar sets.

    Each shingle that only one has changes one bit, so sets differ by as many shingles as bits, at least; similar sets
    differ by (1 - s) / (1 + s) of their sizes at most. Bitmaps are compared at the level of the larger set; if similar,
    levels differ by one at most.
    """
    col = lambda side, c: F.col(f"{side}.{c}")
    sized = F.least(col(a, "n"), col(b, "n")) * WHOLE >= F.greatest(col(a, "n"), col(b, "n")) * PART
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    step = col(a, "level") - col(b, "level")
    bits = F.when(step == 0, differ(col(a, "odd"), col(b, "odd"))).when(step == 1, differ(col(a, "odd"), col(b, "finer"))).when(step == -1, differ(col(a, "finer"), col(b, "odd")))
    return sized & (bits * (PART + WHOLE) <= (col(a, "n") + col(b, "n")) * (WHOLE - PART))


PROFILE = ("n", "level", "odd", "finer")


def _with_both(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    for side in ("u", "v"):
        pairs = pairs.join(of.select(F.col("node").alias(side), F.struct(*columns).alias(f"of_{side}")), side)
    return pairs


def similar(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar, written. Only sets of pairs that sizes and bitmaps allow are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, n), (y, m) = (flat_values(batch.column(i), "<u8") for i in (2, 3))
            a, b, keep = starts_of(n).tolist(), starts_of(m).tolist(), []
            for i in range(batch.num_rows):
                own, other = x[a[i] : a[i + 1]], y[b[i] : b[i + 1]]
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append((PART + WHOLE) * both >= PART * (len(own) + len(other)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    listed = materialise(pairs.distinct(), "near-listed")
    profiles = _held(seen, listed, *PROFILE)
    few = materialise(_with_both(listed, profiles, *PROFILE).where(bitmaps_fit("of_u", "of_v")).select("u", "v"), "near-pairs")
    sets = _with_both(few, _held(seen, few, "shingles"), "shingles")
    return materialise(sets.select("u", "v", "of_u.shingles", F.col("of_v.shingles").alias("others")).mapInArrow(released(run), "u long, v long"), "near-links")


def _held(seen: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """(node, ...) of the nodes in `pairs` (u, v), each once."""
    ends = materialise(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "near-ends")
    return semi_join(seen.select("node", *columns), ends).dropDuplicates(["node"])


def labels(links: DataFrame) -> DataFrame:
    """(node, label): the smallest neighbour's smallest neighbour. Nodes with one label are connected; the reverse need not hold."""
    both = links.select(F.col("u").alias("node"), F.col("v").alias("to")).union(links.select("v", "u"))
    once = both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label"))
    again = both.join(once.select(F.col("node").alias("to"), F.col("label").alias("far")), "to").groupBy("node").agg(F.least(F.min("far"), F.col("node")).alias("label"))
    return materialise(again, "near-labels")


def open_buckets(found: DataFrame, near: DataFrame) -> DataFrame:
    """(key, node, score, label, main) of the buckets in which links leave several labels; main is the most frequent there."""
    members = found.join(labels(near), "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("label", F.struct("size", "label")).alias("main"))
    return materialise(members.join(parts.where("parts > 1").drop("parts"), "key"), "near-open")


def components(seen: DataFrame, close: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes of `seen` that are similar to another, directly or through others.

    close: further candidate pairs (u, v). The component is the smallest node.
    """
    found = central(buckets(seen))
    hubs = found.groupBy("key").agg(F.max_by("node", "score").alias("hub"), F.max("score").alias("score"))
    first = best_hubs(found.select("key", "node"), hubs)
    near = similar(first.union(close) if close is not None else first, seen)
    forget(seen.sparkSession)
    left = open_buckets(found, near)
    mains = left.where("label = main").groupBy("key").agg(F.max_by("node", "score").alias("hub"), F.max("score").alias("score"))
    near = near.union(similar(best_hubs(left.where("label <> main").select("key", "node"), mains), seen))
    left = open_buckets(left.select("key", "node", "score"), near)
    forget(seen.sparkSession)
    profiles = semi_join(seen.select("node", *PROFILE), materialise(left.select("node").distinct(), "near-ends")).dropDuplicates(["node"])
    left = materialise(left.join(profiles, "node"), "near-apart")
    a, b = left.where("label <> main").alias("a"), left.alias("b")
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label")) & ((F.col("b.label") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
    rest = a.join(b, apart & bitmaps_fit("a", "b")).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
    groups = materialise(connected(near.union(similar(rest, seen))), "near-groups")
    forget(seen.sparkSession)
    return groups


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text).

    Sets of shingles with a Jaccard similarity of 0.8 or more are linked; component_id is the smallest doc_id reachable, the
    row's own included, and kept tells whether it is the row's own. A text without words, null or empty, has no shingles
    and is linked with nothing. An empty table gives an empty result; further columns are ignored; a text of any length is
    taken whole; rows that repeat a doc_id each get a row by their own text. A row without doc_id is in no group: its
    component_id is null and it is kept.
    """
    seen = marked(docs, shingle)
    members = seen.where("doc_id is not null and node is not null").select("node", "doc_id")
    placed = members.join(components(seen), "node")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("least"))
    # Nodes in no component still hold all rows of one set.
    alone = members.groupBy("node").agg(F.min("doc_id").alias("own"))
    of_node = placed.select("node", "component").distinct().join(least, "component").select("node", "least")
    known = alone.join(of_node, "node", "left").select("node", F.coalesce("least", "own").alias("least"))
    out = seen.select("doc_id", "node", F.col("n").cast("long").alias("n_shingles")).join(known, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
