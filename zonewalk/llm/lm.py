"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) P(cell | class, history) P(token | cell). The first two factors are softmaxes over
the sums of hashed feature rows: the word before (bigram), the two before together (trigram), and the words two and three
back (skips); rows of the second are hashed together with the class. Classes are groups of frequent words that keep the
same company, each cut by frequency, one for the end of a text, and one for all other words. The words of a class are
dealt to its cells by count, so that a frequent word has a cell to itself and its history alone decides; other words
have their cell by how they end. Within a cell, tokens share its probability by their counts in all training texts. Counts
of other words are discounted and unknown words that end alike get what that frees, so the model is a distribution over
the vocabulary and, for each such ending, `unknown`.

Counts and company cover all training texts. Each text is encoded once as word ids and the rounds and the scoring read
those. The feature rows are trained by rounds of distributed gradient updates: in each, tasks update the rows on their
texts of that round's slice, and the rows are averaged by how often each was used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewalk.llm.common import flat_values, lower_words, materialise, pieces, segment_sums, starts_of, sum_blocks, values_of

#: Kinds of words without an id of their own, by their last two bytes.
KINDS = 256
#: Words with an id of their own: the most frequent ones, so many at most, so that ids and kinds fit in 16 bits.
WORDS = 65536 - KINDS - 1
#: Words whose counts are broadcast, by hash: 16 bytes each. Counts of all others come by a join.
COUNTED = 1 << 19
GROUPS, CUTS = 6, 5
CLASSES = GROUPS * CUTS + 2
ENDING, OTHER = CLASSES - 2, CLASSES - 1
CELLS = 32
#: Hashed rows of each feature: of the class factor, and of the cell factor.
FEATURES, SLOT_BITS = 4, 12
INNER, INNER_BITS = 3, 13
ROUNDS = 3
BATCH_TOKENS = 16384
ANCHORS = 64
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 500_000
#: Feature rows that are averaged together.
AVERAGED = 1024
#: Words whose company is added up together.
BLOCK_WORDS = 1024
END = b"\n"  # no word holds it
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: bytes) -> int:
    """The same as Spark's xxhash64 of the word, unsigned."""
    return xxhash.xxh64_intdigest(word, 42)


def kind_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % KINDS


@dataclass
class Lexicon:
    """What is known of the training words: `hashes` (sorted) with their `counts` and `ids` (-1: none); `frequent`: counts by id.

    other_total and other_distinct: sums over the words without an id, by cell.
    """

    total: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    frequent: np.ndarray
    other_total: np.ndarray
    other_distinct: np.ndarray
    discount: float
    end: int

    def base(self, count: np.ndarray | int) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.distinct + 1))

    def inside(self, count: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """log10 P(token | cell) of words without an id; of an unknown one (count 0) that of `unknown`."""
        freed = np.maximum(self.discount * self.other_distinct[cells], 1e-9)
        return np.log10(np.where(count > 0, count - self.discount, freed) / np.where(self.other_total[cells] > 0, self.other_total[cells], freed))


@dataclass
class Model:
    """classes, cells, within: of each id and each kind; outer and inner: the feature rows of the two softmaxes."""

    classes: np.ndarray
    cells: np.ndarray
    within: np.ndarray
    bias: np.ndarray
    cell_bias: np.ndarray
    outer: np.ndarray
    inner: np.ndarray


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of `docs` (text), ends included; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> pa.Table:
            return pa.Table.from_batches(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

        held, size, texts = [], 0, 0
        for part, column in pieces(batches):
            found = pc.value_counts(lower_words(column)[0])
            held.append(pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "c"]))
            size, texts = size + len(found), texts + part.num_rows
            if size > HELD_WORDS:
                now = merged()
                if now.num_rows > HELD_WORDS // 2:
                    yield from now.to_batches(1 << 16)
                    now = now.slice(0, 0)
                held, size = now.combine_chunks().to_batches(), now.num_rows
        if held:
            yield from merged().to_batches(1 << 16)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([texts], pa.int64())], names=["word", "c"])

    return materialise(docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def leading(count: Column) -> Column:
    """The count with all but its seven leading bits cleared."""
    bits = F.greatest(F.floor(F.log2(F.greatest(count, F.lit(1)).cast("double"))).cast("int") - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", count, bits), bits)


def least_count(vocabulary: DataFrame, most: int) -> int:
    """The smallest count, 2 at least, that no more than `most` words reach: words of equal count are all taken or none.

    A histogram by leading bits finds the range in which it lies, an exact one over that range the count itself.
    """
    often = vocabulary.where("c > 1")
    above, last = 0, None
    for r in sorted(often.groupBy(leading(F.col("c")).alias("low")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.low):
        if above + r.n > most:
            break
        above, last = above + r.n, r.low
    else:
        return 2
    least = last
    for r in sorted(often.where(leading(F.col("c")) == r.low).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.c):
        if above + r.n > most:
            return r.c + 1
        above, least = above + r.n, r.c
    return least or 2


def lexicon(vocabulary: DataFrame, words: int = WORDS, counted: int = COUNTED) -> Lexicon:
    """From `vocabulary` (word, c). Only the hashes and counts of its `counted` most frequent words come to the driver."""
    c = F.col("c")
    floor, least = least_count(vocabulary, counted), least_count(vocabulary, words)
    is_end = F.col("word") == F.lit(END)
    got = vocabulary.where((c >= floor) | is_end).select(F.xxhash64("word").alias("h"), "c").toArrow()
    h, count = got.column(0).to_numpy().astype(np.int64).view(np.uint64), got.column(1).to_numpy().astype(np.int64)
    order = np.lexsort((h, -count))
    h, count = h[order], count[order]
    end = np.uint64(word_hash(END))
    own = np.flatnonzero((count >= least) | (h == end))
    ids = np.full(len(h), -1)
    ids[own] = np.arange(len(own))
    cell = F.crc32(F.substring("word", -2, 2)) % KINDS % CELLS
    others = vocabulary.where((c < least) & ~is_end).groupBy(cell.alias("cell")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("n")).collect()
    total, distinct = np.zeros(CELLS), np.zeros(CELLS)
    for r in others:
        total[r.cell], distinct[r.cell] = r.total, r.n
    sums = vocabulary.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (c, F.lit(1), (c == 1).cast("int"), (c == 2).cast("int")))).first()
    discount = min(max(sums[2] / max(sums[2] + 2 * sums[3], 1), 0.1), 0.9)
    sort = np.argsort(h)
    at_end = ids[h == end]
    return Lexicon(sums[0], sums[1], h[sort], count[sort], ids[sort], count[own], total, distinct, discount, int(at_end[0]) if len(at_end) else -1)


ENCODED = "row long, doc_id long, train boolean, slice int, n long, known long, base double, inside double, ids binary, word binary"


def encode(docs: DataFrame, lex: Lexicon, train: Column) -> tuple[DataFrame, DataFrame]:
    """Each text as ids, and (row, word, n) for the words whose count is not in the lexicon; both in the shared folder.

    Texts are (row, doc_id, train, slice, n, known, base, inside, ids): n tokens, known ones, log10 sums over those whose
    count the lexicon has. A word without an id is WORDS and its kind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        row = TaskContext.get().partitionId() << 40
        end = lex.end if lex.end >= 0 else WORDS + kind_of(END)
        end_base = float(lex.base(lex.frequent[lex.end] if lex.end >= 0 else 0))
        end_inside = 0.0 if lex.end >= 0 else float(lex.inside(np.zeros(1), np.array([kind_of(END) % CELLS]))[0])
        for part, texts in pieces(batches):
            flat, sizes = lower_words(texts)
            held = flat.dictionary_encode()
            words, at = values_of(held.dictionary), held.indices.to_numpy()
            hashes = np.fromiter(map(word_hash, words), np.uint64, len(words))
            kinds = np.fromiter(map(kind_of, words), np.int64, len(words))
            place = np.minimum(np.searchsorted(lex.hashes, hashes), len(lex.hashes) - 1)
            found = lex.hashes[place] == hashes if len(lex.hashes) else np.zeros(len(words), bool)
            count = np.where(found, lex.counts[place], 0) if len(lex.hashes) else np.zeros(len(words), np.int64)
            ids = np.where(found, lex.ids[place], -1) if len(lex.hashes) else np.full(len(words), -1)
            base = np.where(found, lex.base(count), 0.0)
            inside = np.where(found & (ids < 0), lex.inside(count, kinds % CELLS), 0.0)
            starts = starts_of(sizes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            tokens = np.full(len(at) + len(sizes), end, dtype="<u2")
            tokens[np.arange(len(at)) + doc] = np.where(ids < 0, WORDS + kinds, ids)[at]
            known, base, inside = (segment_sums(v[at], starts) for v in (found, base, inside))
            rare = np.flatnonzero(~found[at])
            pair, times = np.unique(doc[rare] * (len(words) + 1) + at[rare], return_counts=True)
            n, bytes_of = part.num_rows, tokens.tobytes()
            cuts = ((starts + np.arange(n + 1)) * 2).tolist()
            none = [None] * n
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + n)), part.column(0).cast(pa.int64()), part.column(2), part.column(3).cast(pa.int32()), pa.array(sizes + 1),
                pa.array(known.astype(np.int64) + (lex.end >= 0)), pa.array(base + end_base), pa.array(inside + end_inside), pa.array([bytes_of[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array(none, pa.binary()),
            ], names=names)
            if len(pair):
                void = [pa.nulls(len(pair), t) for t in (pa.int64(), pa.bool_(), pa.int32())]
                more = [pa.nulls(len(pair), t) for t in (pa.int64(), pa.float64(), pa.float64(), pa.binary())]
                of = pair % (len(words) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(pair // (len(words) + 1) + row), *void, pa.array(times), *more, held.dictionary.take(pa.array(of)).cast(pa.binary())], names=names)
            row += n

    names = [c.split()[0] for c in ENCODED.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(ROUNDS)).cast("int").alias("slice"))
    both = materialise(rows.mapInArrow(run, ENCODED), "encoded")
    return both.where("word is null").drop("word"), both.where("word is not null").select("row", "word", "n")


def _company(encoded: DataFrame, size: int) -> np.ndarray:
    """words x ANCHORS: how often each frequent word stands within three words of each of the most frequent ones."""
    blocks = -(-size // BLOCK_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        near = np.zeros(blocks * BLOCK_WORDS * ANCHORS, dtype=np.int64)
        for batch in batches:
            at, sizes = flat_values(batch.column(0), "<u2")
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            for i in range(0, len(at), 1 << 20):
                own, of, keys = at[i : i + (1 << 20) + 3].astype(np.int64), doc[i : i + (1 << 20) + 3], []
                for d in (1, 2, 3):
                    a, b = own[d : d + (1 << 20)], own[: len(own) - d][: 1 << 20]
                    same = of[d : d + (1 << 20)] == of[: len(own) - d][: 1 << 20]
                    for x, y in ((a, b), (b, a)):
                        use = np.flatnonzero(same & (x < size) & (y < ANCHORS))
                        keys.append(x[use] * ANCHORS + y[use])
                near += np.bincount(np.concatenate(keys), minlength=len(near))
        for b in range(blocks):
            part = near[b * BLOCK_WORDS * ANCHORS : (b + 1) * BLOCK_WORDS * ANCHORS]
            if part.any():
                yield b, part

    out = np.zeros((blocks * BLOCK_WORDS, ANCHORS), dtype=np.float32)
    for b, part in sum_blocks(encoded.select("ids"), run, blocks).items():
        out[b * BLOCK_WORDS : (b + 1) * BLOCK_WORDS] = part.reshape(-1, ANCHORS)
    return out[:size]


def _groups(near: np.ndarray) -> np.ndarray:
    """A group for each frequent word by its company: a mixture of word distributions over the most frequent words nearby."""
    heard = near.sum(axis=1)
    unit = near / np.maximum(np.linalg.norm(near, axis=1), 1e-9)[:, None]
    seeds = [0]
    first = np.flatnonzero(heard[: 16 * ANCHORS] >= 20)
    for _ in range(1, GROUPS):  # the next seed is the least like all before
        if len(first):
            seeds.append(int(first[np.argmin((unit[first] @ unit[seeds].T).max(axis=1))]))
    of = np.argmax(unit @ unit[seeds].T, axis=1)
    for _ in range(12):
        mean = np.stack([near[of == g].sum(axis=0) + 0.5 for g in range(GROUPS)])
        of = np.argmax(near @ np.log(mean / mean.sum(axis=1, keepdims=True)).T, axis=1)
    of[heard == 0] = np.argmax(np.bincount(of, minlength=GROUPS))
    return of


def _dealt(counts: np.ndarray) -> np.ndarray:
    """A cell for each word of a class, by falling count: a cell is closed when it has its share of what is left."""
    out, cell, held, left = np.zeros(len(counts), np.int64), 0, 0, int(counts.sum())
    for i, n in enumerate(counts.tolist()):
        out[i], held = cell, held + n
        if cell < CELLS - 1 and held * (CELLS - cell) >= left:
            left, held, cell = left - held, 0, cell + 1
    return out


def _begin(encoded: DataFrame, lex: Lexicon) -> Model:
    """The model before training: classes and cells with their shares of all tokens."""
    size = len(lex.frequent)
    classes, cells = np.full(WORDS + KINDS, OTHER), np.zeros(WORDS + KINDS, np.int64)
    cells[WORDS:] = np.arange(KINDS) % CELLS
    if size:
        group = _groups(_company(encoded, size))
        for g in range(GROUPS):
            own = np.flatnonzero(group == g)
            if len(own):
                share = np.cumsum(lex.frequent[own]) / lex.frequent[own].sum()
                classes[own] = g * CUTS + np.minimum((share * CUTS - 1e-9).astype(int), CUTS - 1)
        if lex.end >= 0:
            classes[lex.end] = ENDING
        for k in range(OTHER):
            own = np.flatnonzero(classes[:size] == k)
            cells[own] = _dealt(lex.frequent[own])
    mass = np.bincount(classes[:size] * CELLS + cells[:size], weights=lex.frequent, minlength=CLASSES * CELLS).reshape(CLASSES, CELLS)
    within = np.zeros(WORDS + KINDS)
    within[:size] = np.log10(lex.frequent / mass[classes[:size], cells[:size]])
    mass[OTHER] = lex.other_total
    # Empty cells stay empty, but a word that ends as no other does may come in the last class.
    open_cells = np.where(np.arange(CLASSES)[:, None] == OTHER, mass + 0.5, mass)
    cell_bias = np.log(np.maximum(open_cells, 1e-12) / np.maximum(open_cells.sum(axis=1, keepdims=True), 1e-9)).astype(np.float32)
    cell_bias[open_cells.sum(axis=1) == 0] = 0
    of = mass.sum(axis=1)
    bias = np.log((of + 0.5) / (of.sum() + 0.5 * CLASSES)).astype(np.float32)
    return Model(classes, cells, within, bias, np.maximum(cell_bias, -30), np.zeros((FEATURES << SLOT_BITS, CLASSES), np.float32), np.zeros((INNER << INNER_BITS, CELLS), np.float32))


def _histories(at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the ids and one of the tokens one, two and three back; 0 before a text's first."""
    first = starts_of(sizes)[:-1][sizes > 0]
    out, last = [], at + np.uint16(1)
    for _ in range(3):
        last = np.concatenate((last[:0], [0], last[:-1])).astype(np.uint16)[: len(at)] if len(at) else last
        last[first] = 0
        out.append(last)
    return out[0], out[1], out[2]


def _hashed(keys: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """16 bits each, so that they are sorted by radix."""
    return [(((k + np.uint64(1)) * FACTOR) >> np.uint64(64 - bits)).astype(np.uint16) for k in keys]


def _slots(back: tuple[np.ndarray, np.ndarray, np.ndarray], of: slice, classes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The feature rows of the tokens `of`, by feature: for the class, and for the cell in the token's class."""
    w1, w2, w3 = (w[of].astype(np.uint64) for w in back)
    both, kind = w1 * np.uint64(1_000_003) + w2, classes.astype(np.uint64) << np.uint64(40)
    return _hashed([w1, w2, w3, both], SLOT_BITS), _hashed([w1 + kind, w2 + kind, both + kind], INNER_BITS)


class Room:
    """Arrays of one batch that are used again and again, as fresh ones of this size cost more than what is done in them."""

    def __init__(self, width: int) -> None:
        self.sums, self.rows, self.share = (np.empty((BATCH_TOKENS, width), np.float32) for _ in range(3))


def _softmax(rows: np.ndarray, slots: list[np.ndarray], bias: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the feature rows and of `bias` (one row, or one by token), their exponentials, and the sums of those."""
    n, size = len(slots[0]), len(rows) // len(slots)
    z, more, e = room.sums[:n], room.rows[:n], room.share[:n]
    rows[:size].take(slots[0], axis=0, out=z, mode="clip")
    for f in range(1, len(slots)):
        z += rows[f * size : (f + 1) * size].take(slots[f], axis=0, out=more, mode="clip")
    z += bias
    np.exp(np.clip(z, -40, 40, out=z), out=e)
    return z, e, np.einsum("ij->i", e)


def _log_share(rows: np.ndarray, slots: list[np.ndarray], bias: np.ndarray, target: np.ndarray, room: Room) -> np.ndarray:
    z, _, total = _softmax(rows, slots, bias, room)
    return z[np.arange(len(target)), target] - np.log(total)


def _run_sums(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of rows, run i of n[i] rows from first[i]: row by row for all runs at once, the ends of long runs one run at a time."""
    out, more, done = values.take(first, axis=0), np.flatnonzero(n > 1), 1
    while len(more) and done < 16:
        out[more] += values.take(first[more] + done, axis=0)
        done += 1
        more = more[n[more] > done]
    for i, a, b in zip(more.tolist(), (first[more] + done).tolist(), (first[more] + n[more]).tolist()):
        out[i] += np.add.reduce(values[a:b], axis=0)
    return out


def _update(rows: np.ndarray, used: np.ndarray, slots: list[np.ndarray], bias: np.ndarray, target: np.ndarray, skip: np.ndarray | None, rate: float, room: Room) -> None:
    """One gradient step for the feature rows that the batch uses; tokens of `skip` pull at none."""
    _, step, total = _softmax(rows, slots, bias, room)
    step *= (-1 / total)[:, None]
    step[np.arange(len(target)), target] += 1
    if skip is not None:
        step[skip] = 0
    size = len(rows) // len(slots)
    for f, own in enumerate(slots):
        order = np.argsort(own, kind="stable")
        sorted_own = own[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_own[1:] != sorted_own[:-1])))
        n = np.diff(np.append(first, len(order)))
        at = sorted_own[first].astype(np.int64) + f * size
        rows[at] += _run_sums(step.take(order, axis=0, out=room.rows[: len(own)], mode="clip"), first, n) * (rate / (n + 10)).astype(np.float32)[:, None]
        used[at] += n


def _train(encoded: DataFrame, model: Model, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """One round: each task's updates on its texts, averaged by use."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    split = len(model.outer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rows = (m.outer.copy(), m.inner.copy())
        used, rooms = tuple(np.zeros(len(r), dtype=np.float32) for r in rows), (Room(CLASSES), Room(CELLS))
        for batch in batches:
            at, sizes = flat_values(batch.column(0), "<u2")
            back = _histories(at, sizes)
            for i in range(0, len(at), BATCH_TOKENS):
                of = slice(i, i + BATCH_TOKENS)
                classes, cells = m.classes[at[of]], m.cells[at[of]]
                outer, inner = _slots(back, of, classes)
                _update(rows[0], used[0], outer, m.bias, classes, None, rate, rooms[0])
                _update(rows[1], used[1], inner, m.cell_bias[classes], cells, np.flatnonzero(classes == ENDING), rate, rooms[1])
        for begin, own, n in ((0, rows[0], used[0]), (split, rows[1], used[1])):
            for b in range(0, len(own), AVERAGED):
                if n[b : b + AVERAGED].any():
                    yield pa.RecordBatch.from_arrays([pa.array([begin + b], pa.int64()), pa.array([n[b : b + AVERAGED].tobytes()], pa.binary()), pa.array([own[b : b + AVERAGED].astype(np.float16).tobytes()], pa.binary())], names=["block", "used", "rows"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, used, rows in zip(*(c.to_pylist() for c in batch.columns)):
                n = np.frombuffer(used, np.float32).astype(np.float64)
                t = total.setdefault(b, [np.zeros(AVERAGED), np.zeros((AVERAGED, CELLS))])
                t[0] += n
                t[1] += n[:, None] * np.frombuffer(rows, np.float16).reshape(AVERAGED, CELLS)
        for b, (n, t) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([n.astype(np.float32).tobytes()], pa.binary()), pa.array([(t / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())], names=["block", "used", "rows"])

    schema = "block long, used binary, rows binary"
    both = np.concatenate((model.outer, model.inner))
    for r in encoded.select("ids").mapInArrow(run, schema).repartition(len(both) // AVERAGED, "block").mapInArrow(mean, schema).collect():
        n, own = np.frombuffer(r.used, np.float32), np.frombuffer(r["rows"], np.float32).reshape(AVERAGED, CELLS)
        part = both[r.block : r.block + AVERAGED]
        both[r.block : r.block + AVERAGED] = np.where(n[:, None] > 0, own, part)
    return both[:split], both[split:]


def fit(encoded: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Model:
    """The model of the training texts of `encoded`; without any, one that knows classes by their bias alone."""
    own = encoded.where("train")
    model = _begin(own, lex)
    for r in range(rounds):
        model.outer, model.inner = _train(own.where(F.col("slice") % rounds == r), model, 1.0 / (1 + r))
    return model


def score(encoded: DataFrame, rare: DataFrame, model: Model, lex: Lexicon, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of `encoded`."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, rooms = shared.value, (Room(CLASSES), Room(CELLS))
        for batch in batches:
            at, sizes = flat_values(batch.column(batch.schema.get_field_index("ids")), "<u2")
            back, value = _histories(at, sizes), m.within[at]
            for i in range(0, len(at), BATCH_TOKENS):
                of = slice(i, i + BATCH_TOKENS)
                classes, cells = m.classes[at[of]], m.cells[at[of]]
                outer, inner = _slots(back, of, classes)
                share = _log_share(m.outer, outer, m.bias, classes, rooms[0])
                share = share + np.where(classes == ENDING, 0, _log_share(m.inner, inner, m.cell_bias[classes], cells, rooms[1]))
                value[of] += share / np.log(10)
            model_sum = segment_sums(value, starts_of(sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(batch.column(5).to_numpy() + model_sum)], names=[*batch.schema.names[:5], "score"])

    whole = encoded.select("row", "doc_id", "n", "known", "base", "inside", "ids").mapInArrow(run, "row long, doc_id long, n long, known long, base double, score double")
    c, n = F.coalesce("c", F.lit(0)), F.col("n")
    base = F.log10((c + 1) / F.lit(float(lex.total + lex.distinct + 1)))
    # Of a word without an id: its discounted count, or what the discounts of its cell free, over the cell's total.
    cell = (F.crc32(F.substring("word", -2, 2)) % KINDS % CELLS).cast("int")
    total, freed = (F.element_at(F.array(*[F.lit(float(x)) for x in v]), cell + 1) for v in (lex.other_total, np.maximum(lex.discount * lex.other_distinct, 1e-9)))
    inside = F.log10(F.when(c > 0, c - F.lit(lex.discount)).otherwise(freed) / F.when(total > 0, total).otherwise(freed))
    more = rare.join(vocabulary, "word", "left").groupBy("row").agg(F.sum(F.when(c > 0, n).otherwise(0)).alias("more"), F.sum(base * n).alias("base_more"), F.sum(inside * n).alias("score_more"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias
    return whole.join(more, "row", "left").select("doc_id", F.col("n").alias("n_tokens"), plus("known", "more")("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), plus("base", "base_more")("base_score"), plus("score", "score_more")("score"))


def score_corpus(docs: DataFrame, train: Column, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs` (doc_id, text); learns from the rows of `train`.

    Tokens are the lower-cased words and one end; null text counts as empty and has the end alone. base_score is the log10
    probability under add-one counts, score that of the model. Without a row of `train` (null counts as false) nothing
    is known and base_score is 0. An empty table gives an empty result; repeated rows each get one and count each;
    further columns are ignored. A text of any length is scored whole: one at a time beyond the size of a piece.
    """
    vocabulary = count_words(docs.where(train))
    lex = lexicon(vocabulary)
    encoded, rare = encode(docs, lex, train)
    return score(encoded, rare, fit(encoded, lex, rounds), lex, vocabulary)
