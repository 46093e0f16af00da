"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

Each class, toxic and ordinary, has discounted counts of the longest contexts (up to five bytes, words begin and end with
a mark). Both back off, with what the discounts free and a prior besides, to one interpolated Kneser-Ney model of all
words, so that rare expressions are smoothed by counts that both share; each model sums to one after every context.

A toxic document has ordinary words too: its words are a mixture. Which of them are toxic is not labelled; it is found by
expectation-maximisation, in which the words of toxic documents count for the toxic model as far as it explains them
better than the ordinary one does. A document's score compares the log-likelihood of all its words, repeats included,
under the mixture with that under the ordinary model alone: by word, and by the root of the number of words, as the noise
of such sums grows with it. Scores of labelled documents by a model of the others map these to 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewalk.llm.common import flat_values, fold, lower_words, pieces, sample_by_label, segment_sums, starts_of, values_of

ORDER = 6
DISCOUNT = 0.75
#: Observations of the shared model that each class's context starts from.
PRIOR = 20.0
#: Share of toxic words in a toxic document.
SHARE = 0.02
ROUNDS = 10
#: Labelled documents of each class that the fit takes, about; it does not grow with the input.
MAX_PER_CLASS = 2000
BEGIN, END = b"\x01", b"\x02"


@dataclass
class Model:
    """Log-likelihood ratios: of known grams, and of unknown grams after known contexts."""

    grams: np.ndarray
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    #: Of the mean ratio, of the sum of ratios by the root of the number of words, and the offset.
    calibration: tuple[float, float, float] = (1.0, 0.0, 0.0)


def _laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked words end to end; for each byte but the begin marks, its place and its depth in the word."""
    data = np.frombuffer(b"".join(BEGIN + w + END for w in words), dtype=np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    depth = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(depth)
    return data, at, depth[at]


def _keys(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes that end at each place, the last lowest."""
    key = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        key |= data[at - j].astype(np.uint64) << np.uint64(8 * j)
    return key


def _full(data: np.ndarray, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Keys of the longest grams, with their size in the top byte; a shorter one begins with the begin mark."""
    size = np.minimum(depth + 1, ORDER)
    out = np.zeros(len(at), dtype=np.uint64)
    for n in range(2, ORDER + 1):
        own = np.flatnonzero(size == n)
        out[own] = _keys(data, at[own], n) | np.uint64(n << 56)
    return out


def _context(keys: np.ndarray) -> np.ndarray:
    body = np.uint64((1 << 56) - 1)
    return ((keys & body) >> np.uint64(8)) | (keys & ~body)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 if not there."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _shared(data: np.ndarray, at: np.ndarray, depth: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each gram size 0 to ORDER - 1, sorted grams with their Kneser-Ney probability from continuation counts."""
    tables = [(np.zeros(0, np.uint64), np.zeros(0))]
    for n in range(1, ORDER):
        longer = np.unique(_keys(data, at[depth >= n], n + 1))
        grams, count = np.unique(longer & np.uint64((1 << (8 * n)) - 1), return_counts=True)
        if n == 1:
            tables.append((grams, (count + 0.5) / (count.sum() + 128)))
            continue
        context, of = np.unique(grams >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(of, weights=count), np.bincount(of)
        low_grams, low = tables[n - 1]
        below = low[_find(low_grams, grams & np.uint64((1 << (8 * (n - 1))) - 1))]
        tables.append((grams, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds[of] * below) / total[of]))
    return tables


class Counts:
    """The grams of distinct words and what the shared model makes of them, for any counts of the words."""

    def __init__(self, words: list[bytes], every: np.ndarray) -> None:
        data, at, depth = _laid_out(words)
        self.of_word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) + 1 for w in words])
        keys = _full(data, at, depth)
        self.grams, self.of = np.unique(keys, return_inverse=True)
        self.contexts, self.of_context = np.unique(_context(self.grams), return_inverse=True)
        low = np.zeros(len(self.grams))
        tables, size = _shared(data, at, depth), (self.grams >> np.uint64(56)).astype(int)
        for n in range(2, ORDER + 1):
            own = np.flatnonzero(size == n)
            table, p = tables[n - 1]
            low[own] = p[_find(table, self.grams[own] & np.uint64((1 << (8 * (n - 1))) - 1))]
        kept, freed, total = self.by_gram(every)
        self.shared = (kept + freed[self.of_context] * low) / np.maximum(total, 1e-9)[self.of_context]

    def by_gram(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From counts of words: of each gram what the discount leaves, of each context what it takes and the total."""
        c = np.bincount(self.of, weights=counts[self.of_word], minlength=len(self.grams))
        freed, total = (np.bincount(self.of_context, weights=w, minlength=len(self.contexts)) for w in (np.minimum(c, DISCOUNT), c))
        return np.maximum(c - DISCOUNT, 0), freed, total

    def model(self, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
        logs, backs = [], []
        for counts in (toxic, ordinary):
            kept, freed, total = self.by_gram(counts)
            back = (freed + PRIOR) / (total + PRIOR)
            logs.append(np.log(kept / (total + PRIOR)[self.of_context] + back[self.of_context] * self.shared))
            backs.append(np.log(back))
        return Model(self.grams, (logs[0] - logs[1]).astype(np.float32), self.contexts, (backs[0] - backs[1]).astype(np.float32))

    def ratios(self, model: Model, words: int) -> np.ndarray:
        """word_ratios of the counted words."""
        return np.bincount(self.of_word, weights=model.gram_ratio[self.of], minlength=words)


def mixed(ratio: np.ndarray) -> np.ndarray:
    """log of P(word) in a toxic document over P(word | ordinary), from log P(word | toxic) / P(word | ordinary)."""
    return np.log(1 - SHARE + SHARE * np.exp(np.clip(ratio, -20, 20)))


def count_model(words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray, rounds: int = ROUNDS) -> Model:
    """From distinct words and how often the documents of each class have them."""
    counts, share = Counts(words, toxic + ordinary), np.full(len(words), 0.5)
    for _ in range(rounds):
        model = counts.model(toxic * share, ordinary + toxic * (1 - share))
        odds = SHARE * np.exp(np.clip(counts.ratios(model, len(words)), -20, 20))
        share = odds / (1 - SHARE + odds)
    return model


def word_ratios(words: list[bytes], model: Model) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary). After an unknown gram both back off to the same shared probability."""
    if not (words and len(model.grams)):
        return np.zeros(len(words))
    data, at, depth = _laid_out(words)
    keys = _full(data, at, depth)
    i = _find(model.grams, keys)
    ratio = np.where(i >= 0, model.gram_ratio[i], 0.0)
    unknown = np.flatnonzero(i < 0)
    j = _find(model.contexts, _context(keys[unknown]))
    ratio[unknown] = np.where(j >= 0, model.context_ratio[j], 0.0)
    return segment_sums(ratio, starts_of([len(w) + 1 for w in words]))


def ratios(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the mixture's log-likelihood ratio over the words of each text, and their number."""
    flat, sizes = lower_words(pc.utf8_lower(texts))
    held = flat.dictionary_encode()
    values = mixed(word_ratios(values_of(held.dictionary), model))[held.indices.to_numpy()]
    return segment_sums(values, starts_of(sizes)), sizes


def normalised(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """texts x 2: the mean by word, and the sum by the root of the number of words; 0 without words."""
    n = np.maximum(words, 1)
    return np.stack([total / n, total / np.sqrt(n)], axis=1)


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients and offset of a logistic regression by Newton's method."""
    spread = np.maximum(x.std(axis=0), 1e-9)
    z, b = np.column_stack([x / spread, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(b))
        b += np.linalg.solve(h, z.T @ (weight * (y - p)) - 1e-2 * b)
    return np.append(b[:-1] / spread, b[-1])


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model:
    """Learn from labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    Of rows that repeat a doc_id, in `docs` or in `labels`, one counts. Without labels of both classes every text gets the rate of toxic
    labels, drawn towards a quarter by one label.
    """
    marked = labels.where((fold(F.col("doc_id"), 5) != 0) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    sampled, share = sample_by_label(marked, "toxic", max_per_class)
    few = docs.select("doc_id", "text").join(F.broadcast(sampled), "doc_id").select("doc_id", "text", "toxic").dropDuplicates(["doc_id"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text as its distinct words and their counts."""
        for rows, texts in pieces(batches):
            flat, sizes = lower_words(pc.utf8_lower(texts))
            held = flat.dictionary_encode()
            words, at = values_of(held.dictionary), held.indices.to_numpy()
            pair, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * (len(words) + 1) + at, return_counts=True)
            cuts = np.searchsorted(pair // (len(words) + 1), np.arange(len(sizes) + 1)).tolist()
            kinds = (pair % (len(words) + 1)).tolist()
            joined = [b"\n".join([words[k] for k in kinds[a:b]]) for a, b in zip(cuts, cuts[1:])]
            times = [n[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(2).cast(pa.int32()), pa.array(joined, pa.binary()), pa.array(times, pa.binary())], names=["doc_id", "toxic", "words", "times"])

    got = few.mapInArrow(count, "doc_id long, toxic int, words binary, times binary").toArrow().sort_by([("doc_id", "ascending"), ("words", "ascending")]).combine_chunks()
    toxic = got.column("toxic").to_numpy()
    if not (0 < toxic.sum() < len(toxic)):
        rate = (share.get(1, 0) + 0.25) / (share.get(1, 0) + share.get(0, 0) + 1)
        empty = np.zeros(0, np.uint64)
        return Model(empty, np.zeros(0, np.float32), empty, np.zeros(0, np.float32), (0.0, 0.0, float(np.log(rate / (1 - rate)))))
    ids: dict[bytes, int] = {}
    held = [[ids.setdefault(w, len(ids)) for w in x.split(b"\n")] if x else [] for x in got.column("words").to_pylist()]
    sizes, at = np.array([len(x) for x in held]), np.array([w for x in held for w in x], dtype=np.int32)
    times = flat_values(got.column("times").chunk(0), "<u4")[0]
    of, words = np.repeat(np.arange(len(held)), sizes), list(ids)
    del got, held, ids

    def learn(which: np.ndarray) -> Model:
        use = which[of]
        toxic_n, ordinary_n = (np.bincount(at[use & (toxic[of] == y)], weights=times[use & (toxic[of] == y)], minlength=len(words)) for y in (1, 0))
        seen = np.flatnonzero(toxic_n + ordinary_n)
        return count_model([words[i] for i in seen], toxic_n[seen], ordinary_n[seen])

    # Scores of each half by a model of the other.
    half, scored = np.arange(len(toxic)) % 2 == 0, np.zeros((len(toxic), 2))
    for own in (half, ~half):
        if 0 < toxic[~own].sum() < (~own).sum() and own.any():
            value = mixed(word_ratios(words, learn(~own)))
            total, n = (np.bincount(of, weights=w, minlength=len(toxic)) for w in (value[at] * times, times))
            scored[own] = normalised(total, n)[own]
    model = learn(np.ones(len(toxic), bool))
    y = toxic.astype(float)
    weight = np.where(y == 1, share[1] / y.sum(), share[0] / (len(y) - y.sum())) * len(y) / (share[0] + share[1])
    model.calibration = tuple(_calibrate(scored, y, weight).tolist())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, ratio, score, predicted) for every row of `docs` (doc_id, text).

    ratio is the log-likelihood ratio by word, score the calibrated probability of label 1, predicted 1 from 0.5 on. Null
    and empty texts have ratio 0 and the score that follows from it. An empty table gives an empty result; repeated rows
    each get one; further columns are ignored; a text of any length is scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_mean, by_root, offset = shared.value.calibration
        for part, texts in pieces(batches):
            x = normalised(*ratios(texts, shared.value))
            p = 1 / (1 + np.exp(-np.clip(x[:, 0] * by_mean + x[:, 1] * by_root + offset, -40, 40)))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(x[:, 0]), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "ratio", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ratio double, score double, predicted int")
