"""Quality rules: document statistics, and gradient-boosted trees over them with monotonic constraints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewalk.llm.common import chunks, fold, sample_by_label, segment_sums, starts_of
from zonewalk.llm.trees import Forest, boost

#: Labelled documents of each quality that the fit takes, about; it does not grow with the input.
MAX_PER_CLASS = 3000
SYMBOLS = b"#*$%&|<>"
#: Kinds of bytes: white space, lower case, upper case, digit, symbol, other ASCII, first of several, continuation.
KINDS = np.array([0 if b in b" \t\n\x0b\x0c\r" else 1 if 97 <= b < 123 else 2 if 65 <= b < 91 else 3 if 48 <= b < 58 else 4 if b in SYMBOLS else 5 if b < 128 else 7 if b < 192 else 6 for b in range(256)], dtype=np.int64)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbols", "upper", "digits", "other", "repeated", "repeated_lines", "same_as_last", "line_words")
#: The score never rises with these columns: symbols, repeated passages, repeated lines, doubled words.
NEVER_RISES = {FEATURES.index(f): -1 for f in ("symbols", "repeated", "repeated_lines", "same_as_last")}


def repeats(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: words in 3-word windows that it holds twice or more, and words equal to the one before."""
    n, docs = len(codes), len(starts) - 1
    doc = np.repeat(np.arange(docs), np.diff(starts))
    same = np.zeros(n, dtype=bool)
    same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    covered = np.zeros(n, dtype=bool)
    if n >= 3:
        whole = np.flatnonzero(doc[2:] == doc[:-2])
        _, pair = np.unique(codes[whole] * (codes.max() + 1) + codes[whole + 1], return_inverse=True)
        _, window = np.unique(pair * (codes.max() + 1) + codes[whole + 2], return_inverse=True)
        _, at, count = np.unique(doc[whole] * (n + 1) + window, return_inverse=True, return_counts=True)
        twice = whole[count[at] > 1]
        for i in range(3):
            covered[twice + i] = True
    return segment_sums(covered, starts).astype(np.int64), segment_sums(same, starts).astype(np.int64)


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """texts x COUNTS as integers, texts x FEATURES as floats; empty texts give zeros."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    kinds = np.bincount(np.repeat(np.arange(n) * 8, sizes) + KINDS[np.frombuffer(b"".join(texts), dtype=np.uint8)], minlength=8 * n).reshape(n, 8)
    words, ids = [t.split() for t in texts], {}
    codes = np.array([ids.setdefault(w, len(ids)) for x in words for w in x], dtype=np.int64)
    starts = starts_of([len(x) for x in words])
    repeat, same = repeats(codes, starts)
    lines, dup = np.zeros(n), np.zeros(n, dtype=np.int64)
    for i, t in enumerate(texts):
        own = [x for x in t.split(b"\n") if x.strip()]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    n_words, chars = np.diff(starts), kinds[:, 1:7].sum(axis=1)
    base = np.stack([n_words, chars, kinds[:, 4], dup, repeat], axis=1)
    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    shape = [np.log1p(n_words), chars / w, kinds[:, 4] / c, kinds[:, 2] / c, kinds[:, 3] / c, kinds[:, 5] / c, repeat / w, dup / np.maximum(lines, 1), same / w, np.log1p(n_words / np.maximum(lines, 1))]
    return base, np.stack(shape, axis=1)


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Forest | None:
    """Learn quality from labelled documents whose crc32(doc_id as text) mod 5 is not 0; None if there are none.

    The offset is that of all labels, so the verdicts do not depend on how much of each quality was sampled. Of rows
    that repeat a doc_id, in `docs` or in `labels`, one counts.
    """
    rated = labels.where((fold(F.col("doc_id"), 5) != 0) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    few, share = sample_by_label(rated.dropDuplicates(["doc_id"]), "quality", max_per_class)
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            _, x = statistics(texts)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.int32()), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["doc_id", "quality", *names])

    schema = "doc_id long, quality int, " + ", ".join(f"{c} double" for c in names)
    got = sorted(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "quality", "text").dropDuplicates(["doc_id"]).mapInArrow(run, schema).collect(), key=lambda r: r.doc_id)
    if not got:
        return None
    x = np.array([r[2:] for r in got], dtype=float)
    y = np.array([r.quality for r in got], dtype=float)
    forest = boost(x, y, NEVER_RISES)
    if 0 < y.sum() < len(y):
        forest.base += float(np.log(share[1] / share[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return forest


def judge(docs: DataFrame, forest: Forest | None, min_score: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for every row of `docs`.

    Null text has no words. base_failed: under 50 words, or over half of the words in repeated 3-word windows; then kept
    is false. Else kept is whether the trees give a probability of good quality of `min_score` or more; without trees
    (no labels) it is true; a score equal to `min_score` is kept. An empty table gives an empty result; repeated rows
    each get one; further columns are ignored; a text of any length is read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            base, x = statistics(texts)
            failed = base_failed(base)
            score = 1 / (1 + np.exp(-shared.value.predict(x))) if shared.value else np.ones(len(texts))
            columns = [pa.array(base[:, i]) for i in range(len(COUNTS))] + [pa.array(failed), pa.array(~failed & (score >= min_score)), pa.array(score)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *columns], names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
