"""Quality classifier: ordinal cumulative-link regression on graded ratings.

The grade of a labelled document is 0 if its quality is 0, 1 if its quality is 1 but it is toxic, 2 if it is neither. One
vector of hashed-text weights is shared by all grades; ordered thresholds turn its sum into the probability of each grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewalk.llm import grams
from zonewalk.llm.common import chunks, fold, release, released, sample_by_label, segment_sums, starts_of
from zonewalk.llm.linear import Rows, ordinal, sigmoid

#: Labelled documents of each grade that the fit takes, about; it does not grow with the input.
MAX_PER_GRADE = 900
GRADES = 3
#: Further slots beside the hashed n-grams: share of words equal to the one before, whether it is over a quarter, share of repeated lines.
PATTERNS = 3
#: The sum of weights of a text of so many bytes counts half: the fewer n-grams, the noisier their mean.
DOUBT_BYTES = 60


@dataclass
class Model:
    weights: np.ndarray
    patterns: np.ndarray
    thresholds: np.ndarray


def grade(quality: Column, toxic: Column) -> Column:
    """0, 1 or 2; null without a quality label, and a null toxic label counts as 0."""
    return F.when(quality == 0, 0).when(quality == 1, F.when(toxic == 1, 1).otherwise(2))


def patterns(texts: list[bytes]) -> np.ndarray:
    """texts x PATTERNS."""
    out = np.zeros((len(texts), PATTERNS))
    words = [t.split() for t in texts]
    flat = [w for x in words for w in x]
    starts = starts_of([len(x) for x in words])
    same = np.fromiter((a == b for a, b in zip(flat, flat[1:])), bool, max(len(flat) - 1, 0))
    same = np.concatenate(([False], same))[: len(flat)]
    same[starts[:-1][np.diff(starts) > 0]] = False
    out[:, 0] = segment_sums(same, starts) / np.maximum(np.diff(starts), 1)
    out[:, 1] = out[:, 0] > 0.25
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[i, 2] = (len(lines) - len(set(lines))) / max(len(lines), 1)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_per_grade: int = MAX_PER_GRADE) -> Model | None:
    """Learn from labelled documents whose crc32(doc_id as text) mod 5 is not 0; None if there are none.

    Sampled grades weigh as they do among all labels, so the verdicts do not depend on how much was sampled. Of rows
    that repeat a doc_id, in `docs` or in `labels`, one counts.
    """
    rated = labels.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")).where("grade is not null")
    few, share = sample_by_label(rated.dropDuplicates(["doc_id"]), "grade", max_per_grade)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "grade", "text").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            own = patterns(texts)
            made = [grams.sparse(t) for t in texts]
            at = [np.append(a, np.arange(PATTERNS) + grams.DIMS).astype(np.int32) for a, _ in made]
            val = [np.append(v, p).astype(np.float32) for (_, v), p in zip(made, own)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.int32()), pa.array([x.tobytes() for x in at]), pa.array([x.tobytes() for x in val])], names=["doc_id", "grade", "at", "val"])

    got = rows.mapInArrow(released(run), "doc_id long, grade int, at binary, val binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by("doc_id").combine_chunks()
    raw, grades = Rows.held(got, grams.DIMS + PATTERNS), got.column("grade").to_numpy()
    del got
    scale = raw.scale()
    scale[grams.DIMS :] *= 4  # few and telling, among many slots
    weight = np.array([share[g] / max((grades == g).sum(), 1) for g in range(GRADES) if g in share])
    of = {g: i for i, g in enumerate(g for g in range(GRADES) if g in share)}
    weight = weight[[of[g] for g in grades.tolist()]]
    w, thresholds = ordinal(raw.scaled(scale), grades, GRADES, weight / weight.mean())
    del raw
    release()
    return Model((w * scale)[: grams.DIMS].astype(np.float32), (w * scale)[grams.DIMS :], thresholds)


def rate(texts: list[bytes], model: Model) -> np.ndarray:
    """texts x (GRADES - 1): the probability of a grade above 0, above 1, ..."""
    size = np.fromiter(map(len, texts), np.float64, len(texts))
    latent = grams.scores(texts, model.weights[None, :])[:, 0] * size / (size + DOUBT_BYTES) + patterns(texts) @ model.patterns
    return sigmoid(latent[:, None] - model.thresholds[None, :])


def classify(docs: DataFrame, model: Model | None, min_tail: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, p_keep, kept) for every row of `docs` (doc_id, text).

    p_keep is the probability of grade 1 or more, kept whether it reaches `min_tail` (a tie is kept). Null and empty texts
    hold nothing to train on: expected_grade and p_keep are 0 and they are not kept; so it is for every text without a
    model. An empty table gives an empty result; repeated rows each get one; further columns are ignored; a text of any
    length is read whole.
    """
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("p_keep"), F.lit(False).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            tails = rate(texts, shared.value)
            tails[[not t.strip() for t in texts]] = 0
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 0] >= min_tail)], names=["doc_id", "expected_grade", "p_keep", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_grade double, p_keep double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, min_tail: float = 0.5) -> DataFrame:
    """The rows of `docs` that the classifier keeps, each judged by itself; all columns stay. Without labels there is no verdict and all rows stay."""
    model = fit(docs, labels)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            good = (rate(texts, shared.value)[:, 0] >= min_tail) & np.array([bool(t.strip()) for t in texts])
            yield part.filter(pa.array(good))

    return docs.mapInArrow(released(run), docs.schema)
