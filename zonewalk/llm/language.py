"""Language identification by hierarchical discrimination.

A linear support vector machine for each pair of families votes for the language family; within it, one for each pair of
its languages votes for the language. Inputs are hashed byte n-grams of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewalk.llm import grams
from zonewalk.llm.common import chunks, fold, release, released, sample_by_label
from zonewalk.llm.linear import Rows, sigmoid, svm

#: Documents of each language that the fit takes, about; it does not grow with the input.
MAX_PER_LANGUAGE = 600
#: Documents of all languages together, about: with more than twenty languages each has an equal part of these.
MAX_DOCUMENTS = 12_000
#: Margins of texts of so many bytes count half: the fewer n-grams, the noisier their mean.
DOUBT_BYTES = 150
#: Families of languages by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"only {lang}")


@dataclass
class Model:
    """Rows of `weights` are machines; pairs[i] = (level, a, b): machine i speaks for a if positive, else for b."""

    langs: list[str]
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray
    offsets: np.ndarray


def fit(docs: DataFrame, max_per_language: int = MAX_PER_LANGUAGE) -> Model | None:
    """Learn from text and non-null lang of documents whose crc32(doc_id as text) mod 4 is not 2; None if there are none."""
    known = docs.where((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Rows are told apart by where they are read, so a doc_id that many rows repeat is not drawn as one.
    sampled, _ = sample_by_label(known, "lang", max_per_language, total=MAX_DOCUMENTS, key=F.struct("doc_id", F.monotonically_increasing_id()))
    rows = sampled.select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            made = [grams.sparse(t.lower()) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array([a.tobytes() for a, _ in made]), pa.array([v.tobytes() for _, v in made])], names=["doc_id", "lang", "at", "val"])

    got = rows.mapInArrow(released(run), "doc_id long, lang string, at binary, val binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending")]).combine_chunks()
    raw = Rows.held(got, grams.DIMS)
    scale = raw.scale()
    x, lang = raw.scaled(scale), np.array(got.column("lang").to_pylist(), dtype=object)
    del got, raw
    langs = sorted(set(lang))
    of = np.array([family(v) for v in lang], dtype=object)
    tasks = [("family", a, b, of) for a, b in combinations(sorted(set(of)), 2)]
    tasks += [(f, a, b, lang) for f in sorted(set(of)) for a, b in combinations([v for v in langs if family(v) == f], 2)]
    pairs, weights, offsets = [], [], []
    for level, a, b, kind in tasks:
        which = np.flatnonzero((kind == a) | (kind == b))
        w, offset = svm(x.pick(which), np.where(kind[which] == a, 1.0, -1.0))
        pairs.append((level, a, b))
        weights.append((w * scale).astype(np.float32))
        offsets.append(offset)
    del x
    release()
    return Model(langs, pairs, np.array(weights, dtype=np.float32).reshape(len(pairs), grams.DIMS), np.array(offsets))


def _vote(margins: np.ndarray, machines: list[int], names: list[str], pairs: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the name with most votes (ties: the largest sum of margins) and its least support, 0 to 1."""
    n = len(margins)
    votes, sums, least = np.zeros((n, len(names))), np.zeros((n, len(names))), np.ones((n, len(names)))
    for i in machines:
        for name, sign in ((pairs[i][1], 1), (pairs[i][2], -1)):
            j, m = names.index(name), sign * margins[:, i]
            votes[:, j] += m > 0
            sums[:, j] += np.tanh(m)
            least[:, j] = np.minimum(least[:, j], sigmoid(3 * m))
    best = np.argmax(votes + sums / (4 * len(names) + 4), axis=1)
    return best, least[np.arange(n), best]


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict_batch(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.float64, len(texts))
    margins = (grams.scores([t.lower() for t in texts], model.weights) + model.offsets) * (size / (size + DOUBT_BYTES))[:, None]
    families = sorted({family(v) for v in model.langs})
    top, sure = _vote(margins, [i for i, p in enumerate(model.pairs) if p[0] == "family"], families, model.pairs)
    pred, score = np.full(len(texts), "und", dtype=object), sure.copy()
    for j, f in enumerate(families):
        rows = np.flatnonzero(top == j)
        langs = [v for v in model.langs if family(v) == f]
        own, inner = _vote(margins[rows], [i for i, p in enumerate(model.pairs) if p[0] == f], langs, model.pairs)
        pred[rows] = np.array(langs, dtype=object)[own]
        score[rows] = np.minimum(sure[rows], inner)
    silent = [not has_letter(t) for t in texts]
    pred[silent], score[silent] = "und", 0.0
    return pred, score


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of `docs` (doc_id, text).

    lang_pred is `und` with score 0 if the text is null or has no letter, and for every text if there is no model. The
    score is the least support, 0 to 1, that the prediction has from the machines it depends on; of languages with equal
    votes the one with the larger margins is taken, then the first by name. An empty table gives an empty result;
    repeated rows each get one; further columns are ignored; a text of any length is read whole.
    """
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            pred, score = predict_batch(texts, shared.value)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(pred.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of `docs` in which a language is found, so those not `und`; all columns stay.

    Each row is judged by itself, null text is `und`. Without any learned language there is no verdict and all rows stay.
    """
    model = fit(docs)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            pred, _ = predict_batch(texts, shared.value)
            yield part.filter(pa.array(pred != "und", pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
