import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import helpers
from tests.llm.test_learned import crc
from zonewalk.llm import lm
from zonewalk.llm.common import flat_values, fold, lower_words, values_of


def tokens_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower)] + [lm.END]


def test_words_are_split_at_ascii_white_space_alone():
    texts = ["  Foo b\t\n\x0b\x0c\r x ", "", " \t", "a\x1cb\x85c\xa0d É\x00Z", "one", " x y"]
    flat, counts = lower_words(pa.array(texts, pa.large_string()))
    assert values_of(flat) == [w for t in texts for w in tokens_of(t)[:-1]]
    assert counts.tolist() == [len(tokens_of(t)) - 1 for t in texts]


def test_values_of_sliced_columns():
    held = pa.array([b"abcd", None, b"ef", b""], pa.binary())
    assert flat_values(held.slice(1), "u1")[0].tolist() == list(b"ef") and flat_values(held, "u1")[1].tolist() == [4, 0, 2, 0]
    assert values_of(pa.array([b"x", b"", b"yz"], pa.large_binary()).slice(1)) == [b"", b"yz"]


def test_hash_is_that_of_the_engine(spark):
    got = spark.createDataFrame([("é a",), ("",), ("x" * 99,)], "w string").select("w", F.xxhash64(F.col("w").cast("binary")).alias("h")).collect()
    assert all(r.h % 2**64 == lm.word_hash(r.w.encode()) == xxhash.xxh64_intdigest(r.w.encode(), 42) for r in got)


def reference_score(texts, lex, model, counts):
    """Scores by the formula, token by token, in plain Python."""
    ids = {w: int(lex.ids[np.searchsorted(lex.hashes, np.uint64(lm.word_hash(w)))]) for w in counts if np.uint64(lm.word_hash(w)) in lex.hashes}

    def key(w):
        return ids[w] if ids.get(w, -1) >= 0 else lm.WORDS + lm.kind_of(w)

    def row(k, bits):
        return int(((k + 1) * int(lm.FACTOR)) % 2**64 >> (64 - bits))

    def log_share(rows, keys, bits, bias, target):
        z = bias.astype(float) + sum(rows[(f << bits) + row(k, bits)].astype(float) for f, k in enumerate(keys))
        z = np.clip(z, -40, 40)
        return z[target] - math.log(np.exp(z).sum())

    out = []
    for text in texts:
        total, held = 0.0, [key(w) for w in text]
        for i, w in enumerate(text):
            w1, w2, w3 = (held[i - d] + 1 if i >= d else 0 for d in (1, 2, 3))
            c, e = int(model.classes[held[i]]), int(model.cells[held[i]])
            both = (w1 * 1_000_003 + w2) % 2**64
            total += log_share(model.outer, (w1, w2, w3, both), lm.SLOT_BITS, model.bias, c) / math.log(10)
            if c != lm.ENDING:
                kind = c << 40
                total += log_share(model.inner, (w1 + kind, w2 + kind, both + kind), lm.INNER_BITS, model.cell_bias[c], e) / math.log(10)
            if held[i] < lm.WORDS:
                total += float(model.within[held[i]])
            else:
                freed = max(lex.discount * lex.other_distinct[e], 1e-9)
                n = counts.get(w, 0)
                total += math.log10((n - lex.discount if n else freed) / (lex.other_total[e] or freed))
        out.append(total)
    return out


@pytest.mark.parametrize("words, counted", [(lm.WORDS, lm.COUNTED), (40, 90), (0, 0)])
def test_scores_equal_brute_force(spark, monkeypatch, words, counted):
    monkeypatch.setattr(lm, "lexicon", lambda v, own=lm.lexicon: own(v, words, counted))
    docs, train = helpers.documents(spark), fold(F.col("doc_id"), 7) != 2
    rows = [r for r in helpers.rows() if r[1] is None or len(r[1]) < 20000 or r[0] % 2]
    vocabulary = lm.count_words(docs.where(train))
    lex = lm.lexicon(vocabulary)
    encoded, rare = lm.encode(docs, lex, train)
    model = lm.fit(encoded, lex)
    got = {r.doc_id: r for r in lm.score(encoded, rare, model, lex, vocabulary).collect()}
    tokens = {i: tokens_of(t) for i, t, *_ in helpers.rows()}
    counts = Counter(w for i, t in tokens.items() if crc(i, 7) != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(tokens)
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in counts for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    few = [i for i, *_ in rows if len(tokens[i]) < 300][:40] + [5000, 5001, 5003]
    for i, want in zip(few, reference_score([tokens[i] for i in few], lex, model, counts)):
        assert math.isclose(got[i].score, want, rel_tol=1e-4, abs_tol=1e-3), i
    held = [i for i in tokens if crc(i, 7) == 2 and i < 5000]
    if words:
        assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_the_model_is_a_distribution(spark):
    docs = helpers.documents(spark)
    vocabulary = lm.count_words(docs.where("doc_id < 100"))
    lex = lm.lexicon(vocabulary, 50, 80)
    encoded, _ = lm.encode(docs, lex, F.col("doc_id") < 100)
    model = lm.fit(encoded, lex, rounds=2)
    inside = np.zeros((lm.CLASSES, lm.CELLS))
    size = len(lex.frequent)
    np.add.at(inside, (model.classes[:size], model.cells[:size]), 10 ** model.within[:size])
    for r in vocabulary.collect():
        word = bytes(r.word)
        place = np.searchsorted(lex.hashes, np.uint64(lm.word_hash(word)))
        if place == len(lex.hashes) or lex.hashes[place] != np.uint64(lm.word_hash(word)) or lex.ids[place] < 0:
            e = lm.kind_of(word) % lm.CELLS
            inside[lm.OTHER, e] += 10 ** lex.inside(np.array([r.c]), np.array([e]))[0]
    inside[lm.OTHER] += 10 ** lex.inside(np.zeros(lm.CELLS), np.arange(lm.CELLS))
    filled = inside > 0
    assert np.allclose(inside[filled], 1) and filled[lm.OTHER].all()
    back = tuple(np.array(x, np.uint16) for x in ((0, 3, 9), (0, 0, 3), (0, 0, 0)))
    room = lm.Room(lm.CELLS)
    for k in range(lm.CLASSES):
        classes = np.full(3, k)
        outer, inner = lm._slots(back, slice(0, 3), classes)
        z = [lm._log_share(model.inner, inner, model.cell_bias[classes], np.full(3, e), room) for e in range(lm.CELLS)]
        share = np.exp(z)
        assert np.allclose(share.sum(axis=0), 1, atol=1e-4)
        if filled[k].any() and k != lm.ENDING:
            assert np.allclose(share[filled[k]].sum(axis=0), 1, atol=1e-3)
    assert np.allclose(sum(np.exp(lm._log_share(model.outer, outer, model.bias, np.full(3, k), room)) for k in range(lm.CLASSES)), 1, atol=1e-4)


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5, 6, 7, 100])
def test_the_most_frequent_words_are_taken_exactly(spark, most):
    counts = [1, 1, 2, 7, 8, 9, 9, 300, 301, 5000, 5001]
    vocabulary = spark.createDataFrame([(bytes([i]), c) for i, c in enumerate(counts)], "word binary, c long")
    least = lm.least_count(vocabulary, most)
    taken = [c for c in counts if c >= least]
    assert len(taken) <= most and least >= 2
    more = sorted({c for c in counts if 1 < c < least}, reverse=True)
    assert not more or len([c for c in counts if c >= more[0]]) > most


def test_company_and_classes_cover_all_training_texts(spark):
    train = spark.createDataFrame([(i, f"the w{i % 9} of a w{i % 7}") for i in range(9000)], "doc_id long, text string")
    lex = lm.lexicon(lm.count_words(train))
    encoded, _ = lm.encode(train, lex, F.lit(True))
    near = lm._company(encoded, len(lex.frequent))
    at = {w: int(lex.ids[np.searchsorted(lex.hashes, np.uint64(lm.word_hash(w)))]) for w in (b"the", b"of")}
    assert near[at[b"the"], at[b"of"]] == 9000 and near[at[b"of"], at[b"the"]] == 9000


def test_language_model_of_nothing(spark):
    got = lm.score_corpus(helpers.documents(spark), F.lit(False)).collect()
    assert len(got) == len(helpers.rows()) and all(r.n_known == 0 and r.base_score == 0 and r.train_tokens == 0 for r in got)
    assert lm.score_corpus(helpers.empty(spark), F.lit(True)).count() == 0


def test_run_sums():
    rng = np.random.default_rng(4)
    n = np.array([1, 2, 40, 1, 16, 17, 3])
    values, first = rng.normal(size=(n.sum(), 5)), np.cumsum(n) - n
    assert np.allclose(lm._run_sums(values, first, n), np.add.reduceat(values, first, axis=0))
