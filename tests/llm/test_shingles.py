import random
from itertools import combinations

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm import helpers
from zonewalk.llm import minhash, shingles


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


def table():
    """Copies with few to many words changed, chains of such copies, a large group, and a line that many texts share."""
    rng, out = random.Random(3), []
    line = helpers.prose(rng, "en", 30)
    for _ in range(30):
        text = helpers.prose(rng, rng.choice(["en", "de"]), rng.randint(20, 250))
        out.append(text + " " + line)
        for n in (1, 2, 4, 6, 9):
            out.append(edited(rng, rng.choice([text, out[-1]]), n))
    base = helpers.prose(rng, "fr", 150)
    out += [edited(rng, base, rng.randint(1, 4)) for _ in range(80)]
    return [*out, "", " ", "one two", "One  two", "a b c d e", "a b c d e f"]


def test_groups_equal_brute_force(spark):
    texts = table()
    want, sets = list(range(len(texts))), [shingle_set(t) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((want[i], want[j]))
            want = [a if w == b else w for w in want]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = shingles.similar_groups(docs).collect()
    got = {r.doc_id: r.keep_id for r in found}
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)
    assert {i: got.get(i, i) for i in range(len(texts))} == dict(enumerate(want))


def test_stage_drops_copies_with_a_few_words_changed(spark):
    rng = random.Random(8)
    texts = [helpers.prose(rng, "en", 248) for _ in range(12)]
    pairs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, edited(rng, t, 4)) for i, t in enumerate(texts)]
    assert all(jaccard(shingle_set(t), shingle_set(pairs[12 + i][1])) >= 0.8 for i, t in enumerate(texts))
    docs = spark.createDataFrame(pairs + [(None, texts[0])], "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([*range(12), None], key=str)


def test_shingle_sets_are_those_of_the_words():
    texts = ["a b c d e f", "A b\tc d e", "a b", "", " ", "b a", "a b c d e f a b c d e f", "x y z v w"]
    hashes, sizes = minhash.shingle_sets(pa.array(texts, pa.large_string()), 5)
    cuts = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    sets = [frozenset(hashes[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]
    want = [shingle_set(t) if t.strip() else set() for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for i, j in combinations(range(len(texts)), 2):
        assert len(sets[i] & sets[j]) == len(want[i] & want[j]), (i, j)


def test_each_row_has_its_own_verdict(spark):
    rng = random.Random(9)
    one, two = helpers.prose(rng, "en", 90), helpers.prose(rng, "de", 90)
    rows = [(1, one), (5, one + " end"), (5, two), (5, two), (9, two + " ende"), (None, one), (9, "quite another text than all the rest")]
    docs = spark.createDataFrame([(*r, {"k": 1}) for r in rows], "doc_id long, text string, extra map<string,int>").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in shingles.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, one), (5, two), (None, one), (9, "quite another text than all the rest")], key=str)
    assert shingles.keep_one(docs.limit(0)).count() == 0


def grouped(texts, of=shingle_set):
    want, sets = list(range(len(texts))), [of(t) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((want[i], want[j]))
            want = [a if w == b else w for w in want]
    return dict(enumerate(want))


def listed(spark, monkeypatch, texts):
    """How many pairs each comparison was given, and the groups."""
    seen, compare = [], minhash.similar
    monkeypatch.setattr(minhash, "similar", lambda pairs, *a: seen.append(pairs.distinct().count()) or compare(pairs, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.keep_id for r in shingles.similar_groups(docs).collect()}
    return seen, {i: got.get(i, i) for i in range(len(texts))}


def test_texts_of_common_lines_make_few_pairs(spark, monkeypatch):
    rng = random.Random(11)
    lines = [helpers.prose(rng, "en", 10) for _ in range(12)]
    texts = [" ".join(rng.sample(lines, 5)) for _ in range(200)]
    texts += [edited(rng, helpers.prose(rng, "de", 9) + " " + t, 1) for t in texts[:5] for _ in range(2)]
    seen, got = listed(spark, monkeypatch, texts)
    assert got == grouped(texts)
    assert len(seen) == 3 and seen[-1] < len(texts), seen


def test_long_texts_that_share_a_third_make_few_pairs(spark, monkeypatch):
    rng = random.Random(12)
    third = helpers.prose(rng, "en", 500)
    texts = [third + " " + helpers.prose(rng, "de", 1000) for _ in range(60)]
    texts += [edited(rng, t, 20) for t in texts[:6]]
    seen, got = listed(spark, monkeypatch, texts)
    assert got == grouped(texts)
    assert seen[-1] < 10, seen


def test_bitmaps_rule_out_no_similar_pair(spark):
    rng, rows = np.random.default_rng(4), []
    for n in (3, 40, 126, 130, 700, 1030, 5000):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for cut in (0, n // 12, n // 9, n // 6, n // 3, n):
            other = np.concatenate((base[cut:], rng.integers(0, 1 << 63, cut // 2).astype(np.uint64)))
            if len(other):
                rows.append([(len(x), int(level), minhash.bitmap(x, level).tolist(), minhash.bitmap(x, level + 1).tolist()) for x in (base, other) for level in minhash.level_of(np.array([len(x)])).tolist()] + [len(np.intersect1d(base, other))])
    schema = "n int, level int, odd array<long>, finer array<long>"
    docs = spark.createDataFrame(rows, f"a struct<{schema}>, b struct<{schema}>, both int")
    for r in docs.withColumn("may", minhash.bitmaps_fit("a", "b")).collect():
        if 9 * r.both >= 4 * (r.a.n + r.b.n):
            assert r.may
        if r.both == 0 and r.a.n > 100:
            assert not r.may


def bigrams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def test_minhash_groups_equal_brute_force(spark):
    rng = random.Random(21)
    texts = table() + [edited(rng, t, n) for t in table()[:30] for n in (3, 7)]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (None, None)], "doc_id long, text string").repartition(3)
    got = minhash.near_groups(docs).collect()
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None) == sorted([(len(bigrams(texts[0])), None, True), (0, None, True)])
    named = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {i: r.component_id for i, r in named.items()} == grouped(texts, bigrams)
    assert all(r.n_shingles == len(bigrams(texts[i])) and r.kept == (i == r.component_id) for i, r in named.items())


def test_bands_find_pairs_at_the_least_similarity():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(300):  # 80 of 100 in both
        x = np.unique(rng.integers(0, 1 << 64, 100, dtype=np.uint64))
        sets += [x[:90], np.concatenate((x[:80], x[90:]))]
    signature = minhash.signatures(np.concatenate(sets), np.array([len(x) for x in sets]))
    agree = (signature[::2] == signature[1::2]).mean(axis=1)
    assert abs(agree.mean() - 0.8) < 0.01 and agree.std() < 0.025  # no wider than independent coordinates would be
    keys = minhash.band_keys(signature)
    shared = (keys[::2] == keys[1::2]).sum(axis=1)
    assert shared.min() > 0 and abs(shared.mean() - minhash.BANDS * 0.8**minhash.ROWS) < 1


def test_minhash_rows_of_one_doc_id_and_other_columns(spark):
    rng = random.Random(5)
    one, two = helpers.prose(rng, "en", 90), helpers.prose(rng, "de", 90)
    docs = spark.createDataFrame([(4, one, 1), (4, two, 1), (4, two, 1), (7, two + " x", 2), (2, one + " y", 3)], "doc_id long, text string, `a.b` int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_groups(docs).collect())
    assert got == [(2, 90, 2), (4, 89, 2), (4, 89, 4), (4, 89, 4), (7, 90, 4)]
    assert minhash.near_groups(docs.limit(0)).count() == 0
