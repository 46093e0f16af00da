import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import helpers
from zonewalk.llm import exact_dedup, simhash
from zonewalk.llm.common import Filter
from zonewalk.llm.components import connected

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_az(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def brute_components(marks):
    """Component of each distinct fingerprint, as sets."""
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if bin(a ^ b).count("1") <= 2:
            root[find(b)] = find(a)
    return {m: find(m) for m in root}


def test_fingerprints_and_components_equal_brute_force(spark):
    table = helpers.rows()
    table = [(i, t if t is None or len(t) < 5000 else t[:3000], *r) for i, t, *r in table]
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_groups(helpers.documents(spark, table)).collect()}
    want = {i: brute_fingerprint(t) for i, t, *_ in table}
    assert {i: fp for i, (fp, _) in got.items()} == want
    of = brute_components(want.values())
    low = {}
    for i, fp in want.items():
        low[of[fp]] = min(i, low.get(of[fp], i))
    assert {i: c for i, (_, c) in got.items()} == {i: low[of[fp]] for i, fp in want.items()}


@pytest.mark.parametrize("cap", [0, 3, 256])
@pytest.mark.parametrize("segments", [3, 5, 7])
def test_links_lose_nothing_for_any_bucket_size(spark, cap, segments):
    rng = np.random.default_rng(segments)
    seeds = rng.integers(0, 2**63, 6, dtype=np.uint64)
    marks = set()
    for s in seeds:  # clusters of neighbours, some within two bits, some just beyond
        for _ in range(25):
            x = int(s)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(bit)
            marks.add(x)
    of = brute_components(marks)
    nodes = {m: i for i, m in enumerate(sorted(marks))}
    classes = spark.createDataFrame([(m - 2**64 if m >= 2**63 else m, i) for m, i in nodes.items()], "fp long, node long")
    groups = {r.node: r.component for r in connected(simhash.links(classes, segments, cap)).collect()}
    want = {}
    for m, i in nodes.items():
        want.setdefault(of[m], []).append(i)
    assert {i: groups.get(i, i) for i in nodes.values()} == {i: min(g) for g in want.values() for i in g}


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in connected(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_exact_groups_equal_brute_force(spark):
    table = helpers.rows() + [(6000, "b a", None, None, None), (6001, " ba  ", None, None, None), (6002, "b  a ", None, None, None)]
    want, groups = {}, {}
    for i, t, *_ in table:
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i))
    for text, members in groups.items():
        for _, i in members:
            keep = min(members)[1]
            want[i] = (keep, len(members), i == keep, hashlib.sha256(text.encode()).hexdigest())
    for size in (16, 1):  # one byte: many texts share a digest and their bytes tell them apart
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(helpers.documents(spark, table), size).collect()}
        assert got == want


def test_repeated_rows_and_missing_ids(spark):
    docs = helpers.documents(spark, [(1, "a b", "en"), (1, "a b", "en"), (None, "a b", "en"), (2, "ab", "en")])
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False), (None, None, 1, True)], key=str)
    near = [(r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()]
    assert len(near) == 4 and (None, None) in near
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def test_empty_tables(spark):
    assert simhash.near_groups(helpers.empty(spark)).count() == 0
    assert exact_dedup.exact_groups(helpers.empty(spark)).count() == 0


def test_filter_passes_every_hit(spark):
    hits = spark.createDataFrame([(bytes([i, 7]),) for i in range(200)], "digest binary")
    rows = hits.union(spark.createDataFrame([(bytes([i, 9]),) for i in range(200)], "digest binary"))
    passed = {bytes(r.digest) for r in Filter.of(hits, 200).passed(rows).collect()}
    assert {bytes([i, 7]) for i in range(200)} <= passed and len(passed) < 240
    assert Filter.of(hits, 1 << 40) is None


def memtable(spark, rows):
    return spark.createDataFrame([(bytes([d]), n, i) for d, n, i in rows], "digest binary, n_chars long, doc_id long")


def test_runs_are_merged_by_level_without_a_shuffle(spark):
    rng, made, want = np.random.default_rng(1), exact_dedup.MergeIndex(spark, 4), {}
    for _ in range(5):
        rows = [(int(d), int(n), int(i)) for d, n, i in zip(rng.integers(0, 60, 50), rng.integers(1, 9, 50), rng.integers(0, 999, 50))]
        made.insert(memtable(spark, rows + [(0, 1, 2)]))
        for d, n, i in [*rows, (0, 1, 2)]:
            best, size = want.get(d, ((0, 0), 0))
            want[d] = (min(best, (-n, i)) if size else (-n, i), size + 1)
    assert sorted(r.level for r in made.runs) == [0, 2]
    both = exact_dedup.merge(*(spark.table(r.table) for r in made.runs))
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    got = {r.digest[0]: (tuple(r.best), r.size) for r in made.look_up(made.spark.createDataFrame([(bytes([d]),) for d in range(70)], "digest binary")).collect()}
    assert got == want
    assert {r.digest[0]: (tuple(r.best), r.size) for r in made.whole().collect()} == want
    made.clear()
    assert not made.runs


def test_look_ups_read_only_runs_whose_filter_passes(spark):
    made = exact_dedup.MergeIndex(spark, 4)
    for begin in (0, 10, 100):
        made.insert(memtable(spark, [(d, 1, 100 + d) for d in range(begin, begin + 10)]))
    asked = memtable(spark, [(103, 0, 0), (104, 0, 0)]).select("digest")
    assert made.readable(asked) == [made.runs[1]]
    assert {(r.digest[0], r.best.doc_id) for r in made.look_up(asked).collect()} == {(103, 203), (104, 204)}
    assert made.look_up(memtable(spark, [(250, 0, 0)]).select("digest")).count() == 0
    made.clear()


def test_each_row_has_its_own_verdict(spark):
    rows = [(1, "A a"), (5, "Aa"), (5, "unique other text here"), (7, "same same"), (7, "same same"), (8, "samesame"), (9, "b b"), (9, "bb"), (None, "A a"), (3, None), (2, "")]
    docs = spark.createDataFrame([(*r, {"k": 1}) for r in rows], "doc_id long, text string, extra map<string,int>").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in exact_dedup.drop_copies(docs).collect()), key=str)
    assert kept == sorted([(1, "A a"), (5, "unique other text here"), (7, "same same"), (9, "b b"), (None, "A a"), (2, "")], key=str)
