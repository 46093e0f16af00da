"""Divergence and ranked search: against their SQL on odd tables, and against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm import helpers
from zonewalk.llm import divergence, queries, search, terms


def odd_documents():
    """(doc_id, text, lang, source): a source that holds a third of all rows, sources without terms, texts with every hard case."""
    rng, out = random.Random(7), []
    words = {lang: [helpers.prose(rng, lang, 1)[:-1] for _ in range(60)] for lang in helpers.SYLLABLES}
    for i in range(300):
        lang = rng.choice(list(words))
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(6)}"
        out.append((i, " ".join(rng.choices(words[lang], k=rng.randint(1, 60))) + rng.choice([".", "\n7a b7", " É İx", "-Z_z"]), lang, source))
    out += [(400, None, "en", "null text"), (401, "", "en", None), (402, "1 2 !", "en", "no letters"), (403, "alone", "xx", "only one"), (404, "few", "yy", "a"), (405, "few", "yy", "b"), (406, None, None, None), (None, "the " * 30, "en", "hot"), (3, "a second row of this id", "en", "s1"), (3, "a second row of this id", "en", "s1")]
    return out + [(500, "la " * 20000 + "é" * 5000, "fr", "long")]


def written(spark, tmp_path, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' as term", "1 as count", "2 as `a.b`", "3 as rank").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", search.F.lit(1)).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return con


def items():
    docs = odd_documents()
    return [(i, d[1]) for i, d in enumerate(docs[:25])] + [(30, None), (31, "!!"), (32, "nowhere"), (33, "é É 7A"), (None, docs[40][1]), (5, docs[50][1]), (5, None)]


@pytest.mark.parametrize("kind", ["odd", "no documents", "no items", "no terms"])
def test_queries_equal_sql_on_odd_tables(spark, tmp_path, kind):
    docs = {"no documents": [], "no terms": [(1, "", "en", "a"), (2, None, "en", "b")]}.get(kind, odd_documents())
    con = written(spark, tmp_path, docs, [] if kind == "no items" else items())
    for name in ("op11_source_divergence", "op12_ranked_search"):
        found = con.sql(queries.oracle_sql()[name])
        want = sorted(map(str, found.fetchall()))
        got = sorted(str(tuple(r[c] for c in found.columns)) for r in queries.queries()[name](spark, str(tmp_path)).collect())
        assert got == want, (name, kind)
    assert got if kind == "odd" else not got


def test_small_blocks_turns_and_depths_give_the_same_ranking(spark, monkeypatch):
    docs = spark.createDataFrame([(d[0], d[1]) for d in odd_documents()], "doc_id long, text string").repartition(4)
    wanted = spark.createDataFrame(items(), "item_id long, text string")
    want = sorted(map(str, search.search(docs, wanted, 7).collect()))
    monkeypatch.setattr(search, "TURN_BYTES", 1500)
    monkeypatch.setattr(search, "DEPTH", 1)
    assert sorted(map(str, search.search(docs, wanted, 7).collect())) == want


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(2)
    n = 20000
    sizes = np.full(n, 3)
    chosen = np.sort(np.argsort(rng.random((n, 6)), axis=1)[:, :3], axis=1).astype(np.int64).ravel()
    counts = rng.zipf(2.0, 3 * n).clip(1, 10**6)
    block = search.Block(pa.array(np.arange(n)), np.full(n, 50), sizes, chosen, counts, np.array([900, 2000, 2500, 3000, 3500, 4000]), n, 50 * n)
    inside, looked = np.array([True, False, True, False, True, False]), []
    look_up = block.look_up
    block.look_up = lambda docs, i: looked.append(len(docs)) or look_up(docs, i)
    docs, scores = block.best(np.array([0, 2, 4]), inside, 10, 1)
    every = look_up(np.arange(n), inside)
    order = np.lexsort((np.arange(n), -every))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
    assert sum(looked) < n / 2


def test_terms_are_those_of_the_patterns():
    texts = ["Ab-c é7É_x", "", "ÄÖ İ z 9", " \t", "a\x00b\x7fc", "日本 x1"]
    for kept, pattern in ((terms.WITH_DIGITS, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), (terms.LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")):
        flat, sizes = terms.split(pa.array(texts, pa.large_string()).slice(1), kept)
        want = [re.findall(pattern, "".join(c.lower() if c.isascii() else c for c in t)) for t in texts[1:]]
        assert [x.decode() for x in flat.to_pylist()] == sum(want, []) and sizes.tolist() == [len(w) for w in want]


def test_divergence_of_large_counts_is_exact(spark):
    big = 30_000_000_000  # times 10^9 it is beyond 64 bits
    row = spark.range(1).select(divergence.share(divergence.F.lit(big), divergence.F.lit(7 * big), divergence.F.lit(11)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 2) // (7 * big + 22)


def test_search_equals_plain_python(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, weights=range(40, 0, -1), k=rng.randint(1, 50))) for _ in range(250)]
    asked = [" ".join(rng.sample(words, 6)) for _ in range(5)]
    tf = [Counter(t.split()) for t in texts]
    n, total = len(texts), sum(sum(c.values()) for c in tf)
    df = Counter(w for c in tf for w in c)
    want = defaultdict(list)
    for i, a in enumerate(asked):
        for d, c in enumerate(tf):
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(a.split()) if c[w])
            if s:
                want[i].append((-s, d))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = search.search(docs, spark.createDataFrame(list(enumerate(asked)), "item_id long, text string"))
    flat = sorted((i, r + 1, d, -s) for i, rows in want.items() for r, (s, d) in enumerate(sorted(rows)[:50]))
    assert sorted((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()) == flat
