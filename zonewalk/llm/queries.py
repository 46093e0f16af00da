"""One query for each operator of this subpackage, over whole tables, and the SQL for those that SQL can express.

Each but op11 and op12 gives one row for every row of `documents`: none for an empty table, one each for rows that repeat a doc_id, a null
doc_id as null. Further columns are ignored, texts of any length are taken whole, and null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from zonewalk.llm import bpe, divergence, exact_dedup, language, lm, minhash, packing, quality, rules, search, simhash, token_counts, toxicity
from zonewalk.llm.common import fold, table

#: The tokenizer of the encoding and counting queries, and its end-of-document id.
TOKENIZER, END_OF_DOCUMENT = "byte_bpe_50k.json", 50256


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and groups of fingerprints within two bits; texts without words have fingerprint zero and are linked; a row without doc_id is in no group."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text; an empty text has no tokens."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages learned from three folds, predicted for all texts; `und` and 0 without a letter, and for all if no language can be learned."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity learned from four folds of the labels; without labels of both classes every text has the rate of label 1."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "ratio")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as plain token files, and their tokens counted there; an empty text has 0."""
    return token_counts.document_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_OF_DOCUMENT)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades learned from four folds of the labels; texts without words, and all texts without labels, have 0 and are not kept."""
    docs = table(spark, sf_dir, "documents")
    found = quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "expected_grade", "p_keep", "kept")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts scored by a model of six folds; an empty text is one end. Without training texts nothing is known and base_score is 0."""
    scored = lm.score_corpus(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all texts; without labels the base rule alone decides."""
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every text; an empty one has one token, the end."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every row; empty texts are copies of each other; a row without doc_id is in no group and kept."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of each language, all of them, and the terms that a source has more of, ten at most; one row for each, not for each document."""
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for every item of `benchmark`; rows are those of items, and an item without terms has none."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share at least 0.8 of their two-word shingles; texts without words are in none."""
    return minhash.near_groups(table(spark, sf_dir, "documents"))


QUERIES = (op1_simhash, op2_bpe, op3_language_id, op4_toxicity, op5_token_counts, op6_quality_classifier, op7_lm_scoring, op8_quality_rules, op9_packing, op10_exact_dedup, op11_source_divergence, op12_ranked_search, op13_minhash)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_ranked_search": OP12_SQL}


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, max(n) OVER (PARTITION BY text_sha256) AS most,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND n = most AS kept, text_sha256 FROM g
"""


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), groups AS (SELECT DISTINCT lang, source FROM d
), counted AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL
), full_counts AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
), priced AS (
  SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER g + 2 * count(*) OVER g) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (total + 2)) // (sum(total) OVER g + 2 * count(*) OVER g) AS q
  FROM full_counts WINDOW g AS (PARTITION BY lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM priced WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT id, doc_id, term, count(*) AS tf FROM d GROUP BY ALL
), sizes AS (SELECT id, count(*) AS n FROM d GROUP BY id
), whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (id), whole GROUP BY item_id, id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
