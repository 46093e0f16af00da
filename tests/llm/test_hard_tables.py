"""Every query and the pipeline on tables with nothing in them, without labels, and with odd rows."""

import pytest

import corpus_pipeline
from tests.llm import helpers
from zonewalk.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, word string, digest string, bucket string, kept boolean, node long"
LONG = ("lorem ipsum dolor sit amet " * 210_000)[:5_000_000]


def prose(n):
    return [(i, t, lang, "s", len(t or ""), 1, "w", "d", "b", True, 3) for i, t, lang, *_ in helpers.rows(n) if i < 5000]


def table(spark, kind):
    rows = prose(40)
    if kind == "empty":
        return spark.createDataFrame([], COLUMNS)
    if kind == "odd":
        rows += [(None, "one two three", "en", *rows[0][3:]), (None, None, None, None, None, None, None, None, None, None, None), rows[0], rows[0], (rows[1][0], "another text of the same id", *rows[1][2:]), (9001, LONG, *rows[0][2:]), (9002, "x" * 300_000, *rows[0][2:]), (9003, "", None, *rows[0][3:]), (9004, " \n", None, *rows[0][3:])]
    if kind == "without lang":
        rows = [(r[0], r[1], None, *r[3:]) for r in rows]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def labels(spark, kind):
    if kind in ("empty", "without labels"):
        return spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(i, q, t) for i, _, _, q, t in helpers.rows(40) if q is not None and i < 5000]
    if kind == "one label":
        rows = [(i, 1, 0) for i, _, _ in rows]
    return spark.createDataFrame(rows + [(None, 1, 1), (None, None, None), rows[0]], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["empty", "odd", "without lang", "without labels", "one label"])
def test_queries_and_pipeline_take_hard_tables(spark, tmp_path, kind):
    docs = table(spark, kind)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, kind).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = sorted((str(r.doc_id) for r in docs.select("doc_id").collect()))
    for name, query in queries.queries().items():
        if kind in ("without lang", "without labels", "one label") and name not in ("op3_language_id", "op4_toxicity", "op6_quality_classifier", "op8_quality_rules"):
            continue
        got = query(spark, str(tmp_path)).collect()
        assert sorted(str(r.doc_id) for r in got) == ids, name
        if name == "op3_language_id" and kind == "without lang":
            assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
        if name == "op6_quality_classifier" and kind == "without labels":
            assert {(r.p_keep, r.kept) for r in got} == {(0.0, False)}
        if name == "op4_toxicity":
            assert all(0 <= r.score <= 1 for r in got)
    if kind in ("empty", "odd"):
        kept = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert len({(r.bucket, r.batch, r.place) for r in kept}) == len(kept) and {str(r.doc_id) for r in kept} <= set(ids)
        assert bool(kept) == (kind == "odd")


def test_stages_carry_columns_of_any_name(spark):
    rng = helpers.random.Random(2)
    texts = [helpers.prose(rng, "en", 80) for _ in range(4)]
    names = ["doc_id", "text", "_may", "_id", "_node", "a.b", "row", "id", "digest", "_bits", "sha", "n"]
    rows = [(i, t, *[f"{c}{i}" for c in names[2:]]) for i, t in enumerate([texts[0], texts[0], texts[1], texts[1] + " end", texts[2], texts[3]])] + [(5, texts[3], *[f"{c}5" for c in names[2:]])]
    docs = spark.createDataFrame(rows, names).repartition(3)
    for stage, left in ((corpus_pipeline.exact_copies, [0, 2, 3, 4, 5]), (corpus_pipeline.near_copies, [0, 2, 4, 5])):
        kept = stage(spark, docs, "")
        assert kept.columns == names
        assert sorted(tuple(r) for r in kept.collect()) == [rows[i] for i in left]
