import os

import corpus_pipeline
from tests.llm import helpers
from zonewalk.llm import queries


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = helpers.documents(spark).drop("fp", "word", "digest", "bucket", "kept")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    helpers.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    now, ids = docs, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        kept = {r.doc_id for r in now.collect()}
        assert kept < ids or name == "language ID", name
        ids = kept
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids
    good = {i for i, _, _, q, t in helpers.rows() if q == 1 and t == 0 and i < 160}
    copied = range(0, 20, 4)  # of exact copies the longest stays, so it need not be the first
    assert len(good - set(copied) - ids) <= 0.03 * len(good)
    for i in set(copied) & good:
        assert len({i, 160 + i, 161 + i, 162 + i} & ids) == 1, i


def test_pipeline_of_empty_tables(spark, tmp_path):
    helpers.empty(spark).drop("fp", "word", "digest", "bucket", "kept").write.parquet(f"{tmp_path}/documents.parquet")
    helpers.labels(spark).limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_exact_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = duckdb.sql(queries.OP10_SQL).fetchall()
        got = [tuple(r) for r in queries.op10_exact_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
        names = [c[0] for c in duckdb.sql(queries.OP10_SQL).description]
        order = [names.index(c) for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")]
        assert sorted(got) == sorted(tuple(r[i] for i in order) for r in want)
