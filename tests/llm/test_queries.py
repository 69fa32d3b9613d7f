"""Registered queries against their SQL, and the pipeline's contract."""

import pytest

import corpus_pipeline
from loomwright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(name, spark, small, same):
    same(queries.QUERIES[name](spark, small), queries.ORACLE_SQL[name])


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_keep_columns_and_clean_documents(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mix", "pack"]
    now = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in now.select("doc_id").collect()}
        now = stage(spark, now, small)
        now.write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        after = {r.doc_id for r in now.select("doc_id").collect()}
        assert after <= before and after
        if name != "pack":
            assert now.columns == docs.columns
        if name == "toxicity":
            lost = before - after
            assert sum(labels.get(d) == 1 for d in lost) >= 0.5 * len(lost & labels.keys())
            assert sum(labels.get(d) == 0 for d in after) >= 0.97 * sum(v == 0 for v in labels.values())
        if name == "near_dedup":
            assert now.count() == len(after)
        if name == "pii":
            assert after == before and now.where("text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9-]+'").isEmpty()
            assert now.where("n_chars <> length(text)").isEmpty()


def test_pipeline_over_no_documents(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
