import corpus_pipeline
from caseforge.llm import decontaminate, near_dedup, queries

from .conftest import prose


def test_stages_one_by_one(spark, docs, items, tmp_path):
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    d, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        assert d.columns == base.columns
        seen[name] = sorted((r.doc_id for r in d.collect()), key=str)
    assert not {40, 41, 42, 43, 50, 51} & set(seen["quality rules"]) and {*range(12), 20, 30, 44, 52} <= set(seen["quality rules"])
    assert seen["line dedup"] == seen["quality rules"]
    near = spark.read.parquet(f"{tmp_path}/2")
    assert {20, 30, 31, 44, 52, 60} <= set(seen["near-duplicate dedup"]) and not {21, 22, 23, 24} & set(seen["near-duplicate dedup"])
    assert near_dedup.classes(near).filter("class_size > 1").count() == 0
    assert 52 not in seen["benchmark decontamination"] and len(seen["benchmark decontamination"]) == len(seen["near-duplicate dedup"]) - 1
    assert decontaminate.contaminated(spark.read.parquet(f"{tmp_path}/3"), items).count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id for r in whole.collect()), key=str) == seen["source mixing"]


def test_empty_tables(spark, empty, items, tmp_path):
    d = empty.select("doc_id", "text", "lang", "source", "n_chars")
    items.limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        assert d.count() == 0


def test_every_query_is_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
    assert prose(1, 3).count(" ") == 2
