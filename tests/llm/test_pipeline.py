import corpus_pipeline as P
from scholia.llm import decontaminate, quality

from .conftest import rows
from .test_simhash import brute, fingerprint


def folder(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "12 34")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_by_brute_force(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "learn", lambda *a, **k: 1.0)
    d = folder(spark, odd, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())
    for name, stage in P.STAGES:
        out = stage(spark, docs, d)
        if name == "near_dedup":
            roots = brute([(r[0], fingerprint(r[1])) for r in rows()])
            assert ids(out) == sorted({str(r) for r in roots})
        if name == "decontamination":
            assert set(ids(docs)) - set(ids(out)) == {"8"}
        if name == "mixing":
            assert set(ids(out)) <= set(ids(docs))
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
    assert docs.count() and "shard" in docs.columns
    assert sorted(map(str, P.run(spark, d).collect())) == sorted(map(str, docs.collect()))


def test_a_classifier_that_rejects(spark, odd, tmp_path):
    d = folder(spark, odd, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = P.good_quality(spark, docs, d)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert decontaminate.clean(docs, spark.read.parquet(f"{d}/benchmark.parquet")).count() == docs.count() - 1
