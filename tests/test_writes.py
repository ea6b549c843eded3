"""Versions, changes of an index and resumed stages."""

import pytest
from pyspark.sql import functions as F

from scholia.operators import resume as R
from scholia.operators import writes as W
from scholia.sources.versions import Conflict, Rejected, Store

DOCS = "filename string, total_pages int, is_scanned boolean, file_hash string, pages int, status string"
CHUNKS = "filename string, page int, chunk_index long, text string"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([("a", 2, True, "h", 1, "ocr_partial_reviewed"), ("b", 1, False, "h", 1, "indexed"), ("c", 3, True, "h", 0, "ocr_partial_reviewed")], DOCS)
    chunks = spark.createDataFrame([("a", 1, 0, "one"), ("a", 1, 1, "two"), ("b", 1, 0, "b one")], CHUNKS)
    assert s.version() == 0 and s.commit({"documents": docs, "chunks": chunks}, check=lambda t: W.faults(t["documents"], t["chunks"])) == 1
    return s


def change(s, by, **more):
    docs, chunks = by(s.read("documents"), s.read("chunks"))
    return s.commit({"documents": docs, "chunks": chunks}, check=lambda t: W.faults(t["documents"], t["chunks"]), **more)


def state(s):
    return {r["filename"]: (r["pages"], r["status"]) for r in s.read("documents").collect()}, sorted(tuple(r) for r in s.read("chunks").select(*W.CHUNK).collect())


def test_pages_are_replaced_with_their_counts(spark, store):
    pages = spark.createDataFrame([("a", 2, "word " * 400), ("c", 3, " third ")], "filename string, page int, text string")
    assert change(store, lambda d, c: W.replace_pages(d, c, pages)) == 2
    docs, chunks = state(store)
    assert docs == {"a": (2, "indexed"), "b": (1, "indexed"), "c": (1, "ocr_partial_reviewed")}
    assert [c[:3] for c in chunks] == [("a", 1, 0), ("a", 1, 1), ("a", 2, 0), ("a", 2, 1), ("b", 1, 0), ("c", 3, 0)]
    blank = spark.createDataFrame([("a", 2, "  ")], "filename string, page int, text string")
    change(store, lambda d, c: W.replace_pages(d, c, blank))
    assert state(store)[0]["a"] == (1, "ocr_partial_reviewed")


def test_a_failed_batch_leaves_the_old_version(spark, store):
    before = state(store)
    for row, kind in [(("a", 9, 0, "x"), "page_out_of_range"), (("z", 1, 0, "x"), "unknown_document"), (("a", 1, 1, "again"), "place_held_twice"), (("a", 2, 0, " "), "blank_chunk")]:
        new = spark.createDataFrame([("b", 1, 7, "good"), row], CHUNKS)
        with pytest.raises(Rejected) as e:
            change(store, lambda d, c, new=new: W.insert_chunks(d, c, new))
        assert [f["kind"] for f in e.value.faults] == [kind] and e.value.count == 1
        assert store.version() == 1 and state(store) == before
    change(store, lambda d, c: W.insert_chunks(d, c, spark.createDataFrame([("b", 1, 7, "good")], CHUNKS)))
    assert ("b", 1, 7, "good") in state(store)[1] and store.read("chunks", 1).count() == 3


def test_one_of_two_writers_gets_through(spark, store):
    one = spark.createDataFrame([("b", 1, 7, "x")], CHUNKS)
    change(store, lambda d, c: W.insert_chunks(d, c, one), parent=1)
    with pytest.raises(Conflict):
        change(store, lambda d, c: W.delete_obsolete(d, c, one), parent=1)
    assert store.version() == 2


def test_obsolete_documents_go_with_their_chunks(spark, store):
    change(store, lambda d, c: W.delete_obsolete(d, c, spark.createDataFrame([("b",), ("c",), ("b",)], "filename string")))
    docs, chunks = state(store)
    assert set(docs) == {"b", "c"} and [c[0] for c in chunks] == ["b"]


def test_reviews_are_checked_as_a_batch(spark, store):
    schema = "filename string, page int, text string, source_hash string, completeness string, unresolved int"
    rows = [("a", 1, "t", "h", "complete", 0), ("q", 1, "t", "h", "complete", 0), ("a", 2, "t", "other", "complete", 0), ("a", 3, "t", "h", "complete", 0), ("c", 1, "t", "h", "part", 0), ("c", 2, "t", "h", "complete", 2), ("c", 3, " ", "h", "complete", None), ("b", 1, "t", "h", "complete", 0), ("b", 1, "u", "h", "complete", 0), ("a", None, "t", "h", "complete", 0)]
    got = sorted((r["kind"], r["filename"], r["page"] or 0) for r in W.review_faults(store.read("documents"), spark.createDataFrame(rows, schema)).collect())
    assert got == [("blank_text", "c", 3), ("incomplete", "c", 1), ("page_out_of_range", "a", 0), ("page_out_of_range", "a", 3), ("reviewed_twice", "b", 1), ("source_changed", "a", 2), ("unknown_document", "q", 1), ("unresolved", "c", 2)]


def test_broken_runs_resume(spark, tmp_path):
    source = spark.range(200).withColumn("text", F.concat(F.lit("t"), F.col("id") % 7))
    calls = []

    def stages(broken):
        def made(name, body):
            def stage(rows):
                calls.append(name)
                if name == broken:
                    raise ZeroDivisionError(name)
                return body(rows)

            return name, stage

        return [made("filter", lambda r: r.where("id % 2 = 0")), made("distinct", lambda r: r.groupBy("text").agg(F.min("id").alias("id"))), made("mark", lambda r: r.withColumn("odd", F.col("id") % 4 == 0))]

    run = R.Resumable(spark, str(tmp_path / "run"))
    for broken in ("filter", "distinct", "mark"):
        calls.clear()
        with pytest.raises(ZeroDivisionError):
            run.run(source, stages(broken), {"p": 1})
        assert calls[-1] == broken and len(calls) == 1 + (broken != "filter")
    rows, did = run.run(source, stages(None), {"p": 1})
    whole, all_ = R.Resumable(spark, str(tmp_path / "other")).run(source, stages(None), {"p": 1})
    assert did == ["mark"] and all_ == ["filter", "distinct", "mark"] and sorted(rows.collect()) == sorted(whole.collect()) and rows.count() == 7
    assert run.run(source.repartition(3), stages(None), {"p": 1})[1] == []
    for changed in ((source, stages(None), {"p": 2}), (source.where("id < 199"), stages(None), {"p": 1}), (source, stages(None)[:2], {"p": 1})):
        with pytest.raises(R.OtherPlan):
            run.run(*changed)
