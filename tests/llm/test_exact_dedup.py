import hashlib
import re

from pyspark.sql import functions as F

from scholia.llm import exact_dedup as E

from .conftest import rows


def expected():
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in rows():
        groups.setdefault(norm(r[1]), []).append(r[0])
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}, norm


def test_odd_rows(spark, odd, none, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    groups, norm = expected()
    got = E.exact_dedup(spark, f"{tmp_path}/documents.parquet", per_salt=1).collect()
    assert len(got) == len(rows())
    want = sorted((str(r[0]), str(groups[norm(r[1])][0]), groups[norm(r[1])][1], hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows())
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["digest"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    none.write.parquet(f"{tmp_path}/none.parquet")
    assert E.exact_dedup(spark, f"{tmp_path}/none.parquet").count() == 0


def test_collisions_are_told_apart_by_bytes(spark, tmp_path):
    data = [(i, f"text {i % 7}") for i in range(60)]
    spark.createDataFrame(data, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d.parquet")
    weak = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)
    got = E.exact_dedup(spark, f"{tmp_path}/d.parquet", digest=weak, per_salt=10).collect()
    assert len(got) == 60
    for r in got:
        assert r["keep_id"] == r["doc_id"] % 7 and r["kept"] == (r["doc_id"] < 7)
        assert r["group_size"] == sum(i % 7 == r["doc_id"] % 7 for i in range(60))


def test_many_batches_give_the_same(spark, tmp_path):
    spark.range(200).selectExpr("id AS doc_id", "concat('t ', id % 50) AS text").repartition(8).write.parquet(f"{tmp_path}/d.parquet")
    got = E.exact_dedup(spark, f"{tmp_path}/d.parquet", batch_bytes=1).collect()
    assert len(got) == 200 and all(r["group_size"] == 4 and r["keep_id"] == r["doc_id"] % 50 for r in got)


def test_far_ids(spark, tmp_path):
    far = 9 * 10**18
    data = [(-far, "a  b"), (far, "a b"), (None, "a b"), (far, "c"), (None, "d"), (None, "d")]
    spark.createDataFrame(data, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d.parquet")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_dedup(spark, f"{tmp_path}/d.parquet").collect()), key=str)
    assert got == sorted([(-far, -far, 3, True), (far, -far, 3, False), (None, -far, 3, False), (far, far, 1, True), (None, None, 2, True), (None, None, 2, False)], key=str)


def test_ids_that_are_text(spark, tmp_path):
    spark.createDataFrame([("y", "a b"), ("x", "a\tb"), ("z", None)], "doc_id string, text string").write.parquet(f"{tmp_path}/e x")
    got = {tuple(r)[:4] for r in E.exact_dedup(spark, f"{tmp_path}/e x/").collect()}
    assert got == {("y", "x", 2, False), ("x", "x", 2, True), ("z", "z", 1, True)}


def test_a_later_run_reads_new_files_only(spark, tmp_path):
    table, state = f"{tmp_path}/d.parquet", f"{tmp_path}/state"
    spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string").coalesce(1).write.parquet(table)
    run = lambda: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_dedup(spark, table, state=state).collect())
    assert run() == [(5, 5, 1, True), (6, 6, 1, True)]
    spark.createDataFrame([(2, "a  b"), (7, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(table)
    assert run() == [(2, 2, 2, True), (5, 2, 2, False), (6, 6, 2, True), (7, 6, 2, False)]
    batches = [r[0] for r in spark.read.parquet(f"{state}/state").where("copies > 0").groupBy("batch").agg(F.sum(F.lit(1))).orderBy("batch").select("batch").collect()]
    assert batches == [0, 1]
    assert run() == [(2, 2, 2, True), (5, 2, 2, False), (6, 6, 2, True), (7, 6, 2, False)]
    again = [r[0] for r in spark.read.parquet(f"{state}/state").where("copies > 0").select("batch").distinct().orderBy("batch").collect()]
    assert again == batches
