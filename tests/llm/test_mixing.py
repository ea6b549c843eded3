from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scholia.llm import mixing as M

from .conftest import rows


def water(sizes, weights=(5, 2, 1), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        if not rest:
            return fixed
        rate = (total - sum(fixed.values())) / sum(w[s] for s in rest)
        over = [s for s in rest if w[s] * rate > most * sizes[s]]
        if not over:
            return fixed | {s: w[s] * rate for s in rest}
        fixed |= {s: most * sizes[s] for s in over}


def lague(weights, seats):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        got[max(sorted(weights), key=lambda k: weights[k] / (2 * got[k] + 1))] += 1
    return got


@pytest.mark.parametrize("seats", [0, 1, 7, 50, 333])
def test_apportion_by_highest_quotients(spark, seats):
    weights = {f"s{i:02}": float((i * 37) % 101 + 0.25 * i + 1) for i in range(23)} | {"big": 5000.0}
    df = spark.createDataFrame([("g", k, v) for k, v in weights.items()], "g string, k string, w double")
    got = {r["k"]: r["quota"] for r in M.apportion(df, ["g"], "w", F.lit(seats), ["k"]).collect()}
    assert got == lague(weights, seats)


def test_odd_rows(odd, none):
    got = M.mix(odd).collect()
    assert len(got) == len(rows())
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
    want = water(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64 + 0.02 * want[s]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, M.mix(odd.repartition(3)).collect()), key=str)
    assert M.mix(none).count() == 0
    assert M.mixed(odd).columns == odd.columns and M.mixed(none).count() == 0


def test_hot_source_and_caps(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 < 1 THEN 'hot' ELSE concat('s', id % 9) END AS source", "trim(repeat('w ', cast(id % 200 AS int))) AS text")
    got = M.mix(docs, block=16, shard_blocks=50)
    per = got.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in per:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 40 + 0.01 * r["max(target)"]
    whole = M.mixed(docs, block=16, shard_blocks=50)
    words = {r["source"]: r["n"] for r in whole.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != ""))).alias("n")).collect()}
    for r in per:  # what the integer quotas give, to within half a document
        assert abs(words[r["source"]] - r["sum(taken)"]) <= 100
    assert whole.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3


def test_running_sums_do_not_depend_on_buckets(spark):
    df = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('s', id % 2) END AS g", "(id * 7919 % 1009) / 1009.0D AS o", "id % 13 AS size")
    a, b = (sorted(map(tuple, M.running(df, "g", "o", ["id"], "size", n).collect()), key=str) for n in (10, 10**6))
    assert a == b and len(a) == 2000
