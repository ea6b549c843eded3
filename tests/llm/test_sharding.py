import hashlib
import math
import zlib
from collections import Counter

from scholia.llm import sharding as S

from .conftest import rows


def fall(key, n):
    """The tree's law, one row at a time."""

    def draw(name, w):
        digits = hashlib.md5(f"tree:{'null' if key is None else key}:{name}".encode()).hexdigest()[:13]
        return -math.log((int(digits, 16) + 0.5) / 16**13) / w

    tops = {}
    for s in S.tree(n):
        tops.setdefault(f"shard{s.shard}" if s.added else f"region{s.region}", []).append(s)
    best = tops[min(tops, key=lambda g: (draw(g, sum(s.weight for s in tops[g])), g))]
    if len(best) > 1:
        racks = {}
        for s in best:
            racks.setdefault(f"rack{s.rack}", []).append(s)
        best = racks[min(racks, key=lambda g: draw(g, len(racks[g])))]
        best = [min(best, key=lambda s: draw(f"shard{s.shard}", s.weight))]
    return best[0].shard


def test_law_and_growth(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    got = S.shard_documents(docs).collect()
    assert len(got) == 3000
    for r in got:
        assert r["shard"] == fall(r["doc_id"], 40)
        assert r["grown_shard"] in (r["shard"], 40)
        assert r["grown_shard"] == fall(r["doc_id"], 41)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(40)) and max(counts.values()) < 130
    for shard in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(counts[shard]))


def test_weights(spark):
    shards = [S.Shard(0, 0, 0, 3.0), S.Shard(1, 0, 0, 1.0), S.Shard(2, 1, 1, 4.0)]
    counts = {r["shard"]: r["count"] for r in S.assign(spark.range(8000).toDF("doc_id"), shards).groupBy("shard").count().collect()}
    assert abs(counts[0] - 3000) < 250 and abs(counts[1] - 1000) < 200 and abs(counts[2] - 4000) < 250


def test_odd_rows(odd, none):
    got = S.shard_documents(odd).collect()
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got}
    assert by[2]["size"] == 16 and by[2]["text_crc32"] == 0 and by[8]["text_crc32"] == zlib.crc32(rows()[9][1].encode())
    assert by[None]["shard"] == fall(None, 40)
    same = [r for r in got if r["doc_id"] == 4]
    assert len({r["shard"] for r in same}) == 1 and len({r["slot"] for r in same}) == 2
    assert S.shard_documents(none).count() == 0
