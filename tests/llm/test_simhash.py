import re
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.llm import simhash as S

from .conftest import rows


def fingerprint(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(pairs, radius=4):
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if (pairs[a][1] ^ pairs[b][1]).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(pairs))]


@given(st.text(max_size=200))
@settings(max_examples=100, deadline=None)
def test_fingerprint(text):
    assert S.fingerprint(S.shingle_hashes(text, 4)) == fingerprint(text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")) or any(0xD800 <= ord(c) < 0xE000 for c in text)


def test_odd_rows(odd, none):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_dedup(odd).collect()}
    pairs = [(r[0], fingerprint(r[1])) for r in rows()]
    assert got == {(d, f"{p:016x}", c) for (d, p), c in zip(pairs, brute(pairs), strict=True)}
    assert S.near_dedup(odd).count() == len(rows()) and S.near_dedup(none).count() == 0
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None) == sorted({c for c in brute(pairs) if c is not None})


def test_links_by_tiles_are_exact(spark):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(60)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for c in centres for _ in range(12)}
    fps |= {centres[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute(list(zip(signed, fps, strict=True)))
    for blocks, tile in ((5, 4096), (5, 16), (6, 16)):  # small tiles: every large bucket is cut
        roots = {x["node"]: x["root"] for x in S.components(S.links(df, 4, blocks, tile)).collect()}
        assert [roots.get(x, x) for x in signed] == want


def test_forest_between_tiles():
    a, b = np.array([0, 1 << 10, 0xFFFF], np.uint64), np.array([1, 0xFF00FF], np.uint64)
    member, root = S.forest(a, b, 2)
    assert set(zip(member.tolist(), root.tolist(), strict=True)) == {(1, 0), (1 << 10, 0)}


def test_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r["root"] for r in S.components(edges).collect()} == {0}


def test_hot_centre(spark):
    """A star of more leaves than a part holds: its joins are salted."""
    edges = spark.range(1, 2500).selectExpr("id AS a", "IF(id % 3 = 0, 1, 2) AS b")
    assert {r["root"] for r in S.components(edges.unionByName(spark.createDataFrame([(1, 2)], "a long, b long"))).collect()} == {1}


def test_parts_grow_with_the_fingerprints():
    assert [S.parts(n, 4) for n in (0, 1000, 10**7, 10**9, 5 * 10**10)] == [5, 5, 5, 6, 7]


def test_rounds_end_with_stars(spark, monkeypatch):
    """Stars need no round; chains, hubs and random edges give what union-find gives, no round after the last that changes them."""
    cuts = []
    monkeypatch.setattr(S, "cut", lambda df, f=S.cut: cuts.append(1) or f(df))
    r = random.Random(3)
    for edges, most in ([[(1, x) for x in range(2, 50)] + [(60, 61)], 1], [[(1, 2), (2, 3)], 2], [[(i, i + 1) for i in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(90)] + [(300, x) for x in range(301, 1700)], 9]):
        cuts.clear()
        root = {x: x for e in edges for x in e if e[0] != e[1]}

        def top(x, root=root):
            return x if root[x] == x else top(root[x])

        for a, b in edges:
            if a != b:
                a, b = sorted((top(a), top(b)))
                root[b] = a
        assert {row.node: row.root for row in S.components(spark.createDataFrame(edges, "a long, b long")).collect()} == {x: top(x) for x in root}
        assert len(cuts) <= most


def test_an_edge_stays_one_row(spark, monkeypatch):
    """No round makes rows of an edge's two directions, also where hubs are salted: nodes with many larger, and with many smaller neighbours."""
    plans = []
    monkeypatch.setattr(S, "cut", lambda df, f=S.cut: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    for edges in ([(1, x) for x in range(3, 1500)] + [(2, x) for x in range(1400, 2900)], [(5000, x) for x in range(1200)] + [(6000, x) for x in range(1100, 2300)] + [(7000, 7001)]):
        got = {row.node: row.root for row in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: 7000 if x >= 7000 else min(map(min, edges)) for e in edges for x in e}
    assert len(plans) > 4 and not [p for p in plans if "inline(" in p]
