import hashlib
import zlib

import pytest

from scholia.llm import merkle as K

from .conftest import SCHEMA, rows


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, add=0):
    values = (r[0], r[3], r[2], None if r[4] is None else r[4] + add, r[1])
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def proofs(leaves):
    """The root of a list of leaves and each leaf's siblings with their side, one level after the other."""
    nodes, members, paths = leaves, [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        up, over = [], []
        for i in range(0, len(nodes), 2):
            pair = nodes[i : i + 2]
            for side in range(len(pair)):
                for leaf_at in members[i + side]:
                    paths[leaf_at].append((1 - side, pair[1 - side]) if len(pair) == 2 else (None, ""))
            up.append(H(*pair))
            over.append(sum(members[i : i + 2], []))
        nodes, members = up, over
    return nodes[0], paths


def climb(node, path):
    for side, other in path:
        node = H(node) if side is None else H(other, node) if side == 0 else H(node, other)
    return node


def brute(data):
    groups = {}
    for r in data:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built, subroots = {}, []
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[g] = (own, *proofs([leaf(r) for r in own]))
        subroots.append(built[g][1])
    root, above = proofs(subroots)
    out = []
    for g, up in zip(names, above, strict=True):
        own, sub, paths = built[g]
        for r, p in zip(own, paths, strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = climb(leaf(r, int(bad)), p + up)
            out.append((r[0] is not None, r[0] or 0, leaf(r), sub, root, H(*[o for _, o in p + up]), folded, folded == root))
    return sorted(out)


def ours(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in K.audit_documents(df).collect())


@pytest.mark.parametrize("n", [*range(1, 36), 63, 64, 65, 255, 256])
def test_positions_and_paths(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    for top in {K.height(n), 8}:
        log = K.append_all(leaves, top)
        at, count, level = [], n, leaves
        for h in range(top + 1):
            assert [log[32 * K.position(h, i, n) :][:32] for i in range(count)] == level
            at += [K.position(h, i, n) for i in range(count)]
            level, count = [K.node(*level[i : i + 2]) for i in range(0, count, 2)] if h < top else level, (count + 1) // 2
        assert sorted(at) == list(range(len(log) // 32))
        assert all(K.fold(leaves[i], K.path(log, i, n, top)) == log[-32:] for i in range(n))


def test_nodes_come_after_their_children():
    for n in range(2, 70):
        for h in range(1, K.height(n) + 1):
            count = -(-n // (1 << h))
            below = -(-n // (1 << (h - 1)))
            for i in range(count):
                assert all(K.position(h - 1, c, n) < K.position(h, i, n) for c in (2 * i, 2 * i + 1) if c < below)


def test_several_tiers(spark):
    """A group of more than 256 runs of 256 would take long; runs of four rows make five tiers of a small one."""
    data = [(i, f"text {i}", ["en", "de", None, "à"][0 if i % 3 else i % 4], "s", i if i % 5 else None) for i in range(330)]
    height, K.HEIGHT = K.HEIGHT, 2
    try:
        assert ours(spark.createDataFrame(data, SCHEMA).repartition(5)) == brute(data)
    finally:
        K.HEIGHT = height


def test_one_group_over_many_runs(spark):
    data = [(i, f"text {i}", "en", "s", i) for i in range(1500)]
    assert ours(spark.createDataFrame(data, SCHEMA).repartition(7)) == brute(data)


def test_equal_rows_and_one_row(spark):
    data = [(5, "same", "en", "s", 4)] * 600
    assert ours(spark.createDataFrame(data, SCHEMA)) == brute(data)
    assert ours(spark.createDataFrame(data[:1], SCHEMA)) == brute(data[:1])


def test_odd_rows(odd, none, spark):
    assert ours(odd) == brute(rows())
    assert K.audit_documents(none).count() == 0
    assert K.audit_documents(spark.createDataFrame([("a'b", "x", "en", "s", 9223372036854775807)], SCHEMA.replace("doc_id long", "doc_id string"))).first()["doc_id"] == "a'b"
