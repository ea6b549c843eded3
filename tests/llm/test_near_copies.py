import random

import corpus_pipeline as P
from scholia.llm import near_copies as N

from .conftest import rows


def shingles(text, words=5):
    w = text.lower().split()
    return {" ".join(w[i : i + words]) for i in range(len(w) - words + 1)}


def planted(seed=2):
    """Texts with edited copies of all similarities, a group of copies of copies, and the components by brute force."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioustrnlcdm") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    edited = lambda t, n: " ".join(r.choice(vocabulary) if i in spots else w for spots in [set(r.sample(range(len(t.split())), n))] for i, w in enumerate(t.split()))
    texts = []
    for _ in range(30):
        base = " ".join(r.choice(vocabulary) for _ in range(r.randrange(80, 300)))
        texts += [base, *[edited(base, r.randrange(1, 2 + len(base.split()) // 40)) for _ in range(3)]]
    texts += [edited(texts[0], 2) for _ in range(40)]
    sets = [shingles(t) for t in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    root = list(range(len(texts)))
    for i, j in sorted(near):
        a, b = sorted((root[i], root[j]))
        root = [a if x == b else x for x in root]
    return texts, near, root


def test_stage_against_brute_force(spark, tmp_path):
    texts, near, root = planted()
    assert len(near) > 100 and len(set(root)) > 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in N.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == root
    kept = {r["doc_id"] for r in P.one_of_each(spark, docs, str(tmp_path)).collect()}
    assert kept == set(root)


def test_tiles_of_a_large_group(spark, monkeypatch):
    """Small tiles: the group that no star joins is compared by pairs of tiles, and nothing is lost."""
    monkeypatch.setattr(N, "TILE", 7)
    monkeypatch.setattr(N, "STARS", 0)
    texts, _, root = planted()
    got = {r["doc_id"]: r["component_id"] for r in N.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_links_of_tiles():
    """Links of two tiles, and within one, connect what brute force connects."""
    texts, near, _ = planted()
    sets = [N.shingles(t, 5) for t in texts]

    def top(edges, x):
        seen, todo = {x}, [x]
        while todo:
            k = todo.pop()
            todo += (new := {j for e in edges if k in e for j in e} - seen)
            seen |= new
        return frozenset(seen)

    for split in (0, 1, 70, len(sets) - 1):
        want = {e for e in near if not split or (min(e) < split <= max(e))}
        got = set(N.links_of(sets, list(range(len(sets))), split, 0.8))
        assert got <= {tuple(sorted(e)) for e in want} and {top(got, i) for i in range(len(sets))} == {top(want, i) for i in range(len(sets))}


def test_texts_that_share_passages(spark, monkeypatch):
    """Texts of which half is one common passage: no links, whatever the tiles; their near copies are found."""
    monkeypatch.setattr(N, "TILE", 16)
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioustrnlcdm") for _ in range(6))
    passage = " ".join(word() for _ in range(100))
    texts = [f"{' '.join(word() for _ in range(60))} {passage} {' '.join(word() for _ in range(20))}" for _ in range(120)]
    texts += [t + " " + word() for t in texts[:20]]
    got = {row["doc_id"]: row["component_id"] for row in N.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(120)}, **{120 + i: i for i in range(20)}}


def test_one_id_of_two_texts(spark):
    """Of a repeated id the row whose text is a copy goes, the other text stays."""
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    kept = N.keep_one(spark.createDataFrame([(3, a), (7, a), (7, b)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [(3, a), (7, b)]


def test_odd_rows(odd, none):
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == ["1", "10", "2", "5", "6", "8", "None"]
    assert N.near_copies(odd).count() == len(rows()) and N.near_copies(none).count() == 0


def test_fingerprints_link_without_bands(spark, monkeypatch):
    """Operator 5's tiles alone join close copies; unlike texts of near fingerprints are told apart by their sets."""
    monkeypatch.setattr(N, "STARS", 0)
    monkeypatch.setattr(N, "_tiled", lambda now, texts, words, least: spark.createDataFrame([], "a long, b long"))
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioustrnlcdm") for _ in range(6))
    bases = [[word() for _ in range(2000)] for _ in range(10)]
    texts = [" ".join(b) for b in bases] + [" ".join([*b[:-1], word()]) for b in bases]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {row["doc_id"]: row["component_id"] for row in N.near_copies(docs).collect()} == {i: i % 10 for i in range(20)}
    monkeypatch.setattr(N, "RADIUS", 30)
    monkeypatch.setattr(N, "parts", lambda *a: 31)
    monkeypatch.setattr(N, "links", lambda fps, radius, blocks: fps.alias("x").join(fps.alias("y"), how="cross").selectExpr("x.fp AS a", "y.fp AS b"))
    assert {row["doc_id"]: row["component_id"] for row in N.near_copies(docs).collect()} == {i: i % 10 for i in range(20)}


def test_shuffle_files_go(spark):
    """Each step's shuffle files go when its rows are in the checkpoint folder, as a stage has some forty steps."""
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    before = set(files().split())
    rows_ = N.cut(spark.range(1000).selectExpr("id % 7 AS a").groupBy("a").count())
    assert not [f for f in set(files().split()) - before if "/shuffle_" in f]
    assert sorted(map(tuple, rows_.collect())) == [(a, 143 if a < 6 else 142) for a in range(7)]
