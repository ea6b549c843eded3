import random

import numpy as np
import pytest

from scholia.llm import langid, quality
from scholia.llm.common import sample_ids

from .conftest import rows


def prose(r, n, letters="aeioustrnlcdm"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def network():
    r = random.Random(2)
    texts, labels = [], []
    for i in range(240):
        t = prose(r, r.randrange(5, 120))
        if i % 3 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        texts.append(t)
        labels.append(int(i % 3 > 0))
    return quality.train(texts[:160], labels[:160]), texts[160:], labels[160:]


def test_held_out_quality(network):
    net, texts, labels = network
    s = quality.score(net, texts)
    assert ((s >= 0.3) == (np.array(labels) == 1)).mean() > 0.95


def test_whole_text_counts(network):
    """Trash at the very end of a long text shows."""
    net, *_ = network
    r = random.Random(5)
    clean = prose(r, 5000)
    trash = clean + " " + " ".join(w.upper() + "!!" for w in prose(r, 400).split())
    a, b = quality.score(net, [clean, trash])
    assert a > 0.5 and b < a  # seen, though its like was never learned
    joined = quality.chunks_of("x" * 5000)
    assert joined.shape[1] == quality.CHUNK and (joined[0] == ord("x")).all()


def test_gradients():
    """Analytic against numeric, over documents of several chunks, some at a time."""
    r = np.random.default_rng(3)
    net = quality.Network(1)
    for w in net.weights():
        w += r.normal(0, 0.05, w.shape).astype(np.float32)
    docs = [quality.chunks_of(prose(random.Random(i), n)) for i, n in enumerate((3, 400, 900))]
    y, weight = np.array([1, 0, 1], np.float32), np.array([1, 2, 0.5], np.float32)

    def loss():
        pools = [net.pools(d).astype(np.float64) for d in docs]
        p = net.combine(np.array([x.max(0) for x in pools]), np.array([x.mean(0) for x in pools]))
        return float((-weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    got = quality.gradients(net, docs, y, weight, part=2)
    for w, g in zip(net.weights(), got, strict=True):
        for at in np.argsort(-np.abs(g).ravel())[:6].tolist():
            h, old = np.float32(2e-3), w.ravel()[at]
            w.ravel()[at] = old + h
            above = loss()
            w.ravel()[at] = old - h
            below = loss()
            w.ravel()[at] = old
            assert (above - below) / (2 * h) == pytest.approx(g.ravel()[at], rel=0.1, abs=2e-4)


def test_training_reads_whole_texts():
    """What tells the labels apart lies far behind the beginning of long texts."""
    r = random.Random(9)
    texts = [prose(r, 25_000) + (" " + " ".join(w.upper() + "!!" for w in prose(r, 3000).split()) if i % 2 else " " + prose(r, 3000)) for i in range(10)]
    assert min(map(len, texts)) > 130_000
    s = quality.score(quality.train(texts, [1, 0] * 5, epochs=6, batch=2), texts)
    assert s[::2].min() > s[1::2].max()


def test_quality_odd_rows(spark, odd, none, network):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 0), (7, 0, 0), (8, 0, None), (None, 1, 0), (4, None, 1), (9, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, quality.learn(odd, labels)).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert quality.learn(odd, labels.limit(0)) == 0.5 and quality.classify(none, 0.5).count() == 0
    assert quality.classify(odd, quality.learn(odd, labels.where("quality = 1"))).where("score <> 1").count() == 0
    assert quality.keep_good(odd, network[0]).columns == odd.columns


LETTERS = {"aa": "aeioust", "bb": "rnlcdmé", "cc": "xyzwvkq"}


def test_languages():
    r = random.Random(4)
    m = langid.train({x: [prose(r, 60, s) for _ in range(40)] for x, s in LETTERS.items()})
    for x, s in LETTERS.items():
        texts = [prose(r, n, s) for n in (1, 3, 10, 100)]
        pred, score, _, rejected = m.predict(texts)
        assert pred == [x] * 4 and (score > 0.3).all() and not rejected[2:].any()
    assert m.predict(["", None, "12 !!", "жук жил " * 20])[0][:3] == ["und"] * 3
    assert m.predict(["жук жил " * 20])[3][0]


def test_probabilities_sum_to_one():
    """After any context, the models' probabilities of all characters and of one unseen sum to 1."""
    r = random.Random(4)
    m = langid.train({x: [prose(r, 30, s) for _ in range(10)] for x, s in LETTERS.items()})
    alphabet = sorted(set("".join(LETTERS.values()))) + [" ", "ж"]
    for context in ("ae", "rn", "a r", "zz", "жж"):
        texts = [context + c for c in alphabet if c != " "]
        logs = []
        for t in texts:
            c, starts, counted = langid.characters([t])
            logs.append(m.log_probabilities(c, np.array([len(c) - 1])))
        c, _, _ = langid.characters([context + " a"])
        logs.append(m.log_probabilities(c, np.array([len(c) - 2])))
        assert np.exp(np.concatenate(logs)).sum(axis=0) == pytest.approx(1, abs=0.02)


def test_pieces_change_nothing(monkeypatch):
    r = random.Random(4)
    m = langid.train({x: [prose(r, 30, s) for _ in range(10)] for x, s in LETTERS.items()})
    texts = [prose(r, 400, "aeiourn"), "", prose(r, 3, "xyz"), prose(r, 90, "aeirn") + " 12 -- 34 " * 30 + prose(r, 50, "xyz"), "-" * 900]
    whole, counts = m.totals(texts), langid._counts(texts)
    for size in (7, 50, 500):
        monkeypatch.setattr(langid, "PIECE", size)
        parts = m.totals(texts)
        assert np.allclose(whole[0], parts[0], atol=1e-2) and (whole[1] == parts[1]).all()
        for a, b in zip(counts, langid._counts(texts), strict=True):
            assert sorted(zip(a["keys"].tolist(), a["n"].tolist(), a["context"].tolist(), strict=True)) == sorted(zip(b["keys"].tolist(), b["n"].tolist(), b["context"].tolist(), strict=True))


def test_training_reads_whole_languages(spark):
    """The second half of a text, far behind the old bound, is learned too."""
    r = random.Random(4)
    rows = [(i, prose(r, 2000, LETTERS[x]) + " " + prose(r, 2000, "éèêëïî" if x == "aa" else LETTERS[x]), x) for i, x in enumerate(sorted(LETTERS) * 12)]
    models = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert models.predict([prose(r, 5, "éèêëïî")])[0] == ["aa"]


def test_language_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in langid.identify(odd, langid.learn(odd)).collect()}
    assert langid.identify(odd, langid.learn(odd)).count() == len(rows())
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 7))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.learn(none) is None and langid.identify(none, None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


def test_samples_are_bounded_and_stable(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN 'x' ELSE 'hot' END AS k")
    got = sorted(map(tuple, sample_ids(df, "k", 50).collect()))
    assert len(got) == 100 and got == sorted(map(tuple, sample_ids(df.repartition(7), "k", 50).collect()))


def test_letters_of_all_planes():
    m = langid.train({"a": ["abc abd " * 20] * 10, "b": ["xyz xyw " * 20] * 10})
    pred = m.predict(["\U00030001\U00030002", "\U0010ffff", "abd"])[0]
    assert pred[0] != "und" and pred[1:] == ["und", "a"]
