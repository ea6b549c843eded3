import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.llm import decontaminate as D

from .conftest import rows


def edits(item, text):
    """Fewest edits of item into any stretch of text: the plain table."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


@given(st.lists(st.tuples(st.text("abé ", min_size=1, max_size=30), st.text("abé ", max_size=60)), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_distances(pairs):
    assert D.distances([a for a, _ in pairs], [b for _, b in pairs], together=3).tolist() == [edits(a, b) for a, b in pairs]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_words(text):
    low = text.lower().encode("utf-8", "surrogatepass")
    assert D.plain(text) == b" ".join(re.findall(rb"[0-9a-z\x80-\xff]+", low))
    got, where = D.words(np.frombuffer(low, np.uint8))
    assert all(a == low[i] for a, i in zip(got.tolist(), where.tolist(), strict=True) if a != 32)


def passages(rate, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioustrnlcdm") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(15, 60)))) for i in range(80)]
    texts = []
    for _, t in items:
        out = []
        for w in t.split():
            out += [w] if r.random() >= rate else r.choice([[], [w, r.choice(vocabulary)], [r.choice(vocabulary)]])
        texts.append(" ".join(r.choice(vocabulary) for _ in range(50)) + " " + " ".join(out) + " " + " ".join(r.choice(vocabulary) for _ in range(50)))
    return items, texts


def near(item, text):
    item = D.plain(item).decode()
    return D.distances([item], [D.plain(text).decode()])[0] <= 0.2 * len(item)


def test_recall_of_edited_words():
    for rate in (0.0, 0.05, 0.1, 0.2):
        items, texts = passages(rate)
        ix = D.index([t for _, t in items])
        want = {(i, i) for i, (_, item) in enumerate(items) if near(item, texts[i])}
        got = {(k, i) for k, i, *_ in D.hits(ix, texts, 0.2)}
        assert all(near(items[i][1], texts[k]) for k, i in got)
        assert len(want) > 20 and len(got & want) >= (1.0 if rate == 0 else 0.95) * len(want)


def edited(r, text, rate, kind, spread):
    """The text with so many of its characters edited, at random places or evenly spread."""
    k = int(rate * len(text))
    places = [int((i + 0.5) * len(text) / k) for i in range(k)] if spread else sorted(r.sample(range(len(text)), k))
    out = list(text)
    for at in reversed(places):
        how, c = kind if kind != "any" else r.choice(["replace", "insert", "delete"]), r.choice("abcdefghijklmnopqrstuvwxyz")
        out[at : at + (how != "insert")] = [] if how == "delete" else [c]
    return "".join(out)


@pytest.mark.parametrize("spread", [False, True])
@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.19])
def test_recall_of_edited_characters(rate, spread):
    items, _ = passages(0.0)
    ix = D.index([t for _, t in items])
    r = random.Random(4)
    owner = [i for _ in range(3) for i in range(len(items))]
    kinds = [kind for kind in ("replace", "any", "delete") for _ in items]
    texts = [f"{items[i - 1][1][:80]} {edited(r, items[i][1], rate, kind, spread)} {items[i - 2][1][:80]}" for i, kind in zip(owner, kinds, strict=True)]
    whole = [D.plain(items[i][1]).decode() for i in owner]
    fewest = D.distances(whole, [D.plain(t).decode() for t in texts])
    want = {(k, i) for k, i in enumerate(owner) if fewest[k] <= 0.2 * len(whole[k])}
    got = {(k, i) for k, i, *_ in D.hits(ix, texts, 0.2)}
    assert len(want) > 200 and len(got & want) >= 0.95 * len(want)


SCRIPTS = {"han": (0x4E00, 0x9FFF, ""), "cyrillic": (0x430, 0x44F, " "), "greek": (0x3B1, 0x3C9, " "), "hangul": (0xAC00, 0xD7A3, " "), "thai": (0xE01, 0xE2E, ""), "emoji": (0x1F300, 0x1F5FF, "")}


def in_script(r, name, size):
    first, last, gap = SCRIPTS[name]
    return "".join(gap if gap and i % 7 == 6 else chr(r.randint(first, last)) for i in range(size))


@pytest.mark.parametrize("name", SCRIPTS)
def test_scripts_beyond_ascii(name):
    """Items of other scripts are found in spite of edits, and texts that share nothing with them are no candidates."""
    r = random.Random(5)
    items = [in_script(r, name, 150) for _ in range(300)]
    ix = D.index(items)
    other = D.plain(in_script(r, name, 20000))
    assert len(D.candidates(ix, np.frombuffer(other, np.uint8), np.array([0]))) <= 3
    texts = []
    for item in items[:60]:
        out = list(item)
        for at in r.sample(range(len(out)), 22):
            out[at] = r.choice(["", in_script(r, name, 1), in_script(r, name, 2)])
        texts.append(in_script(r, name, 200) + "".join(out) + in_script(r, name, 200))
    got = {(k, i) for k, i, *_ in D.hits(ix, texts, 0.2)}
    want = {(i, i) for i in range(60) if near(items[i], texts[i])}
    assert got <= want and len(want) > 40 and len(got) >= 0.95 * len(want)


def test_hits_in_slices(monkeypatch):
    """Items that share a passage which a text repeats: the same candidates, however few hits are expanded together."""
    items, texts = passages(0.05)
    shared = texts[0][:200]
    ix = D.index([f"{shared} {t}" for _, t in items])
    text = np.frombuffer(D.plain(" ".join([shared, *texts[:20]] * 3)), np.uint8)
    whole = D.candidates(ix, text, np.array([0]))
    monkeypatch.setattr(D, "HITS", 50)
    assert len(whole) > 20 and D.candidates(ix, text, np.array([0])) == whole


def test_passages_that_lack_their_first_words():
    items, _ = passages(0.0)
    cut = [" ".join(t.split()[2:]) for _, t in items]
    texts = [x for t in cut for x in ("some other text of a few words", t)]
    got = {(k, i) for k, i, *_ in D.hits(D.index([t for _, t in items]), texts, 0.2)}
    want = {(2 * i + 1, i) for (i, t), c in zip(items, cut, strict=True) if near(t, c)}
    assert got == want and len(want) > 60


def test_passages_across_pieces():
    items, texts = passages(0.05)
    whole = " filler words".join(texts) * 8
    assert len(whole) > D.PIECE / 2
    found = {i for _, i, *_ in D.hits(D.index([t for _, t in items]), [whole * 3], 0.2)}
    assert found == {i for i, t in items if near(t, texts[i])} and len(found) > 70


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, rows()[0][1].upper().replace(" ", "\n")), (2, None), (3, ""), (4, "!!! ..."), (5, "12  34"), (6, rows()[0][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in D.contaminated(odd, bench).collect()}
    assert got == {(d, i, 0) for d in (1, 4, 9) for i in (1, 6)} | {(8, 5, 0)}
    blocks = {(r["doc_id"], r["item_id"], r["edits"]) for r in D.contaminated(odd, bench, block=2).collect()}
    assert blocks == got
    kept = D.clean(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(str(r[0]) for r in rows() if r[0] not in (1, 4, 8, 9))
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in D.contaminated(named, bench.withColumn("item_id", F.col("item_id").cast("int"))).collect()} == {(f"d{a}", b, c) for a, b, c in got}
    assert D.contaminated(none, bench).count() == 0 and D.contaminated(odd, bench.limit(0)).count() == 0
