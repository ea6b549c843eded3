"""Blocks, edits and ratios against the standard library's matcher."""

import difflib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.operators import agreement as A


def plain(left, right):
    a, b = A.compact(left), A.compact(right)
    if a == b:
        return True, 1.0, []
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return False, m.ratio(), [(op, i, x, j, y, a[i:x], b[j:y]) for op, i, x, j, y in m.get_opcodes() if op != "equal"]


@given(st.text("abc \n", max_size=60), st.text("abc \n", max_size=60))
@settings(max_examples=500, deadline=None)
def test_small_alphabet(left, right):
    assert A.compared(left, right) == plain(left, right)


@given(st.text("aàà \U0001f600é-", max_size=40), st.text("aàà \U0001f600é-", max_size=40))
@settings(max_examples=200, deadline=None)
def test_composition_and_far_code_points(left, right):
    assert A.compared(left, right) == plain(left, right)


def noisy(text, r, share=0.02):
    return "".join(r.choice(["", c + " ", "x", c.upper()]) if r.random() < share else c for c in text)


def test_pages(spark):
    r = random.Random(4)
    pages = ["".join(r.choice("abcdefghij àé.,\n") for _ in range(1200)) for _ in range(8)]
    rows = [(i, p, noisy(p, r)) for i, p in enumerate(pages)] + [(20, None, None), (21, "", "x"), (22, "a b", " a\nb")]
    got = {x["k"]: x for x in A.agreement(spark.createDataFrame(rows, "k int, a string, b string"), "k", "a", "b").collect()}
    for k, a, b in rows:
        exact, ratio, differences = plain(a or "", b or "")
        assert (got[k]["exact"], got[k]["agreement"], [tuple(d) for d in got[k]["differences"]]) == (exact, ratio, differences)


def test_a_long_text_is_compared_whole():
    """150,000 characters of four kinds: a matcher that follows all equal characters would take hours."""
    r = random.Random(1)
    text = "".join(r.choice("acgt") for _ in range(150_000))
    at = sorted(r.sample(range(len(text)), 40))
    other = "".join("n" if i in set(at) else c for i, c in enumerate(text))
    exact, ratio, differences = A.compared(text, other)
    assert not exact and ratio == 2 * (len(text) - 40) / (2 * len(text))
    assert [d[1] for d in differences] == at and all(d[0] == "replace" for d in differences)


def test_ranges_by_either_search(monkeypatch):
    """Ranges that are scanned and ranges that are searched by sums give the same blocks."""
    r = random.Random(5)
    for n in (3, 40, 200):
        left, right = ("".join(r.choice("abcd") for _ in range(n)) for _ in range(2))
        found = []
        for limit in (0, 30, 1 << 24):
            monkeypatch.setattr(A, "SCANNED", limit)
            found.append(A.compared(left, right))
        assert found[0] == found[1] == found[2] == plain(left, right)


def test_many_small_blocks_take_few_searches(monkeypatch):
    """Unlike texts have many short blocks: ranges of a few thousand characters are not sorted for each."""
    monkeypatch.setattr(A.Matcher, "_first", lambda *a: 1 / 0)
    r = random.Random(6)
    left, right = ("".join(r.choice("etaoinshrdlu ") for _ in range(3000)) for _ in range(2))
    exact, ratio, differences = A.compared(left, right)
    assert not exact and 0 < ratio < 1 and len(differences) > 100


def test_pairs_that_lie_together_are_dealt(spark):
    pairs = spark.createDataFrame([(i, f"left {i}", f"right {i}") for i in range(400)], "k int, a string, b string").coalesce(1)
    assert A.agreement(pairs, "k", "a", "b").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
