import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.llm import fill_middle as M

from .conftest import rows

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_way(key, text):
    """n, form, lengths and output, by the pattern and slices of code points."""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.text("ab \n\t\x0b\x85\xa0é中\U0001f600<PSM>", max_size=120), st.integers(0, 5000))
@settings(max_examples=500, deadline=None)
def test_one_text(text, key):
    got = M.rewrite(text.encode(), str(key))
    assert (got.n, got.form, got.prefix_chars, got.middle_chars, got.output.decode()) == plain_way(key, text)
    assert M.restore(got.output, got.form) == text.encode()


@given(st.lists(st.integers(0, 4), max_size=400), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_ranks_and_selects(values, value):
    import numpy as np

    m = M.WaveletMatrix(np.array(values, np.uint8))
    assert [m.rank(value, p) for p in range(len(values) + 1)] == [values[:p].count(value) for p in range(len(values) + 1)]
    at = [i for i, v in enumerate(values) if v == value]
    assert [m.select(value, k + 1) for k in range(len(at) + 1)] == [*at, len(values)]


def test_very_long_text():
    r = random.Random(3)
    text = "".join(r.choice(["wörd ", "a", "\n\n", "中文", "  "]) for _ in range(400_000))
    key = next(k for k in range(100) if plain_way(k, "a")[1] == "psm")
    got = M.rewrite(text.encode(), str(key))
    assert (got.n, got.form, got.prefix_chars, got.middle_chars, got.output.decode()) == plain_way(key, text)


def test_odd_rows(odd, none):
    got = M.restored(M.fill_middle(odd)).collect()
    want = sorted((r[0] is not None, r[0] or 0, *plain_way("null" if r[0] is None else r[0], r[1] or "")) for r in rows())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n"], r["form"], r["prefix_chars"], r["middle_chars"], bytes(r["output"]).decode()) for r in got) == want
    texts = {(r[0], (r[1] or "").encode()) for r in rows()}
    assert {(r["doc_id"], bytes(r["restored"])) for r in got} == texts
    assert M.restored(M.fill_middle(none)).count() == 0


def test_rates(spark):
    docs = spark.range(4000).selectExpr("cast(id AS string) AS doc_id", "'one two three four' AS text")
    forms = {r["form"]: r["count"] for r in M.fill_middle(docs, M.Rates(rewritten=25, suffix_first=50, seed=1)).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 3000) < 120 and abs(forms["spm"] - 500) < 90 and abs(forms["psm"] - 500) < 90
