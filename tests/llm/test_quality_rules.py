import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.llm import quality_rules as Q

from .conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def normal(line):
    return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line))).strip(" ")


def brute(data, share, least, words=10, left=0.3):
    holds, texts = defaultdict(set), defaultdict(set)
    for _, text, _, source, _ in data:
        host, text = source or "", text or ""
        texts[host].add(text)
        for line in text.split("\n"):
            if WORD.search(line):
                holds[host, normal(line)].add(text)
    out = []
    for doc_id, text, _, source, _ in data:
        host, text = source or "", text or ""
        base = plain_counts(text)
        gone = sum(len(WORD.findall(x)) for x in text.split("\n") if WORD.search(x) and len(holds[host, normal(x)]) > max(least, share * len(texts[host])))
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        stay = base[0] - gone
        out.append((doc_id is not None, doc_id or 0, *base, failed, not failed and stay >= words and stay >= left * base[0], gone))
    return sorted(out)


def ours(df, **more):
    return sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in Q.judge(df, **more).collect())


@given(st.text("ab \n\x0b\t#é中<", max_size=200))
@settings(max_examples=400, deadline=None)
def test_counts(text):
    assert Q.counts(text.encode()) == plain_counts(text)


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_repeated_words(words):
    assert Q.repeated_words(words) == plain_counts(b" ".join(words).decode())[4]


def corpus():
    """Host a: 30 documents of 5 own lines; a notice on 12 of them (with other numbers), on three of which little else stands. Host b: the notice on 5 documents; 40 copies of one text."""
    own = lambda n: "\n".join(f"own {'xyz'[k % 3] * (n + 1)} line {'k' * (k + 1)} with words" for k in range(5))
    notice = "Page {} of this Site is under a license with all rights kept by the owners of the site"
    data = [(n, (own(n) + "\n" if n >= 3 else "two words\n") + (notice.format(n) if n < 12 else "the end"), "en", "a", 1) for n in range(30)]
    data += [(100 + n, own(n) + "\n" + notice.format(7), "en", "b", 1) for n in range(5)]
    return data + [(200 + n, own(77) + "\nwith one more line", "en", "b", 1) for n in range(40)]


def test_lines_of_a_host(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    want = brute(corpus(), 0.1, 6)
    assert ours(df, share=0.1, least=6) == want
    assert ours(df, share=0.1, least=6, most_broadcast=0) == want  # lines and frequent lines joined instead
    kept = {r[1]: r[8] for r in want}
    assert [n for n, k in kept.items() if not k] == [0, 1, 2]
    texts = {r["doc_id"]: r["text"] for r in Q.clean(df, share=0.1, least=6).collect()}
    assert set(texts) == {n for n, k in kept.items() if k}
    assert "license" not in texts[5] and texts[5] == corpus()[5][1].rsplit("\n", 1)[0] and "license" in texts[101] and texts[210] == corpus()[-1][1]


def test_hot_lines_and_copies(spark):
    """A line on all documents and 3,000 copies of one, beyond the size from which joins are salted."""
    line = "the very same line of ten words stands on all"
    data = [(n, f"{line}\n" + " ".join("w" + chr(97 + n % 26) + chr(97 + n // 26 % 26) + chr(97 + n // 676) + "x" * k for k in range(25)), "en", "h", 1) for n in range(1500)] + [(5000 + n, f"{line}\nand " + " ".join(f"c{k}" for k in range(12)), "en", "h", 1) for n in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    want = brute(data, 0.01, 10)
    assert ours(df) == want and ours(df, most_broadcast=0) == want
    assert all(r[8] and r[9] == 10 for r in want)
    assert Q.clean(df).where("text NOT LIKE 'the very same%'").count() == 4500


def test_odd_rows(odd, none, spark):
    assert ours(odd, share=0.0, least=0) == brute(rows(), 0.0, 0)
    assert ours(odd) == brute(rows(), 0.01, 10)
    assert Q.clean(odd).columns == odd.columns and Q.judge(none).count() == 0 and Q.clean(none).count() == 0
    assert Q.judge(spark.createDataFrame([("x", "a b", "en", "s", 1)], "doc_id string, text string, lang string, source string, n_chars long")).first()["doc_id"] == "x"
