from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.llm import tokens as K

from .conftest import rows

SMALL = [b" a", b" ab", b" abcd", b"b", b"bc", b"cd", b"cde", b"e", b"abcde", b" x", b"xx", b"xxxx"]


def pieces(words, vocabulary):
    """Greedy longest match, building the pieces."""
    longest = max(map(len, vocabulary))
    n = 0
    for w in words:
        w, i = b" " + w, 0
        while i < len(w):
            j = min(len(w), i + longest)
            while j > i + 1 and w[i:j] not in vocabulary:
                j -= 1
            n, i = n + 1, j
    return n


@given(st.lists(st.text("abcdex é\n", max_size=90), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_small_vocabulary(texts):
    data = [t.encode() for t in texts]
    words, got = K.count_texts(K.build(SMALL), data)
    assert words.tolist() == [len(t.split()) for t in data]
    assert got.tolist() == [pieces(t.split(), set(SMALL)) for t in data]


def test_public_vocabulary_and_odd_rows(odd, none):
    vocabulary = set(K.vocabulary())
    got = {(r["doc_id"], r["n_bytes"], r["n_words"], r["n_tokens"]) for r in K.token_counts(odd).collect()}
    want = set()
    for r in rows():
        t = (r[1] or "").encode()
        want.add((r[0], len(t), len(t.split()), pieces(t.split(), vocabulary)))
    assert got == want and K.token_counts(odd).count() == len(rows()) and K.token_counts(none).count() == 0
