"""Spans, sentences, covers and claim maps against plain Python and literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from scholia.functions import claims as C
from scholia.functions import spans as P

SOURCE = "Trẻ em  học\nbằng “thử và sai”. It's a rule (p. 5) that holds; a.b*c [x] costs $5. \U0001f600 End\tof it"


@pytest.mark.parametrize(
    ("span", "verbatim", "how"),
    [
        ("thử và sai", "thử và sai", "exact"),
        ("  Trẻ em học bằng ", "Trẻ em  học\nbằng", "spaced"),
        ("that holds", "that holds", "spaced"),
        ('"thử và sai"', "“thử và sai”", "quotes"),
        ("It’s a rule", "It's a rule", "quotes"),
        ("«costs $5.»", "costs $5.", "unwrapped_exact"),
        ("[a rule (p. 5)]", "a rule (p. 5)", "unwrapped_exact"),
        ('"( End of  it )"', "End\tof it", "unwrapped_spaced"),
        ("'[It’s a]'", "It's a", "unwrapped_quotes"),
        ("a.b*c [x]", "a.b*c [x]", "exact"),
        ("«“thử và sai”»", "“thử và sai”", "unwrapped_exact"),
        ("\"[x] costs\"", "[x] costs", "unwrapped_exact"),
        ("'«thử và sai»'", "thử và sai", "unwrapped_exact"),
        ("a.b*d", None, None),
        ("It's no rule", None, None),
        ("holds that", None, None),
        ("", None, None),
        (' "" ', None, None),
        (None, None, None),
    ],
)
def test_ways(spark, span, verbatim, how):
    df = spark.createDataFrame([(SOURCE, span)], "source string, span string")
    got = df.select(P.resolve(F.col("source"), F.col("span")).alias("r")).first()["r"]
    if verbatim is None:
        assert got is None
    else:
        assert (got["verbatim"], got["how"]) == (verbatim, how) and SOURCE[got["begin"] : got["end"]] == verbatim


def test_any_part_of_a_text_is_found(spark):
    r = random.Random(5)
    rows = []
    for n in range(300):
        words = [r.choice(["a", "b.", "“c”", "d's", "e,", "\\f", "g$1", "é", "\U0001f600"]) for _ in range(30)]
        text = "".join(w + r.choice([" ", "  ", "\n", "\t", " "]) for w in words)
        i = r.randrange(25)
        part = words[i : i + r.randrange(1, 6)]
        joined = " ".join(part).translate(str.maketrans("“”’", "\"\"'"))
        rows.append((n, text, r.choice([joined, f"[{joined}]", f"«{joined}»", " " + joined + "\n"])))
    df = spark.createDataFrame(rows, "n int, source string, span string")
    plain = lambda t: t.translate(str.maketrans("“”‘’", "\"\"''")).split()
    for row, source in zip(df.select("span", P.resolve(F.col("source"), F.col("span")).alias("r")).collect(), [x[1] for x in rows], strict=True):
        assert row["r"] is not None, row
        found = source[row["r"]["begin"] : row["r"]["end"]]
        assert found == row["r"]["verbatim"]
        assert plain(found) in (plain(row["span"]), plain(row["span"].strip().strip("«»\"'")), plain(row["span"].strip()[1:-1]))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One. Two!  Three?", ["One.", "Two!", "Three?"]),
        ("Dr. Who met Prof. X. \"Yes!\" he said... Then 3.5 m, e.g. this.", ["Dr. Who met Prof. X.", "\"Yes!\"", "he said...", "Then 3.5 m, e.g. this."]),
        ("A heading\n\nA line\nand more?! (so.) \n\n\n tail ", ["A heading", "A line\nand more?!", "(so.)", "tail"]),
        ("dr. x. final. y", ["dr. x.", "final.", "y"]),
        (" \n\n ", []),
        ("", []),
        (None, []),
    ],
)
def test_sentences(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(P.sentences(F.col("t"), "A1").alias("s")).first()["s"]
    assert [s["text"] for s in got] == want and [s["id"] for s in got] == [f"A1.{i + 1}" for i in range(len(want))]
    assert all(text[s["begin"] : s["end"]].strip() == s["text"] for s in got)


def test_cover(spark):
    r = random.Random(2)
    rows = [(r.randrange(40), [(a, a + r.randrange(-2, 9)) for a in (r.randrange(-3, 42) for _ in range(r.randrange(6)))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "n int, x array<struct<begin: int, end: int>>")
    for (n, xs), row in zip(rows, df.select(P.cover(F.col("x"), F.col("n")).alias("c")).collect(), strict=True):
        marked = {p for a, b in xs for p in range(max(a, 0), min(b, n))}
        gaps = {p for g in row["c"]["gaps"] for p in range(g["begin"], g["end"])}
        assert row["c"]["covered"] == len(marked) and gaps == set(range(n)) - marked
        assert all(g["begin"] == 0 or g["begin"] - 1 in marked for g in row["c"]["gaps"])


GOOD = {"claim_id": "C1", "claim_text": "x", "answer_sentence_id": "A1.1", "answer_offsets": [0, 9], "source_sentence_ids": ["S1.1"], "evidence_spans": ["gốc  rễ"], "relation": "entailment", "modality": "asserted", "claim_type": "fact", "is_supported": True}
REST = {**GOOD, "claim_id": "C2", "answer_sentence_id": "A1.2", "answer_offsets": [10, 18]}
ANSWER, TEXT = "Cây có rễ. Đất ẩm.", "Cây có gốc rễ. Nó uống."


@pytest.mark.parametrize(
    ("change", "kinds"),
    [
        ({}, []),
        ({"claim_id": "C2"}, ["duplicate_claim_id: C2"]),
        ({"claim_text": "  "}, ["empty_claim_text: C1"]),
        ({"answer_sentence_id": "A1.9"}, ["unrecognized_answer_sentence_id: A1.9 in C1", "incomplete_answer_coverage: uncovered A1.1"]),
        ({"answer_sentence_id": None}, ["unrecognized_answer_sentence_id: None in C1", "incomplete_answer_coverage: uncovered A1.1"]),
        ({"answer_offsets": [3]}, ["invalid_answer_offsets_shape: C1"]),
        ({"answer_offsets": [4, 99]}, ["answer_offsets_out_of_bounds: C1 [4:99]"]),
        ({"answer_offsets": [4, 4]}, ["answer_offsets_out_of_bounds: C1 [4:4]"]),
        ({"source_sentence_ids": ["S1.2", "S1.3"]}, ["unrecognized_source_sentence_id: S1.3 in C1"]),
        ({"evidence_spans": ["Nó uống.", "", "nó không có trong nguồn này và dài hơn bốn mươi chữ"]}, ["unmatched_evidence_span: C1 -> nó không có trong nguồn này và dài hơn b"]),
        ({"relation": "Contradiction"}, ["negative_or_unsupported_relation: C1 (contradiction)"]),
        ({"modality": "uncertain"}, ["uncertain_modality_asserted_as_fact: C1"]),
        ({"modality": "uncertain", "claim_type": "guess"}, []),
        ({"is_supported": False}, ["claim_marked_not_supported: C1"]),
    ],
)
def test_each_fault_has_its_kind(spark, change, kinds):
    order = ["claim_id", "claim_text", "answer_sentence_id", "answer_offsets", "source_sentence_ids", "evidence_spans", "relation", "modality", "claim_type", "is_supported"]
    first = {**GOOD, **change}
    claims = [tuple(c[k] for k in order) for c in (first, REST)]
    if first["claim_id"] == "C2":
        kinds = ["duplicate_claim_id: C2"]
    df = spark.createDataFrame([(TEXT, ANSWER, claims)], f"source string, answer string, claims {C.CLAIMS}")
    got = df.select(C.claim_map(F.col("source"), F.col("answer"), F.col("claims"), language=False).alias("m")).first()["m"]
    assert got["violations"] == kinds and got["valid"] == (not kinds)
    assert got["sentences"] == 2 and got["coverage"] == (0.5 if any("incomplete" in k for k in kinds) else 1.0)


def test_empty_maps_and_languages(spark):
    df = spark.createDataFrame([(TEXT, ANSWER, []), (None, None, None)], f"source string, answer string, claims {C.CLAIMS}")
    for r in df.select(C.claim_map(F.col("source"), F.col("answer"), F.col("claims")).alias("m")).collect():
        assert r["m"]["violations"] == ["empty_or_invalid_claim_map"] and not r["m"]["valid"]
    texts = [("Đây là một câu tiếng Việt rất bình thường.", None), ("This is one sentence in English and no other.", "insufficient_vietnamese_diacritics"), ("", "empty_text"), (None, "empty_text"), ("ăâđ " + "the cat of the dog in the box and on the mat is this", "excessive_untranslated_english"), ("short", None)]
    got = spark.createDataFrame(texts, "t string, want string").select("want", C.vietnamese_fault(F.col("t")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
