import random
import re

import pytest

from scholia.llm import line_dedup as L

from .conftest import rows


def expected(docs, least):
    """Every run of every document against every earlier one, by brute force; docs as (id, text) in order."""
    held, first = [], {}
    for d, text in docs:
        lines = (text or "").split("\n")
        held.append([(n, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for n, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)] if text is not None else [])
    reach = 1 + least  # a stretch of ``least`` words has at most so many lines
    for k, h in enumerate(held):
        for a in range(len(h)):
            for b in range(a + 1, min(len(h), a + reach) + 1):
                first.setdefault(tuple(x[1] for x in h[a:b]), (k, a))
    out = []
    for k, h in enumerate(held):
        gone = set()
        for a in range(len(h)):
            for b in range(a + 1, min(len(h), a + reach) + 1):
                if first[tuple(x[1] for x in h[a:b])] == (k, a):
                    break
                if sum(x[2] for x in h[a:b]) >= least:
                    gone |= {x[0] for x in h[a:b]}
        text = docs[k][1]
        out.append((docs[k][0], None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone), len(gone)))
    return out


@pytest.mark.parametrize("least", [1, 4, 10])
def test_brute_force(spark, least):
    r = random.Random(least)
    pool = ["a", "b c", "d e f", "", "g h i j k", "l", "m n"]
    docs = [(i, "\n".join(r.choice(pool if i % 3 else [*pool, f"only {i} {r.random()}"]) for _ in range(r.randrange(12)))) for i in range(40)]
    docs.append((40, "x\n" * 30))  # a run that overlaps itself
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((x["doc_id"], x["text"], x["n_removed"]) for x in L.dedup_lines(df, least).collect())
    assert got == expected(docs, least)


def test_odd_rows(odd, none):
    got = L.dedup_lines(odd).select("doc_id", "text", "n_removed", "d", "t").collect()
    assert len(got) == len(rows()) and {r["d"] for r in got} == {"other"}
    by = {r["doc_id"]: r for r in got}
    assert by[2]["text"] is None and by[3]["text"] == "" and by[7]["text"] == rows()[8][1]
    assert by[1]["n_removed"] == 0 and by[4]["n_removed"] == 1 and by[4]["text"] == ""
    assert len({(r["text"], r["n_removed"]) for r in got if r["doc_id"] == 4}) == 1
    assert by[6]["n_removed"] == 2300 and by[5]["n_removed"] == 0
    assert L.dedup_lines(none).count() == 0


def test_ids_of_any_type(spark):
    """Text ids in the order of the numbers give the same lines; with null ids, and decimals."""
    from scholia.llm import line_dedup

    run = "one two three four five six\nseven eight nine ten eleven"
    data = [(1, f"a start\n{run}\nan end"), (2, f"{run}\nmore of it"), (None, run), (3, "alone"), (10, f"x\n{run}"), (None, None)]
    numbers = spark.createDataFrame(data, "doc_id long, text string")
    want = sorted((r["doc_id"] or 99, r["text"] or "", r["n_removed"]) for r in line_dedup.dedup_lines(numbers).collect())
    assert [w[2] for w in want] == [0, 2, 0, 2, 0, 2]
    for cast in ("lpad(cast(doc_id AS string), 3, '0')", "cast(doc_id AS decimal(10, 2))", "cast(doc_id AS short)"):
        other = numbers.selectExpr(f"{cast} AS doc_id", "text") if "decimal" not in cast else numbers.where("doc_id < 10 OR doc_id IS NULL").selectExpr(f"{cast} AS doc_id", "text")
        got = sorted((int(r["doc_id"]) if r["doc_id"] is not None else 99, r["text"] or "", r["n_removed"]) for r in line_dedup.dedup_lines(other).collect())
        assert got == [w for w in want if "decimal" not in cast or w[0] != 10]
