"""Auditors' verdicts: strict parsing, evidence ids, quotes and coverage, one literal case a row."""

import json

import pytest
from pyspark.sql import functions as F

from scholia.functions import audits as A
from scholia.plans import claims

SOURCES = {"S1": "Cây có rễ. Rễ hút nước! Lá xanh; thân cao.\nGiá trị là 3.5 m. a < b & c", "S2": "Đất ẩm."}


def one(statement="Cây có rễ", source="S1", **more):
    return {"statement": statement, "source_id": source, "evidence_id": "E1", "verdict": "supported", **more}


def doc(*claims, overall="supported"):
    return json.dumps({"claims": list(claims), "overall_verdict": overall}, ensure_ascii=False)


GOOD = doc(one())
CASES = [
    (GOOD, "verified", ["supported"]),
    ("```json\n" + GOOD + "\n```", "verified", ["supported"]),
    ("```\n" + GOOD + "```", "verified", ["supported"]),
    ("```json\n" + GOOD, "unverified", []),
    ("Here it is: " + GOOD, "unverified", []),
    (GOOD + " done", "unverified", []),
    (GOOD + GOOD, "unverified", []),
    ("[" + GOOD + "]", "unverified", []),
    (GOOD[:-2], "unverified", []),
    (GOOD.replace('"verdict": "supported"', '"verdict": "unsupported", "verdict": "supported"'), "unverified", []),
    (GOOD[:-1] + ',"x":{}}', "verified", ["supported"]),
    (GOOD + ',"y":0}', "unverified", []),
    ('{"claims": [], "overall_verdict": "supported"}', "unverified", []),
    ('{"claims": {}, "overall_verdict": "supported"}', "unverified", []),
    ('{"claims": [7], "overall_verdict": "supported"}', "unverified", []),
    (doc(one(), overall="maybe"), "unverified", []),
    (doc(one(), overall=None), "unverified", []),
    (doc(one(), overall=" Supported "), "verified", ["supported"]),
    (doc(one(), overall="uncertain"), "partially_verified", ["supported"]),
    (doc(one(), overall="unsupported"), "unverified", ["supported"]),
    (doc(one(verdict="UNCERTAIN")), "partially_verified", ["uncertain"]),
    (doc(one(verdict="unsupported")), "unverified", ["unsupported"]),
    (doc(one(verdict=True)), "unverified", []),
    (doc(one(statement="  ")), "unverified", []),
    (doc(one(statement=5)), "unverified", []),
    (doc(one(source="S9", evidence_quote="Cây")), "unverified", ["unsupported"]),
    (doc(one(evidence_id="E77")), "partially_verified", ["uncertain"]),
    (doc(one(evidence_id="E77", evidence_quote="Lá xanh")), "verified", ["supported"]),
    (doc(one(evidence_id="", evidence_quote="Lá  xanh")), "partially_verified", ["uncertain"]),
    (doc(one(evidence_id=None, evidence_quote="a &lt; b &amp; c")), "verified", ["supported"]),
    (doc(one(evidence_id=None)), "unverified", []),
    (doc(one(), one(source="S2", evidence_id="e-1")), "verified", ["supported", "supported"]),
    (doc(one(), one(source="S2", evidence_id="E2")), "partially_verified", ["supported", "uncertain"]),
    ("", "unverified", []),
    (None, "unverified", []),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0], SOURCES) for i, c in enumerate(CASES)], "i int, raw string, sources map<string, string>")
    rows = df.select("i", A.audited(F.col("raw"), F.col("sources")).alias("a")).orderBy("i").collect()
    for r, (raw, status, verdicts) in zip(rows, CASES, strict=True):
        assert (r["a"]["status"], [c["verdict"] for c in r["a"]["claims"]]) == (status, verdicts), raw


@pytest.mark.parametrize(
    ("draft", "status"),
    [
        ("Cây có rễ [S1].", "verified"),
        ("<think>không</think>- **Cây có rễ**. Rễ hút nước [S1; S2]!\nNguồn: sách", "verified"),
        ("Cây có rễ và Rễ hút nước.", "verified"),
        ("Cây có rễ. Nó cao.", "unverified"),
        ("cây có rễ.", "unverified"),
        ("---", "verified"),
        ("...", "unverified"),
        ("", "verified"),
        (None, "verified"),
    ],
)
def test_drafts(spark, draft, status):
    raw = doc(one(), one("Rễ hút nước", evidence_id="E2"), one("---", evidence_id="E3"))
    df = spark.createDataFrame([(raw, draft, SOURCES)], "raw string, draft string, sources map<string, string>")
    assert df.select(A.audited(F.col("raw"), F.col("sources"), F.col("draft")).alias("a")).first()["a"]["status"] == status


def test_catalogue_and_ids(spark):
    df = spark.createDataFrame([(SOURCES["S1"], i) for i in ("E1", "e-05", "E 6.", "E0", "E9", "5", None)] + [("ab", "E1"), (" ", "E1"), (None, "E1")], "t string, i string")
    got = df.select(A.evidence_quote(A.catalog(F.col("t")), F.col("i")).alias("q")).collect()
    assert [r["q"] for r in got] == ["Cây có rễ.", "Giá trị là 3.5 m.", "a < b & c", None, None, None, None, "ab", None, None]


def test_catalog_of_long_texts(spark, monkeypatch):
    """However little of a text is cut first, the spans are those of the whole."""
    texts = [
        "One. Two is 3. 4 five! Six?  Seven; eight.\r\nNine.\r\n\r\n   Ten is 10.\n ab \nc. d. e. Eleven.   \n\nTwelve!! Thirteen; f; g; fourteen.",
        "word " * 40 + "end. " + "Last one here",
        "a. b. c. d. e. f. g. h. i. j. k. l. m. n. o. p. q. r. s. t. u. v. w. only here",
        " \n \r\n" * 20,
        "x" * 60,
        "Câu một. " * 30,
        "",
        None,
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    cols = [A.catalog(F.col("text"), limit) for limit in (1, 2, 5, 30)]  # no text is longer than HEAD
    want = docs.select("id", *cols).orderBy("id").collect()
    assert [len(x) for x in want[0][1:]] == [1, 2, 5, 12] and want[2][1] == ["only here"] and want[4][1] == ["x" * 60]
    for head in (1, 2, 3, 7, 12, 20, 33, 46, 47, 64, 100):
        monkeypatch.setattr(A, "HEAD", head)
        assert docs.select("id", *[A.catalog(F.col("text"), limit) for limit in (1, 2, 5, 30)]).orderBy("id").collect() == want


def test_query_makes_a_catalog_once(spark):
    """No filter, and no claim, makes the catalog of a document again."""
    plan = claims.answer_audit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sorted({line.split("Generate")[0].strip() for line in plan.split("\n") if "x0B" in line}) == ["+-"] and plan.count("x0B") == 2
