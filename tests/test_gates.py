"""What may be trained on, broken links one at a time, exercises in SQL and DataFrames alike, enumerated curricula."""

import pytest
from pyspark.sql import functions as F

from scholia.operators import curricula as C
from scholia.operators import exercises as E
from scholia.operators import gates as G
from scholia.operators import provenance as V

GOOD = {"is_verified": True, "handwriting_suspected": False, "verified_by": "a", "verified_at": "t", "review_schema": "ocr-region-review-v2", "regions": [("verified", " one "), ("rejected", "no"), ("corrected", "two")], "text": "one\ntwo"}


@pytest.mark.parametrize(
    ("change", "fault"),
    [
        ({}, None),
        ({"is_verified": False}, "unverified"),
        ({"is_verified": None, "handwriting_suspected": True}, "unverified_handwriting"),
        ({"verified_by": ""}, "no_reviewer"),
        ({"verified_at": None}, "no_reviewer"),
        ({"regions": None}, "invalid_regions"),
        ({"regions": [("verified", None)]}, "invalid_regions"),
        ({"regions": [("pending", "one")]}, "regions_differ"),
        ({"text": "one two"}, "regions_differ"),
        ({"text": None}, "regions_differ"),
        ({"review_schema": None, "regions": None, "text": "any"}, None),
    ],
)
def test_transcripts(spark, change, fault):
    row = {**GOOD, **change}
    df = spark.createDataFrame([(tuple(row.values()),)], f"r struct<{', '.join(f'{k}: {t}' for k, t in zip(row, ['boolean', 'boolean', 'string', 'string', 'string', 'array<struct<status: string, text: string>>', 'string'], strict=True))}>")
    assert df.select(G.transcript_fault(F.col("r"))).first()[0] == fault


def test_forbidden_names(spark):
    names = ["books/hidden.pdf", "Đề thi"]
    rows = [("a/hidden.pdf", True), ("x/books/hidden.pdf.bak", True), ("a/De thi.pdf", False), ("a/Đề thi.pdf", True), ("a/Đề thi.pdf", True), ("hiddenpdf", False)]
    got = spark.createDataFrame(rows, "f string, want boolean").select("want", G.forbidden(F.col("f"), names).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_each_broken_link_shows_alone(spark):
    base = spark.createDataFrame([(1, 7, "the text", "q", "p", "t", '{"supported": true}')], "sample_id int, source_id int, source_text string, question string, prompt string, target string, verdict string")
    live = spark.createDataFrame([(7, "the text", "text_verified")], "source_id int, text string, state string")
    faults = lambda s, x=live: V.proof(s, x).first()["faults"]
    sealed = V.sealed(base).cache()
    assert faults(sealed) == []
    for column in ("question", "prompt", "target"):
        assert faults(sealed.withColumn(column, F.lit("other"))) == [f"{column}_changed"]
    assert faults(sealed.withColumn("verdict", F.lit('{"supported": true }'))) == ["verdict_changed"]
    for link, column in V.LINKS:  # a recorded digest that is changed breaks its own link and the one behind it
        got = faults(sealed.withColumn(link, F.sha2(F.lit("x"), 256)))
        assert got[0] == f"{column}_changed" and len(got) == 2 - (column == "verdict")
    assert faults(sealed, live.withColumn("text", F.lit("new"))) == ["source_changed"]
    assert faults(sealed, live.where("false")) == ["source_missing"]
    assert faults(sealed, live.withColumn("state", F.lit(None).cast("string"))) == ["source_not_verified"]
    assert faults(sealed.unionByName(sealed)) == ["key_repeated"]
    assert faults(V.sealed(base.withColumn("verdict", F.lit("no json")))) == ["verdict_negative"]


def test_sql_and_dataframes_agree(spark):
    E.register(spark)
    texts = ["Bài tập 3\nfind x\n  Ví dụ 1.2: y\nz", "no such thing", "In practice it works", "- Examples\nfoo", "Examplesque words", "CÂU HỎI ôn tập\na\n\nCâu 4.1 b", None, "", "x\n\n\n * Problem 7"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    df.createOrReplaceTempView("pages_of_exercises")
    sql = {r[0]: r[1] for r in spark.sql("SELECT k, is_exercise_candidate(t) FROM pages_of_exercises").collect()}
    assert sql == {r[0]: r[1] for r in df.select("k", E.is_candidate(F.col("t"))).collect()}
    assert [k for k, v in sorted(sql.items()) if v] == [0, 2, 3, 4, 5, 8]
    parts = sorted(tuple(r) for r in E.parts(df, "k", "t").collect())
    assert parts == sorted(tuple(r) for r in spark.sql("SELECT e.k, p.n, p.heading, p.body FROM pages_of_exercises e, LATERAL exercise_parts(e.t) p").collect())
    assert parts == [(0, 0, "Bài tập 3", "find x"), (0, 1, "Ví dụ 1.2: y", "z"), (3, 0, "- Examples", "foo"), (5, 0, "CÂU HỎI ôn tập", "a"), (5, 1, "Câu 4.1 b", ""), (8, 0, "* Problem 7", "")]


def test_examples_go_once(spark):
    rows = [("f", 2, 0, "Ví dụ 1\nSame  text", False, "indexed"), ("f", 1, 5, "VÍ DỤ 1 same text\n", False, "indexed"), ("f", 1, 0, "practice only", False, "indexed"), ("f", 3, 0, "Problem: a ≤ b same", False, "ocr_partial_reviewed"), ("g", 1, 0, "Problem same", False, "indexed"), ("f", 9, 0, "Problem same", False, "indexed")]
    df = spark.createDataFrame(rows, "filename string, page int, chunk_index int, text string, is_scanned boolean, status string")
    got = [(r["page"], r["chunk_index"], r["needs_source_check"]) for r in E.examples(df, F.col("filename") == "f", (1, 5), "SAME").collect()]
    assert got == [(1, 5, False), (3, 0, True)]
    assert E.examples(df, F.col("filename") == "f", (1, 5), limit=1).count() == 1


def test_enumeration(spark):
    templates = [C.Template("one", [[1, 2], ["a", "b", "c"]], lambda n, s: F.concat(n.cast("string"), s), lambda n, s: n), C.Template("two", [[5, 6]], lambda n: n.cast("string"), lambda n: n * 2)]
    rows = spark.range(17).withColumnRenamed("id", "i")
    got = [(r["template"], r["text"], r["answer"]) for r in C.enumerated(rows, "i", templates).orderBy("i").collect()]
    cycle = [("one", f"{n}{s}", str(n)) for n in (1, 2) for s in "abc"] + [("two", "5", "10"), ("two", "6", "12")]
    assert C.total(templates) == 8 and got == [cycle[i % 8] for i in range(17)]
    other = C.enumerated(rows.repartition(5), "i", templates).orderBy("i").collect()
    assert [(r["template"], r["text"], r["answer"]) for r in other] == got


def gated(spark, copies):
    """A gate over as many files of one text, each read once, every other of them a scan."""
    text, h = "one text that is long enough to be native", "a" * 64
    n = spark.range(copies).select(F.col("id").alias("chunk_id"), F.concat(F.lit("f"), "id").alias("filename"), F.lit(1).alias("page"))
    chunks = n.select("*", F.lit("long  enough").alias("text"), F.lit(h).alias("file_hash"))
    files = n.select("filename", F.lit(h).alias("current_hash"), (F.col("chunk_id") % 2 == 0).alias("is_scanned"))
    good = F.struct(F.lit(True).alias("is_verified"), F.lit(False).alias("handwriting_suspected"), F.lit("a").alias("verified_by"), F.lit("t").alias("verified_at"), F.lit(None).cast("string").alias("review_schema"), F.lit(None).cast("array<struct<status: string, text: string>>").alias("regions"), F.lit(text).alias("text"))
    reviews = n.select(F.lit(h).alias("source_hash"), "page", good.alias("r")).select("source_hash", "page", "r.*")
    return G.gate(chunks, files, n.select("filename", "page", F.lit(text).alias("native_text")), reviews, n.select("filename", "page").limit(0), [])


def test_copies_do_not_meet_each_others_transcripts(spark):
    got = gated(spark, 300)
    assert {(r["chunk_id"] % 2, r["allowed"], r["reason"]) for r in got.collect()} == {(0, True, "verified_transcript"), (1, True, "native")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = gated(spark, 300)
        plan.collect()
        nodes, made = [plan._jdf.queryExecution().executedPlan()], []
        while nodes:
            node = nodes.pop()
            if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
                made.append(node.metrics().apply("numOutputRows").value())
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        assert made and max(made) <= 300  # 90,000 where each chunk meets the transcript of each copy
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_settled_page_is_not_cleaned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(G, "cleaned", lambda c: seen.append(str(c)) or F.coalesce(c, F.lit("")))
    gated(spark, 4).collect()
    assert len(seen) == 1 and "_raw" in seen[0]
