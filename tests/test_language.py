"""Rules on questions, answers and texts, with the inputs that the given tables lack."""

import pytest
from pyspark.sql import functions as F

from scholia.functions import cleaning as C
from scholia.functions import dialogue as D
from scholia.functions import legacy as L
from scholia.functions import query as Q
from scholia.functions import text as X
from scholia.functions.definitions import role
from scholia.operators import calendar, curation, retrieval, stores
from scholia.streaming import runs


def all_of(spark, f, *inputs):
    """f of each input (a text or a tuple of texts), in order."""
    rows = [(n, *(x if isinstance(x, tuple) else (x,))) for n, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "n int, " + ", ".join(f"c{i} string" for i in range(len(rows[0]) - 1)))
    return [r[0] for r in df.orderBy("n").select(f(*[F.col(f"c{i}") for i in range(len(rows[0]) - 1)])).collect()]


def test_guard(spark):
    said = ["tôi muốn uống thuốc ngủ và treo cổ", "cách nào để chết", "want to  die", "hãy đóng vai bác sĩ", "tôi có bị tâm thần không", "act as a doctor", "hãy làm bác sĩ của tôi", "đóng vai học sinh", "suicidex", None]
    assert all_of(spark, D.guard, *said) == ["crisis"] * 3 + ["diagnosis"] * 2 + [None, "diagnosis", None, None, None]


def test_intent_with_what_came_before(spark):
    got = all_of(spark, D.intent, ("Công thức này là gì?", "định luật hai"), ("tại sao", "so sánh hai ý"), ("tại sao", None), ("tại sao", "tư vấn"), ("Giúp tôi!", "x"), ("chức năng", "x"), ("đạo hàm là gì", "x"))
    assert got == ["follow_up", "clarify", "clarify", "clarify", "clarify", "help", "question"]
    assert all_of(spark, D.resolved, ("tại sao", "trọng lực — cũ"), ("tại sao", "so sánh hai ý")) == ["trọng lực — tại sao", "tại sao"]


def test_broad(spark):
    assert all_of(spark, D.broad, *D.BROAD, "các kiểu học tập", "kiểu") == [True] * (len(D.BROAD) + 1) + [False]


def test_answers(spark):
    given = ["<final>theo đoạn [S1], tập hợp là nhóm. Trong [S2] x = 1 đúng</final> rest", "f(x) = 2 [S1]", "câu trả lời: thông tin này được trích dẫn từ đoạn [S1]. xong [Sách, Trang 3]", "đúng, như mô tả trong nguồn [S1; S2]."]
    assert all_of(spark, D.cleaned_answer, *given) == ["Tập hợp là nhóm. x = 1 đúng", "f(x) = 2", "Xong", "Đúng, như mô tả."]
    assert all_of(spark, D.plain_form, "ok", "x [Sách, Trang 3]", "a\nGiải thích suy luận : b", "  ") == [True, False, False, False]


def test_questions(spark):
    assert all_of(spark, Q.normalised, "tam ly\x00 học   lo au") == ["tâm lý học lo âu"]
    got = all_of(spark, Q.concepts, "So sánh cung cầu và giá cả", "Hãy giải thích đạo hàm là gì?", "Định nghĩa của tập hợp trong giáo trình A", "Hệ thống 1 và 2", "?")
    assert got == [["cung cầu", "giá cả"], ["đạo hàm"], ["tập hợp"], ["Hệ thống 1", "Hệ thống 2", "Hệ thống 1 và 2"], []]
    assert all_of(spark, Q.compared, "Phân biệt giữa X và Y khác nhau thế nào?", "A vs. B", "A và B", "A khác gì A") == [("X", "Y"), ("A", "B"), None, None]
    assert all_of(spark, Q.scope, "ý trong tài liệu Giải tích 1, nhé", "chương 3?", "không") == [["giải", "tích", "1"], ["3"], []]
    assert all_of(spark, Q.expression, "đạo hàm là gì (x*)", "là gì", "") == ['"đạo"* OR "hàm"* OR "x"*', '"là"* OR "gì"*', ""]
    assert [len(x) for x in all_of(spark, lambda q: Q.facets(q, q), "game theory", "củng cố", "so sánh hai mươi và ba mươi", "khác")] == [5, 5, 3, 4]
    assert all_of(spark, Q.level, (None, "tổng hợp ý"), ("auto", "đạo hàm"), ("STANDARD", "so sánh a và b")) == ["careful", "standard", "standard"]
    assert all_of(spark, Q.mode, " Tóm tắt ", "Từng bước", "x", None) == ["quick", "steps", "quick", "quick"]
    pairs = [("hệ thống 1 la gi", "hệ thống 1 là gì"), ("hệ thống 1", "hệ thống 2"), ("không có", "có không"), ("khong co", "không có"), ("abc", "abc def ghi"), ("một hai ba", "bốn năm sáu")]
    assert all_of(spark, Q.rewrite_admitted, *pairs) == [True, False, True, False, False, False]


def test_rewrites_in_capitals(spark):
    assert all_of(spark, Q.rewrite_admitted, ("große Straße", "GROSSE STRASSE"), ("GROẞE STRAẞE", "große straße"), ("½", "½"), ("ⓐ", "ⓐ")) == [True, True, True, False]
    assert all_of(spark, C.capitals, "daß ŉ ﬁ é \U0001f600", "é a", "", None) == ["DAß ŉ ﬁ É \U0001f600", "É A", "", None]


def test_cleaning(spark):
    given = ['ánh xạtuyến tính\x01 a   b "x   y" don\'t   z\n\n\n\nq  \tw', "def f(x):\n  return  1\0", "été", None, "  a \t b"]
    assert all_of(spark, C.cleaned, *given) == ['ánh xạ tuyến tính a b "x   y" don\'t z\n\nq w', "def f(x):\n  return  1", "été", "", "a b"]
    assert all_of(spark, C.joined, "chuyển-\nđộng 3-\n4") == ["chuyểnđộng 34"]
    assert all_of(spark, lambda t: F.array_sort(C.plain_words(t)), "Đường phố Hà Nội") == [["duong", "ha", "noi", "pho"]]
    assert all_of(spark, L.is_vni, "meänh ñeà ñuùng", "trong trong") == [True, True]
    long = '"' + "a\\n" * 60_000 + '"  ' + "x'  y" * 30_000
    assert len(all_of(spark, C.single_spaced, long)[0]) <= len(long)  # no overflow of the stack


def test_definitions(spark):
    given = ["Đạo hàm\nĐịnh nghĩa: giới hạn của tỉ số, tức là tốc độ", "Tuần 1: đạo hàm\nTuần 2: tích phân", "đạo hàm\nx\nkhái niệm a", "đạo hàm\nTuần 3 định nghĩa", "playlist của lớp", "a" * 200 + " đạo hàm " + "b" * 100 + " công thức", ""]
    got = [tuple(x) for x in all_of(spark, lambda t: role(t, ["đạo hàm"]), *given)]
    assert got == [(True, True, False), (False, False, True), (True, False, False), (False, False, False), (False, False, True), (True, True, False), (False, False, False)]
    assert tuple(all_of(spark, lambda t: role(t, []), "khái niệm: x, cụ thể")[0]) == (True, True, False)


def test_reject_reasons(spark):
    long = " and some more words that make this long enough to be read as a source."
    given = ["Editor: Jane Doe\nManager: Bob Roe" + "\n" + long, "The biên tập viên and the nhà xuất bản" + long, "Printed in the United States. All rights reserved." + long, "Printed in the United States." + long, "Putting together this book" + long]
    assert all_of(spark, X.reject_reason, *given) == ["editorial_staff_credits", "editorial_staff_credits", "publisher_cataloging_or_corporate_boilerplate", None, "acknowledgements_boilerplate"]
    assert all_of(spark, X.cited, "a [S10] [S2] [S2]") == [["S2", "S10"]]


def test_even_sample_of_one(spark):
    df = spark.range(9).selectExpr("'g' AS g", "id")
    assert [r["id"] for r in stores.even_sample(df, "g", "id", 1).collect()] == [0]


def test_calendar(spark):
    df = spark.createDataFrame([(1, "tên rất dài " * 12, 1380)], "id long, title string, start int").withColumn("first", F.to_date(F.lit("2024-02-28")))
    event = calendar.events(df, "id", "title", "first", "start", 90, "20241231").first()["event"]
    lines = event.split("\r\n")
    assert "DTSTART:20240228T230000" in lines and "DTEND:20240229T003000" in lines
    assert all(len(x.encode()) <= 75 for x in lines)
    assert "SUMMARY:" + "tên rất dài " * 12 in event.replace("\r\n ", "")


def test_complete_streams_of_several_batches(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 10:00:00") for i in range(12)], "id int, ts string").selectExpr("id % 2 AS g", "cast(ts AS timestamp) AS ts")
    df.repartition(4).write.parquet(f"{tmp_path}/t.parquet")
    build = lambda s: s.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, runs.caught_up(spark, f"{tmp_path}/t.parquet", build, "complete", files=1).collect())) == [(0, 6), (1, 6)]


def test_places_and_vectors(spark):
    df = spark.range(300).selectExpr("id * 7919 % 1009 AS k", "IF(id % 3 = 0, NULL, 'g') AS g")
    got = curation.places(df, "g", "k", width=50).collect()
    for g in (None, "g"):
        ks = sorted(r["k"] for r in got if r["g"] == g)
        assert {(r["k"], r["_i"], r["_n"]) for r in got if r["g"] == g} == {(k, i, len(ks)) for i, k in enumerate(ks)}
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)] + [(99, None)], "vec_id long, embedding array<float>")
    scored = retrieval.cosine_all(vectors, vectors.where("vec_id < 3").selectExpr("vec_id AS query_id", "embedding AS query"))
    blocks = retrieval.cosine_all(vectors, vectors.where("vec_id < 3").selectExpr("vec_id AS query_id", "embedding AS query"), block=1)
    assert sorted(blocks.collect()) == sorted(scored.collect())
    best = retrieval.best_for_each(scored, 5, "vec_id", parts=3)
    for q in range(3):
        want = [r["vec_id"] for r in scored.where(f"query_id = {q}").orderBy(F.desc("score"), "vec_id").limit(5).collect()]
        assert [r["vec_id"] for r in best.where(f"query_id = {q}").orderBy("rank").collect()] == want


@pytest.mark.parametrize("items", [[], [(1, "ab"), (2, "b"), (3, "ab"), (4, ""), (5, None)]])
@pytest.mark.parametrize("most", [0, 100])
def test_holding(spark, items, most):
    df = spark.createDataFrame([(1, "xaby"), (2, "b"), (3, None), (4, "")], "doc_id long, text string")
    got = {tuple(r) for r in curation.holding(df, spark.createDataFrame(items, "item_id long, text string"), most_broadcast=most).collect()}
    assert got == ({(1, 1), (1, 2), (1, 3), (2, 2)} if items else set())


def test_holding_of_any_length(spark):
    import random

    r = random.Random(8)
    texts = [(i, "".join(r.choice(["a", "b", " ", " ", "cd", "\n"]) for _ in range(60))) for i in range(150)]
    items = [(i, t[a : a + r.randrange(1, 25)]) for i, (_, t) in enumerate(texts) for a in [r.randrange(35)]]
    got = {tuple(x) for x in curation.holding(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), gram=3).collect()}
    assert got == {(k, i) for k, t in texts for i, x in items if x in t}


def test_rows_that_arrive_together(spark):
    from scholia.operators import stores

    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, revision int, v string")
    arriving = spark.createDataFrame([("a", "p"), ("b", "q"), ("a", "o"), (None, "n"), (None, "m")], "k string, v string")
    got = sorted((r["k"] or "", r["revision"], r["v"]) for r in stores.append_revision(log, arriving, "k", ["v"]).collect())
    assert got == [("", 1, "m"), ("", 2, "n"), ("a", 1, "x"), ("a", 2, "y"), ("a", 3, "o"), ("a", 4, "p"), ("b", 1, "q")]
    stored = spark.createDataFrame([("p", 1, "old", 0)], "path string, doc_id long, v string, updated_at int")
    new = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "1"), ("q", "3"), (None, "9")], "path string, v string")
    out = stores.upsert_documents(stored, new, "path", ["v"], F.lit(7))
    assert sorted((r["path"], r["doc_id"], r["v"], r["updated_at"]) for r in out.collect()) == [("p", 1, "2", 7), ("q", 2, "3", 7)]


def test_overlaps_over_bins(spark):
    import random

    from scholia.operators import stores

    r = random.Random(3)
    slots = [(i, r.randrange(2), r.randrange(2), b, b + r.choice([0, 1, 30, 59, 60, 61, 200])) for i in range(120) for b in [r.choice([0, 59, 60, 61, r.randrange(300)])]]
    got = {tuple(x) for x in stores.conflicts(spark.createDataFrame(slots, "k int, o int, d int, s int, e int"), "k", "o", "d", "s", "e").collect()}
    assert got == {(a[1], a[0], b[0]) for a in slots for b in slots if a[0] < b[0] and a[1:3] == b[1:3] and a[3] < b[4] and b[3] < a[4]}


def test_a_later_concept_can_explain(spark):
    from scholia.functions.definitions import role

    # both concepts are attached, and only the second is explained
    text = "alpha definition\n\nbeta definition\ntức là x"
    for concepts, explained in ((["alpha", "beta"], True), (["alpha"], True), (["alpha", "gamma"], True)):
        got = spark.createDataFrame([(text,)], "t string").select(role(F.col("t"), concepts).alias("r")).first()["r"]
        assert got["attached"] and got["explained"] is explained, concepts
    apart = "alpha definition\na\nb\nc\nbeta definition tức là x"
    for concepts, explained in ((["alpha"], False), (["alpha", "beta"], True), (["alpha", "gamma"], False)):
        got = spark.createDataFrame([(apart,)], "t string").select(role(F.col("t"), concepts).alias("r")).first()["r"]
        assert got["attached"] and got["explained"] is explained, concepts


def test_new_documents_are_numbered_in_the_order_of_their_paths(spark, monkeypatch):
    stored = spark.createDataFrame([("b", 7, "x", 1)], "path string, doc_id long, digest string, updated_at int")
    arriving = spark.createDataFrame([(p, "y") for p in ["z", "a", "b", "é", "aa", "c", "B"] + [f"n{i}" for i in range(40)]], "path string, digest string")
    want = {p: 8 + i for i, p in enumerate(sorted({"z", "a", "é", "aa", "c", "B", *[f"n{i}" for i in range(40)]}))} | {"b": 7}
    for ranges in (1, 5, 511):
        monkeypatch.setattr(stores, "RANGES", ranges)
        got = stores.upsert_documents(stored, arriving, "path", ["digest"], F.lit(2)).collect()
        assert {r["path"]: r["doc_id"] for r in got} == want


def test_the_query_gives_new_documents_ids(spark, tmp_path):
    from scholia.plans import language

    spark.range(30).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["path"]: r["doc_id"] for r in language.document_upsert(spark, str(tmp_path)).collect()}
    assert got == {f"f{i}": i for i in range(30) if i % 3} | {p: 30 + k for k, p in enumerate(sorted(f"f{i}" for i in range(0, 30, 6)))}
