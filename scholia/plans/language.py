"""Queries on cleaning, question analysis, fusion's second half, evidence, document stores and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions import cleaning as C
from scholia.functions import query as Q
from scholia.operators import audit, stores
from scholia.operators import retrieval as R
from scholia.plans.corpus import ORACLES as CORPUS
from scholia.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn with its first three words of letters."""
    w = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text", w.alias("w"))
    return rows.select("conv_id", "turn", "text", *[F.coalesce(F.get("w", i), F.lit("x")).alias(f"w{i}") for i in range(3)])


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Every document, made worse by control characters, blank lines and quoted spaces."""
    worse = F.concat(F.lit("a\x01b  c \"d  e\"   f\n\n\n\nánh xạtuyến tính "), "text")
    return _docs(spark, d).select("doc_id", F.md5(C.tidied(worse).cast("binary")).alias("clean_md5"))


def prose_joined(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(C.joined(F.replace("text", F.lit(" th"), F.lit("-\nth"))).cast("binary")).alias("joined_md5"))


def query_normalise(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit(" Tam  ly và lo\tau: "), "text")
    return _asked(spark, d).select("conv_id", "turn", F.md5(Q.normalised(said).cast("binary")).alias("query_md5"))


def plain_word_sets(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(C.plain_words(F.col("text"))).alias("words"))


def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """Search expressions of user turns, with stop words and marks put in."""
    said = F.concat_ws(" ", F.lit("thế nào là"), "w0", F.lit("và (\"xạ\""), "w1", F.lit("tuyến)"))
    return _asked(spark, d).select("conv_id", "turn", Q.expression(said).alias("expression"))


def stop_words_only(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("turn") % 4 < 2, F.lit("là gì")).otherwise(F.col("w0"))
    return _asked(spark, d).select("conv_id", "turn", Q.expression(said).alias("expression"))


def scope_words(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("turn") % 4 < 2, F.concat_ws(" ", F.lit("Nêu ý trong sách"), "w0", "w1", F.lit(", rồi"), "w2")).otherwise(F.concat(F.lit("tài liệu 3 "), "w0", F.lit("?")))
    return _asked(spark, d).select("conv_id", "turn", F.array_join(Q.scope(said), " ").alias("scope"))


def number_phrases(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat_ws(" ", "w0", "w1", F.lit("1 vs 2 rồi"), "w2", F.lit("tự nhiên 7"))
    return _asked(spark, d).select("conv_id", "turn", F.array_join(Q.numbered(said), "|").alias("phrases"))


def compare_concepts(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("turn") % 4 < 2, F.concat_ws(" ", F.lit("Hãy so sánh giữa"), "w0", F.lit("và"), "w1", F.lit("khác nhau thế nào?"))).otherwise(F.concat_ws(" ", "w0", F.lit("khác gì"), "w1"))
    return _asked(spark, d).select("conv_id", "turn", Q.compared(said).alias("x")).select("conv_id", "turn", F.col("x.left").alias("left"), F.col("x.right").alias("right"))


def question_concepts(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("turn") % 4 < 2, F.concat_ws(" ", F.lit("Hãy giải thích"), "w0", "w1", F.lit("là gì?"))).otherwise(F.concat_ws(" ", F.lit("Khái niệm về"), "w0", F.lit("trong giáo trình"), "w1"))
    return _asked(spark, d).select("conv_id", "turn", F.array_join(Q.concepts(said), "|").alias("concepts"))


def question_facets(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("turn") % 4 < 2, F.concat_ws(" ", F.lit("So sánh"), "w0", F.lit("và"), "w1")).otherwise(F.concat_ws(" ", F.lit("Tổng quan"), "w0"))
    return _asked(spark, d).select("conv_id", "turn", F.array_join(Q.facets(said, F.col("w0")), "|").alias("facets"))


def answer_modes(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in (" Tóm tắt ", "STEPS", "so sánh", "từng bước", "other")])
    picked = F.get(names, (F.col("conv_id") + F.col("turn")) % 6)
    return _asked(spark, d).select("conv_id", "turn", Q.mode(picked).alias("mode"))


def processing_level(spark: SparkSession, d: str) -> DataFrame:
    asked = F.get(F.array(F.lit("auto"), F.lit("standard"), F.lit("Careful")), F.col("conv_id") % 4)
    said = F.when(F.col("turn") % 4 < 2, F.concat_ws(" ", F.lit("mối  liên hệ của"), "w0")).otherwise(F.col("text"))
    return _asked(spark, d).select("conv_id", "turn", Q.level(asked, said).alias("level"))


def rewrite_guard(spark: SparkSession, d: str) -> DataFrame:
    """Rewrites of user turns: in capitals, with a number more, halved, or with a negation put in."""
    rows = _asked(spark, d).withColumn("k", (F.col("conv_id") + F.col("turn")) % 4)
    made = F.when(F.col("k") == 1, F.concat("text", F.lit(" 77"))).when(F.col("k") == 2, F.expr("substring(text, 1, cast(length(text) / 2 AS int))")).when(F.col("k") == 3, F.concat(F.lit("never "), "text")).otherwise(C.capitals(F.col("text")))
    return rows.select("conv_id", "turn", Q.rewrite_admitted(F.col("text"), made).alias("admitted"))


def hybrid_content(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all documents times their form's factor."""
    scored = _docs(spark, d).select("doc_id", "text", (F.regexp_count("text", F.lit("the")) / (F.length("text") + 1.0)).alias("score"))
    return R.by_content(scored, ["of the"]).select("doc_id", "hybrid")


def citation_labels(spark: SparkSession, d: str) -> DataFrame:
    """One hit for each file, page and chunk, with its label."""
    file = F.concat("source", F.get(F.array(F.lit(".pdf"), F.lit(".DOCX"), F.lit(".png"), F.lit(".md")), (F.col("doc_id") % 4).cast("int")))
    hits = _docs(spark, d).select(file.alias("file"), (F.col("doc_id") % 3).alias("page"), (F.col("doc_id") % 2).alias("chunk"), "doc_id", "source")
    return R.one_each(hits, ["file", "page", "chunk"], "doc_id").select("doc_id", "file", "page", "chunk", R.label(F.col("source"), F.col("file"), F.col("page")).alias("label"))


def page_fetch(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(F.col("source").alias("file"), (F.col("doc_id") % 10).alias("page_num"), F.col("doc_id").alias("chunk_index"), "text")
    return R.page_passages(rows, "src4", 4, 12, "file").select("file", "page_num", "chunk_index")


def quality_attach(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return _docs(spark, d).select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.col("quality").isNull().alias("unknown"), F.coalesce("quality", F.lit(0)).alias("quality"))


def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    """For each source: whether its documents hold enough of the terms, or one is near the first vector."""
    first = table(spark, d, "embeddings").where("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("query"))
    near = R.cosine_all(table(spark, d, "embeddings"), first).select(F.col("vec_id").alias("doc_id"), F.col("score").alias("cosine"))
    return R.relevant(_docs(spark, d).join(near, "doc_id", "left"), ["the", "of", "onsh", "zzz"], "source")


def retrieval_reason(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 7
    found, page = F.col("n_chars") > 200, k < 3
    sides = F.when(k == 5, F.contains("text", F.lit("the ")).cast("int") + F.contains("text", F.lit("of ")).cast("int"))
    why = R.reason(found, page, k == 1, sides, F.contains("text", F.lit(" is ")))
    return _docs(spark, d).select("doc_id", F.coalesce(why, F.lit("")).alias("reason"))


def eligible_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Status allow-list, ranges of length and page, noise left out, a theme looked for."""
    page = F.col("doc_id") % 40
    keep = F.col("lang").isin("en", "fr") & F.col("n_chars").between(150, 4000) & page.between(2, 30) & ~F.col("text").like("%|%") & (F.lower("text").like("%tion%") | F.lower("text").like("%ment%"))
    return _docs(spark, d).where(keep).select("doc_id", page.alias("page"))


def document_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    stored = docs.where("doc_id % 3 <> 0").withColumn("updated_at", F.lit(1))
    arriving = docs.where("doc_id % 2 = 0").select("path", F.md5(F.col("digest").cast("binary")).alias("digest"))
    twice = arriving.unionByName(arriving.where("path like '%4'").withColumn("digest", F.lit("")))  # an older version of some
    return stores.upsert_documents(stored, twice, "path", ["digest"], F.lit(2)).select("path", "digest", "updated_at", "doc_id")


def upsert_ids(spark: SparkSession, d: str) -> DataFrame:
    """How many ids are new, and that they are distinct and without gaps."""
    stored = _docs(spark, d).where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "lang", F.lit(1).alias("updated_at"))
    arriving = _docs(spark, d).where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("path"), "lang")
    ids = stores.upsert_documents(stored, arriving, "path", ["lang"], F.lit(2))
    return ids.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids"), F.max("doc_id").alias("last"))


def revision_log(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("revision"), "event_type")
    arriving = log.where("revision <= 3 and event_type <> 'view'").select("user_id", "event_type", "revision")
    return stores.append_revision(log, arriving, "user_id", ["event_type"], ["revision"])


def legacy_migration(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role")
    stored = turns.where("conv_id like '%1'").withColumn("conv_id", F.concat(F.lit("legacy_"), "conv_id"))
    return stores.migrated(stored, turns, "conv_id")


def topic_list(spark: SparkSession, d: str) -> DataFrame:
    """Topics are first lines up to a dash or colon; a source without a usable one is its own."""
    line = F.get(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), 0)
    first = F.trim(F.get(F.split(F.trim(F.regexp_replace(line, r"^#+\s*", "")), r"\s*[—–\-:]\s*", 2), 0))
    topic = F.when(F.length(first).between(2, 100), first).otherwise(F.col("source"))
    return _docs(spark, d).groupBy(topic.alias("topic")).agg(F.count(F.lit(1)).alias("documents"))


def topic_match(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose name holds the topic or is held by it, and all whose texts do."""
    return _docs(spark, d).groupBy("source").agg(F.bool_or(F.contains("source", F.lit("src1")) | F.contains(F.lit("src1"), F.col("source"))).alias("by_name"), F.bool_or(F.contains(F.lower("text"), F.lit("eeling"))).alias("by_text")).where("by_name or by_text")


def grade_report(spark: SparkSession, d: str) -> DataFrame:
    """Grades before and after, their pass rate, and how many declined by rank."""
    rank = F.create_map(F.lit("fail"), F.lit(0), F.lit("partial"), F.lit(1), F.lit("pass"), F.lit(2))
    grade = lambda n: F.get(F.array(F.lit("fail"), F.lit("partial"), F.lit("pass")), n)
    rows = _docs(spark, d).select("lang", grade((F.col("doc_id") % 3).cast("int")).alias("before"), grade(F.least(F.floor(F.col("n_chars") / 700), F.lit(2)).cast("int")).alias("after"))
    per = rows.groupBy("lang").agg(*[F.count_if(F.col("after") == g).alias(g) for g in ("fail", "partial", "pass")], F.count_if(rank[F.col("after")] < rank[F.col("before")]).alias("declined"), F.count(F.lit(1)).alias("n"))
    return per.select("lang", "fail", "partial", "pass", "declined", F.round(F.col("pass") / F.col("n"), 2).alias("pass_rate"))


def paired_grounding(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("lang", (F.col("n_chars") > 300).alias("base"), F.contains("text", F.lit("\n")).alias("adapter"))
    return rows.groupBy("lang").agg(F.count_if("base").alias("base_pass"), F.count_if("adapter").alias("adapter_pass"), F.count(F.lit(1)).alias("n"))


def history_window(spark: SparkSession, d: str) -> DataFrame:
    return stores.last_turns(table(spark, d, "conversations").select("conv_id", "turn", "role"), 6)


def recent_sources(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "events").select("event_id", F.concat(F.col("event_type"), F.lit(":"), (F.col("user_id") % 5).cast("string")).alias("s"))
    return stores.recent_sources(hits, F.col("s"), ["event_id"], 15).select("source", F.col("position").cast("int").alias("position"))


def library_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(F.contains(F.lower("url"), F.lit("a")) & F.contains(F.lower("html"), F.lit("the"))).select("page_id")


def weak_topics(spark: SparkSession, d: str) -> DataFrame:
    """Each user's topics of wrong answers, distinct in the order of the queue, 3 at most."""
    wrong = table(spark, d, "events").where("value < 30").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    return audit.latest(wrong, ["user_id", "event_type"], ["at"]).withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("at"))).where("place <= 3").select("user_id", "event_type", F.col("place").cast("int").alias("place"))


_ASKED = r"a AS (SELECT conv_id, turn, text, coalesce(w[1], 'x') AS w0, coalesce(w[2], 'x') AS w1, coalesce(w[3], 'x') AS w2 FROM (SELECT conv_id, turn, text, regexp_extract_all(text, '\p{L}+') AS w FROM conversations WHERE role = 'user'))"
_CODE = C.CODE.replace("(?m)", "(?m)")
_SQL_PARTS = r""""[^"\\]*(?:\\.[^"\\]*)*"|''[^''\\]*(?:\\.[^''\\]*)*''|[^"'']+|["'']"""


def _stop(x: str) -> str:
    return "lower(" + x + ") IN (" + ", ".join(f"'{w}'" for w in Q.STOPWORDS) + ")"


ORACLES = {
    "clean_text": rf"""WITH d AS (SELECT doc_id, nfc_normalize('a' || chr(1) || 'b  c "d  e"   f' || repeat(chr(10), 4) || 'ánh xạtuyến tính ' || text) AS t FROM documents),
r AS (SELECT doc_id, regexp_matches(t, '{_CODE}') AS code, t, regexp_extract_all(regexp_replace(replace(regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g'), 'ánh xạtuyến tính', 'ánh xạ tuyến tính'), '\n{{3,}}', chr(10) || chr(10), 'g'), '{_SQL_PARTS}') AS p FROM d),
s AS (SELECT doc_id, CASE WHEN code THEN t ELSE array_to_string(list_transform(p, lambda x, i: CASE WHEN length(x) > 1 AND x[1] IN ('"', '''') THEN x WHEN i > 1 AND p[i - 1] IN ('"', '''') THEN regexp_replace('x' || x, '(\S)[ \t]{{2,}}', '\1 ', 'g')[2:] ELSE regexp_replace(x, '(\S)[ \t]{{2,}}', '\1 ', 'g') END), '') END AS o FROM r)
SELECT doc_id, md5(regexp_replace(o, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')) AS clean_md5 FROM s""",
    "prose_joined": r"SELECT doc_id, md5(regexp_replace(replace(text, ' th', '-' || chr(10) || 'th'), '([\p{L}\p{M}\p{N}_]+)-\n([\p{L}\p{M}\p{N}_]+)', '\1\2', 'g')) AS joined_md5 FROM documents",
    "query_normalise": rf"WITH {_ASKED} SELECT conv_id, turn, md5('tâm lý và lo âu: ' || trim(regexp_replace(nfc_normalize(text), '[\s\x00-\x1F\x{{00A0}}]+', ' ', 'g'))) AS query_md5 FROM a",
    "plain_word_sets": r"SELECT doc_id, len(list_distinct(regexp_extract_all(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '\p{Mn}+', '', 'g'), '[\p{L}\p{M}\p{Nd}\p{Pc}]+'))) ::INT AS words FROM documents",
    "search_terms": rf"""WITH {_ASKED}, t AS (SELECT conv_id, turn, list_filter(['thế', 'nào', 'là', w0, 'và', 'xạ', w1, 'tuyến'], lambda x: NOT {_stop('x')}) AS k FROM a)
SELECT conv_id, turn, array_to_string(list_transform(k || ['xạtuyến', 'sốtuyến'], lambda x: '"' || x || '"*'), ' OR ') AS expression FROM t""",
    "stop_words_only": rf"""WITH {_ASKED} SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN '"là"* OR "gì"*' ELSE '"' || w0 || '"*' END AS expression FROM a""",
    "scope_words": rf"WITH {_ASKED} SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN lower(w0) || ' ' || lower(w1) ELSE '3 ' || lower(w0) END AS scope FROM a",
    "number_phrases": rf"WITH {_ASKED} SELECT conv_id, turn, w0 || ' ' || w1 || ' 1|' || w0 || ' ' || w1 || ' 2|tự nhiên 7' AS phrases FROM a",
    "compare_concepts": rf"""WITH {_ASKED} SELECT conv_id, turn, CASE WHEN w0 <> w1 THEN w0 END AS "left", CASE WHEN w0 <> w1 THEN w1 END AS "right" FROM a""",
    "question_concepts": rf"WITH {_ASKED} SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN w0 || ' ' || w1 WHEN length(w0) >= 2 THEN w0 ELSE '' END AS concepts FROM a",
    "question_facets": rf"""WITH {_ASKED} SELECT conv_id, turn, array_to_string(CASE WHEN turn % 4 < 2 THEN [w0] || list_transform(list_filter([w0, w1], lambda x: length(x) > 3), lambda x: x || ' đặc điểm nguyên lý') ELSE [w0, {', '.join(f"w0 || ' {x}'" for x in Q.ASPECTS)}] END, '|') AS facets FROM a""",
    "answer_modes": rf"WITH {_ASKED} SELECT conv_id, turn, coalesce(['quick', 'steps', 'compare', 'steps', 'quick'][(conv_id + turn) % 6 + 1], 'quick') AS mode FROM a",
    "processing_level": rf"WITH {_ASKED} SELECT conv_id, turn, CASE conv_id % 4 WHEN 1 THEN 'standard' WHEN 2 THEN 'careful' ELSE CASE WHEN turn % 4 < 2 OR regexp_matches(text, '(?i)\b(versus|vs\.?)\s') THEN 'careful' ELSE 'standard' END END AS level FROM a",
    "rewrite_guard": rf"""WITH {_ASKED}, m AS (SELECT *, (conv_id + turn) % 4 AS k FROM a), n AS (SELECT *, CASE k WHEN 1 THEN text || ' 77' WHEN 2 THEN text[1:length(text) // 2] WHEN 3 THEN 'never ' || text ELSE upper(text) END AS r FROM m),
s AS (SELECT *, list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}_]+')) AS x, list_distinct(regexp_extract_all(strip_accents(lower(r)), '[\p{{L}}\p{{N}}_]+')) AS y FROM n)
SELECT conv_id, turn, length(r) BETWEEN length(text) * 0.6 AND length(text) * 1.5 AND regexp_extract_all(text, '[0-9]+') = regexp_extract_all(r, '[0-9]+') AND regexp_matches(text, '(?i)\bnever\b') = regexp_matches(r, '(?i)\bnever\b') AND regexp_matches(text, '(?i)\bnot\b') = regexp_matches(r, '(?i)\bnot\b') AND len(list_intersect(x, y)) >= 0.5 * greatest(len(x), 1) AS admitted FROM s""",
    "hybrid_content": f"""WITH toc AS ({CORPUS['toc_detect']}), s AS (SELECT d.doc_id, is_contents, text, len(regexp_extract_all(text, 'the')) / (length(text) + 1.0::DOUBLE) AS score FROM documents d JOIN toc USING (doc_id)),
c AS (SELECT *, CASE WHEN is_contents THEN -0.8::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), 'playlist') THEN -0.5::DOUBLE ELSE 0 END + CASE WHEN length(text) > 100 AND regexp_matches(text, '[.!?;\\n]') THEN 0.1::DOUBLE ELSE 0 END AS c FROM s)
SELECT doc_id, round(score * (1 + greatest(-0.8::DOUBLE, c)), 9) AS hybrid FROM c""",
    "citation_labels": "WITH h AS (SELECT source || ['.pdf', '.DOCX', '.png', '.md'][doc_id % 4 + 1] AS file, doc_id % 3 AS page, doc_id % 2 AS chunk, doc_id, source FROM documents) SELECT doc_id, file, page, chunk, '[' || source || ', ' || CASE doc_id % 4 WHEN 0 THEN 'Trang' WHEN 2 THEN 'Hình' ELSE 'Đoạn' END || ' ' || page || ']' AS label FROM h QUALIFY row_number() OVER (PARTITION BY file, page, chunk ORDER BY doc_id) = 1",
    "page_fetch": "SELECT * FROM (SELECT source AS file, doc_id % 10 AS page_num, doc_id AS chunk_index, text FROM documents WHERE source = 'src4' AND doc_id % 10 = 4 ORDER BY doc_id LIMIT 12) WHERE trim(text) <> ''".replace("SELECT * FROM", "SELECT file, page_num, chunk_index FROM"),
    "quality_attach": "SELECT d.doc_id, q IS NULL AS unknown, coalesce(q, 0) AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l USING (doc_id)",
    "evidence_gate": r"""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), n AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)) AS c FROM embeddings, q),
t AS (SELECT source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, c FROM documents LEFT JOIN n ON vec_id = doc_id), g AS (SELECT source, (max(list_contains(w, 'the')::INT) + max(list_contains(w, 'of')::INT) + max(list_contains(w, 'onsh')::INT) + max(list_contains(w, 'zzz')::INT)) / 4.0::DOUBLE AS s, max(coalesce(c, 0)) AS c FROM t GROUP BY 1)
SELECT source, round(s, 6) AS covered, s >= 0.75 OR round(c, 6) >= 0.52 AS relevant FROM g""",
    "retrieval_reason": """WITH k AS (SELECT *, doc_id % 7 AS k, contains(text, ' is ') AS r FROM documents) SELECT doc_id, CASE WHEN n_chars <= 200 THEN CASE WHEN k < 3 THEN 'page_empty' ELSE 'no_results' END WHEN k < 3 THEN CASE WHEN k <> 1 AND NOT r THEN 'page_scope_too_narrow' ELSE '' END
WHEN k = 5 THEN CASE contains(text, 'the ')::INT + contains(text, 'of ')::INT WHEN 0 THEN 'low_relevance' WHEN 1 THEN 'partial_evidence' ELSE '' END WHEN NOT r THEN 'low_relevance' ELSE '' END AS reason FROM k""",
    "eligible_chunks": "SELECT doc_id, doc_id % 40 AS page FROM documents WHERE lang IN ('en', 'fr') AND n_chars BETWEEN 150 AND 4000 AND doc_id % 40 BETWEEN 2 AND 30 AND text NOT LIKE '%|%' AND (lower(text) LIKE '%tion%' OR lower(text) LIKE '%ment%')",
    "document_upsert": """WITH d AS (SELECT 'f' || doc_id AS path, doc_id, md5(text) AS digest FROM documents), s AS (SELECT * FROM d WHERE doc_id % 3 <> 0), n AS (SELECT path, md5(digest) AS digest FROM d WHERE doc_id % 2 = 0)
SELECT path, coalesce(n.digest, s.digest) AS digest, CASE WHEN n.path IS NULL THEN 1 ELSE 2 END AS updated_at, coalesce(s.doc_id, (SELECT max(doc_id) FROM s) + row_number() OVER (PARTITION BY s.doc_id IS NULL ORDER BY path)) AS doc_id FROM s FULL JOIN n USING (path)""",
    "upsert_ids": "WITH s AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id FROM documents WHERE doc_id % 6 = 0) SELECT (SELECT count(*) FROM s) + (SELECT count(*) FROM n) AS rows, (SELECT count(*) FROM s) + (SELECT count(*) FROM n) AS ids, (SELECT max(doc_id) FROM s) + (SELECT count(*) FROM n) AS last",
    "revision_log": "WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision, event_type FROM events) SELECT user_id, revision::INT AS revision, event_type FROM l UNION ALL SELECT user_id, ((SELECT max(revision) FROM l m WHERE m.user_id = l.user_id) + row_number() OVER (PARTITION BY user_id ORDER BY revision))::INT, event_type FROM l WHERE revision <= 3 AND event_type <> 'view'",
    "legacy_migration": "SELECT 'legacy_' || conv_id AS conv_id, turn, role FROM conversations",
    "topic_list": r"""WITH f AS (SELECT source, trim(regexp_split_to_array(trim(regexp_replace(list_filter([trim(x) for x in string_split(text, chr(10))], lambda x: x <> '')[1], '^#+\s*', '')), '\s*[—–\-:]\s*')[1]) AS t FROM documents)
SELECT CASE WHEN length(t) BETWEEN 2 AND 100 THEN t ELSE source END AS topic, count(*) AS documents FROM f GROUP BY 1""",
    "topic_match": "SELECT source, bool_or(contains(source, 'src1') OR contains('src1', source)) AS by_name, bool_or(contains(lower(text), 'eeling')) AS by_text FROM documents GROUP BY 1 HAVING by_name OR by_text",
    "grade_report": """WITH r AS (SELECT lang, doc_id % 3 AS b, least(n_chars // 700, 2) AS a FROM documents) SELECT lang, count(*) FILTER (a = 0) AS fail, count(*) FILTER (a = 1) AS partial, count(*) FILTER (a = 2) AS pass, count(*) FILTER (a < b) AS declined, round(count(*) FILTER (a = 2) / count(*), 2) AS pass_rate FROM r GROUP BY 1""",
    "paired_grounding": "SELECT lang, count(*) FILTER (n_chars > 300) AS base_pass, count(*) FILTER (contains(text, chr(10))) AS adapter_pass, count(*) AS n FROM documents GROUP BY 1",
    "history_window": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6",
    "recent_sources": "WITH f AS (SELECT event_type || ':' || (user_id % 5) AS source, min(event_id) AS seen FROM events GROUP BY 1) SELECT source, row_number() OVER (ORDER BY seen)::INT AS position FROM f QUALIFY position <= 15",
    "library_filter": "SELECT page_id FROM pages WHERE contains(lower(url), 'a') AND contains(lower(html), 'the')",
    "weak_topics": "WITH w AS (SELECT user_id, event_type, min(event_id) AS seen FROM events WHERE value < 30 GROUP BY 1, 2) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY seen)::INT AS place FROM w QUALIFY place <= 3",
}
QUERIES = {f.__name__: f for f in (clean_text, prose_joined, query_normalise, plain_word_sets, search_terms, stop_words_only, scope_words, number_phrases, compare_concepts, question_concepts, question_facets, answer_modes, processing_level, rewrite_guard, hybrid_content, citation_labels, page_fetch, quality_attach, evidence_gate, retrieval_reason, eligible_chunks, document_upsert, upsert_ids, revision_log, legacy_migration, topic_list, topic_match, grade_report, paired_grounding, history_window, recent_sources, library_filter, weak_topics)}
