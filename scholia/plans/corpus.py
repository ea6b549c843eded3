"""Corpus queries: chunks, cleaning, language, quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text as X
from scholia.operators import chunking
from scholia.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(_docs(spark, d)).select("doc_id", "chunk_index", "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def paragraph_explode(spark: SparkSession, d: str) -> DataFrame:
    return chunking.paragraph_rows(_docs(spark, d))


def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sentences(_docs(spark, d)).select("doc_id", "sentence", "char_start", "char_end")


def sanitize_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(X.sanitized(F.col("html")).cast("binary")).alias("safe_md5"))


def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.language(F.col("text")).alias("language"))


def lang_majority(spark: SparkSession, d: str) -> DataFrame:
    """A source is English if six tenths of its first 20 documents are; a rank limit keeps 20 rows a source before the shuffle."""
    from pyspark.sql import Window

    docs = _docs(spark, d)
    first = docs.select("doc_id", "source").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= 20")
    voted = docs.select("doc_id", X.language(F.col("text")).alias("language")).join(first.select("doc_id", "source"), "doc_id")
    return voted.groupBy("source").agg((F.avg((F.col("language") == "en").cast("double")) >= 0.6).alias("english"))


def substantive_filter(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(X.substantive(F.col("text"))).select("doc_id")


def source_reject_reason(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.coalesce(X.reject_reason(F.col("text")), F.lit("")).alias("reason"))


def toc_detect(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.is_contents(F.col("text")).alias("is_contents"))


def block_classify(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy(X.block_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def pua_scan(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(X.private_use(F.col("text"))).cast("long").alias("private_use"))


def repetition_flag(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.repeats(F.col("text")).alias("repeats"))


def language_drift(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", X.drifts(F.col("text")).alias("drifts"))


def query_policy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(X.query_problem(F.col("text")), F.lit("")).alias("problem"))


def title_derivation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.clean_title(F.regexp_replace("url", "^.*/", "")).alias("title"))


_LINES = r"list_filter([trim(x) for x in string_split(trim(text), chr(10))], lambda x: x <> '')"
_LEAD = r"((?:\.\s*){4,}|…{2,}|_{4,}|-{4,})\s*\d*\s*$"
_JAIL = [r"(?i)ignore\s+(?:all\s+)?(?:(?:previous|prior|above)\s+)?instructions", r"(?i)disregard\s+(?:all\s+)?(?:(?:previous|prior|above)\s+)?instructions", r"(?i)system\s*:\s*you\s+are\s+now", r"(?i)bỏ\s+qua\s+(?:tất\s+cả\s+)?(?:các\s+)?hướng\s+dẫn(?:\s+trước)?", r"(?i)từ\s+bây\s+giờ\s+hãy\s+đóng\s+vai"]


def _sanitize_sql(column: str) -> str:
    out = column
    for p in _JAIL:
        out = f"regexp_replace({out}, '{p}', '[Bị vô hiệu hóa: Cụm từ chỉ dẫn không an toàn]', 'g')"
    out = rf"regexp_replace({out}, '<\|([^|>]+)\|>', '&lt;|\1|&gt;', 'g')"
    return f"replace(replace(replace({out}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_LANG = r"""CASE WHEN en >= 8 AND vi <= w * 0.2 THEN 'en' WHEN vi >= greatest(3, n // 180) THEN 'vi' WHEN en >= 8 THEN 'en' ELSE 'vi' END"""
_LANG_CTE = r"""l AS (SELECT doc_id, source, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x IN ('the', 'and', 'of', 'to', 'that', 'with', 'for', 'is', 'in'))) AS en,
len(regexp_extract_all(lower(text), '[a-z]+')) AS w, len(regexp_extract_all(text, '[ăâđêôơưĂÂĐÊÔƠƯ\x{1EA0}-\x{1EF9}]')) AS vi, length(text) AS n FROM documents)"""

def _reject_sql() -> str:
    test = lambda c, patterns: "(" + " OR ".join(f"regexp_matches({c}, '(?i){p}')" for p in patterns) + ")"
    begins = lambda heads: "(" + " OR ".join(f"starts_with(low, '{h}')".replace("\n'", "' || chr(10)") for h in heads) + ")"
    roles = "(" + " OR ".join(f"contains(lower(l), '{r}')" for r in X.ROLES) + ")"
    return rf"""WITH d AS (SELECT doc_id, trim(text) AS t, lower(trim(text)) AS low, {_LINES} AS ls FROM documents),
x AS (SELECT *, string_split_regex(t, '\s+')[-1] AS last, {' + '.join(f"regexp_matches(low, '{p}')::INT" for p in X.BIOGRAPHY)} AS hits,
 len(list_filter(ls, lambda l: regexp_matches(l, '(?i){X.CONTENTS_LINE}'))) AS listed, len(list_filter(ls, lambda l: regexp_matches(l, '{X.ROLE_LINE}') AND {roles})) AS credits,
 len(list_distinct({' || '.join(f"regexp_extract_all(low, '{p}')" for p in X.STAFF)})) AS named FROM d)
SELECT doc_id, CASE WHEN t = '' THEN 'empty_source' WHEN length(t) < 50 THEN 'source_too_short' WHEN {test('low', X.ACKNOWLEDGEMENTS)} THEN 'acknowledgements_boilerplate'
 WHEN {begins(X.BIOGRAPHY_HEADS)} OR hits >= 2 THEN 'contributor_biography' WHEN named >= 2 OR (credits >= 2 AND credits / len(ls) >= 0.2) THEN 'editorial_staff_credits'
 WHEN {test('low', X.PUBLISHER)} AND ({' OR '.join(f"contains(low, '{p}')" for p in X.PUBLISHER_TOO)}) THEN 'publisher_cataloging_or_corporate_boilerplate'
 WHEN {begins(X.CONTENTS_HEADS)} OR (len(ls) >= 4 AND listed / len(ls) >= 0.35) THEN 'table_of_contents' WHEN {begins(X.REFERENCES_HEADS)} THEN 'bibliography_or_references'
 WHEN regexp_matches(t, '[-–—,]$') OR (length(last) <= 2 AND NOT regexp_matches(last, '[.!?"''”»]$')) OR NOT regexp_matches(t, '[.!?"''”)»]$') THEN 'truncated_source_text' ELSE '' END AS reason FROM x"""


ORACLES = {
    "sentence_spans": r"""WITH d AS (SELECT doc_id, text, string_split(text, '') AS cs FROM documents WHERE text <> ''),
p AS (SELECT doc_id, i, text, len(cs) AS n, cs[i] AS c, cs[i + 1] AS x FROM (SELECT doc_id, text, cs, unnest(range(1, len(cs) + 1)) AS i FROM d)),
b AS (SELECT doc_id, i AS e FROM p WHERE c IN ('.', '!', '?', '"', '''', '”', '’', '»', ')') AND (i = n OR regexp_matches(x, '\s')) AND regexp_matches(substr(text, greatest(i - 20, 1), least(i, 21)), '[.!?][.!?]*["''”’»)]*$')
  AND NOT regexp_matches(substr(text, greatest(i - 20, 1), least(i, 21)), '(?i)\b(?:PhD|Dr|Mr|Mrs|Ms|Prof|vs|e\.g|i\.e|al|No|vol|pp|sec)\.$')
  UNION SELECT doc_id, i - 1 FROM p WHERE c = chr(10) AND x = chr(10) UNION SELECT doc_id, length(text) FROM d),
s AS (SELECT doc_id, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY e), 0) AS a FROM b),
t AS (SELECT doc_id, a, e, text[a + 1:e] AS part FROM s JOIN d USING (doc_id)),
r AS (SELECT doc_id, e - length(regexp_replace(part, '^\s+', '')) AS char_start, e AS char_end FROM t WHERE regexp_matches(part, '\S'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY char_end) - 1 AS sentence, char_start, char_end FROM r""",
    "page_chunks": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
c AS (
  SELECT doc_id, t, 0 AS chunk_index, 0 AS s, CASE WHEN length(t) <= 1200 THEN length(t) ELSE coalesce(nullif(600 + length(regexp_extract(t[601:1200], '(?s)^(.*\s)', 1)), 600), 1200) END AS e FROM d WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, t, chunk_index + 1, e - 200, CASE WHEN length(t) <= e + 1000 THEN length(t) ELSE coalesce(nullif(e + 400 + length(regexp_extract(t[e + 401:e + 1000], '(?s)^(.*\s)', 1)), e + 400), e + 1000) END FROM c WHERE e < length(t)
)
SELECT doc_id, chunk_index, s::INT AS char_start, e::INT AS char_end, md5(t[s + 1:e]) AS text_md5 FROM c""",
    "paragraph_explode": r"""WITH p AS (SELECT doc_id, list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') for x in regexp_split_to_array(text, '\n\s*\n')], lambda x: x <> '') AS ps FROM documents)
SELECT doc_id, unnest(range(1, len(ps) + 1))::INT AS paragraph, unnest(ps) AS text FROM p""",
    "sanitize_prompt": f"SELECT page_id, md5({_sanitize_sql('html')}) AS safe_md5 FROM pages",
    "lang_detect": f"WITH {_LANG_CTE} SELECT doc_id, {_LANG} AS language FROM l",
    "lang_majority": f"WITH {_LANG_CTE}, f AS (SELECT source, {_LANG} AS language FROM l QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20) SELECT source, avg((language = 'en')::INT) >= 0.6 AS english FROM f GROUP BY source",
    "substantive_filter": r"""SELECT doc_id FROM documents WHERE NOT (len(regexp_extract_all(text, '_{3,}')) >= 2 OR (length(text) - length(replace(text, chr(10), '')) >= 8 AND NOT contains(text, '.') AND len(regexp_extract_all(text, '\S+')) < 100))""",
    "source_reject_reason": _reject_sql(),
    "toc_detect": rf"""WITH d AS (SELECT doc_id, trim(text) AS t, lower(trim(text)) AS low, {_LINES} AS ls FROM documents),
x AS (SELECT *, len(ls) AS n, len(list_filter(ls, lambda l: regexp_matches(l, '{_LEAD}'))) AS leaders, len(list_filter(ls, lambda l: length(l) > 80 AND NOT regexp_matches(l, '{_LEAD}'))) AS long,
 array_to_string(list_filter(ls, lambda l: length(l) > 60 AND NOT regexp_matches(l, '^(\d+[.)]|[A-ZĐ.\-\s]{{3,}})')), ' ') AS body,
 len(list_filter(ls, lambda l: regexp_matches(l, '^\d+[.)]\s*'))) AS numbered, len(list_filter(ls, lambda l: regexp_matches(l, '^(\d+(\.\d+)*\.?|[A-ZĐ\d.\s\-]{{3,30}}$)'))) AS sections FROM d)
SELECT doc_id, t = '' OR (leaders >= 2 AND long < 2) OR ((regexp_matches(low, '^(mục lục|table of contents)') OR (starts_with(low, 'nội dung') AND regexp_matches(low, 'chương trình|mục lục|chi tiết|bài giảng|khóa học'))) AND length(body) < 150)
 OR (n >= 3 AND numbered >= n * 0.6 AND long = 0) OR (n <= 6 AND length(t) < 250 AND sections > 0 AND sections >= n - 1) AS is_contents FROM x""",
    "block_classify": rf"""WITH d AS (SELECT trim(text) AS t, {_LINES} AS ls FROM documents)
SELECT CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '(?m)^\s*(def |class |import |from \S+ import |#include|public |private |function |return |SELECT |for \()|[{{}};]\s*$') THEN 'code'
 WHEN len(ls) = 1 AND length(t) <= 120 AND NOT ends_with(t, '.') AND regexp_matches(t, '^(\d+(\.\d+)*\.?\s+\S|[A-ZĐ]|#+\s)') THEN 'heading'
 WHEN contains(t, chr(9)) OR (length(t) - length(replace(t, '|', '')) >= 2 AND len(ls) >= 2) THEN 'table'
 WHEN regexp_matches(t, '[=≈≠≤≥∑∫√±×÷∂∞]\s*\S|\\frac|\\sum|\^\d') THEN 'formula' ELSE 'prose' END AS kind, count(*) AS n FROM d GROUP BY 1""",
    "pua_scan": r"SELECT doc_id, len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]')) AS private_use FROM documents",
    "repetition_flag": r"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '(?i)\[S\d+\]', '', 'g'), '[.!?\n]+')) AS x FROM documents),
c AS (SELECT doc_id, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS y, count(*) AS n FROM s WHERE len(regexp_extract_all(x, '\S+')) >= 8 GROUP BY 1, 2)
SELECT d.doc_id, coalesce(max(n), 0) >= 3 AS repeats FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1""",
    "language_drift": r"WITH c AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[\x{3400}-\x{9FFF}]')) AS han, len(regexp_extract_all(text, '\p{L}')) AS letters FROM conversations) SELECT conv_id, turn, han >= 10 AND han / greatest(letters, 1) >= 0.05 AS drifts FROM c",
    "query_policy": r"""SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'not_text' WHEN regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') THEN 'control_character' WHEN regexp_matches(text, '[\x{202A}-\x{202E}\x{2066}-\x{2069}]') THEN 'bidi_control'
 WHEN regexp_matches(text, '\p{M}{17,}') THEN 'combining_run' WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) > 4000 THEN 'too_long' WHEN strlen(trim(text)) > 16000 THEN 'too_many_bytes'
 WHEN NOT regexp_matches(trim(text), '[^\s\x{200B}-\x{200D}\x{2060}\x{FEFF}]') THEN 'invisible_only' WHEN NOT regexp_matches(trim(text), '[\p{L}\p{N}]') THEN 'no_letter_or_number' ELSE '' END AS problem FROM conversations""",
    "title_derivation": r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '\.[^.]*$', ''), '[_\s]+', ' ', 'g')) AS title FROM pages",
}
QUERIES = {f.__name__: f for f in (page_chunks, paragraph_explode, sentence_spans, sanitize_prompt, lang_detect, lang_majority, substantive_filter, source_reject_reason, toc_detect, block_classify, pua_scan, repetition_flag, language_drift, query_policy, title_derivation)}
