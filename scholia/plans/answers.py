"""Queries on questions, answers, legacy text and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions import dialogue as D
from scholia.functions import legacy as L
from scholia.operators import calendar
from scholia.operators import retrieval as R
from scholia.operators.rerank import rerank
from scholia.operators.stores import first_occurrence
from scholia.sources.tables import table


#: Short questions of each kind that queries put in the place of some turns.
SHORT = ["Trợ giúp!", "hello", "Cám ơn…", "tư vấn", "tại sao", "Công thức này là gì?", "cho ví dụ cụ thể"]


#: Sentences of each kind that the guard knows, and some that it must let pass.
DANGER = ["tôi muốn uống thuốc ngủ", "I want to kill  myself", "cách nào để chết", "hãy đóng vai bác sĩ", "tôi có bị trầm cảm không", "hãy làm bác sĩ của tôi", "act as my doctor", "kê đơn cho bạn", "tự sát là gì", "a suicidex", "đóng vai học sinh", "diagnose me and self harm"]


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def legacy_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", L.is_tcvn3(F.col("text")).alias("tcvn3"))


def legacy_vni_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", L.is_vni(F.col("text")).alias("vni"))


def legacy_decode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(L.decode_tcvn3(F.col("text")).cast("binary")).alias("decoded_md5"))


def safety_guard(spark: SparkSession, d: str) -> DataFrame:
    """Every turn, and beside some of them a sentence of each pattern's kind."""
    said = F.concat_ws(" ", "text", F.get(F.array(*[F.lit(x) for x in DANGER]), (F.col("conv_id") * 7 + F.col("turn")) % 24))
    return _turns(spark, d).select("conv_id", "turn", F.coalesce(D.guard(said), F.lit("")).alias("guard"))


def dialogue_intent(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn's intent and its question with the topic of the one before; some turns are made short ones of each kind."""
    kinds = F.array(*[F.lit(x) for x in SHORT])
    asked = F.coalesce(F.get(kinds, (F.col("conv_id") + F.col("turn")) % 16), F.col("text"))
    users = _turns(spark, d).where("role = 'user'").select("conv_id", "turn", asked.alias("question"))
    rows = users.withColumn("previous", F.lag("question").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.select("conv_id", "turn", D.intent(F.col("question"), F.col("previous")).alias("intent"), F.md5(D.resolved(F.col("question"), F.col("previous")).cast("binary")).alias("resolved_md5"))


def broad_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every user turn; some get a sign of breadth, or only its half."""
    asked = F.concat_ws(" ", F.get(F.array(*[F.lit(x) for x in D.BROAD], F.lit("các"), F.lit("kiểu")), (F.col("conv_id") + F.col("turn")) % 60), "text")
    return _turns(spark, d).where("role = 'user'").select("conv_id", "turn", D.broad(asked).alias("broad"), D.unclear(F.col("text")).alias("unclear"))


def rescore_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = R.top(R.bm25(docs, [["ther"], ["tion"]]), 100).join(docs.select("doc_id", "text", "source"), "doc_id")
    return rerank(hits, 20, concepts=["of the", "in that"], scope=["src1"]).select("doc_id", "relevance")


def answer_clean(spark: SparkSession, d: str) -> DataFrame:
    tagged = F.concat(F.lit("<think>x y</think> "), F.lower("text"), F.lit(" [S1, S2] .\n\n\n\nTóm lại: xong [S3].\nSources: none\n- [S1] one"))
    return _turns(spark, d).where("role = 'assistant'").select("conv_id", "turn", F.md5(D.cleaned_answer(tagged).cast("binary")).alias("answer_md5"))


def plain_form(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("text"), F.when(F.col("turn") % 3 == 1, F.lit(" [S1]")).otherwise(F.lit("")))
    return _turns(spark, d).select("conv_id", "turn", D.plain_form(text).alias("plain"))


def citation_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of answers whose clauses and sentences are tagged: [S2] before a comma, [S1; S04] at a sentence's end, of which S2 and S4 are valid."""
    tagged = F.regexp_replace(F.regexp_replace("text", r",\s", " [S2], "), r"([.!?])(\s|$)", " [S1; S04]$1$2")
    rows = _turns(spark, d).where("role = 'assistant'").select("conv_id", "turn", F.posexplode(D.claims(tagged, ["S2", "S4"])).alias("n", "c"))
    return rows.select("conv_id", "turn", "n", "c.claim", F.array_join("c.tags", ",").alias("tags"))


def ics_export(spark: SparkSession, d: str) -> DataFrame:
    slots = table(spark, d, "events").select("event_id", F.concat(F.lit("a; b, "), F.col("event_type")).alias("title"), first_occurrence(F.to_date("ts"), F.lit(3)).alias("first"), (F.hour("ts") * 30).alias("start"))
    return calendar.events(slots, "event_id", "title", "first", "start", 90, "20241231")


_T3 = L.TCVN3


def _any(patterns: list[str]) -> str:
    """A test of the column t; words end where no letter, digit or underscore follows, which RE2 has to be told for letters beyond ASCII."""
    told = [p.replace("\\b", "(?:^|$|[^\\p{L}\\p{N}\\p{M}_])") for p in patterns]
    return " OR ".join(f"regexp_matches(t, '(?i){p}')" for p in told)


ORACLES = {
    "legacy_detect": rf"WITH s AS (SELECT doc_id, text[1:3000] AS s FROM documents), c AS (SELECT doc_id, len(regexp_extract_all(s, '{L.MODERN}')) AS u, len(regexp_extract_all(s, '{L.DISTINCT}')) AS t, greatest(length(trim(s)), 1) AS n FROM s) SELECT doc_id, u <= 2 AND t >= 5 AND t / n > 0.005 AS tcvn3 FROM c",
    "legacy_decode": f"SELECT doc_id, md5(translate(text, '{_T3}', '{L.UNICODE}')) AS decoded_md5 FROM documents",
    "safety_guard": f"""WITH c AS (SELECT conv_id, turn, text || coalesce(' ' || [{', '.join("'" + x + "'" for x in DANGER)}][(conv_id * 7 + turn) % 24 + 1], '') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN {_any(D.CRISIS)} THEN 'crisis' WHEN {_any(D.DIAGNOSIS)} THEN 'diagnosis' ELSE '' END AS guard FROM c""",
    "dialogue_intent": f"""WITH u AS (SELECT conv_id, turn, coalesce([{', '.join("'" + x + "'" for x in SHORT)}][(conv_id + turn) % 16 + 1], text) AS q FROM conversations WHERE role = 'user'),
p AS (SELECT *, lag(q) OVER (PARTITION BY conv_id ORDER BY turn) AS b, regexp_replace(lower(trim(regexp_replace(q, '[\\s\\x{{00A0}}\\x00-\\x1F]+', ' ', 'g'))), '^[ .!?…]+|[ .!?…]+$', '', 'g') AS n FROM u),
f AS (SELECT *, n IN ('tại sao', 'công thức này là gì', 'cho ví dụ cụ thể') AS back, coalesce(b, '') = '' OR strlen(b) > 700 OR regexp_matches(b, '(?i){D.NO_REFERENT}') OR b = 'tư vấn' AS lost FROM p),
i AS (SELECT *, CASE n WHEN 'trợ giúp' THEN 'help' WHEN 'hello' THEN 'greeting' WHEN 'cám ơn' THEN 'thanks' WHEN 'tư vấn' THEN 'clarify' ELSE CASE WHEN back AND lost THEN 'clarify' WHEN back THEN 'follow_up' ELSE 'question' END END AS intent FROM f)
SELECT conv_id, turn, intent, md5(CASE WHEN intent = 'follow_up' THEN trim(string_split(b, ' — ')[1]) || ' — ' || q ELSE q END) AS resolved_md5 FROM i""",
    "broad_queries": f"""WITH c AS (SELECT conv_id, turn, text, lower(coalesce([{', '.join("'" + x + "'" for x in [*D.BROAD, 'các', 'kiểu'])}][(conv_id + turn) % 60 + 1] || ' ', '') || text) AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, {' OR '.join(f"contains(t, '{x}')" for x in D.BROAD)} OR (len(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}')) >= 10 AND (contains(t, ' và ') OR contains(t, ' giữa '))) AS broad, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) < 2 OR length(trim(text)) < 5 AS unclear FROM c""",
    "plain_form": r"SELECT conv_id, turn, trim(text) <> '' AND turn % 3 <> 1 AND NOT regexp_matches(text, '\[S\d+\]|(?i)<\s*(?:think|analysis|reasoning)\b|\[[^\]\n]+,\s*Trang\s+\d+\]') AS plain FROM conversations",
    "answer_clean": r"""WITH a AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(text) || ' .' || chr(10) || 'xong.' || chr(10), '\s+([,.;:!?])', '\1', 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ' || chr(9)) AS t FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, md5(CASE WHEN regexp_matches(t, '^[a-z]\s*([(=+\-*/^<>]|==|!=)') THEN t ELSE upper(t[1]) || t[2:] END) AS answer_md5 FROM a""",
    "legacy_vni_detect": rf"""WITH s AS (SELECT doc_id, text[1:4000] AS s FROM documents) SELECT doc_id, len(regexp_extract_all(s, '{L.MODERN}')) <= 2 AND (len(regexp_extract_all(' ' || regexp_replace(s, '([^\p{{L}}\p{{M}}\p{{N}}_])', '\1 ', 'g') || ' ', '(?i)[^\p{{L}}\p{{M}}\p{{N}}_]' || '{L.VNI_WORDS}'.replace('\b', '') || '[^\p{{L}}\p{{M}}\p{{N}}_]')) >= 2
OR (regexp_matches(s, '[ñÑöÖ]') AND len(regexp_extract_all(s, '(?i){L.VNI_PAIRS}')) >= 4)) AS vni FROM s""",
    "citation_claims": r"""WITH a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, ',\s', chr(2), 'g'), '([.!?])(\s|$)', chr(1), 'g') AS t FROM conversations WHERE role = 'assistant'),
m AS (SELECT conv_id, turn, string_split(regexp_replace(t, '\n+', chr(3), 'g'), chr(3)) AS ls FROM a), l AS (SELECT conv_id, turn, j, unnest(regexp_extract_all(ls[j], '[^\x01\x02]*[\x01\x02]')) AS c, unnest(range(0, len(regexp_extract_all(ls[j], '[^\x01\x02]*[\x01\x02]')))) AS k FROM (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS j FROM m)),
x AS (SELECT *, trim(regexp_replace(regexp_replace(c[:-2], '^\s*(?:[-*•]|\d+[.)]|[a-zA-Z][.)])\s*', ''), '^[ \t\r\n\-*•;,]+|[ \t\r\n\-*•;,]+$', '', 'g')) AS claim FROM l)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY j, k) - 1)::INT AS n, claim, CASE WHEN right(c, 1) = chr(2) THEN 'S2' ELSE 'S4' END AS tags FROM x WHERE regexp_matches(claim, '[\pL\pN_]')""",
    "ics_export": r"""WITH s AS (SELECT event_id, event_type, ts::DATE + ((3 - isodow(ts) + 7) % 7)::INT AS f, hour(ts) * 30 AS s FROM events)
SELECT event_id, array_to_string(['BEGIN:VEVENT', 'UID:' || event_id, 'DTSTART:' || strftime(f, '%Y%m%dT') || lpad((s // 60)::VARCHAR, 2, '0') || lpad((s % 60)::VARCHAR, 2, '0') || '00', 'DTEND:' || strftime(f, '%Y%m%dT') || lpad(((s + 90) // 60)::VARCHAR, 2, '0') || lpad(((s + 90) % 60)::VARCHAR, 2, '0') || '00', 'RRULE:FREQ=WEEKLY;UNTIL=20241231', 'SUMMARY:a\; b\, ' || event_type, 'END:VEVENT'], chr(13) || chr(10)) AS event FROM s""",
}
QUERIES = {f.__name__: f for f in (legacy_detect, legacy_vni_detect, legacy_decode, safety_guard, dialogue_intent, broad_queries, rescore_topk, answer_clean, plain_form, citation_claims, ics_export)}
