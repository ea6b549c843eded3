"""Curation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions.text import cited, hash_mod
from scholia.operators import curation as C
from scholia.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _names(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", "source", C.content_hash(F.col("text")).alias("digest"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("name"))


def exact_content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return C.first_per_content(_docs(spark, d))


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return C.first_per_content(_docs(spark, d)).where("copies > 1")


def canonical_per_hash(spark: SparkSession, d: str) -> DataFrame:
    return C.canonical_names(_names(spark, d), "name")


def holdout_alias_exclusion(spark: SparkSession, d: str) -> DataFrame:
    names = _names(spark, d)
    return C.without_aliases(names, names.where("source = 'src7'")).select("doc_id")


def book_holdout(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("source", "lang").distinct()
    book = F.concat_ws(":", "source", "lang")
    return rows.select("source", "lang", ((hash_mod(book, 10) == 0) | ((F.col("lang") == "en") & (hash_mod(book, 7) == 0))).alias("held"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return C.split(_docs(spark, d).select("doc_id", "source"), F.concat(F.col("source"), F.lit(":"), F.floor(F.col("doc_id") / 15).cast("string")))


def hash_split_85_15(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("doc_id", "group", "partition")


def split_leak_check(spark: SparkSession, d: str) -> DataFrame:
    """Split by document, groups that leak: here the group is the content."""
    rows = C.split(_names(spark, d), F.col("name"))
    return C.leaking_groups(rows.withColumn("group", F.col("digest")))


def release_gate(spark: SparkSession, d: str) -> DataFrame:
    return C.release_gates(_split(spark, d), {"train": 500, "valid": 50, "groups": 100})


def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.stride(_docs(spark, d).select("doc_id", "source"), "source", "doc_id", 16)


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return C.round_robin(_docs(spark, d).select("doc_id", "source"), "source", "doc_id", 100).select("doc_id", "source", F.col("position").cast("int").alias("position"))


def adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.adjacent_pairs(_docs(spark, d).select("doc_id", "source", (F.col("doc_id") / 10).cast("long").alias("page")), "source", "page", "doc_id")


def cross_language_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", "lang", "source", (F.col("doc_id") % 50).alias("theme"))
    return C.cross_pairs(rows, "theme", "lang", "source", "doc_id")


def train_minus_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = C.split(_names(spark, d), F.col("name"))
    held = rows.where("partition = 'valid'").select("digest").distinct()
    return rows.where("partition = 'train'").join(held, "digest", "left_anti").select("doc_id")


def benchmark_contamination(spark: SparkSession, d: str) -> DataFrame:
    return C.holding(_docs(spark, d), table(spark, d, "benchmark"))


def number_grounding(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return turns.select("conv_id", "turn", F.size(C.ungrounded(F.col("text"), before)).cast("long").alias("ungrounded"))


def exposure_balance(spark: SparkSession, d: str) -> DataFrame:
    return C.exposure(_docs(spark, d).select("lang", "source", "n_chars"), "lang", "n_chars", "source", 0.5 / 6, 1.5 / 6)


def accuracy_exact(spark: SparkSession, d: str) -> DataFrame:
    """Share of labelled documents whose length guess of quality is right."""
    docs = _docs(spark, d).select("doc_id", "lang", F.when(F.col("n_chars") > 200, "1").otherwise("0").alias("predicted"))
    rows = docs.join(table(spark, d, "labels"), "doc_id")
    right = (F.trim("predicted") == F.trim(F.col("quality").cast("string"))).cast("double")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


def paired_regressions(spark: SparkSession, d: str) -> DataFrame:
    """Base passes by label, candidate by a length rule: gains, regressions and the decision of promotion."""
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("base"), (F.col("n_chars") > 500).alias("candidate"))
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("base").alias("base_pass"), F.count_if("candidate").alias("candidate_pass"), F.count_if(F.col("base") & ~F.col("candidate")).alias("regressions"))
    gain = (F.col("candidate_pass") - F.col("base_pass")) / F.col("n")
    return per.withColumn("gain", F.round(gain, 3)).withColumn("promoted", (gain >= 0.05) & (F.col("candidate_pass") / F.col("n") >= 0.8) & (F.col("regressions") == 0))


def citation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Answers with tags made from the turn's number: cited set, tags within the sources, set equality."""
    turns = table(spark, d, "conversations").where("role = 'assistant'")
    answer = F.concat(F.col("text"), F.lit(" [S1] [S"), (F.col("turn") % 4).cast("string"), F.lit("]"))
    known = F.array(F.lit("S1"), F.lit("S2"))
    rows = turns.select("conv_id", "turn", cited(answer).alias("tags"))
    return rows.select("conv_id", "turn", F.array_join("tags", ",").alias("cited"), ((F.size("tags") > 0) & (F.size(F.array_except("tags", known)) == 0)).alias("tags_valid"), (F.col("tags") == known).alias("citation_valid"))


def source_signature(spark: SparkSession, d: str) -> DataFrame:
    """One signature a source: the hash of its contents' hashes, summed in four parts, so order-free and of a few numbers a source."""
    h = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return _docs(spark, d).groupBy("source").agg(F.sha2(F.concat_ws(":", *parts), 256).alias("signature"))


_N = "n AS (SELECT doc_id, source, sha256(text) AS digest, source || '/' || doc_id AS name FROM documents)"


def _mod(text: str, m: int) -> str:
    return f"list_reduce(list_prepend(0, [instr('0123456789abcdef', x) - 1 for x in string_split(sha256({text}), '')]), lambda a, x: (a * 16 + x) % {m})"


_PART = f"CASE WHEN {_mod('grp', 100)} < 15 THEN 'valid' ELSE 'train' END"
_SPLIT = f"s AS (SELECT doc_id, grp AS \"group\", {_PART} AS \"partition\" FROM (SELECT doc_id, source || ':' || (doc_id // 15) AS grp FROM documents))"
_BYNAME = f"s AS (SELECT doc_id, digest, {_PART} AS part FROM (SELECT *, name AS grp FROM n))"

ORACLES = {
    "exact_content_dedupe": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "duplicate_groups": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "canonical_per_hash": f"WITH {_N} SELECT digest, name AS canonical FROM n QUALIFY row_number() OVER (PARTITION BY digest ORDER BY length(name), name) = 1",
    "holdout_alias_exclusion": f"WITH {_N} SELECT doc_id FROM n WHERE digest NOT IN (SELECT digest FROM n WHERE source = 'src7')",
    "book_holdout": f"SELECT source, lang, {_mod('b', 10)} = 0 OR (lang = 'en' AND {_mod('b', 7)} = 0) AS held FROM (SELECT DISTINCT source, lang, source || ':' || lang AS b FROM documents)",
    "hash_split_85_15": f"WITH {_SPLIT} SELECT * FROM s",
    "split_leak_check": f"WITH {_N}, {_BYNAME} SELECT digest AS \"group\", count(DISTINCT part) AS partitions FROM s GROUP BY 1 HAVING count(DISTINCT part) > 1",
    "release_gate": f"WITH {_SPLIT}, c AS (SELECT count(*) FILTER (\"partition\" = 'train') AS train, count(*) FILTER (\"partition\" = 'valid') AS valid, count(DISTINCT \"group\") AS groups FROM s), l AS (SELECT count(*) AS shared_groups FROM (SELECT \"group\" FROM s GROUP BY 1 HAVING count(DISTINCT \"partition\") > 1)) SELECT *, train >= 500 AND valid >= 50 AND groups >= 100 AND shared_groups = 0 AS release FROM c, l",
    "stride_sample": "WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY source) // 16) AS s FROM documents) SELECT doc_id, source, (i // s)::INT AS place FROM p WHERE i % s = 0 AND i // s < 16",
    "round_robin": "WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS t FROM documents) SELECT doc_id, source, (row_number() OVER (ORDER BY t, source))::INT AS position FROM p QUALIFY position <= 100",
    "adjacent_pairs": "WITH p AS (SELECT source, doc_id AS first, lead(doc_id) OVER w AS second, lead(doc_id // 10) OVER w - doc_id // 10 AS gap FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id // 10, doc_id)) SELECT source, first, second FROM p WHERE gap <= 2",
    "cross_language_pairs": "WITH f AS (SELECT doc_id % 50 AS theme, lang, source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 50, lang ORDER BY doc_id) = 1) SELECT a.theme, a.doc_id AS \"left\", b.doc_id AS \"right\" FROM f a JOIN f b ON a.theme = b.theme AND a.lang < b.lang AND a.source <> b.source",
    "train_minus_valid": f"WITH {_N}, {_BYNAME} SELECT doc_id FROM s WHERE part = 'train' AND digest NOT IN (SELECT digest FROM s WHERE part = 'valid')",
    "benchmark_contamination": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "number_grounding": r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '\d+(?:[.,]\d+)*') AS a, regexp_extract_all(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '\d+(?:[.,]\d+)*') AS b FROM conversations)
SELECT conv_id, turn, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS ungrounded FROM t""",
    "exposure_balance": """WITH s AS (SELECT lang, source, sum(n_chars) AS w FROM documents GROUP BY 1, 2), g AS (SELECT lang, sum(w)::BIGINT AS total, count(*) AS sources, max(w)::BIGINT AS largest FROM s GROUP BY 1), a AS (SELECT *, sum(total) OVER ()::DOUBLE AS whole FROM g)
SELECT lang, round(total / whole, 6) AS share, sources, round(largest / total, 6) AS top_share, total / whole BETWEEN 0.5::DOUBLE / 6 AND 1.5::DOUBLE / 6 AND sources >= 2 AND largest * 2 <= total AS balanced FROM a""",
    "accuracy_exact": "SELECT lang, count(*) AS n, round(avg(((CASE WHEN n_chars > 200 THEN 1 ELSE 0 END) = quality)::INT), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "paired_regressions": """WITH p AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS base_pass, count(*) FILTER (n_chars > 500) AS candidate_pass, count(*) FILTER (quality = 1 AND n_chars <= 500) AS regressions FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT *, round((candidate_pass - base_pass) / n, 3) AS gain, (candidate_pass - base_pass) / n >= 0.05 AND candidate_pass / n >= 0.8 AND regressions = 0 AS promoted FROM p""",
    "citation_metrics": r"""WITH c AS (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(text || ' [S1] [S' || (turn % 4) || ']', '\[(S\d+)\]', 1))) AS tags FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, array_to_string(tags, ',') AS cited, len(tags) > 0 AND list_has_all(['S1', 'S2'], tags) AS tags_valid, tags = ['S1', 'S2'] AS citation_valid FROM c""",
    "source_signature": "SELECT source, sha256(concat_ws(':', " + ", ".join(f"sum(('0x' || substr(md5(text), {1 + 8 * i}, 8))::BIGINT)" for i in range(4)) + ")) AS signature FROM documents GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (exact_content_dedupe, duplicate_groups, canonical_per_hash, holdout_alias_exclusion, book_holdout, hash_split_85_15, split_leak_check, release_gate, stride_sample, round_robin, adjacent_pairs, cross_language_pairs, train_minus_valid, benchmark_contamination, number_grounding, exposure_balance, accuracy_exact, paired_regressions, citation_metrics, source_signature)}
