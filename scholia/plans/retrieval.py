"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators import retrieval as R
from scholia.sources.tables import table

TERMS = [["ther"], ["tion"], ["onsh"]]
WORDS = [["the"], ["theth"], ["eron"]]
PHRASE = [["of", "the"]]
VIEW = ["the", "of", "and", "onsh", "eron"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _out(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "score", F.col("rank").cast("int").alias("rank"))


def bm25_or_topk(spark: SparkSession, d: str) -> DataFrame:
    return _out(R.ranked(R.bm25(_docs(spark, d), WORDS, prefix=False), 50))


def bm25_prefix_topk(spark: SparkSession, d: str) -> DataFrame:
    return _out(R.ranked(R.bm25(_docs(spark, d), TERMS), 50))


def bm25_and_topk(spark: SparkSession, d: str) -> DataFrame:
    return _out(R.ranked(R.bm25(_docs(spark, d), TERMS, every=True), 50))


def bm25_phrase_topk(spark: SparkSession, d: str) -> DataFrame:
    return _out(R.ranked(R.bm25(_docs(spark, d), PHRASE), 50))


def multi_probe_first_seen(spark: SparkSession, d: str) -> DataFrame:
    probes = R.bm25_probes(_docs(spark, d), [(PHRASE, True, False), (TERMS, True, True), (TERMS, True, False)])
    return R.first_seen([R.ranked(p, 100) for p in probes])


def like_fallback(spark: SparkSession, d: str) -> DataFrame:
    return R.contains_any(_docs(spark, d), ["to", "thestor", "ciónes"], 50)


def scoped_search(spark: SparkSession, d: str) -> DataFrame:
    """The scope filter comes before the limit."""
    return _out(R.ranked(R.bm25(_docs(spark, d).where("source = 'src3'"), TERMS), 10))


def _vectors(spark: SparkSession, d: str, among: DataFrame | None = None, **limit) -> DataFrame:
    """Vectors' scores for each query: the rows whose id is divisible by 50 are queries, against all rows (or all of the ids ``among``)."""
    vectors = table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.cosine_all(vectors if among is None else vectors.join(among, "vec_id", "left_semi"), queries, **limit)


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.best_for_each(_vectors(spark, d, best=20), 20, "vec_id").select("query_id", "vec_id", "score", F.col("rank").cast("int").alias("rank"))


def cosine_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, least=0.3)


def _fused(spark: SparkSession, d: str, weight: float) -> DataFrame:
    """The keyword ranking, the same for every query vector that ranks any document, fused with each query vector's ranking of documents."""
    words = R.ranked(R.bm25(_docs(spark, d), TERMS), 100).select("doc_id", "rank")
    scored = _vectors(spark, d, _docs(spark, d).select(F.col("doc_id").alias("vec_id")), best=100).withColumnRenamed("vec_id", "doc_id")
    vectors = R.best_for_each(scored, 100, "doc_id").select("query_id", "doc_id", "rank")
    # the words go in beside each query's first row, so that the scores are computed once
    both = vectors.crossJoin(F.broadcast(words.agg(F.collect_list(F.struct("doc_id", "rank")).alias("words"))))
    own = F.array(F.struct("doc_id", "rank"))
    rows = both.select("query_id", F.explode(F.when(F.col("rank") == 1, F.concat(own, "words")).otherwise(own)).alias("x")).select("query_id", "x.*")
    return R.fuse([(rows, weight)], ["query_id", "doc_id"])


def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, 0.5)


def rrf_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, 1.0)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", "source", "text", (F.regexp_count("text", F.lit("the")) / (F.length("text") + 1.0)).alias("score"))


def dedupe_text_keep_best(spark: SparkSession, d: str) -> DataFrame:
    return R.dedupe_text(_scored(spark, d)).select("doc_id", F.round("score", 9).alias("score"))


def per_source_cap_backfill(spark: SparkSession, d: str) -> DataFrame:
    kept = R.diversify(_scored(spark, d), "source", 2, 40)
    return kept.select("doc_id", "source", F.col("position").cast("int").alias("position"))


def interleave_compare(spark: SparkSession, d: str) -> DataFrame:
    left, right = (R.ranked(p, 20) for p in R.bm25_probes(_docs(spark, d), [([["ther"]], True, False), ([["tion"]], True, False)]))
    return R.interleave(left, right).select("doc_id", F.col("position").cast("int").alias("position"))


def facet_first_seen(spark: SparkSession, d: str) -> DataFrame:
    probes = R.bm25_probes(_docs(spark, d), [([[f]], True, False) for f in ("ther", "tion", "onsh", "eron")])
    return R.first_seen([R.ranked(p, 6) for p in probes]).select("doc_id", "probe")


def lexical_coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    return R.coverage(_docs(spark, d), VIEW)


def partial_evidence(spark: SparkSession, d: str) -> DataFrame:
    return R.one_side_only(_docs(spark, d), "of the", "der nothing")


def concept_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", R.holds_concept(F.col("text"), "in the").alias("held"))


_TOKS = r"tok AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS toks FROM documents)"


def _bm25_sql(name: str, phrases: list[list[str]], prefix: bool = True, every: bool = False, where: str = "true") -> str:
    """CTEs name_c (counts) and name (doc_id, score), by joins and list functions of DuckDB."""
    cols = []
    for i, p in enumerate(phrases):
        if len(p) == 1:
            test = f"starts_with(x, '{p[0]}')" if prefix else f"x = '{p[0]}'"
            cols.append(f"len(list_filter(toks, lambda x: {test})) AS tf{i}")
        else:
            lst = "[" + ", ".join(f"'{w}'" for w in p) + "]"
            cols.append(f"len(list_filter(range(1, greatest(len(toks) - {len(p)} + 1, 1) + 1), lambda j: toks[j:j + {len(p) - 1}] = {lst})) AS tf{i}")
    idf = [f"(CASE WHEN ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) END)" for i in range(len(phrases))]
    score = " + ".join(f"{idf[i]} * (tf{i} * 2.2::DOUBLE) / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(phrases)))
    hit = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(len(phrases)))
    stats = ", ".join(f"count(*) FILTER (tf{i} > 0) AS n{i}" for i in range(len(phrases)))
    return f"""{name}_c AS (SELECT doc_id, len(toks) AS dl, {', '.join(cols)} FROM tok WHERE {where}),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {stats} FROM {name}_c),
{name} AS (SELECT doc_id, round(-({score}), 6) AS score FROM {name}_c, {name}_s WHERE {hit})"""


def _ranked_sql(name: str, k: int, desc: bool = False, key: str = "doc_id") -> str:
    return f"(SELECT {key}, score, (row_number() OVER (ORDER BY score {'DESC' if desc else 'ASC'}, {key}))::INT AS rank FROM {name} QUALIFY rank <= {k})"


_COS = """q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
cosine AS (SELECT query_id, vec_id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 6) AS score FROM embeddings, q)"""


def _best_sql(name: str, k: int, key: str) -> str:
    return f"(SELECT query_id, {key}, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}))::INT AS rank FROM {name} QUALIFY rank <= {k})"


def _rrf_sql(weight: float) -> str:
    return f"""WITH {_TOKS}, {_bm25_sql('b', TERMS)}, {_COS},
w AS {_ranked_sql('b', 100)}, vc AS (SELECT query_id, vec_id AS doc_id, score FROM cosine WHERE vec_id IN (SELECT doc_id FROM documents)), v AS {_best_sql('vc', 100, 'doc_id')}
SELECT query_id, doc_id, round(sum(part), 9) AS score FROM (SELECT query_id, doc_id, {weight}::DOUBLE / (60 + rank) AS part FROM w, (SELECT DISTINCT query_id FROM v) UNION ALL SELECT query_id, doc_id, {weight}::DOUBLE / (60 + rank) FROM v) GROUP BY query_id, doc_id"""


_SCORED = "sc AS (SELECT doc_id, source, text, len(regexp_extract_all(text, 'the')) / (length(text) + 1.0::DOUBLE) AS score FROM documents)"

ORACLES = {
    "bm25_or_topk": f"WITH {_TOKS}, {_bm25_sql('b', WORDS, prefix=False)} SELECT * FROM {_ranked_sql('b', 50)}",
    "bm25_prefix_topk": f"WITH {_TOKS}, {_bm25_sql('b', TERMS)} SELECT * FROM {_ranked_sql('b', 50)}",
    "bm25_and_topk": f"WITH {_TOKS}, {_bm25_sql('b', TERMS, every=True)} SELECT * FROM {_ranked_sql('b', 50)}",
    "bm25_phrase_topk": f"WITH {_TOKS}, {_bm25_sql('b', PHRASE)} SELECT * FROM {_ranked_sql('b', 50)}",
    "multi_probe_first_seen": f"""WITH {_TOKS}, {_bm25_sql('a', PHRASE)}, {_bm25_sql('b', TERMS, every=True)}, {_bm25_sql('c', TERMS)},
u AS (SELECT doc_id, score, 1 AS probe FROM {_ranked_sql('a', 100)} UNION ALL SELECT doc_id, score, 2 FROM {_ranked_sql('b', 100)} UNION ALL SELECT doc_id, score, 3 FROM {_ranked_sql('c', 100)})
SELECT doc_id, probe::INT AS probe, score FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY probe) = 1""",
    "like_fallback": "SELECT doc_id FROM documents WHERE lower(text) LIKE '%thestor%' OR lower(text) LIKE '%ciónes%' ORDER BY doc_id LIMIT 50",
    "scoped_search": f"WITH {_TOKS}, {_bm25_sql('b', TERMS, where="source = 'src3'")} SELECT * FROM {_ranked_sql('b', 10)}",
    "cosine_topk": f"WITH {_COS} SELECT * FROM {_best_sql('cosine', 20, 'vec_id')}",
    "cosine_threshold": f"WITH {_COS} SELECT * FROM cosine WHERE score >= 0.3",
    "rrf_weighted": _rrf_sql(0.5),
    "rrf_unweighted": _rrf_sql(1.0),
    "dedupe_text_keep_best": rf"WITH {_SCORED} SELECT doc_id, round(score, 9) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '[\s\x{{00A0}}]+', ' ', 'g'))) ORDER BY score DESC, doc_id) = 1",
    "per_source_cap_backfill": f"""WITH {_SCORED}, p AS (SELECT doc_id, source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) > 2 AS spare FROM sc)
SELECT doc_id, source, (row_number() OVER (ORDER BY spare, score DESC, doc_id))::INT AS position FROM p QUALIFY position <= 40""",
    "interleave_compare": f"""WITH {_TOKS}, {_bm25_sql('a', [['ther']])}, {_bm25_sql('b', [['tion']])},
u AS (SELECT doc_id, rank, 0 AS side FROM {_ranked_sql('a', 20)} UNION ALL SELECT doc_id, rank, 1 FROM {_ranked_sql('b', 20)}),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank, side) = 1)
SELECT doc_id, (row_number() OVER (ORDER BY rank, side))::INT AS position FROM f""",
    "facet_first_seen": "WITH " + _TOKS + ", " + ", ".join(_bm25_sql(f"f{i}", [[w]]) for i, w in enumerate(("ther", "tion", "onsh", "eron"))) + "\nSELECT doc_id, min(probe)::INT AS probe FROM (" + " UNION ALL ".join(f"SELECT doc_id, {i + 1} AS probe FROM {_ranked_sql(f'f{i}', 6)}" for i in range(4)) + ") GROUP BY doc_id",
    "lexical_coverage_gate": f"WITH {_TOKS}, c AS (SELECT doc_id, round(len(list_intersect(toks, ['the', 'of', 'and', 'onsh', 'eron'])) / 5.0::DOUBLE, 6) AS covered FROM tok) SELECT doc_id, covered, covered < 0.75 AS weak FROM c",
    "partial_evidence": rf"""WITH j AS (SELECT ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS t FROM documents),
c AS (SELECT count(*) FILTER (contains(t, ' of the ') OR (contains(t, ' of ') AND contains(t, ' the '))) AS left_hits, count(*) FILTER (contains(t, ' der nothing ') OR (contains(t, ' der ') AND contains(t, ' nothing '))) AS right_hits FROM j)
SELECT left_hits, right_hits, (left_hits > 0) <> (right_hits > 0) AS partial FROM c""",
    "concept_evidence": r"WITH j AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents) SELECT doc_id, contains(t, ' in the ') OR (contains(t, ' in ') AND contains(t, ' the ')) AS held FROM j",
}
QUERIES = {f.__name__: f for f in (bm25_or_topk, bm25_prefix_topk, bm25_and_topk, bm25_phrase_topk, multi_probe_first_seen, like_fallback, scoped_search, cosine_topk, cosine_threshold, rrf_weighted, rrf_unweighted, dedupe_text_keep_best, per_source_cap_backfill, interleave_compare, facet_first_seen, lexical_coverage_gate, partial_evidence, concept_evidence)}
