"""Queries against their SQL, run by DuckDB, on small tables of inputs that the given tables lack."""

import random

import duckdb

import __spark_entry__ as entry


def both(spark, folder, name, **tables):
    """The sorted rows of the query and those of its SQL on tables given as (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    ordered = lambda found: sorted((tuple(r) for r in found), key=repr)
    return ordered(entry.queries()[name](spark, str(folder)).collect()), ordered(con.execute(entry.oracle_sql()[name]).fetchall())


def test_rewrite_guard(spark, tmp_path):
    """Capitals of ß and of other letters without a capital of one character change neither a text's length nor its words."""
    said = ["Bepfß enßbeie gepfpf chtzüpf. Ieachß.", "ßß ßß", "ŉ ǰ ﬁ", "Straße STRASSE", "½", "² x", "ⓐⓑ", "‿", "?", "", None, "never \U0001f600 say", "Not 7 or 77", "đường", "ab c", "x" * 12, "É é"]
    rows = [(4 * i + k, 0, "user", t) for i, t in enumerate(said) for k in range(4)] + [(999, 0, "system", "x")]
    got, want = both(spark, tmp_path, "rewrite_guard", conversations=(rows, "conv_id long, turn long, role string, text string"))
    assert len(got) == 4 * len(said) and got == want
    assert {(0, 0, True), (4, 0, True), (16, 0, True), (24, 0, False)} <= set(got)


def test_span_resolution(spark, tmp_path):
    """A text's own quotes and brackets at a span's ends, and white space that parts no words, are the span's."""
    r = random.Random(4)
    edge = ["", "", "", '"', "'", "«", "»", "“", "”", "[", "]", "(", ")", ",", "\t", "\r", "\u00a0", "\u2028", "’", "\\", "$1", "\U0001f600"]
    texts = ["".join(r.choice(edge) + f"w{r.randrange(10**6)}" * r.choice([0, 1, 1, 1]) + r.choice(edge) + r.choice([" ", "  ", "\n", " \n"]) for _ in range(r.randrange(3, 16))) for _ in range(800)]
    texts += [t for t in ('a b c "d" e "f"', "a b c [d e]", "a b c (d) (e)", "one two three\tfour\r\nfive\r\nsix\r", 'a b c "', "", " \n", None) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got, want = both(spark, tmp_path, "span_resolution", documents=(rows, "doc_id long, text string"))
    assert len(got) > 700 and sum(x[1] is not None for x in got) > 400 and got == want


def test_cosine_threshold(spark, tmp_path):
    """Every pair that meets the threshold, in any block and part: scores at the limit, copies, repeated and null ids, floats of every size."""
    r = random.Random(8)
    sizes = [1.0, 1.0, 1e-44, 1e-30, 1e30]
    vectors = [[r.choice([-1, 0, 1, 1]) * s for _ in range(10)] for _ in range(2500) for s in [r.choice(sizes)]]
    rows = [(i, v if any(v) else None) for i, v in enumerate(vectors)] + [(0, [1.0] * 10), (0, [1.0] * 10), (None, [1.0] * 10), (-50, [1.0] * 10)]
    got, want = both(spark, tmp_path, "cosine_threshold", embeddings=(rows, "vec_id long, embedding array<float>"))
    assert len(got) > 20_000 and {0.3, 0.316228} & {x[2] for x in got} and got == want
