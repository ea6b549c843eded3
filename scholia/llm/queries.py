"""The queries of the subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import decontaminate, exact_dedup, fill_middle, langid, line_dedup, merkle, mixing, quality, quality_rules, secrets, sharding, simhash, tokens
from scholia.llm.common import documents


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate for a secret in documents, with the forest's score."""
    return secrets.scan(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being of good quality, by a network learned from the labels that are not held out."""
    docs = documents(spark, sf_dir)
    return quality.classify(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by models learned from the documents that are not held out."""
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.learn(docs))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, edited by a fifth of its characters at most, and which."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of 4-word shingles and its component of fingerprints within 4 bits."""
    return simhash.near_dedup(documents(spark, sf_dir))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, words and greedy word pieces."""
    return tokens.token_counts(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, with its source's size and target."""
    return mixing.mix(documents(spark, sf_dir)).drop("source")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its group of equal texts."""
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet").withColumnRenamed("digest", "text_sha256")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 40 shards by the hash tree; with where each would be on 41."""
    return sharding.shard_documents(documents(spark, sf_dir))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the copies of runs of lines that occur earlier."""
    return line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, and whether it stays once lines that many documents of its source share are gone."""
    return quality_rules.judge(documents(spark, sf_dir))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots, proof, and the root that it leads to after some were tampered with."""
    return merkle.audit_documents(documents(spark, sf_dir))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, cuts and digests of what is written and of what it is restored to."""
    made = fill_middle.restored(fill_middle.fill_middle(documents(spark, sf_dir)))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: Windows and lines as rows; lines by their text, not by a digest.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT i, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT i, p, CASE WHEN p + 7 <= len(ws) THEN array_to_string(ws[p:p + 7], ' ') END AS g FROM (SELECT i, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
c AS (SELECT i, p, g IS NOT NULL AND count(*) OVER (PARTITION BY i, g) > 1 AS twice FROM p),
v AS (SELECT i, max(twice) OVER (PARTITION BY i ORDER BY p ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM c),
r AS (SELECT i, count(*) FILTER (covered) AS n_repeat_words FROM v GROUP BY 1),
l AS (SELECT i, host, t, line, trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS normal
  FROM (SELECT i, host, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT i, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY 1),
h AS (SELECT host, count(DISTINCT t) AS texts FROM d GROUP BY 1),
f AS (SELECT host, normal FROM l JOIN h USING (host) GROUP BY host, normal, texts HAVING count(DISTINCT t) > greatest(10, 0.01 * texts)),
g AS (SELECT i, sum(len(string_split(normal, ' '))) AS gone FROM l JOIN f USING (host, normal) GROUP BY 1),
b AS (SELECT i, doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_frequent_words
  FROM d JOIN w USING (i) LEFT JOIN r USING (i) LEFT JOIN u USING (i) LEFT JOIN g USING (i)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_frequent_words >= 10 AND n_words - n_frequent_words >= 0.3 * n_words AS kept, n_frequent_words FROM j
"""

#: Tokens as a list, parts as slices of it.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts, list_transform([1, 9, 17, 25], lambda z: ('0x' || substr(h, z, 8))::BIGINT) AS hs FROM d),
c AS (SELECT *, len(ts) AS n, least(hs[1] % (len(ts) + 1), hs[2] % (len(ts) + 1)) AS a, greatest(hs[1] % (len(ts) + 1), hs[2] % (len(ts) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 50 THEN 'plain' WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT *, coalesce(array_to_string(ts[:a], ''), '') AS p, coalesce(array_to_string(ts[a + 1:b], ''), '') AS m, coalesce(array_to_string(ts[b + 1:], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256 FROM x
"""


def crc_table() -> str:
    """The 256 checksums of one byte, as a list for SQL."""
    crc = []
    for n in range(256):
        c = n
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        crc.append(c)
    return "[" + ", ".join(map(str, crc)) + "]::BIGINT[]"


def op12_sql(levels: int = 26, upper: int = 8) -> str:
    """Level by level as grouped queries, for groups of up to 2 ** ``levels`` rows and 2 ** ``upper`` groups."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda n: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    crc = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    ctes = [
        f"tab AS (SELECT {crc_table()} AS tab)",
        f"d AS (SELECT doc_id, lang, coalesce('=' || lang, '-') AS g, {leaf('n_chars')} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {leaf('(n_chars::HUGEINT + 1)')} ELSE {leaf('n_chars')} END AS claim FROM documents, tab)",
        "r AS (SELECT row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, * FROM d)",
        "t0 AS (SELECT g, i, leaf AS h FROM r)",
        "p0 AS (SELECT id, doc_id, g, i, leaf, claim AS f, '' AS s FROM r)",
    ]

    def climb(t: str, p: str, n: int) -> None:
        for k in range(n):
            ctes.append(f"{t}{k + 1} AS (SELECT g, i // 2 AS i, CASE WHEN max(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {t}{k}) GROUP BY g, i // 2)")
            ctes.append(
                f"{p}{k + 1} AS (SELECT id, doc_id, p.g, p.i // 2 AS i, leaf, CASE WHEN c = 1 THEN f WHEN o.h IS NULL THEN sha256(f) WHEN o.i < p.i THEN sha256(o.h || f) ELSE sha256(f || o.h) END AS f, s || coalesce(o.h, '') AS s "
                f"FROM {p}{k} p JOIN (SELECT g, count(*) AS c FROM {t}{k} GROUP BY 1) n ON p.g = n.g LEFT JOIN {t}{k} o ON o.g = p.g AND o.i = xor(p.i, 1))"
            )

    climb("t", "p", levels)
    ctes += [
        f"s AS (SELECT g AS name, h FROM t{levels})",
        "x AS (SELECT name, h, row_number() OVER (ORDER BY name) - 1 AS i FROM s)",
        "y0 AS (SELECT 0 AS g, i, h FROM x)",
        f"q0 AS (SELECT id, doc_id, 0 AS g, x.i, leaf, f, s FROM p{levels} JOIN x ON x.name = p{levels}.g)",
    ]
    climb("y", "q", upper)
    return "WITH " + ",\n".join(ctes) + f"\nSELECT r.doc_id, r.leaf, x.h AS subroot, y.h AS root, sha256(q.s) AS proof_sha256, q.f AS folded_root, q.f = y.h AS verified FROM r JOIN q{upper} q USING (id) JOIN x ON x.name = r.g, y{upper} y"


#: Targets by sorted limits, every quotient ranked, blocks drawn by the same MD5.
OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
ss AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, sum(source_size) OVER () AS total FROM ss),
o AS (SELECT *, source_size * 3.0::DOUBLE AS lim, (total - coalesce(sum(source_size * 3.0::DOUBLE) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w WINDOW b AS (ORDER BY source_size * 3.0::DOUBLE / weight, source)),
rt AS (SELECT arg_min(rate, lim / weight) FILTER (lim >= rate * weight) AS rate FROM o),
t AS (SELECT source, source_size, total::BIGINT AS total, least(weight * (SELECT rate FROM rt), lim) AS target, 64 AS words FROM o),
c AS (SELECT *, CASE WHEN source_size > 0 THEN target * ceil(source_size / words) / source_size ELSE 0 END AS claim FROM t),
q AS (SELECT source, k, claim / (2 * k + 1) AS x FROM (SELECT source, claim, unnest(range(0, claim::BIGINT + 50)) AS k FROM c)),
g AS (SELECT source, count(*) AS seats FROM (SELECT source, row_number() OVER (ORDER BY x DESC, source, k) AS n FROM q) WHERE n <= (SELECT round_even(sum(claim), 0) FROM c) GROUP BY 1),
sh AS (SELECT source, seats, s AS shard, least(4096, b - s * 4096)::BIGINT AS n FROM (SELECT c.source, coalesce(seats, 0) AS seats, ceil(source_size / words)::BIGINT AS b FROM c LEFT JOIN g ON c.source IS NOT DISTINCT FROM g.source) x, LATERAL (SELECT unnest(range(0, (b + 4095) // 4096)) AS s) r),
hq AS (SELECT source, shard, seats, k, n / (2 * k + 1) AS x FROM (SELECT *, unnest(range(0, 3 * n + 50)) AS k FROM sh)),
hg AS (SELECT source, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY x DESC, shard, k) AS r FROM hq) WHERE r <= seats GROUP BY 1, 2),
bl AS (SELECT sh.source, sh.shard, n, least(coalesce(quota, 0), 3 * n) AS quota, sh.shard * 4096 + j AS block FROM sh LEFT JOIN hg ON sh.source IS NOT DISTINCT FROM hg.source AND sh.shard = hg.shard, range(0, 4096) r(j) WHERE j < n),
ti AS (SELECT source, block, quota // n + (row_number() OVER (PARTITION BY source, shard ORDER BY ('0x' || substr(md5('mix:' || coalesce(source, 'null') || ':' || block), 1, 13))::BIGINT, block) <= quota % n)::INT AS times FROM bl),
p AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('mix-order:' || doc_id), 1, 13))::BIGINT, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM d),
e AS (SELECT i, p.source, start, size, words, unnest(range(start // words, (start + size - 1) // words + 1)) AS block FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source WHERE size > 0),
k AS (SELECT i, sum((least(start + size, (e.block + 1) * words) - greatest(start, e.block * words)) * coalesce(times, 0))::BIGINT AS taken FROM e LEFT JOIN ti ON e.source IS NOT DISTINCT FROM ti.source AND e.block = ti.block GROUP BY 1)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON d.i = k.i
"""

#: Runs of up to ten lines (each has a word, so ten words need no more) against their first occurrence.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
h AS (SELECT doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '[^\x20\x09-\x0D]')) AS ix FROM d),
s AS (SELECT doc_id, ls, ix, unnest(range(1, len(ix) + 1)) AS a FROM h),
r AS (SELECT doc_id, ls, ix, a, unnest(range(a, least(len(ix), a + 9) + 1)) AS b FROM s),
k AS (SELECT doc_id, a, ix[a:b] AS run, array_to_string(list_transform(ix[a:b], lambda i: ls[i]), chr(10)) AS body FROM r),
w AS (SELECT doc_id, a, run, md5(body) AS m, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words FROM k),
f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(a) OVER o AS fa FROM w WINDOW o AS (PARTITION BY m ORDER BY doc_id, a)),
g AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(run) AS i FROM f WHERE words >= 10 AND (fd <> doc_id OR fa <> a)) GROUP BY 1)
SELECT d.doc_id, array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: ls[i]), chr(10)) AS text,
len(ls)::INT AS n_lines, coalesce(len(gone), 0)::INT AS n_removed FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def op9_sql() -> str:
    """The same descent as nested minima, with the checksum as a fold over bytes."""

    def draw(name: str, weight: float) -> str:
        return f"-ln((('0x' || substr(md5('tree:' || doc_id || ':{name}'), 1, 13))::BIGINT + 0.5) / {16**13}.0) / {weight}"

    def best(nodes: list[tuple[str, float, int]]) -> str:
        return f"list_min([{', '.join(f'{{d: {draw(name, weight)}, n: {node}}}' for name, weight, node in nodes)}]).n"

    def levels(shards: int, out: str) -> list[str]:
        inner = sharding._levels(sharding.tree(shards))
        case = lambda at: f"CASE {' '.join(f'WHEN {at} = {i} THEN {best(c)}' for i, c in enumerate(inner) if i)} ELSE {at} END"
        return [f"{out}0 AS (SELECT doc_id, i, {best(inner[0])} AS n FROM d)", f"{out}1 AS (SELECT doc_id, i, {case('n')} AS n FROM {out}0)", f"{out} AS (SELECT i, -1 - ({case('n')}) AS n FROM {out}1)"]

    place = {s.shard: s for s in sharding.tree(40)}
    listed = lambda name: "[" + ", ".join(str(getattr(place[n], name)) for n in range(40)) + "]"
    table = crc_table()
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents), tab AS (SELECT {table} AS tab),
c AS (SELECT i, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM d, tab),
{', '.join(levels(40, 'now') + levels(41, 'grown'))},
r AS (SELECT d.doc_id, strlen(t) + 16 AS size, crc AS text_crc32, now.n::INT AS shard, grown.n::INT AS grown_shard, ('0x' || substr(md5('slot:' || d.doc_id), 1, 6))::INT % 512 AS b FROM d JOIN c USING (i) JOIN now USING (i) JOIN grown USING (i))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY b, doc_id, text_crc32, size) - 1 AS slot, grown_shard, {listed('region')}[shard + 1] AS region, {listed('rack')}[shard + 1] AS rack FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_quality, op3_langid, op4_decontaminate, op5_simhash, op6_tokens, op7_mixing, op8_exact_dedup, op9_sharding, op10_line_dedup, op11_quality_rules, op12_merkle, op13_fill_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": OP8_SQL, "op7_mixing": OP7_SQL, "op9_sharding": op9_sql(), "op10_line_dedup": OP10_SQL, "op11_quality_rules": OP11_SQL, "op12_merkle": op12_sql(), "op13_fill_middle": OP13_SQL}
