"""Queries over conversations, events, names and the relational core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators import stores as S
from scholia.sources.tables import table


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def session_list(spark: SparkSession, d: str) -> DataFrame:
    return S.session_list(_turns(spark, d), limit=20, offset=5)


def session_search(spark: SparkSession, d: str) -> DataFrame:
    return S.session_search(_turns(spark, d), "The ")


def session_context(spark: SparkSession, d: str) -> DataFrame:
    return S.recall(_turns(spark, d), ["the", "of", "and", "in"])


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.turn_pairs(_turns(spark, d))


def even_sample_turns(spark: SparkSession, d: str) -> DataFrame:
    return S.even_sample(_turns(spark, d).select("conv_id", "turn"), "conv_id", "turn", 4)


def idempotent_turns(spark: SparkSession, d: str) -> DataFrame:
    """Even turns are stored; all arrive again, twice."""
    turns = _turns(spark, d).select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("request_id"))
    stored = turns.where("turn % 2 = 0").select("conv_id", "request_id", (F.col("turn") + 1).alias("turn_index"))
    return S.append_turns(stored, turns.unionByName(turns), "conv_id", "request_id", "turn").select("conv_id", "request_id", "turn_index")


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d).select("conv_id", "turn", F.octet_length("text").cast("long").alias("size"))
    return S.pack(turns, 600).select("conv_id", "turn", "used")


def delete_sessions(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    return turns.join(turns.where("role = 'system'").select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "turn")


def overlap_conflicts(spark: SparkSession, d: str) -> DataFrame:
    slots = table(spark, d, "events").select("event_id", "user_id", (F.weekday("ts") + 1).alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("start"))
    slots = slots.withColumn("end", F.col("start") + 15)
    return S.conflicts(slots, "event_id", "user_id", "day", "start", "end")


def office_tier_rank(spark: SparkSession, d: str) -> DataFrame:
    return S.tiers(table(spark, d, "nation"), "nation_1", "n_nationkey", "n_name").select("n_nationkey", "tier", F.col("position").cast("int").alias("position"))


def supplier_tier_rank(spark: SparkSession, d: str) -> DataFrame:
    return S.tiers(table(spark, d, "supplier"), "supplier#00000001", "s_suppkey", "s_name").select("s_suppkey", "tier", F.col("position").cast("int").alias("position"))


def first_weekday(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.first_occurrence(F.to_date("ts"), (F.col("event_id") % 7 + 1).cast("int")).alias("first_date"))


def left_join_having_paging(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey", "o_orderkey")
    counts = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"))  # aggregate below the join
    joined = c.join(counts, c.c_custkey == counts.o_custkey, "left").select("c_custkey", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"))
    return joined.where("orders > 5").orderBy(F.desc("orders"), "c_custkey").offset(20).limit(50)


def exists_semi(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey")
    c = table(spark, d, "customer")
    return c.join(big, c.c_custkey == big.o_custkey, "left_semi").select("c_custkey")


def not_in_anti(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_custkey is not null and o_totalprice > 200000").select("o_custkey")
    c = table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


def count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.countDistinct("l_partkey").alias("parts"), F.count(F.lit(1)).alias("rows"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Parts that some order returns and none of the open ones needs; and how often either is."""
    items = table(spark, d, "lineitem")
    returned, open_ = items.where("l_returnflag = 'R'").select("l_partkey"), items.where("l_linestatus = 'O'").select("l_partkey")
    both = returned.intersect(open_).withColumn("kind", F.lit("both"))
    return both.unionByName(returned.distinct().exceptAll(open_.distinct()).withColumn("kind", F.lit("returned only")))


def match_by_number(spark: SparkSession, d: str) -> DataFrame:
    """Questions and answers of a conversation by number, the number being half the turn modulo 3."""
    turns = _turns(spark, d).select("conv_id", (F.floor(F.col("turn") / 2) % 3).cast("long").alias("number"), "role", F.md5(F.col("text").cast("binary")).alias("text"))
    return S.match_answers(turns.where("role = 'user'"), turns.where("role = 'assistant'"), "conv_id", "number", "text")


_T = r"CASE WHEN length(f) <= 45 THEN f ELSE regexp_replace(f[1:45], '\s+\S*$', '') END"
ORACLES = {
    "session_list": rf"""WITH s AS (SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS q FROM conversations GROUP BY 1 ORDER BY turns DESC, conv_id LIMIT 20 OFFSET 5),
x AS (SELECT *, trim(regexp_replace(q, '\s+', ' ', 'g')) AS f FROM s) SELECT conv_id, turns, last_turn, {_T} AS title FROM x""",
    "session_search": "SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(text), 'the ')",
    "session_context": r"""WITH r AS (SELECT conv_id, turn, len(list_intersect(['the', 'of', 'and', 'in'], regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS o, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations),
x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o DESC, turn DESC) AS n FROM r WHERE age > 4 AND o >= 2)
SELECT conv_id, turn, true AS recent FROM r WHERE age <= 4 UNION ALL SELECT conv_id, turn, false FROM x WHERE n <= 2""",
    "turn_pairs": "WITH t AS (SELECT conv_id, turn, role, lead(turn) OVER w AS answer_turn, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, answer_turn FROM t WHERE role = 'user' AND nr = 'assistant'",
    "even_sample_turns": "WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn FROM p WHERE n <= 4 OR i IN (0, round_even((n - 1) / 3, 0)::INT, round_even(2 * (n - 1) / 3, 0)::INT, n - 1)",
    "idempotent_turns": "WITH s AS (SELECT conv_id, max(turn + 1) AS last FROM conversations WHERE turn % 2 = 0 GROUP BY 1) SELECT c.conv_id, c.conv_id || '-' || turn AS request_id, coalesce(last, 0) + row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS turn_index FROM conversations c LEFT JOIN s ON c.conv_id = s.conv_id WHERE turn % 2 <> 0",
    "context_pack": "WITH u AS (SELECT conv_id, turn, (sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC))::BIGINT AS used FROM conversations) SELECT * FROM u WHERE used <= 600",
    "delete_sessions": "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')",
    "overlap_conflicts": "WITH s AS (SELECT event_id, user_id, isodow(ts) AS d, hour(ts) * 60 + minute(ts) AS s FROM events) SELECT a.user_id, a.event_id AS first, b.event_id AS second FROM s a JOIN s b ON a.user_id = b.user_id AND a.d = b.d AND a.event_id < b.event_id AND a.s < b.s + 15 AND b.s < a.s + 15",
    "office_tier_rank": "WITH t AS (SELECT n_nationkey, n_name, CASE WHEN lower(n_name) = 'nation_1' THEN 1 WHEN starts_with(lower(n_name), 'nation_1 ') THEN 2 WHEN starts_with(lower(n_name), 'nation_1') THEN 3 WHEN contains(' ' || lower(n_name), ' nation_1') THEN 4 WHEN contains(lower(n_name), 'nation_1') THEN 5 END AS tier FROM nation) SELECT n_nationkey, tier, (row_number() OVER (ORDER BY tier, length(n_name), n_nationkey))::INT AS position FROM t WHERE tier IS NOT NULL",
    "supplier_tier_rank": "WITH t AS (SELECT s_suppkey, s_name, CASE WHEN lower(s_name) = 'supplier#00000001' THEN 1 WHEN starts_with(lower(s_name), 'supplier#00000001 ') THEN 2 WHEN starts_with(lower(s_name), 'supplier#00000001') THEN 3 WHEN contains(' ' || lower(s_name), ' supplier#00000001') THEN 4 WHEN contains(lower(s_name), 'supplier#00000001') THEN 5 END AS tier FROM supplier) SELECT s_suppkey, tier, (row_number() OVER (ORDER BY tier, length(s_name), s_suppkey))::INT AS position FROM t WHERE tier IS NOT NULL",
    "first_weekday": "SELECT event_id, (ts::DATE + (((event_id % 7 + 1) - isodow(ts) + 7) % 7)::INT) AS first_date FROM events",
    "left_join_having_paging": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(o_orderkey) > 5 ORDER BY orders DESC, c_custkey LIMIT 50 OFFSET 20",
    "exists_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "not_in_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 200000)",
    "count_distinct": "SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS parts, count(*) AS rows FROM lineitem GROUP BY 1, 2",
    "set_operations": "WITH r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), o AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'O') SELECT l_partkey, CASE WHEN l_partkey IN (SELECT l_partkey FROM o) THEN 'both' ELSE 'returned only' END AS kind FROM r",
    "match_by_number": """WITH t AS (SELECT conv_id, (turn // 2) % 3 AS number, role, md5(text) AS x FROM conversations), e AS (SELECT conv_id, number, count(*) AS n FROM t WHERE role = 'user' GROUP BY 1, 2), a AS (SELECT conv_id, number, count(*) AS m, min(x) AS x FROM t WHERE role = 'assistant' GROUP BY 1, 2)
SELECT e.conv_id, e.number, CASE WHEN n = 1 AND m = 1 THEN x END AS answer, CASE WHEN n = 1 AND m = 1 THEN 'matched' ELSE 'missing' END AS status FROM e LEFT JOIN a ON e.conv_id = a.conv_id AND e.number = a.number""",
}
QUERIES = {f.__name__: f for f in (session_list, session_search, session_context, turn_pairs, even_sample_turns, idempotent_turns, context_pack, delete_sessions, overlap_conflicts, office_tier_rank, supplier_tier_rank, first_weekday, left_join_having_paging, exists_semi, not_in_anti, count_distinct, set_operations, match_by_number)}
