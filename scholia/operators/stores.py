"""Relational reads and writes of sessions, study material, timetables and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of new keys that are numbered apart, less one.
RANGES = 511


def session_list(turns: DataFrame, session: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role", limit: int = 20, offset: int = 0) -> DataFrame:
    """Sessions with a turn: turns, last turn, title (first question, 45 characters at a word's end); a page of them, those of most turns first."""
    question = F.min(F.when(F.col(role) == "user", F.struct(F.col(turn), F.col(text)))).alias("q")
    per = turns.groupBy(session).agg(F.count(F.lit(1)).alias("turns"), F.max(turn).alias("last_turn"), question)
    page = per.where("turns > 0").orderBy(F.desc("turns"), session).offset(max(0, offset)).limit(min(max(1, limit), 200))
    first = F.coalesce(F.col(f"q.{text}"), F.lit(""))
    return page.select(session, "turns", "last_turn", title(first).alias("title"))


def title(question: Column) -> Column:
    """At most 45 characters, cut after the last whole word."""
    flat = F.trim(F.regexp_replace(question, r"\s+", " "))
    return F.when(F.length(flat) <= 45, flat).otherwise(F.regexp_replace(F.substring(flat, 1, 45), r"\s+\S*$", ""))


def session_search(turns: DataFrame, words: str, session: str = "conv_id", text: str = "text") -> DataFrame:
    """Sessions of which some turn contains the words, whatever the case."""
    return turns.where(F.contains(F.lower(F.col(text)), F.lit(words.lower()))).select(session).distinct()


def turn_pairs(turns: DataFrame, session: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Question turns with the next turn where that is an answer."""
    w = Window.partitionBy(session).orderBy(turn)
    both = turns.select(session, turn, role, F.lead(turn).over(w).alias("answer_turn"), F.lead(role).over(w).alias("next_role"))
    return both.where((F.col(role) == "user") & (F.col("next_role") == "assistant")).select(session, turn, "answer_turn")


def recall(turns: DataFrame, words: list[str], recent: int = 4, older: int = 2, session: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The newest turns of each session and, of older ones, those that share two words or more with the question; in turn order."""
    w = Window.partitionBy(session)
    overlap = F.size(F.array_intersect(F.array(*[F.lit(x) for x in words]), F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    rows = turns.select(session, turn, overlap.alias("overlap")).withColumn("age", F.row_number().over(w.orderBy(F.desc(turn))))
    new = rows.where(F.col("age") <= recent).select(session, turn, F.lit(True).alias("recent"))
    old = rows.where((F.col("age") > recent) & (F.col("overlap") >= 2)).withColumn("n", F.row_number().over(w.orderBy(F.desc("overlap"), F.desc(turn)))).where(F.col("n") <= older)
    return new.unionByName(old.select(session, turn, F.lit(False).alias("recent")))


def even_sample(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """k rows of each group, evenly spaced from first to last (ties of rounding to even); groups of k rows or fewer whole; one row is the first."""
    w = Window.partitionBy(group)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(max(1, k - 1)))).cast("int"))
    return placed.where((F.col("_n") <= k) | F.array_contains(picks, F.col("_i"))).drop("_i", "_n")


def append_turns(stored: DataFrame, arriving: DataFrame, session: str, request: str, order: str) -> DataFrame:
    """Arriving turns that no stored one repeats, each request once, numbered on from the session's last turn."""
    fresh = arriving.join(stored.select(session, request), [session, request], "left_anti")
    once = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(session, request).orderBy(order))).where("_n = 1").drop("_n")
    last = stored.groupBy(session).agg(F.max("turn_index").alias("last"))
    numbered = once.withColumn("_p", F.row_number().over(Window.partitionBy(session).orderBy(order)))
    return numbered.join(last, session, "left").withColumn("turn_index", F.coalesce("last", F.lit(0)) + F.col("_p")).drop("_p", "last")


def pack(turns: DataFrame, budget: int, session: str = "conv_id", turn: str = "turn", size: str = "size") -> DataFrame:
    """The newest turns of each session whose sizes fit the budget together; the first that doesn't fit ends it."""
    w = Window.partitionBy(session).orderBy(F.desc(turn))
    return turns.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both, the newest version of each key; the new one wins ties."""
    rows = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_side"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_side")


def conflicts(slots: DataFrame, key: str, owner: str, weekday: str, start: str, end: str, width: int = 60) -> DataFrame:
    """Pairs of an owner's slots on one weekday that overlap; touching ends don't. ``start`` and ``end`` are minutes.

    Slots meet in bins of ``width`` minutes; a pair counts in the bin where the later of both begins, so once. A slot without length
    overlaps those that it lies inside.
    """
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width))
    cut = slots.select(owner, weekday, key, start, end).where(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).withColumn("_bin", F.explode(bins))
    a, b = cut.alias("a"), cut.alias("b")
    same = (F.col(f"a.{owner}") == F.col(f"b.{owner}")) & (F.col(f"a.{weekday}") == F.col(f"b.{weekday}")) & (F.col("a._bin") == F.col("b._bin"))
    over = (F.col(f"a.{key}") < F.col(f"b.{key}")) & (F.col(f"a.{start}") < F.col(f"b.{end}")) & (F.col(f"b.{start}") < F.col(f"a.{end}"))
    once = F.col("a._bin") == F.floor(F.greatest(F.col(f"a.{start}"), F.col(f"b.{start}")) / width)
    return a.join(b, same & over & once).select(F.col(f"a.{owner}").alias(owner), F.col(f"a.{key}").alias("first"), F.col(f"b.{key}").alias("second"))


def tiers(names: DataFrame, query: str, key: str, name: str) -> DataFrame:
    """Matches of a name: 1 exact, 2 word prefix, 3 prefix, 4 at a word's start, 5 anywhere; then by length and key."""
    n, q = F.lower(F.trim(name)), query.strip().lower()
    tier = (
        F.when(n == q, 1)
        .when(n.startswith(q + " "), 2)
        .when(n.startswith(q), 3)
        .when(F.contains(F.concat(F.lit(" "), n), F.lit(" " + q)), 4)
        .when(F.contains(n, F.lit(q)), 5)
    )
    return names.select(key, name, tier.alias("tier")).where("tier is not null").withColumn("position", F.row_number().over(Window.orderBy("tier", F.length(name), key)))


def first_occurrence(start: Column, weekday: Column) -> Column:
    """The first date from ``start`` on that is the ISO weekday (1 Monday to 7)."""
    return F.date_add(start, F.pmod(weekday - (F.weekday(start) + 1), F.lit(7)))


def match_answers(exercises: DataFrame, answers: DataFrame, group: str, number: str, text: str) -> DataFrame:
    """Exercises with their answers by number; ``missing`` where either side has the number more than once, or there is none."""
    count = lambda df, n: df.groupBy(group, number).agg(F.count(F.lit(1)).alias(n), F.min(text).alias(f"{n}_text"))
    met = count(exercises, "asked").join(count(answers, "answered"), [group, number], "left")
    sure = (F.col("asked") == 1) & (F.col("answered") == 1)
    return met.select(group, number, F.when(sure, F.col("answered_text")).alias("answer"), F.when(sure, "matched").otherwise("missing").alias("status"))


def upsert_documents(stored: DataFrame, arriving: DataFrame, key: str, version: list[str], at: Column) -> DataFrame:
    """Stored documents with the arriving ones (key, version columns) put in: a known key keeps its doc_id, a new one gets the next.

    New ids follow the order of the keys. They are given by ranges between ``RANGES`` new keys of the lowest hashes and by the ranges'
    counts, so that no task numbers all new documents. Of rows that arrive for
    one key the one of the greatest version columns holds, compared from the first; a row without a key names no document and is left out.
    """
    newest = arriving.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*version)).alias("_v"))
    arriving = newest.select(key, *[F.col("_v")[c].alias(c) for c in version])
    known = stored.select(key, "doc_id")
    met = arriving.join(known, key, "left")
    old = met.where("doc_id is not null").select("doc_id", key, *version, at.alias("updated_at"))
    last = stored.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("last"))
    fresh = met.where("doc_id is null")
    edges = fresh.select(key).orderBy(F.xxhash64(key), key).limit(RANGES).agg(F.collect_set(key).alias("_edges"))
    fresh = fresh.crossJoin(F.broadcast(edges)).withColumn("_b", F.size(F.filter("_edges", lambda e: e <= F.col(key)))).drop("_edges")
    before = fresh.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    new = fresh.withColumn("_p", place).join(F.broadcast(before), "_b").crossJoin(F.broadcast(last))
    new = new.select((F.col("last") + F.col("_before") + F.col("_p")).alias("doc_id"), key, *version, at.alias("updated_at"))
    left = stored.join(arriving.select(key), key, "left_anti").select("doc_id", key, *version, "updated_at")
    return left.unionByName(old).unionByName(new)


def append_revision(log: DataFrame, arriving: DataFrame, key: str, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """The log with each arriving row as its key's next revision: nothing is ever replaced.

    Rows that arrive for one key are numbered on in ``order`` (by default that of their columns). A null key is a key.
    """
    last = log.groupBy(F.col(key).alias("_key")).agg(F.max("revision").alias("_last"))
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*(order or columns)))
    added = arriving.withColumn("_turn", turn).join(last, F.col(key).eqNullSafe(F.col("_key")), "left")
    return log.select(key, "revision", *columns).unionByName(added.select(key, (F.coalesce("_last", F.lit(0)) + F.col("_turn")).alias("revision"), *columns))


def migrated(stored: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """Legacy rows under the id legacy_<id> that are not stored yet: running it again adds nothing."""
    named = legacy.withColumn(key, F.concat(F.lit("legacy_"), F.col(key).cast("string")))
    return stored.unionByName(named.join(stored.select(key), key, "left_anti").select(*stored.columns))


def last_turns(turns: DataFrame, n: int = 6, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The newest ``n`` turns of each session."""
    return turns.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(turn)))).where(F.col("_n") <= n).drop("_n")


def recent_sources(hits: DataFrame, source: Column, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` distinct sources in the order they were first seen: a minimum for each, then a bounded sort."""
    first = hits.groupBy(source.alias("source")).agg(F.min(F.struct(*order)).alias("seen"))
    return first.orderBy("seen").limit(limit).withColumn("position", F.row_number().over(Window.orderBy("seen"))).select("source", "position")
