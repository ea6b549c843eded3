"""Reviews: verdicts and their consensus, page inspection, evidence, packing, admission, diffs, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.audits import catalog
from scholia.functions.legacy import is_tcvn3, is_vni
from scholia.functions.text import private_use

VERDICT = "struct<supported: boolean, source: string, quote: string, reason: string>"


def verdict(raw: Column, source: Column) -> Column:
    """Struct (state, quote): fails closed. 'supported' only for an object that says so and quotes the source; a quote from elsewhere is 'uncertain'."""
    v = F.from_json(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""), VERDICT)
    quoted = (F.length(F.trim(v["quote"])) > 0) & F.contains(source, v["quote"])
    state = F.when(v.isNull() | v["supported"].isNull(), "invalid").when(~v["supported"], "rejected").when(F.coalesce(quoted, F.lit(False)), "supported").otherwise("uncertain")
    return F.struct(state.alias("state"), v["quote"].alias("quote"))


def consensus(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys that both audits support; a key that either lacks is not kept."""
    a, b = first.select(key, F.col("state").alias("a")), second.select(key, F.col("state").alias("b"))
    return a.join(b, key).select(key, ((F.col("a") == "supported") & (F.col("b") == "supported")).alias("kept"))


def inspection(text: Column, images: Column, drawings: Column) -> Column:
    """Warnings of a page, in a fixed order; it needs review where there is any."""
    formula = text.rlike(r"[=≈≠≤≥∑∫√±]\s*\S")
    return F.array_compact(
        F.array(
            F.when(F.size(private_use(text)) > 0, F.lit("private_use")),
            F.when(is_tcvn3(text), F.lit("legacy_tcvn3")).when(is_vni(text), F.lit("legacy_vni")),
            F.when(drawings >= 5, F.lit("drawings")),
            F.when(images >= 1, F.lit("images")),
            F.when(formula & (images + drawings > 0), F.lit("formula_with_visual")),
            F.when(text.rlike(r"(?i)\b(figure|fig\.|hình)\s*\d"), F.lit("figure_mentioned")),
        )
    )


def evidence(sources: DataFrame, source: str, text: str, limit: int = 30) -> DataFrame:
    """source, evidence (E1 on), sentence: the first spans of each source, as an auditor is given them."""
    rows = sources.select(source, F.posexplode(catalog(F.col(text), limit)).alias("n", "sentence"))
    return rows.select(source, F.concat(F.lit("E"), (F.col("n") + 1).cast("string")).alias("evidence"), "sentence")


def pack_passages(sizes: Column, budget: int) -> Column:
    """Indexes (from 0) of the passages that fit, in order: one that does not fit is skipped and later ones are still tried."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("i"))

    def step(a: Column, size: Column) -> Column:
        fits = a["used"] + size <= budget
        return F.struct((a["used"] + F.when(fits, size).otherwise(0)).alias("used"), F.when(fits, F.array_append(a["taken"], a["i"])).otherwise(a["taken"]).alias("taken"), (a["i"] + 1).alias("i"))

    return F.aggregate(sizes, start, step, lambda a: a["taken"])


def admission(samples: DataFrame, live: DataFrame, key: str, digest: str, state: str) -> DataFrame:
    """key, reason: why a sample may not be used, by the first fault; null where it may."""
    there = live.select(key, F.col(digest).alias("_live"), F.col(state).alias("_state"))
    reason = F.when(F.col("_live").isNull(), "document_missing").when(F.col("_state") != "text_verified", "page_not_verified").when(F.col("_live") != F.col(digest), "text_changed")
    return samples.join(there, key, "left").select(key, reason.alias("reason"))


def page_diff(old: DataFrame, new: DataFrame, page: str, index: str, digest: str) -> DataFrame:
    """page, same, changed, added, removed: chunks of a page compared place by place."""
    both = old.select(page, index, F.col(digest).alias("a")).join(new.select(page, index, F.col(digest).alias("b")), [page, index], "full_outer")
    count = lambda c: F.count_if(c)
    return both.groupBy(page).agg(count(F.col("a") == F.col("b")).alias("same"), count(F.col("a") != F.col("b")).alias("changed"), count(F.col("a").isNull()).alias("added"), count(F.col("b").isNull()).alias("removed"))


def split_conflicts(rows: DataFrame, file: str, part: str) -> DataFrame:
    """Files with rows in more than one split."""
    return rows.groupBy(file).agg(F.countDistinct(part).alias("parts")).where("parts > 1").select(file)


def queue(rows: DataFrame, owner: str, item: str, at: str, cap: int = 100) -> DataFrame:
    """Each owner's newest ``cap`` items, an item counting where it came first."""
    once = rows.groupBy(owner, item).agg(F.min(at).alias(at))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(at), item))).where(F.col("place") <= cap)


def set_summary(sessions: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Sessions with the updates that name their present revision; others leave them as they are. A title changes only where it was automatic."""
    u = updates.select(key, F.col("revision").alias("_r"), F.col("summary").alias("_s"), F.col("title").alias("_t"))
    met = sessions.join(u, key, "left")
    hit = F.coalesce(F.col("_r") == F.col("revision"), F.lit(False))
    return met.select(
        key,
        F.when(hit, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"),
        F.when(hit, F.col("_s")).otherwise(F.col("summary")).alias("summary"),
        F.when(hit & (F.col("title_kind") == "auto"), F.col("_t")).otherwise(F.col("title")).alias("title"),
    )


def ordered_digest(rows: DataFrame, group: str, order: str, text: str, width: int = 65_536) -> DataFrame:
    """One digest for each group: of its ordered contents' digests; ``order`` an integer.

    Where a group reaches over several ranges of ``width``, each range has its digest and the group's is that of its ranges', so
    that no row holds more than a range, or one number for each.
    """
    each = rows.select(group, F.floor(F.col(order) / width).alias("_range"), F.struct(order, F.sha2(F.col(text).cast("binary"), 256).alias("h")).alias("x"))
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c))["h"], "\n"), 256)
    ranges = each.groupBy(group, "_range").agg(joined("x").alias("h"))
    whole = ranges.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("one"), joined(F.struct("_range", "h")).alias("all"))
    return whole.select(group, F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("all")).alias("digest"))


def cards(pages: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """key, term, meaning: definitions found by rule, the first of each page and at most ``limit`` in all."""
    pattern = r"(?m)^\s*([\p{Lu}][\p{L} ]{2,40}?)\s+(?:is|are|means|là|ist|est|es)\s+([^.\n]{10,200})\."
    found = pages.select(key, F.regexp_extract(text, pattern, 1).alias("term"), F.regexp_extract(text, pattern, 2).alias("meaning"))
    return found.where("term <> ''").orderBy(key).limit(limit)
