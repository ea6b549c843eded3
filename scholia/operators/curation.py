"""Curation: content hashes, holdouts, splits, samples, pairs, leaks, release gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import hash_mod


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def first_per_content(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each content, the smallest key: an aggregate, so copies are merged before the shuffle."""
    return rows.select(key, content_hash(F.col(text)).alias("digest")).groupBy("digest").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def canonical_names(files: DataFrame, name: str, digest: str = "digest") -> DataFrame:
    """Each content's canonical name: the shortest, then the first in order."""
    return files.groupBy(digest).agg(F.min(F.struct(F.length(name).alias("n"), F.col(name).alias("name"))).alias("x")).select(digest, F.col("x.name").alias("canonical"))


def without_aliases(files: DataFrame, held: DataFrame, digest: str = "digest") -> DataFrame:
    """The files whose content no held-out file has: every alias of a held-out content goes too."""
    return files.join(held.select(digest).distinct(), digest, "left_anti")


def split(rows: DataFrame, group: Column, valid: int = 15) -> DataFrame:
    """``rows`` with group and partition: a group is valid where its SHA-256 modulo 100 is below ``valid``, so no group is in both."""
    return rows.withColumn("group", group).withColumn("partition", F.when(hash_mod(F.col("group"), 100) < valid, "valid").otherwise("train"))


def leaking_groups(rows: DataFrame, group: str = "group", part: str = "partition") -> DataFrame:
    return rows.groupBy(group).agg(F.countDistinct(part).alias("partitions")).where("partitions > 1")


def places(rows: DataFrame, group: str, key: str, width: int = 65_536) -> DataFrame:
    """``rows`` with ``_i``, the row's place in its group from 0, and ``_n``, the group's rows; ``key`` an integer.

    Ranges of ``width`` keys are numbered apart; the ranges' counts give where each begins, so that no task sorts a whole group.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(key) / width))
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_c"))
    of = Window.partitionBy(group)
    counts = counts.withColumn("_before", F.sum("_c").over(of.orderBy("_range")) - F.col("_c")).withColumn("_n", F.sum("_c").over(of)).withColumnsRenamed({group: "_g", "_range": "_r"}).drop("_c")
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(key))
    met = ranged.withColumn("_p", inside).join(counts, F.col(group).eqNullSafe(F.col("_g")) & F.col("_range").eqNullSafe(F.col("_r")))
    return met.withColumn("_i", F.col("_before") + F.col("_p") - 1).drop("_range", "_r", "_g", "_p", "_before")


def stride(rows: DataFrame, group: str, key: str, cap: int) -> DataFrame:
    """At most ``cap`` rows a group, evenly spaced in its order: rows[::max(1, n // cap)][:cap]."""
    placed = places(rows, group, key)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / cap))
    return placed.where((F.col("_i") % step == 0) & (F.col("_i") < step * cap)).withColumn("place", (F.col("_i") / step).cast("int")).drop("_i", "_n")


def round_robin(rows: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    """The groups' rows in turn: first of each group, then second, and so on. No turn beyond ``limit`` can be among them."""
    inside = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("turn") <= limit)
    best = inside.orderBy("turn", group).limit(limit)
    return best.withColumn("position", F.row_number().over(Window.orderBy("turn", group)))


def adjacent_pairs(rows: DataFrame, book: str, page: str, key: str, gap: int = 2) -> DataFrame:
    """Neighbouring rows of a book at most ``gap`` pages apart: book, first, second."""
    w = Window.partitionBy(book).orderBy(page, key)
    return rows.select(book, F.col(key).alias("first"), F.lead(key).over(w).alias("second"), (F.lead(page).over(w) - F.col(page)).alias("_gap")).where(F.col("_gap") <= gap).drop("_gap")


def cross_pairs(rows: DataFrame, theme: str, language: str, file: str, key: str) -> DataFrame:
    """For each theme the first row of one language with the first of another, from different files."""
    w = Window.partitionBy(theme, language).orderBy(key)
    firsts = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(theme, language, file, key)
    a, b = firsts.alias("a"), firsts.alias("b")
    met = a.join(b, (F.col(f"a.{theme}") == F.col(f"b.{theme}")) & (F.col(f"a.{language}") < F.col(f"b.{language}")) & (F.col(f"a.{file}") != F.col(f"b.{file}")))
    return met.select(F.col(f"a.{theme}").alias(theme), F.col(f"a.{key}").alias("left"), F.col(f"b.{key}").alias("right"))


def holding(rows: DataFrame, items: DataFrame, item: str = "item_id", wanted: str = "text", key: str = "doc_id", text: str = "text", gram: int = 5, most_broadcast: int = 1_000_000) -> DataFrame:
    """key, item of rows that hold an item (a row of ``items``) word for word; null and empty items are held by none.

    What stands between an item's first and last word stands as whole words in any text that holds it. So an item's ``gram`` words
    after its first meet the same words of texts by their hash, and ``contains`` decides. Items with too few words meet by one inner
    word, and those of one or two words are compared with each text: their number is asked first, and beyond ``most_broadcast`` items
    the joins shuffle.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    given = items.where(F.coalesce(F.col(wanted), F.lit("")) != "").select(F.col(item).alias("_item"), F.col(wanted).alias("_wanted"), split(F.col(wanted)).alias("_w"))
    size = F.when(F.size("_w") >= gram + 2, gram).when(F.size("_w") >= 3, 1).otherwise(0)
    known = given.withColumn("_size", size).withColumn("_gram", F.xxhash64(F.slice("_w", F.lit(2), F.col("_size")))).drop("_w").persist()
    hint = (lambda d: F.broadcast(d)) if known.count() <= most_broadcast else (lambda d: d)
    sizes = [r[0] for r in known.select("_size").distinct().collect()]
    texts = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = []
    for n in sorted(sizes):
        own = known.where(F.col("_size") == n).drop("_size")
        if n == 0:
            met = texts.join(hint(own), F.contains("_text", F.col("_wanted")))
        else:
            w = texts.withColumn("_w", split(F.col("_text"))).where(F.size("_w") >= n)
            begins, width = F.sequence(F.lit(1), F.size("_w") - n + 1), F.lit(n)
            grams = F.array_distinct(F.transform(begins, lambda i: F.xxhash64(F.slice("_w", i, width))))  # noqa: B023  built at once
            met = w.select("_key", "_text", F.explode(grams).alias("_gram")).join(hint(own), "_gram").where(F.contains("_text", F.col("_wanted")))
        found.append(met.select("_key", "_item"))
    out = reduce(DataFrame.unionByName, found) if found else texts.join(known, F.lit(False)).select("_key", "_item")
    return out.select(F.col("_key").alias(key), F.col("_item").alias(item))


def ungrounded(answer: Column, source: Column) -> Column:
    """Numbers of the answer that the source lacks."""
    pattern = F.lit(r"\d+(?:[.,]\d+)*")
    return F.array_except(F.regexp_extract_all(answer, pattern, F.lit(0)), F.regexp_extract_all(source, pattern, F.lit(0)))


def exposure(rows: DataFrame, domain: str, weight: str, source: str, low: float, high: float) -> DataFrame:
    """domain, share, sources, top_share, balanced: a domain's share of the weight within bounds, two sources or more, none over half."""
    by_source = rows.groupBy(domain, source).agg(F.sum(weight).alias("w"))
    by_domain = by_source.groupBy(domain).agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("sources"), F.max("w").alias("largest"))
    whole = by_domain.withColumn("all", F.sum("total").over(Window.partitionBy(F.lit(1))))
    return whole.select(
        domain,
        F.round(F.col("total") / F.col("all"), 6).alias("share"),
        "sources",
        F.round(F.col("largest") / F.col("total"), 6).alias("top_share"),
        ((F.col("total") / F.col("all")).between(low, high) & (F.col("sources") >= 2) & (F.col("largest") * 2 <= F.col("total"))).alias("balanced"),
    )


def release_gates(rows: DataFrame, least: dict[str, int], part: str = "partition", group: str = "group") -> DataFrame:
    """One row: counts of both parts and groups, groups in both, and whether every gate passes."""
    per = rows.groupBy(group).agg(F.count_if(F.col(part) == "train").alias("t"), F.count_if(F.col(part) == "valid").alias("v"), F.countDistinct(part).alias("p"))
    counts = per.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("train"), F.coalesce(F.sum("v"), F.lit(0)).alias("valid"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("p") > 1).alias("shared_groups"))
    ok = (F.col("train") >= least["train"]) & (F.col("valid") >= least["valid"]) & (F.col("groups") >= least["groups"]) & (F.col("shared_groups") == 0)
    return counts.withColumn("release", ok)
