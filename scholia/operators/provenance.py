"""A sample's proof: digests chained from the source over question and prompt to the answer and its verdict, held against the live sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The links after the source, each with the column that it binds.
LINKS = [("question_digest", "question"), ("prompt_digest", "prompt"), ("target_digest", "target"), ("verdict_digest", "verdict")]


def bound(before: Column, content: Column) -> Column:
    """The digest of a link: of the one before it and its own content, each with its length, so that nothing moves from one to the other."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(part(F.coalesce(before, F.lit(""))), part(F.coalesce(content, F.lit("")))).cast("binary"), 256)


def sealed(samples: DataFrame, source: str = "source_text") -> DataFrame:
    """Samples with source_digest and the links' digests; what they are made from stays."""
    out = samples.withColumn("source_digest", F.sha2(F.col(source).cast("binary"), 256))
    before = "source_digest"
    for link, content in LINKS:
        out = out.withColumn(link, bound(F.col(before), F.col(content)))
        before = link
    return out


def proof(samples: DataFrame, sources: DataFrame, key: str = "sample_id", source: str = "source_id") -> DataFrame:
    """key, faults: what does not hold of each sample's chain, in the chain's order; empty for a sound one.

    A link is checked with the digest that is recorded before it, so that one change shows as one fault: the links behind it stay
    sound. sources: source, text, state. Faults: source_missing, source_not_verified, source_changed, source_digest_missing, then
    <content>_changed or <content>_digest_missing, verdict_negative, and key_repeated where a key names several rows.
    """
    live = sources.select(F.col(source).alias("_source"), F.sha2(F.col("text").cast("binary"), 256).alias("_live"), F.col("state").alias("_state"))
    met = samples.join(live, F.col(source) == F.col("_source"), "left")
    faults = [
        F.when(F.col("_source").isNull(), "source_missing"),
        F.when(F.col("_source").isNotNull() & ~F.coalesce(F.col("_state") == "text_verified", F.lit(False)), "source_not_verified"),
        F.when(F.col("source_digest").isNull(), "source_digest_missing").when(F.col("_live") != F.col("source_digest"), "source_changed"),
    ]
    before = "source_digest"
    for link, content in LINKS:
        faults.append(F.when(F.col(link).isNull(), f"{content}_digest_missing").when(F.col(before).isNotNull() & (F.col(link) != bound(F.col(before), F.col(content))), f"{content}_changed"))
        before = link
    supported = F.try_variant_get(F.try_parse_json(F.col("verdict")), "$.supported", "boolean")
    faults.append(F.when(~F.coalesce(supported, F.lit(False)), "verdict_negative"))
    each = met.select(key, F.array_compact(F.array(*faults)).alias("_f"))
    # equal keys meet in one row, so that a repeated key shows; what is wrong with any of its rows is wrong with it
    merged = each.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set("_f"))).alias("_all"), F.count(F.lit(1)).alias("_n"))
    return merged.select(key, F.when(F.col("_n") > 1, F.array_append("_all", F.lit("key_repeated"))).otherwise(F.col("_all")).alias("faults"))
