"""What may be trained on: forbidden sources, excluded and changed pages, native text, and transcripts that a person has verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.cleaning import cleaned, nfc
from scholia.functions.spans import stripped

REVIEW = "is_verified boolean, handwriting_suspected boolean, verified_by string, verified_at string, review_schema string, regions array<struct<status: string, text: string>>, text string"
# Schemas of reviews by region, and states of regions whose text counts.
BY_REGION = ["ocr-region-review-v1", "ocr-region-review-v2"]
COUNTED = ["verified", "corrected"]


def forbidden(filename: Column, names: list[str]) -> Column:
    """True where a file has a forbidden name, composed alike: the same path or basename, or the name inside its path."""
    file, out = nfc(filename), F.lit(False)
    base = F.regexp_extract(file, r"([^/]*)/*$", 1)
    for name in names:
        wanted = nfc(F.lit(name))
        out = out | F.contains(file, wanted) | (base == F.regexp_extract(wanted, r"([^/]*)/*$", 1))
    return out


def transcript_fault(review: Column) -> Column:
    """Why a transcript (struct of REVIEW) may not be trained on; null where it may. No flag but a verification with its author and time lets one in.

    unverified_handwriting, unverified, no_reviewer, invalid_regions (none given, or one without a text), regions_differ (the texts of
    verified and corrected regions, a line each, are not the transcript). Regions of the first schema have to come cleaned.
    """
    regions, schema = review["regions"], review["review_schema"]
    texts = F.transform(F.filter(regions, lambda r: r["status"].isin(COUNTED)), lambda r: r["text"])
    joined = F.array_join(F.transform(texts, stripped), "\n")
    by_region = F.coalesce(schema.isin(BY_REGION), F.lit(False))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(review.isNull(), "invalid")
        .when(~F.coalesce(review["is_verified"], F.lit(False)), F.when(F.coalesce(review["handwriting_suspected"], F.lit(False)), "unverified_handwriting").otherwise("unverified"))
        .when(blank(review["verified_by"]) | blank(review["verified_at"]), "no_reviewer")
        .when(by_region & (regions.isNull() | F.exists(regions, lambda r: r.isNull() | r["text"].isNull())), "invalid_regions")
        .when(by_region & (blank(joined) | ~F.coalesce(joined == review["text"], F.lit(False))), "regions_differ")
    )


def _folded(text: Column) -> Column:
    return F.regexp_replace(stripped(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+", " ")


def gate(chunks: DataFrame, files: DataFrame, pages: DataFrame, reviews: DataFrame, excluded: DataFrame, names: list[str], key: str = "chunk_id", least: int = 30) -> DataFrame:
    """key, allowed, reason for each chunk (key, filename, page, text, file_hash); a key names one chunk.

    files: filename, current_hash, is_scanned. pages: filename, page, native_text. reviews: source_hash, page and REVIEW. excluded:
    filename, page. Reasons in the order in which they are looked for: forbidden_source, source_missing, invalid_hash, blank_text,
    source_changed, page_excluded; then native where the page of a file that is no scan has ``least`` characters of native text, given
    or cleaned, that hold the chunk but for layout; verified_transcript where a transcript without fault does; else no_verified_text.
    """
    at = ["filename", "page"]
    out = excluded.select(*at).distinct().withColumn("_excluded", F.lit(True))
    native = pages.where(F.length(stripped(F.coalesce("native_text", F.lit("")))) >= least).select(*at, "native_text")
    good = reviews.where(transcript_fault(F.struct(*[c.split()[0] for c in REVIEW.replace("array<struct<status: string, text: string>>", "x").split(", ")])).isNull())
    # copies have one hash: transcripts that say the same are one, so that no chunk meets one for each copy
    good = good.select(F.col("source_hash").alias("file_hash"), "page", _folded(F.col("text")).alias("_read")).where("_read <> ''").distinct()
    near = chunks.select(key, *at, "text", "file_hash").withColumn("_chunk", _folded(F.col("text"))).join(files.select("filename", "current_hash", "is_scanned"), "filename", "left").join(out, at, "left").join(native, at, "left")
    kept = [key, *at, "file_hash", "current_hash", "_excluded", "_chunk"]
    page, chunk = F.col("native_text"), F.col("_chunk")
    near = near.withColumn("_native", F.coalesce(~F.coalesce(F.col("is_scanned"), F.lit(False)) & (chunk != "") & page.isNotNull(), F.lit(False)))
    near = near.withColumn("_given", F.col("_native") & F.coalesce(F.contains(_folded(page), chunk), F.lit(False)))
    # cleaning costs most, so it gets null for every page that is settled without
    near = near.select(*kept, "_given", F.when(F.col("_native") & ~F.col("_given"), page).alias("_raw"))
    near = near.select(*kept, (F.col("_given") | F.coalesce(F.col("_raw").isNotNull() & F.contains(_folded(cleaned(F.col("_raw"))), chunk), F.lit(False))).alias("_is_native"))
    met = near.join(good, ["file_hash", "page"], "left")
    is_read = F.coalesce(F.contains(F.col("_read"), chunk), F.lit(False))
    reason = (
        F.when(forbidden(F.col("filename"), names), "0 forbidden_source")
        .when(F.col("current_hash").isNull(), "0 source_missing")
        .when(~F.coalesce(F.col("file_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "0 invalid_hash")
        .when(chunk == "", "0 blank_text")
        .when(F.col("current_hash") != F.col("file_hash"), "0 source_changed")
        .when(F.col("_excluded"), "0 page_excluded")
        .when(F.col("_is_native"), "1 native")
        .when(is_read, "2 verified_transcript")
        .otherwise("3 no_verified_text")
    )
    # a chunk meets every transcript of its page: the best of what they say holds
    best = met.groupBy(key).agg(F.min(reason).alias("_r"))
    return best.select(key, F.substring("_r", 1, 1).isin("1", "2").alias("allowed"), F.substring("_r", 3, 100).alias("reason"))
