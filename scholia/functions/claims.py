"""Claim maps: does every sentence of an answer rest on claims whose evidence stands in the source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions import spans
from scholia.functions.cleaning import let

CLAIMS = (
    "array<struct<claim_id: string, claim_text: string, answer_sentence_id: string, answer_offsets: array<int>, source_sentence_ids: array<string>, "
    "evidence_spans: array<string>, relation: string, modality: string, claim_type: string, is_supported: boolean>>"
)
# Letters of Vietnamese alone, and English words that show a text was left in English.
VIETNAMESE = r"[ăâđêôơưĂÂĐÊÔƠƯ\x{1EA0}-\x{1EF9}]"
ENGLISH = ["the", "and", "of", "to", "in", "is", "that", "for", "with", "on", "as", "by", "this", "are", "from", "at"]


def vietnamese_fault(text: Column) -> Column:
    """Why a text is no natural Vietnamese: empty_text, insufficient_vietnamese_diacritics, excessive_untranslated_english; null if it is."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z]+"), F.lit(0))
    english = F.size(F.filter(words, lambda w: w.isin(ENGLISH)))
    few = (F.regexp_count(text, F.lit(VIETNAMESE)) < 3) & (F.length(text) > 30)
    blank = text.isNull() | (spans.stripped(text) == "")
    return F.when(blank, "empty_text").when(few, "insufficient_vietnamese_diacritics").when((F.size(words) > 10) & (english > 0.25 * F.size(words)), "excessive_untranslated_english")


def _faults(c: Column, i: Column, ids: Column, answer: Column, source: Column, answer_ids: Column, source_ids: Column) -> Column:
    """The violations of one claim, in the order of its fields."""
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    none = F.lit("None")
    name, at, offsets = F.get(ids, i), c["answer_sentence_id"], c["answer_offsets"]
    begin, end = F.get(offsets, F.lit(0)), F.get(offsets, F.lit(1))
    nothing = F.array().cast("array<string>")
    relation, modality, kind = F.lower(F.coalesce(c["relation"], F.lit("entailment"))), F.lower(F.coalesce(c["modality"], F.lit("asserted"))), F.lower(F.coalesce(c["claim_type"], F.lit("fact")))
    shape = offsets.isNull() | (F.size(offsets) != 2)
    inside = F.coalesce((begin >= 0) & (begin < end) & (end <= F.length(answer)), F.lit(False))
    first = F.array(
        F.when(F.array_position(ids, name) <= i, said("duplicate_claim_id: ", name)),
        F.when(spans.stripped(F.coalesce(c["claim_text"], F.lit(""))) == "", said("empty_claim_text: ", name)),
        F.when(~F.coalesce(F.array_contains(answer_ids, at), F.lit(False)), said("unrecognized_answer_sentence_id: ", F.coalesce(at, none), " in ", name)),
        F.when(shape, said("invalid_answer_offsets_shape: ", name)).when(~inside, said("answer_offsets_out_of_bounds: ", name, " [", F.coalesce(begin.cast("string"), none), ":", F.coalesce(end.cast("string"), none), "]")),
    )
    unknown = F.filter(F.coalesce(c["source_sentence_ids"], nothing), lambda s: ~F.coalesce(F.array_contains(source_ids, s), F.lit(False)))
    quotes = F.filter(F.transform(F.coalesce(c["evidence_spans"], nothing), lambda s: spans.stripped(F.coalesce(s, none))), lambda s: (s != "") & spans.resolve(source, s).isNull())
    last = F.array(
        F.when(relation.isin("contradiction", "unsupported"), said("negative_or_unsupported_relation: ", name, " (", relation, ")")),
        F.when((modality == "uncertain") & (kind == "fact"), said("uncertain_modality_asserted_as_fact: ", name)),
        F.when(~F.coalesce(c["is_supported"], F.lit(True)), said("claim_marked_not_supported: ", name)),
    )
    middle = F.concat(F.transform(unknown, lambda s: said("unrecognized_source_sentence_id: ", F.coalesce(s, none), " in ", name)), F.transform(quotes, lambda s: said("unmatched_evidence_span: ", name, " -> ", F.substring(s, 1, 40))))
    return F.concat(F.array_compact(first), middle, F.array_compact(last))


def claim_map(source: Column, answer: Column, claims: Column, source_id: str = "S1", language: bool = True) -> Column:
    """Struct (valid, coverage, sentences, covered, uncovered, violations, places) of a claim map (type CLAIMS) of an answer. Fails closed.

    ``coverage`` is the share of the answer's sentences that a claim names; ``uncovered`` their ids, sorted; ``places`` tells by the
    claims' own offsets how much of the answer they cover, how many overlap, and the gaps. A null or empty map has only the violation
    empty_or_invalid_claim_map; a null answer counts as empty, and so does a null source. Two claims of one id: the later is a duplicate.
    """
    text, origin = F.coalesce(answer, F.lit("")), F.coalesce(source, F.lit(""))
    of = lambda x: F.transform(x, lambda s: s["id"])
    held = F.struct(
        of(spans.sentences(text, "A1")).alias("answer_ids"),
        of(spans.sentences(origin, source_id)).alias("source_ids"),
        F.transform(claims, lambda c, i: F.coalesce(c["claim_id"], F.concat(F.lit("C"), (i + 1).cast("string")))).alias("ids"),
    )

    def judged(h: Column) -> Column:
        named = F.array_intersect(F.transform(claims, lambda c: c["answer_sentence_id"]), h["answer_ids"])
        missing = F.sort_array(F.array_except(h["answer_ids"], named))
        total = F.size(h["answer_ids"])
        each = F.flatten(F.transform(claims, lambda c, i: _faults(c, i, h["ids"], text, origin, h["answer_ids"], h["source_ids"])))
        fault = vietnamese_fault(text)
        tongue = F.array_compact(F.array(F.when(fault.isNotNull(), F.concat(F.lit("vietnamese_language_violation: "), fault)) if language else F.lit(None).cast("string")))
        gap = F.array_compact(F.array(F.when(F.size(missing) > 0, F.concat(F.lit("incomplete_answer_coverage: uncovered "), F.array_join(missing, ", ")))))
        marks = F.transform(F.filter(claims, lambda c: F.size(c["answer_offsets"]) == 2), lambda c: F.struct(F.get(c["answer_offsets"], F.lit(0)).alias("begin"), F.get(c["answer_offsets"], F.lit(1)).alias("end")))
        out = F.struct(F.concat(tongue, each, gap).alias("violations"), missing.alias("uncovered"), total.alias("sentences"), F.size(named).alias("covered"), spans.cover(marks, F.length(text)).alias("places"))
        share = lambda o: o["covered"] / F.greatest(o["sentences"], F.lit(1))
        return let(out, lambda o: F.struct(((F.size(o["violations"]) == 0) & (share(o) == 1)).alias("valid"), share(o).alias("coverage"), o["sentences"], o["covered"], o["uncovered"], o["violations"], o["places"]))

    nothing = F.array(F.lit("empty_or_invalid_claim_map"))
    ids, places = F.array().cast("array<string>"), spans.cover(F.lit(None).cast("array<struct<begin: int, end: int>>"), F.length(text))
    empty = F.struct(F.lit(False).alias("valid"), F.lit(0.0).alias("coverage"), F.lit(0).alias("sentences"), F.lit(0).alias("covered"), ids.alias("uncovered"), nothing.alias("violations"), places.alias("places"))
    return F.when(claims.isNull() | (F.size(claims) == 0), empty).otherwise(let(held, judged))
