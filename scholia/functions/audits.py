"""An auditor's verdict on a drafted answer: strict JSON, evidence by id, quotes held against the sources, every statement covered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.cleaning import let
from scholia.functions.dialogue import CITE, FINAL, THOUGHTS
from scholia.functions.spans import stripped

# Verdicts; the quote that stands for an unknown evidence id; entities of HTML; patterns of markup, joining words and symbols that make a statement.
VERDICTS = ["supported", "unsupported", "uncertain"]
INVALID = "__INVALID_EVIDENCE_ID__"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")]
MARKUP = [
    (r"(?i)\[\s*S\d+(?:\s*[,;]\s*S\d+)*\s*\]", ""),
    (r"^\s*(?:[-*•]|\d+[.)])\s+", ""),
    (r"`([^`]+)`", "$1"),
    (r"`", ""),
    (r"\*{3}([^*]+)\*{3}", "$1"),
    (r"\*{2}([^*]+)\*{2}", "$1"),
    (r"_{2}([^_]+)_{2}", "$1"),
    (r"(?U)(?<!\w)\*(?!\s)([^*\n]+?)(?<!\s)\*(?!\w)", "$1"),
    (r"(?U)(?<!\w)_(?!\s)([^_\n]+?)(?<!\s)_(?!\w)", "$1"),
    (r"[\s\x{00A0}\x{2000}-\x{200B}]+", " "),
]
OUTER = r"[\"'“”‘’«».,;:!? ]+"
SOURCE_LINE = r"(?imu)^\s*(?:#{1,6}\s*)?(?:nguồn(?: tham khảo)?|trích dẫn|tài liệu tham khảo|sources?|references?)\s*:\s*.*$"
ANSWER_HEAD = r"(?imu)^\s*(?:#{1,6}\s*)?(?:câu trả lời(?: cuối cùng)?|final answer)\s*:\s*"
SOURCE_PHRASE = r"(?iU)\b(?:theo|trong|ở|tại)\s+(?:các\s+)?(?:đoạn|nguồn|tài liệu)?\s*\[\s*S\d+(?:\s*[,;]\s*S\d+)*\s*\]\s*,?\s*"
ENDS = r"(?<=[^0-9]\.)\s+|(?<=[0-9]\.)(?!\d)\s+"
JOINS = r"(?:,\s*|\s+)(?:và|đồng\s+thời|nhưng|hoặc)\s+"
STATES = r"(?U)[\p{L}\p{N}+\-=<>/*^√∑∫π≠≤≥]"

#: Characters of a text that are cut into spans before the rest.
HEAD = 4096

AUDIT = "struct<status: string, claims: array<struct<statement: string, source_id: string, evidence_quote: string, verdict: string>>>"
_CLAIM = "array<struct<statement: string, source_id: string, evidence_quote: string, verdict: string>>"


def strict_object(raw: Column) -> Column:
    """The one JSON object that the text is, as a variant; null for anything else.

    A key given twice, text before or behind, a second value, single quotes and numbers that are none make it null. The text is put
    into an object that ends with a key of its own digest, so that a parser which stops early does not find that key.
    """
    mark = F.md5(F.coalesce(raw, F.lit("")).cast("binary"))
    whole = F.try_parse_json(F.concat(F.lit('{"x":'), raw, F.lit(',"'), mark, F.lit('":0}')))

    def inside(v: Column) -> Column:
        closed = F.contains(v.cast("string"), F.concat(F.lit('"'), mark, F.lit('":0')))
        return F.when(closed & F.schema_of_variant(F.try_variant_get(v, "$.x", "variant")).startswith("OBJECT"), F.try_variant_get(v, "$.x", "variant"))

    return let(whole, inside)


def text_field(value: Column, name: str) -> Column:
    """A field of a variant that is a string; null if it is missing or of another type."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def catalog(text: Column, limit: int = 30) -> Column:
    """Array of a source's first ``limit`` spans, E1 on: parts of its lines of three or more characters, each as it stands; the whole text if there is none.

    Of a long text the first ``HEAD`` characters are cut first. All their parts but the last are parts of the text, so the rest is
    cut only if they give too few spans.
    """

    def parts(t: Column) -> Column:
        lines = F.filter(F.transform(F.split(t, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"), stripped), lambda p: p != "")
        return F.flatten(F.transform(lines, lambda p: F.split(p, ENDS + r"|[!?]+\s+|;\s+")))

    def spans(p: Column) -> Column:
        return F.slice(F.filter(F.transform(p, stripped), lambda s: F.length(s) >= 3), 1, limit)

    head = let(parts(F.substring(text, 1, HEAD)), lambda p: spans(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))))
    first = let(F.when(F.length(text) > HEAD, head), lambda k: F.when(F.size(k) == limit, k).otherwise(spans(parts(text))))
    return let(first, lambda k: F.when(F.size(k) > 0, k).when(stripped(text) != "", F.array(stripped(text))).otherwise(F.array().cast("array<string>")))


def evidence_quote(spans: Column, evidence_id: Column) -> Column:
    """The span of an id such as E3, e-03 or "E 3."; null if there is none."""
    number = F.regexp_extract(F.upper(evidence_id), r"E\s*-?\s*(\d{1,9})", 1)
    return F.when(number != "", F.get(spans, number.try_cast("int") - 1))


def unescaped(text: Column) -> Column:
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def escaped(text: Column) -> Column:
    for entity, sign in [ENTITIES[-1], *ENTITIES[:4]]:
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def quoted_in(quote: Column, source: Column) -> Column:
    """True where the quote stands in the source, either of them with or without entities."""
    return F.contains(source, quote) | F.contains(source, unescaped(quote)) | F.contains(unescaped(source), unescaped(quote)) | F.contains(source, escaped(quote))


def normal_statement(text: Column) -> Column:
    """A statement without citations, list marks, markup and outer punctuation; words, numbers and case stay."""
    out = unescaped(F.coalesce(text, F.lit("")))
    for pattern, by in MARKUP:
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_replace(F.trim(out), f"^{OUTER}|{OUTER}$", "")


def statements(draft: Column) -> Column:
    """Array of the statements of what a draft shows: sentences of its lines that hold a letter, digit or sign of a formula."""
    out = F.regexp_replace(draft, "(?is)" + THOUGHTS, "")
    out = F.regexp_replace(out, r"(?is)^.*?<\s*/\s*(?:think|analysis|reasoning)\s*>", "")
    out = F.when(out.rlike("(?is)" + FINAL), F.regexp_extract(out, "(?is)" + FINAL, 1)).otherwise(out)
    for pattern in (SOURCE_LINE, ANSWER_HEAD, SOURCE_PHRASE, "(?i)" + CITE):
        out = F.regexp_replace(out, pattern, "")
    lines = F.filter(F.transform(F.split(out, r"\r?\n"), stripped), lambda x: (x != "") & ~x.rlike(r"^\|[-:|]*\|$"))
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, ENDS + r"|[!?]+(?:\s+|$)")))
    return F.filter(F.transform(parts, stripped), lambda p: p.rlike(STATES))


def covered(draft: Column, supported: Column) -> Column:
    """True where each statement of the draft, or each of its clauses, is one of the ``supported`` statements; false if the draft has none."""
    known = F.transform(supported, normal_statement)

    def met(x: Column) -> Column:
        def one(s: Column) -> Column:
            clauses = F.filter(F.transform(F.split(s, "(?iu)" + JOINS), normal_statement), lambda c: c != "")
            whole = normal_statement(s)
            return (whole == "") | F.array_contains(x["known"], whole) | ((F.size(clauses) > 1) & F.forall(clauses, lambda c: F.array_contains(x["known"], c)))

        return (F.size(x["said"]) > 0) & F.forall(x["said"], one)

    return let(F.struct(known.alias("known"), statements(draft).alias("said")), met)


def audited(raw: Column, sources: Column, draft: Column | None = None, catalogs: Column | None = None) -> Column:
    """Struct AUDIT of an auditor's output, given the admitted sources (a map from id to text). Fails closed.

    ``catalogs``: a map from id to the source's catalog, where the caller has it; else a claim's is made anew.

    ``status``: verified, partially_verified or unverified. Unverified with no claims: no strict object (see ``strict_object``; code
    fences may stand around it), no claims, or one that lacks a statement, source, quote or verdict as text. An evidence id gives the
    quote; one that the source lacks leaves the given quote, or an invalid one. A claim on a source that was not admitted is
    unsupported; a supported one whose quote is not in its source becomes uncertain. A draft (null or empty: not looked at) must be
    covered by supported claims.
    """

    def unfenced(clean: Column) -> Column:
        fence = clean.startswith("```")
        inner = stripped(F.regexp_replace(F.regexp_replace(clean, r"```\z", ""), r"^\s*```(?:json)?", ""))
        return F.when(fence & (~clean.endswith("```") | (F.length(clean) < 6)), F.lit(None)).when(fence, inner).otherwise(clean)

    body = let(let(stripped(F.coalesce(raw, F.lit(""))), unfenced), strict_object)

    def claim(c: Column) -> Column:
        evidence, given = F.try_variant_get(c, "$.evidence_id", "string"), text_field(c, "evidence_quote")
        source = text_field(c, "source_id")
        named = stripped(F.coalesce(evidence, F.lit(""))) != ""
        found = F.when(named, evidence_quote(catalog(F.try_element_at(sources, source)) if catalogs is None else F.try_element_at(catalogs, source), evidence))
        quote = F.coalesce(found, F.when(named & (F.coalesce(given, F.lit("")) == ""), F.lit(INVALID)).otherwise(given))
        said = F.lower(stripped(text_field(c, "verdict")))
        return F.struct(text_field(c, "statement").alias("statement"), source.alias("source_id"), quote.alias("evidence_quote"), said.alias("verdict"))

    def whole(c: Column) -> Column:
        filled = lambda x: F.coalesce(stripped(x) != "", F.lit(False))
        return filled(c["statement"]) & filled(c["source_id"]) & filled(c["evidence_quote"]) & F.coalesce(c["verdict"].isin(VERDICTS), F.lit(False))

    def settled(c: Column) -> Column:
        text = F.try_element_at(sources, c["source_id"])
        verdict = F.when(text.isNull(), "unsupported").when((c["verdict"] == "supported") & ~quoted_in(c["evidence_quote"], text), "uncertain").otherwise(c["verdict"])
        return F.struct(c["statement"], c["source_id"], c["evidence_quote"], verdict.alias("verdict"))

    def judged(x: Column) -> Column:
        overall, claims = x["overall"], x["claims"]
        has = lambda v: F.exists(claims, lambda c: c["verdict"] == v)
        good = F.transform(F.filter(claims, lambda c: c["verdict"] == "supported"), lambda c: c["statement"])
        missed = F.lit(False) if draft is None else (F.coalesce(draft, F.lit("")) != "") & ~covered(draft, good)
        status = F.when(has("unsupported") | missed | (overall == "unsupported"), "unverified").when(has("uncertain") | (overall != "supported"), "partially_verified").otherwise("verified")
        return F.struct(status.alias("status"), claims.alias("claims"))

    refused = F.struct(F.lit("unverified").alias("status"), F.array().cast(_CLAIM).alias("claims"))

    def read(v: Column) -> Column:
        claims = F.transform(F.try_variant_get(v, "$.claims", "array<variant>"), claim)
        overall = F.lower(stripped(text_field(v, "overall_verdict")))
        fields = F.struct(overall.alias("overall"), claims.alias("claims"))
        sound = lambda x: F.coalesce(x["overall"].isin(VERDICTS) & (F.size(x["claims"]) > 0) & F.forall(x["claims"], whole), F.lit(False))
        return let(fields, lambda x: F.when(sound(x), let(F.struct(x["overall"], F.transform(x["claims"], settled).alias("claims")), judged)).otherwise(refused))

    return F.coalesce(let(body, lambda v: F.when(v.isNotNull(), read(v))), refused)
