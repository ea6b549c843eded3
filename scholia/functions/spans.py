"""Where a quoted span stands in its source, sentences with offsets, and how far intervals cover a text.

All offsets count code points from 0 and hold in the text as given: ``text[begin:end]`` is the span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.cleaning import let

#: White space of any script, as a class's inside and as a class.
_BLANK = r"\s\x1C-\x1F\x85\p{Z}"
BLANK = f"[{_BLANK}]"
# Curly quotation marks and what stands for them; marks that may wrap a quoted span; what may close a sentence; abbreviations that end none.
CURLY, STRAIGHT = "“”‘’", "\"\"''"
WRAPPING = "\"'«»“”"
CLOSING = "\"'”’»)"
ABBREVIATIONS = ["PhD", "Dr", "Mr", "Mrs", "Ms", "Prof", "vs", r"e\.g", r"i\.e", "al", "No", "vol", "pp", "sec"]

SPAN = "struct<verbatim: string, begin: int, end: int, how: string>"


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return _stripped(text, BLANK)


def _stripped(text: Column, blank: str) -> Column:
    return F.regexp_replace(text, rf"^{blank}+|{blank}+\z", "")


def _literal(text: Column, blank: str) -> Column:
    """A pattern for the words of the text, in order, with any white space between them."""
    return F.regexp_replace(F.regexp_replace(_stripped(text, blank), r"([\\^$.|?*+()\[\]{}])", r"\\$1"), f"{blank}+", blank.replace("\\", "\\\\") + "+")


def _placed(source: Column, seen: Column, found: Column, how: str) -> Column:
    """The struct for the first place of ``found`` in ``seen``, which has the length of the source; null if there is none."""
    at = F.call_function("locate", found, seen)
    return let(
        F.struct(at.alias("at"), F.length(found).alias("n")),
        lambda p: F.when(p["at"] > 0, F.struct(F.substring(source, p["at"], p["n"]).alias("verbatim"), (p["at"] - 1).alias("begin"), (p["at"] - 1 + p["n"]).alias("end"), F.lit(how).alias("how"))),
    )


def _match(source: Column, span: Column, how: str, blank: str) -> Column:
    """As it stands; else with other white space; else with curly quotes for straight ones or the reverse."""
    plain = lambda t: F.translate(t, CURLY, STRAIGHT)
    found = lambda text, pattern: F.regexp_substr(text, pattern)
    words = F.when(_stripped(span, blank) != "", let(found(source, _literal(span, blank)), lambda f: _placed(source, source, f, how + "spaced")))
    quotes = F.when(_stripped(span, blank) != "", let(found(plain(source), _literal(plain(span), blank)), lambda f: _placed(source, plain(source), f, how + "quotes")))
    return F.coalesce(F.when(F.contains(source, span), _placed(source, source, span, how + "exact")), words, quotes)


def resolve(source: Column, span: Column, blank: str = BLANK) -> Column:
    """Struct (verbatim, begin, end, how) of a quoted span in its source, or null.

    No word may differ. White space may, and curly for straight quotes, and quotes or one pair of brackets put around the span.
    The first of these ways that finds anything decides, and its first place: exact, spaced, quotes, then each with unwrapped_: without one
    quote at each end, as those further in may be the source's own, then without all, and without brackets. Null or blank source or span: null.
    ``blank`` is the class of white space.
    """
    clean = _stripped(span, blank)
    marks = "".join(f"\\{c}" if c in "\"'" else c for c in WRAPPING)
    once = F.regexp_replace(clean, rf"^[{marks}]|[{marks}]\z", "")
    bare = F.regexp_replace(clean, rf"^[{marks}]+|[{marks}]+\z", "")
    inner = F.when(bare.rlike(r"(?s)^(?:\[.*\]|\(.*\))\z") & (F.length(bare) >= 2), _stripped(F.substring(bare, F.lit(2), F.length(bare) - 2), blank)).otherwise(bare)

    def both(x: Column) -> Column:
        fewer = F.when((x["once"] != x["clean"]) & (x["once"] != x["inner"]) & (x["once"] != ""), _match(source, x["once"], "unwrapped_", blank))
        again = F.when((x["inner"] != "") & (x["inner"] != x["clean"]), _match(source, x["inner"], "unwrapped_", blank))
        return F.when((source != "") & (x["clean"] != ""), F.coalesce(_match(source, x["clean"], "", blank), fewer, again))

    return let(F.struct(clean.alias("clean"), once.alias("once"), inner.alias("inner")), both)


def sentences(text: Column, prefix: str = "S1") -> Column:
    """Array of (id, text, begin, end): sentences in order, numbered from 1.

    A sentence ends after .!? and closing marks where white space or the end follows, but not after an abbreviation; and before two
    line breaks. ``text`` has no white space at its ends; ``begin`` and ``end`` may take in some behind it. Null or blank: no sentences.
    """
    over = rf"[.!?]+[\"'”’»)]*(?<!\b(?:{'|'.join(ABBREVIATIONS)})\.)(?=[{_BLANK}]|\z)"
    piece = rf"(?si){BLANK}*[^{_BLANK}].*?(?:{over}|(?=\n\n)|\z)"
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(piece), F.lit(0))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<id: string, text: string, begin: int, end: int>>").alias("out"))

    def add(a: Column, p: Column) -> Column:
        bare = F.regexp_replace(p, f"^{BLANK}+", "")
        end = a["at"] + F.length(p)
        row = F.struct(F.concat(F.lit(prefix + "."), (F.size(a["out"]) + 1).cast("string")).alias("id"), stripped(p).alias("text"), (end - F.length(bare)).alias("begin"), end.alias("end"))
        return F.struct(end.alias("at"), F.array_append(a["out"], row).alias("out"))

    return F.aggregate(pieces, empty, add, lambda a: a["out"])


def cover(intervals: Column, length: Column) -> Column:
    """Struct (covered, overlapping, gaps) of intervals (array of struct<begin, end>) on a text of that length.

    One fold over the intervals in order: ``covered`` counts places in any interval, ``overlapping`` intervals that begin before an
    earlier one ended, ``gaps`` are the maximal uncovered intervals. Intervals are cut to the text; empty ones and nulls do not count.
    """
    zero, size = F.lit(0), F.coalesce(length, F.lit(0))
    cut = F.transform(F.coalesce(intervals, F.array().cast("array<struct<begin: int, end: int>>")), lambda x: F.struct(F.greatest(x["begin"], zero).alias("begin"), F.least(x["end"], size).alias("end")))
    kept = F.array_sort(F.filter(cut, lambda x: F.coalesce(x["begin"] < x["end"], F.lit(False))))
    start = F.struct(zero.alias("at"), zero.alias("covered"), zero.alias("overlapping"), F.array().cast("array<struct<begin: int, end: int>>").alias("gaps"))

    def step(a: Column, x: Column) -> Column:
        gap = F.when(x["begin"] > a["at"], F.array_append(a["gaps"], F.struct(a["at"].alias("begin"), x["begin"].alias("end")))).otherwise(a["gaps"])
        fresh = F.greatest(x["end"] - F.greatest(x["begin"], a["at"]), zero)
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), (a["covered"] + fresh).alias("covered"), (a["overlapping"] + (x["begin"] < a["at"]).cast("int")).alias("overlapping"), gap.alias("gaps"))

    def done(a: Column) -> Column:
        last = F.when(a["at"] < size, F.array_append(a["gaps"], F.struct(a["at"].alias("begin"), size.alias("end")))).otherwise(a["gaps"])
        return F.struct(a["covered"].alias("covered"), a["overlapping"].alias("overlapping"), last.alias("gaps"))

    return F.aggregate(kept, start, step, done)
