"""Cleaning of extracted text: control characters, glued words, blank lines, spaces outside quotes, Unicode forms.

All but the Unicode forms and one legacy code are built-in expressions; the two vectorised UDFs get null for every text that
they would not change.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.legacy import decode_tcvn3, decode_vni, is_tcvn3, is_vni

# Lines that mark a text as code.
CODE = r"(?m)^\s*(?:#include\b|class\s+\w+\s*\{|def\s+\w+\(|(?:public|private|protected):|(?:int|void|const|char|float)\s+[^\n]*[;{])"
# Words that extraction glues together, and how they are parted.
GLUED = [
    (r"\b(ánh\s*)?(xạ)(tuyến\s*tính)\b", "$1xạ $3"),
    (r"\b(đại\s*)?(số)(tuyến\s*tính)\b", "$1số $3"),
    (r"\b(thể)(được)\b", "$1 $2"),
    (r"\b(cơ\s*)?(sở)(cho|là)\b", "$1sở $3"),
    (r"\b(kết\s*)?(quả)(trả\s*về)\b", "$1quả $3"),
    (r"\b(trả\s*)?(về)(là)\b", "$1về $3"),
    (r"\b(mở)(rộng)\b", "$1 $2"),
    (r"\b(tự)(nhiên)\b", "$1 $2"),
    (r"\b(xạ)(f)\b", "$1 $2"),
]
#: Quoted stretches, then what is between quotes, then a quote that closes nothing.
PARTS = r""""[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[^"']++|["']"""
#: Characters that composition can concern: all above Latin but the composed Vietnamese letters.
COMPOSABLE = r"[\x{0300}-\x{1E9F}\x{1EFA}-\x{10FFFF}]"


def _form(text: Column, form: str) -> Column:
    @F.pandas_udf("string")
    def change(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return change(text)


def nfc(text: Column) -> Column:
    """The composed form."""
    return F.coalesce(_form(F.when(text.rlike(COMPOSABLE), text), "NFC"), text)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")


def without_controls(text: Column) -> Column:
    """Control characters but tab and line breaks as spaces."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")


def joined(text: Column) -> Column:
    """Words that a hyphen and a line break part, whole again: for prose only, as elsewhere it may be a minus."""
    return F.regexp_replace(text, r"(?U)(\w+)-\n(\w+)", "$1$2")


def parted(text: Column) -> Column:
    """The glued words parted."""
    for pattern, by in GLUED:
        text = F.regexp_replace(text, "(?iU)" + pattern, by)
    return text


def blank_lines(text: Column) -> Column:
    """At most one blank line in a row."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: in a lambda the expression itself would be computed anew for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def single_spaced(text: Column) -> Column:
    """Runs of spaces and tabs as one space, but at a line's beginning and in quotes."""

    def one(parts: Column, part: Column, i: Column) -> Column:
        # behind a quote that closes nothing a part goes on; behind a quoted stretch it begins
        goes_on = (i > 0) & F.coalesce(F.get(parts, i - 1).rlike("^[\"']$"), F.lit(False))
        spaced = F.when(goes_on, F.substring(F.regexp_replace(F.concat(F.lit("x"), part), r"(?<=\S)[ \t]{2,}", " "), 2, 1 << 30)).otherwise(F.regexp_replace(part, r"(?<=\S)[ \t]{2,}", " "))
        return F.when((F.length(part) > 1) & part.rlike("^[\"']"), part).otherwise(spaced)

    return let(F.regexp_extract_all(text, F.lit(PARTS), F.lit(0)), lambda parts: F.array_join(F.transform(parts, lambda part, i: one(parts, part, i)), ""))


def is_code(text: Column) -> Column:
    return text.rlike(CODE)


def tidied(text: Column, prose: bool = False) -> Column:
    """Text in Unicode by the rules above; code only trimmed and without NUL."""

    def rules(t: Column) -> Column:
        out = without_controls(t)
        out = single_spaced(blank_lines(parted(joined(out) if prose else out)))
        return F.when(is_code(t), trimmed(F.translate(t, "\0", ""))).otherwise(trimmed(out))

    return let(nfc(text), rules)


def cleaned(text: Column, prose: bool = False) -> Column:
    """The chain: legacy codes decoded, but in code, then composed and tidied. Null gives an empty text."""
    given = F.coalesce(text, F.lit(""))
    legacy_vni = ~is_code(given) & ~is_tcvn3(given) & is_vni(given)
    return tidied(F.coalesce(decode_vni(F.when(legacy_vni, given)), F.when(~is_code(given) & is_tcvn3(given), decode_tcvn3(given)), given), prose)


def plain_words(text: Column, word: str = r"(?U)\w+") -> Column:
    """The set of lower-case words without marks, đ as d; ``word`` is a word's pattern."""
    flat = F.translate(F.regexp_replace(_form(F.lower(text), "NFD"), r"\p{Mn}+", ""), "đ", "d")
    return F.array_distinct(F.regexp_extract_all(flat, F.lit(word), F.lit(0)))


def capitals(text: Column) -> Column:
    """In capitals, character by character: one whose capital form is longer, such as ß, stays."""
    whole = F.upper(text)
    each = F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c))
    return F.when(F.length(whole) == F.length(text), whole).otherwise(F.array_join(each, ""))
