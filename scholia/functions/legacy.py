"""Legacy encodings of Vietnamese: detection and decoding."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The one-byte code (ABC) as characters, and what each stands for.
TCVN3 = "µ¸¶·¹¨»¾¼½Æ©ÇÊÈÉËÌÐÍÎÏªÒÕÓÔÖ×ÝØÜÞßáàãä«åèæçé¬êíëìîïóñòô­õøö÷ùúýûüþ®§"
UNICODE = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđĐ"
# Characters of the code that plain text seldom has, and letters that only Unicode text has.
DISTINCT = r"[µ¸¶·¹¨»¾¼½Æ©ÇÈÉËÌÐÍÎÏªÒÕÓÔÖ×ØÜÞß«¬\x{AD}÷®§]"
MODERN = r"[đĐơưƠƯ\x{1EA0}-\x{1EF9}]"


def is_tcvn3(text: Column) -> Column:
    """By the first 3,000 characters: five distinct ones or more, over a two-hundredth of all, and hardly any modern letter."""
    sample = F.substring(text, 1, 3000)
    marks = F.regexp_count(sample, F.lit(DISTINCT))
    return (F.regexp_count(sample, F.lit(MODERN)) <= 2) & (marks >= 5) & (marks / F.greatest(F.length(F.trim(sample)), F.lit(1)) > 0.005)


def decode_tcvn3(text: Column) -> Column:
    """One character for one, so a built-in translation."""
    return F.translate(text, TCVN3, UNICODE)


# The two-character code marks a base letter by a tone letter that follows it.
_TONES = {"ù": "́", "ø": "̀", "û": "̉", "õ": "̃", "ï": "̣"}
_HAT = {"â": "", "á": "́", "à": "̀", "å": "̉", "ã": "̃", "ä": "̣"}
_BREVE = {"ê": "", "é": "́", "è": "̀", "ú": "̉", "ü": "̃", "ë": "̣"}


def vni_table() -> dict[str, str]:
    """The code's sequences, derived from base letters and tone letters."""
    import unicodedata

    made: dict[str, str] = {"ñ": "đ", "ö": "ư", "ô": "ơ", "öô": "ươ", "í": "í", "ì": "ì", "æ": "ỉ", "ó": "ĩ", "ò": "ị", "î": "ỵ"}
    compose = lambda *parts: unicodedata.normalize("NFC", "".join(parts))
    for base in "aeouy":
        for mark, tone in _TONES.items():
            made[base + mark] = compose(base, tone)
    for base, out in (("ö", "ư"), ("ô", "ơ"), ("öô", "ươ")):
        for mark, tone in _TONES.items():
            made[base + mark] = compose(out, tone)
    for base in "aeo":
        for mark, tone in _HAT.items():
            made[base + mark] = compose(base, "̂", tone)
    for mark, tone in _BREVE.items():
        made["a" + mark] = compose("a", "̆", tone)
    upper = {k.upper(): v.upper() for k, v in made.items()}
    title = {k[0].upper() + k[1:]: v[0].upper() + v[1:] for k, v in made.items() if len(k) > 1}
    return made | upper | title


_VNI: tuple[re.Pattern, dict[str, str]] | None = None


def decode_vni_text(text: str) -> str:
    """Longest sequence first, each character once."""
    global _VNI
    if _VNI is None:
        table = vni_table()
        _VNI = re.compile("|".join(sorted(map(re.escape, table), key=len, reverse=True))), table
    pattern, table = _VNI
    return pattern.sub(lambda m: table[m.group()], text)


def decode_vni(text: Column) -> Column:
    """A chain of replacements would read its own output again, so this is a vectorised UDF."""

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else decode_vni_text(t))

    return decode(text)


# Frequent words of the two-character code, and pairs of a vowel and a tone letter.
VNI_WORDS = r"\b(laø|vaø|meänh|ñeà|coù|ñuùng|cuûa|khoâng|moät|ngöôøi|ñöôïc|nhöng|toaùn|hoïc|ñònh|nghóa|khaúng|phaûi|bieát|caùc|trong|ñaõ|seõ|ñeán)\b"
VNI_PAIRS = r"(?:ñ|öô|[aeouyöô][ùøûõïäâëéèúü]|o[áàảãạâä]|e[áàảãạêë])"


def is_vni(text: Column) -> Column:
    """By the first 4,000 characters: two frequent words of the code, or its letters with four tone pairs, and hardly any modern letter."""
    sample = F.substring(text, 1, 4000)
    return (F.regexp_count(sample, F.lit(MODERN)) <= 2) & ((F.regexp_count(sample, F.lit("(?iU)" + VNI_WORDS)) >= 2) | (sample.rlike("[ñÑöÖ]") & (F.regexp_count(sample, F.lit("(?iu)" + VNI_PAIRS)) >= 4)))
