"""Calendar export of weekly slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    """Backslash, semicolon, comma and line break as a calendar file wants them."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (";", ","):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return F.regexp_replace(out, r"\r?\n", r"\\\\n")


def folded(line: Column, octets: int = 75) -> Column:
    """A line in parts of at most 75 octets, each after the first begun by a space; characters stay whole."""
    chars = F.split(line, "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def step(a: Column, c: Column) -> Column:
        size = F.octet_length(c)
        full = a["used"] + size > octets
        return F.struct(F.concat(a["out"], F.when(full, "\r\n ").otherwise(""), c).alias("out"), F.when(full, size + 1).otherwise(a["used"] + size).alias("used"))

    return F.when(F.octet_length(line) <= octets, line).otherwise(F.aggregate(chars, start, step, lambda a: a["out"]))


def events(slots: DataFrame, key: str, title: str, first: str, start: str, minutes: int, until: str) -> DataFrame:
    """key, event: one VEVENT a slot that recurs weekly; ``first`` a date, ``start`` minutes of the day. A slot may end on the next day."""

    def clock(m: Column) -> Column:
        day, rest = F.date_add(F.col(first), F.floor(m / 1440).cast("int")), m % 1440
        return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("T"), F.lpad(F.floor(rest / 60).cast("string"), 2, "0"), F.lpad((rest % 60).cast("string"), 2, "0"), F.lit("00"))

    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col(key).cast("string")), F.concat(F.lit("DTSTART:"), clock(F.col(start))), F.concat(F.lit("DTEND:"), clock(F.col(start) + minutes)), F.lit(f"RRULE:FREQ=WEEKLY;UNTIL={until}"), F.concat(F.lit("SUMMARY:"), escaped(F.col(title))), F.lit("END:VEVENT")]
    return slots.select(key, F.concat_ws("\r\n", *[folded(x) for x in lines]).alias("event"))
