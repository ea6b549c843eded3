"""Timetables: rows of a recognised table by geometry, valid entries, matches against expected entries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weekday(text: Column) -> Column:
    """1 Monday to 7 Sunday, from numbers, names and 'thứ' forms; null for anything else."""
    t = F.lower(F.trim(text))
    # Names of the days.
    names = [("monday|mon|thứ hai|thứ 2|t2", 1), ("tuesday|tue|thứ ba|thứ 3|t3", 2), ("wednesday|wed|thứ tư|thứ 4|t4", 3), ("thursday|thu|thứ năm|thứ 5|t5", 4), ("friday|fri|thứ sáu|thứ 6|t6", 5), ("saturday|sat|thứ bảy|thứ 7|t7", 6), ("sunday|sun|chủ nhật|cn", 7)]
    out = F.when(t.rlike("^[1-7]$"), t.cast("int"))
    for pattern, day in names:
        out = out.when(t.rlike(f"^(?:{pattern})$"), day)
    return out


def clock(text: Column) -> Column:
    """HH:MM from 7:5, 7h30, 0730 and the like; null where it is no time of day."""
    t = F.trim(text)
    hour = F.regexp_extract(t, r"^(\d{1,2})\s*(?:[:hg.]\s*(\d{1,2})?|(\d{2}))?$", 1)
    minute = F.concat(F.regexp_extract(t, r"^(\d{1,2})\s*[:hg.]\s*(\d{1,2})$", 1 + 1), F.regexp_extract(t, r"^(\d{2})(\d{2})$", 2))
    h, m = F.when(hour != "", hour.cast("int")), F.when(minute != "", minute.cast("int")).otherwise(0)
    return F.when((h < 24) & (m < 60), F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0")))


def entry_problem(course: Column, day: Column, start: Column, end: Column) -> Column:
    time = r"^([01]\d|2[0-3]):[0-5]\d$"
    return F.when(F.coalesce(F.trim(course), F.lit("")) == "", "course").when(~F.coalesce(day.between(1, 7), F.lit(False)), "weekday").when(~F.coalesce(start.rlike(time) & end.rlike(time), F.lit(False)), "time").when(start >= end, "order")


def bands(lines: DataFrame, image: str = "image", anchor: str = "anchor") -> DataFrame:
    """image, row, column, text: words of a table's cells. Anchor lines open rows; a row reaches to the next anchor; columns are those of the headers.

    lines: image, text, x, y, header (a column's name on header lines), anchor (true on lines that open a row).
    """
    heads = lines.where("header is not null").select(image, F.col("header").alias("column"), F.col("x").alias("left"))
    heads = heads.withColumn("right", F.lead("left", 1, float("inf")).over(Window.partitionBy(image).orderBy("left")))
    rows = lines.where(F.col(anchor)).select(image, F.col("y").alias("top"))
    w = Window.partitionBy(image).orderBy("top")
    rows = rows.withColumn("row", F.row_number().over(w)).withColumn("bottom", F.lead("top", 1, float("inf")).over(w))
    words = lines.where("header is null").select(image, "text", "x", "y")
    met = words.join(rows, image).where((F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom")))
    cells = met.join(heads, image).where((F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "text"))), lambda s: s["text"]), " ")
    return cells.groupBy(image, "row", "column").agg(joined.alias("text"))


def best_matches(found: DataFrame, expected: DataFrame, group: str) -> DataFrame:
    """group, expected, found, points: greedy one-to-one matching, 3 points for the course and 2 for the weekday; sequential, so by group."""
    both = expected.select(group, F.lit(True).alias("wanted"), "id", "course", "day").unionByName(found.select(group, F.lit(False).alias("wanted"), "id", "course", "day"))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows[~rows["wanted"]].sort_values("id").to_dict("records")
        out = []
        for e in rows[rows["wanted"]].sort_values("id").to_dict("records"):
            points = [(3 * (f["course"] == e["course"]) + 2 * (f["day"] == e["day"]), -i) for i, f in enumerate(left)]
            best = max(points, default=(0, 0))
            hit = left.pop(-best[1]) if best[0] > 0 else None
            out.append((e[group], e["id"], hit["id"] if hit else None, best[0]))
        return pd.DataFrame(out, columns=[group, "expected", "found", "points"]).astype({"found": "Int64"})

    return both.groupBy(group).applyInPandas(match, f"{group} string, expected long, found long, points int")
