"""Literal cases of study material and timetables."""

import pytest
from pyspark.sql import functions as F

from scholia.operators import stores, study
from scholia.operators import timetable as T


def test_items_and_answers(spark):
    text = "# Theory\n1. not this\n## Exercises\n1. What is\nthe sum?\n2) And this?\n2. Twice\n## Answers\n1. Four\n3. Nothing asked\n"
    assert study.numbered_items(text) == [("exercise", 1, "What is the sum?"), ("exercise", 2, "And this?"), ("exercise", 2, "Twice"), ("answer", 1, "Four"), ("answer", 3, "Nothing asked")]
    rows = study.items(spark.createDataFrame([("p", text), ("q", None)], "id string, text string"), "id", "text")
    met = stores.match_answers(rows.where("section = 'exercise'"), rows.where("section = 'answer'"), "id", "number", "text")
    assert {tuple(r) for r in met.collect()} == {("p", 1, "Four", "matched"), ("p", 2, None, "missing")}


def test_gap(spark):
    df = spark.createDataFrame([(1, "Short one. The quick brown foxes jump over lazily sleeping dogs today. End.")], "id long, t string")
    assert study.gaps(df, "id", "t", 5).first()[1:] == ("The quick brown foxes jump over lazily ____ dogs today.", "sleeping")


@pytest.mark.parametrize(("text", "wanted"), [("7:5", "07:05"), ("7h30", "07:30"), ("0730", "07:30"), ("9", "09:00"), ("25:00", None), ("x", None)])
def test_clock(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(T.clock(F.col("t"))).first()[0] == wanted


def test_weekdays_and_entries(spark):
    got = [r[0] for r in spark.createDataFrame([("Thứ Hai",), ("sun",), ("3",), ("8",)], "t string").select(T.weekday(F.col("t"))).collect()]
    assert got == [1, 7, 3, None]
    rows = spark.createDataFrame([("A", 1, "07:00", "08:00"), ("", 1, "07:00", "08:00"), ("A", 9, "07:00", "08:00"), ("A", 1, "7:00", "08:00"), ("A", 1, "09:00", "08:00")], "c string, d int, s string, e string")
    assert [r[0] for r in rows.select(T.entry_problem(F.col("c"), F.col("d"), F.col("s"), F.col("e"))).collect()] == [None, "course", "weekday", "time", "order"]


def test_bands(spark):
    lines = [("i", "Course", 0.0, 0.0, "course", False), ("i", "Room", 50.0, 0.0, "room", False), ("i", "Maths", 1.0, 10.0, None, True), ("i", "B1", 51.0, 12.0, None, False), ("i", "II", 2.0, 15.0, None, False), ("i", "Art", 1.0, 20.0, None, True), ("i", "above", 1.0, 5.0, None, False)]
    got = {tuple(r) for r in T.bands(spark.createDataFrame(lines, "image string, text string, x double, y double, header string, anchor boolean")).collect()}
    assert got == {("i", 1, "course", "Maths II"), ("i", 1, "room", "B1"), ("i", 2, "course", "Art")}


def test_best_matches(spark):
    schema = "g string, id long, course string, day int"
    want = spark.createDataFrame([("g", 1, "A", 1), ("g", 2, "B", 2), ("g", 3, "C", 5)], schema)
    found = spark.createDataFrame([("g", 10, "B", 1), ("g", 11, "A", 3)], schema)
    assert {tuple(r) for r in T.best_matches(found, want, "g").collect()} == {("g", 1, 11, 3), ("g", 2, 10, 3), ("g", 3, None, 0)}
