"""Literal cases of verdicts, packing, admission and queues."""

import pytest
from pyspark.sql import functions as F

from scholia.operators import review as V


@pytest.mark.parametrize(
    ("raw", "state"),
    [
        ('{"supported": true, "quote": "a fact"}', "supported"),
        ('```json\n{"supported": true, "quote": "a fact"}\n```', "supported"),
        ('{"supported": true, "quote": "no fact"}', "uncertain"),
        ('{"supported": true, "quote": ""}', "uncertain"),
        ('{"supported": true}', "uncertain"),
        ('{"supported": false, "quote": "a fact"}', "rejected"),
        ('{"supported": tr', "invalid"),
        ("{}", "invalid"),
        (None, "invalid"),
    ],
)
def test_verdicts_fail_closed(spark, raw, state):
    df = spark.createDataFrame([(raw, "here is a fact.")], "raw string, source string")
    assert df.select(V.verdict(F.col("raw"), F.col("source"))["state"]).first()[0] == state


def test_pack_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([([5, 9, 4, 1],)], "s array<long>")
    assert df.select(V.pack_passages(F.col("s"), 10)).first()[0] == [0, 2, 3]


def test_inspection(spark):
    df = spark.createDataFrame([("x = 1 as in figure 2 ", 1, 7), ("plain", 0, 0)], "t string, i int, d int")
    got = [r[0] for r in df.select(V.inspection(F.col("t"), F.col("i"), F.col("d"))).collect()]
    assert got == [["private_use", "drawings", "images", "formula_with_visual", "figure_mentioned"], []]


def test_update_needs_the_present_revision(spark):
    sessions = spark.createDataFrame([(1, 3, "s", "t", "auto"), (2, 3, "s", "t", "manual"), (3, 4, "s", "t", "auto")], "id long, revision int, summary string, title string, title_kind string")
    updates = spark.createDataFrame([(1, 3, "n", "m"), (2, 3, "n", "m"), (3, 3, "n", "m")], "id long, revision int, summary string, title string")
    got = {tuple(r) for r in V.set_summary(sessions, updates, "id").collect()}
    assert got == {(1, 4, "n", "m"), (2, 4, "n", "t"), (3, 4, "s", "t")}
