"""Synthetic exercises enumerated from an index space: a number's digits in mixed radix choose a template and its values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``axes``: each a list of values of one type. ``text`` and ``answer`` make columns of one column an axis."""

    name: str
    axes: list[list]
    text: Callable[..., Column]
    answer: Callable[..., Column]

    @property
    def size(self) -> int:
        return prod(len(a) for a in self.axes)


def total(templates: list[Template]) -> int:
    return sum(t.size for t in templates)


def digits(number: Column, radixes: list[int]) -> list[Column]:
    """The number's digits, the first axis turning slowest."""
    out, below = [], prod(radixes)
    for radix in radixes:
        below //= radix
        out.append((F.floor(number / below) % radix).cast("int"))
    return out


def enumerated(rows: DataFrame, number: str, templates: list[Template]) -> DataFrame:
    """``rows`` with template, text and answer of their number, which is taken modulo the number of all samples.

    A row is made from its own number alone: no list of samples anywhere, the same rows from any partitioning, no shuffle. A null number has none.
    """
    at, first, cases = F.pmod(F.col(number), F.lit(total(templates))), 0, []
    for t in templates:
        inside = [F.get(F.array(*[F.lit(v) for v in axis]), d) for axis, d in zip(t.axes, digits(at - first, [len(a) for a in t.axes]), strict=True)]
        cases.append((at < first + t.size, F.struct(F.lit(t.name).alias("template"), t.text(*inside).alias("text"), t.answer(*inside).cast("string").alias("answer"))))
        first += t.size
    made = F.when(*cases[0])
    for case in cases[1:]:
        made = made.when(*case)
    return rows.withColumn("_made", made).select("*", "_made.template", "_made.text", "_made.answer").drop("_made")


def _said(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def arithmetic() -> list[Template]:
    """Sums, products, shares and rates, whose answers are whole numbers or exact fractions."""
    numbers, small = list(range(2, 102)), list(range(2, 22))
    things = ["pages", "books", "exercises", "chapters", "notes"]
    return [
        Template("sum", [numbers, numbers, things], lambda a, b, x: _said("A shelf holds ", a, " ", x, " and another ", b, ". How many ", x, " are there?"), lambda a, b, x: a + b),
        Template("product", [small, numbers, things], lambda a, b, x: _said(a, " boxes hold ", b, " ", x, " each. How many ", x, " are there?"), lambda a, b, x: a * b),
        Template("share", [small, numbers], lambda a, b: _said(a * b, " pages are read in ", a, " equal parts. How long is a part?"), lambda a, b: b),
        Template("percent", [list(range(5, 100, 5)), numbers], lambda p, n: _said("What is ", p, " % of ", n * 20, "?"), lambda p, n: F.floor(p * n / 5)),
    ]
