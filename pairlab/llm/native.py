"""Column expressions shared by the operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of the two word definitions, and the letters that are lower-cased.
SPACES = r"[\x20\x09-\x0D]+"
NOT_ALPHANUMERIC = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it and wherever the optimiser moves it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: str | Column, separators: str) -> Column:
    """Words of a text; none for null."""
    value = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_remove(F.split(value, separators), "")


def lower_ascii(text: str | Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def starts(words: Column, length: int | Column) -> Column:
    """0-based starts of the windows of ``length`` words."""
    n = F.size(words)
    length = F.lit(length) if isinstance(length, int) else length
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def covered_length(spans: Column) -> Column:
    """Places that spans (start, len), in order of start, cover: a fold over two numbers, however many runs there are."""

    def step(acc: Column, span: Column) -> Column:
        end = span["start"] + span["len"]
        more = F.greatest(end - F.greatest(span["start"], acc["upto"]), F.lit(0))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(spans, nothing, step, lambda acc: acc["n"])
