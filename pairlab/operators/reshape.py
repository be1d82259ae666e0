"""Long to wide and back."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only_value(value: Column, test: Column) -> Column:
    """The single value of a cell; two rows in one cell fail the job."""
    clash = F.raise_error(F.lit("more than one row for one cell")).cast("string")
    return F.when(F.count_if(test) > 1, clash).otherwise(F.min(F.when(test, value)))


def first_value(value: Column, test: Column) -> Column:
    """Smallest value of a cell, so that repeated rows give a stable answer."""
    return F.min(F.when(test, value))


def mean_value(value: Column, test: Column) -> Column:
    """Mean of a cell, skipping missing values."""
    return F.avg(F.when(test, value))


def strict_mean_value(value: Column, test: Column) -> Column:
    """Mean of a cell; NULL as soon as one of its values is missing."""
    return F.when(F.count_if(test & value.isNull()) == 0, F.avg(F.when(test, value)))


def exact_mean_value(places: int) -> Callable[[Column, Column], Column]:
    """Strict mean of numbers with so many decimal places, summed exactly: the order of rows can't change a digit."""

    def aggregate(value: Column, test: Column) -> Column:
        total = F.sum(F.when(test, value.cast(f"decimal(28,{places})"))).cast("double")
        return F.when(F.count_if(test & value.isNull()) == 0, F.try_divide(total, F.count_if(test)))

    return aggregate


def to_wide(
    df: DataFrame,
    keys: Sequence[str],
    names_from: str,
    levels: Sequence[str],
    values: Mapping[str, Callable[[Column, Column], Column]],
    naming: str = "{value}_{level}",
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Long to wide by conditional aggregation.

    One partial aggregation and one shuffle on ``keys``; DataFrame.pivot would aggregate
    and shuffle twice, and would need a job of its own to find unlisted levels.
    """
    cells = [
        aggregate(F.col(value), F.col(names_from) == F.lit(level)).alias(
            naming.format(value=value, level=level)
        )
        for value, aggregate in values.items()
        for level in levels
    ]
    added = [column.alias(name) for name, column in (extra or {}).items()]
    return df.groupBy(*keys).agg(*cells, *added)


def to_long(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], names_to: str, values_to: str
) -> DataFrame:
    """Wide to long; missing values keep their row."""
    return df.unpivot(list(keys), list(columns), names_to, values_to)


def to_long_grouped(
    df: DataFrame,
    keys: Sequence[str],
    groups: Mapping[str, Sequence[str]],
    names_to: str,
    values_to: Sequence[str],
) -> DataFrame:
    """Wide to long over groups of columns: one row per input row and group."""
    rows = [
        F.struct(
            F.lit(label).alias(names_to),
            *[F.col(c).alias(v) for c, v in zip(columns, values_to, strict=True)],
        )
        for label, columns in groups.items()
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


def relocate(df: DataFrame, column: str, after: str | None = None) -> DataFrame:
    """Move one column to the front, or right after another."""
    rest = [c for c in df.columns if c != column]
    at = 0 if after is None else rest.index(after) + 1
    return df.select(*rest[:at], column, *rest[at:])
