"""Rating clean-up: group statistics on rows, standardisation, attention checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.exprs import answered_correctly, ratio
from pairlab.sources.staging import stage


def spread_aggregates(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """Put aggregates of each group on all of its rows.

    The aggregates are computed with partial aggregation, staged, and joined back, so a
    group of any size is never gathered in one task the way a window would.  Because the
    staged table has a known size, Spark broadcasts it only while it is small.  A missing
    key is a group of its own.
    """
    stats = stage(
        df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(
            *[column.alias(name) for name, column in aggregates.items()]
        ),
        "group-stats",
    )
    match = reduce(lambda a, b: a & b, [df[k].eqNullSafe(stats[f"__{k}"]) for k in keys])
    return df.join(stats, match, "left").drop(*[f"__{k}" for k in keys])


def standardise(df: DataFrame, by: Sequence[str], value: str, name: str = "zscores") -> DataFrame:
    """(x - mean) / sd within each group, missing values ignored, constant groups NULL.

    Run it before keeping trials only: fillers count towards a rater's mean and sd.
    """
    with_stats = spread_aggregates(
        df, by, {"__mean": F.avg(value), "__sd": F.stddev_samp(value)}
    )
    z = ratio(F.col(value) - F.col("__mean"), F.col("__sd"))
    return with_stats.withColumn(name, z).drop("__mean", "__sd")


def flag_correct(df: DataFrame, score: str = "zscores", kind: str = "classification") -> DataFrame:
    """Add ``correct``: did the rater put the attention item on the right side of zero?"""
    return df.withColumn("correct", answered_correctly(score, kind))


def failed_raters(
    checks: DataFrame,
    rater: str = "partid",
    kind: str = "classification",
    min_high: int = 5,
    min_low: int = 7,
) -> DataFrame:
    """Raters with too few correct high items or too few correct low items.

    ``checks`` carries a ``correct`` flag.  One aggregation; a missing flag counts as not
    correct, so a rater who answers everything alike fails, and a rater who never saw a kind is
    not judged on it.
    """

    def correct(level: str) -> Column:
        seen = F.count_if(F.col(kind) == level) > 0
        return F.when(seen, F.coalesce(F.sum(F.when(F.col(kind) == level, F.col("correct"))), F.lit(0)))

    totals = checks.groupBy(rater).agg(correct("high").alias("high_correct"), correct("low").alias("low_correct"))
    return totals.where((F.col("high_correct") < min_high) | (F.col("low_correct") < min_low))


def above_overall_mean(df: DataFrame, value: str) -> DataFrame:
    """Rows above the whole-table mean, taken from a scalar subquery."""
    mean = df.agg(F.avg(value)).scalar()
    return df.where(F.col(value) > mean)
