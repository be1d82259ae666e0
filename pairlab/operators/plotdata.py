"""The numbers behind the figures: points, trend bands, boxes, bars, bins, ranges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pairlab.functions.tdist import quantile
from pairlab.operators.ols import simple_regressions
from pairlab.operators.quantiles import grouped_quantiles
from pairlab.sources.staging import stage

# Drawing defaults of the study's figures.
SMOOTH_POSITIONS = 80
BAND_LEVEL = 0.95
WHISKER = 1.5
HISTOGRAM_BINS = 30


def points(df: DataFrame, x: str | Column, y: str | Column, *groups: str) -> DataFrame:
    """x, y and the columns that colour or facet them."""
    xc = F.col(x) if isinstance(x, str) else x
    yc = F.col(y) if isinstance(y, str) else y
    return df.select(*groups, xc.cast("double").alias("x"), yc.cast("double").alias("y"))


@F.pandas_udf(DoubleType())
def _t_multiplier(df: pd.Series, level: pd.Series) -> pd.Series:
    return pd.Series([quantile(0.5 + l / 2, d) if d > 0 else None for d, l in zip(df, level)], dtype="float64")


def linear_smooth(
    xy: DataFrame, by: Sequence[str], positions: int = SMOOTH_POSITIONS, level: float = BAND_LEVEL
) -> DataFrame:
    """Fitted line and confidence band at evenly spaced x per group.

    One aggregation of regression sums; only one row per group is expanded.  Two points give
    a line without a band.
    """
    complete = xy.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    limits = complete.groupBy(*by).agg(
        F.regr_count("y", "x").alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_avgx("y", "x").alias("mx"),
        F.regr_avgy("y", "x").alias("my"),
        F.regr_sxx("y", "x").alias("sxx"),
        F.regr_sxy("y", "x").alias("sxy"),
        F.regr_syy("y", "x").alias("syy"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
    ).where((F.col("n") > 1) & (F.col("sxx") > 0))
    residual = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    per_group = limits.withColumns(
        {
            "s2": residual / F.nullif(F.col("n") - 2, F.lit(0)),
            "t": _t_multiplier((F.col("n") - 2).cast("double"), F.lit(level)),
        }
    )
    steps = F.sequence(F.lit(0), F.lit(positions - 1))
    grid = per_group.select("*", F.explode(steps).alias("step"))
    x = F.col("low") + (F.col("high") - F.col("low")) * F.col("step") / F.lit(float(positions - 1))
    grid = grid.withColumn("x", x)
    fit = F.col("my") + F.col("slope") * (F.col("x") - F.col("mx"))
    away = F.col("x") - F.col("mx")
    se = F.sqrt(F.col("s2") * (1 / F.col("n") + away * away / F.col("sxx")))
    return grid.select(
        *by, "step", "x", fit.alias("y"), se.alias("se"),
        (fit - F.col("t") * se).alias("ymin"), (fit + F.col("t") * se).alias("ymax"),
    )


def _with_fences(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows with a value, joined to their group's quartiles and fences; staged once, read twice."""
    if not by:
        raise ValueError("a box needs at least one grouping column")
    rows = stage(df.where(F.col(value).isNotNull()), "box-rows")
    boxes = grouped_quantiles(rows, by, value, (0.25, 0.5, 0.75), ("lower", "middle", "upper"), staged=True)
    reach = (F.col("upper") - F.col("lower")) * WHISKER
    boxes = stage(
        boxes.withColumns({"low_fence": F.col("lower") - reach, "high_fence": F.col("upper") + reach}), "boxes"
    )
    right = boxes.withColumnsRenamed({k: f"__{k}" for k in by})
    match = F.lit(True)
    for k in by:
        match = match & rows[k].eqNullSafe(right[f"__{k}"])
    return rows.join(right, match).drop(*[f"__{k}" for k in by])


def boxes(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whisker ends inside 1.5 IQR and outlier count per group."""
    rows = _with_fences(df.select(*by, value), by, value)
    inside = F.col(value).between(F.col("low_fence"), F.col("high_fence"))
    return rows.groupBy(*by).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max("lower").alias("lower"),
        F.max("middle").alias("middle"),
        F.max("upper").alias("upper"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def box_outliers(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows beyond the whiskers of their group."""
    rows = _with_fences(df, by, value)
    outside = ~F.col(value).between(F.col("low_fence"), F.col("high_fence"))
    return rows.where(outside).select(*df.columns)


def ranges(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Smallest and largest value per group: overlaid bars, or a free axis per facet."""
    return df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def histogram(df: DataFrame, value: str | Column, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in ``bins`` equal bins, centred on the extremes and closed on the right; empty bins have 0.

    The extremes are one row, so the rows are only scanned, never gathered.  Equal values make
    one bin; no values make none.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(x.alias("x")).where(F.col("x").isNotNull())
    low, high = rows.agg(F.min("x")).scalar(), rows.agg(F.max("x")).scalar()
    width = (F.col("high") - F.col("low")) / F.lit(float(bins - 1))
    placed = rows.select("x", low.alias("low"), high.alias("high")).select("x", "low", width.alias("width"))
    number = F.when(F.col("width") > 0, F.ceil((F.col("x") - F.col("low")) / F.nullif(F.col("width"), F.lit(0.0)) - 0.5))
    counts = placed.select(F.coalesce(number, F.lit(0)).cast("bigint").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    ends = rows.agg(F.min("x").alias("low"), F.max("x").alias("high")).where(F.col("low").isNotNull()).select("low", width.alias("width"))
    every = ends.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("width") > 0, bins - 1).otherwise(0).cast("bigint"))).alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("centre"), F.coalesce("n", F.lit(0)).alias("n")
    )
