"""Grouped summaries of ratings and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions.exprs import mean_strict, pair_difference
from pairlab.operators.reshape import exact_mean_value, strict_mean_value, to_wide


def means(df: DataFrame, by: Sequence[str], values: Sequence[str], prefix: str = "mean_") -> DataFrame:
    """Grouped means, missing values skipped."""
    return df.groupBy(*by).agg(*[F.avg(v).alias(f"{prefix}{v}") for v in values])


def strict_means(df: DataFrame, by: Sequence[str], values: Sequence[str], prefix: str = "mean_") -> DataFrame:
    """Grouped means that are NULL as soon as one value is missing."""
    return df.groupBy(*by).agg(*[mean_strict(v).alias(f"{prefix}{v}") for v in values])


def model_summary(
    score_pairs: DataFrame,
    by: Sequence[str] = ("model", "classification"),
    do: str = "DO_score",
    pd: str = "PD_score",
) -> DataFrame:
    """Mean and sd of the difference and both mean scores, for every model in one job."""
    difference = F.col(pd) - F.col(do)
    return score_pairs.groupBy(*by).agg(
        F.avg(difference).alias("mean_diff"),
        F.stddev_samp(difference).alias("std_diff"),
        F.avg(do).alias("mean_DO"),
        F.avg(pd).alias("mean_PD"),
    )


def pair_means(
    ratings: DataFrame,
    keys: Sequence[str],
    constructs: Sequence[str],
    z: str = "zscores",
    raw: str = "value",
    raw_places: int | None = None,
) -> DataFrame:
    """Per pair: strict means of both forms, and the differences between the forms.

    The mean per pair and form and the widening are one aggregation with one shuffle.  Raw ratings
    that have at most ``raw_places`` decimal places can be summed exactly.
    """
    mean_raw = strict_mean_value if raw_places is None else exact_mean_value(raw_places)
    named = ratings.withColumnsRenamed({z: "mean_z", raw: "mean_scores"})
    wide = to_wide(
        named, keys, "construct", constructs, {"mean_z": strict_mean_value, "mean_scores": mean_raw}
    )
    return wide.withColumns(
        {"human_zdiff": pair_difference("mean_z_"), "human_sdiff": pair_difference("mean_scores_")}
    )


def class_means(pair_table: DataFrame, by: Sequence[str] = ("classification", "io")) -> DataFrame:
    """Mean of pair means per class, which weighs every pair alike.

    A pair seen in only one form has no difference and is left out of the difference means.
    """
    named = {
        "mean_DO": "mean_scores_DOsentence",
        "mean_PD": "mean_scores_PDsentence",
        "mean_diff": "human_sdiff",
        "mean_DO_z": "mean_z_DOsentence",
        "mean_PD_z": "mean_z_PDsentence",
        "mean_diff_z": "human_zdiff",
    }
    return pair_table.groupBy(*by).agg(*[F.avg(c).alias(n) for n, c in named.items()])
