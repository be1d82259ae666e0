"""Least squares from sufficient statistics, for any number of groups at once.

Spark reduces the rows of each group to means and centred cross products in one
aggregation with map-side combine; the p x p solve then runs in tasks, one small row per
group.  Neither rows nor groups pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairlab.functions.design import INTERCEPT, Term
from pairlab.functions.tdist import two_sided_p

_TERM = "struct<term:string,estimate:double,std_error:double,t_value:double,p_value:double>"
_FIT = (
    f"terms array<{_TERM}>, n bigint, df_residual bigint, sigma double, r_squared double, "
    "adj_r_squared double, f_value double, f_df bigint"
)


def moments(df: DataFrame, response: str, terms: Sequence[Term], by: Sequence[str] = ()) -> DataFrame:
    """Count, means and centred cross products of (terms, response) per group.

    Rows with a missing value are left out.  ``covar_pop`` merges centred partial sums, so
    nothing is lost to cancellation and one pass is enough.
    """
    names = [f"__x{i}" for i in range(len(terms))] + ["__y"]
    columns = [c.alias(n) for n, (_, c) in zip(names, terms)] + [F.col(response).cast("double").alias("__y")]
    rows = df.select(*by, *columns).dropna(subset=names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(n) for n in names]).alias("means"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("covariances"),
    )


def unpack(n: float, means: Sequence[float], covariances: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Means and the symmetric matrix of centred cross products."""
    k = len(means)
    cross = np.zeros((k, k))
    cross[np.triu_indices(k)] = np.asarray(covariances, dtype=float) * n
    return np.asarray(means, dtype=float), cross + np.triu(cross, 1).T


def independent_columns(cross: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns, in order, that are not combinations of earlier ones."""
    left, kept = cross.copy(), []
    for j in range(len(cross)):
        if left[j, j] > tolerance * max(cross[j, j], 1e-300):
            kept.append(j)
            left = left - np.outer(left[:, j], left[j, :]) / left[j, j]
    return kept


def _solve(names: Sequence[str], n: int, means, covariances) -> tuple:
    mean, cross = unpack(n, means, covariances)
    sxx, sxy, syy = cross[:-1, :-1], cross[:-1, -1], cross[-1, -1]
    kept = independent_columns(sxx)
    inverse = np.linalg.inv(sxx[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
    slopes = inverse @ sxy[kept]
    xbar = mean[:-1][kept]
    rss = max(float(syy - slopes @ sxy[kept]), 0.0)
    rank = len(kept) + 1
    df = int(n) - rank
    variance = rss / df if df > 0 else np.nan
    estimates = np.concatenate([[mean[-1] - xbar @ slopes], slopes])
    spread = np.concatenate([[1.0 / n + xbar @ inverse @ xbar], np.diag(inverse)])
    errors = np.sqrt(variance * spread)
    labels = [INTERCEPT, *names]
    where = {0: 0, **{j + 1: i + 1 for i, j in enumerate(kept)}}
    rows = []
    for j, label in enumerate(labels):
        if j not in where:
            rows.append((label, None, None, None, None))
            continue
        b, se = float(estimates[where[j]]), float(errors[where[j]])
        t = b / se if se > 0 else np.nan
        p = two_sided_p(t, df)
        rows.append((label, b, *(None if np.isnan(v) else v for v in (se, t, p))))
    r2 = 1.0 - rss / syy if syy > 0 else None
    adjusted = 1.0 - (1.0 - r2) * (n - 1) / df if r2 is not None and df > 0 else None
    f = (syy - rss) / (rank - 1) / variance if rank > 1 and df > 0 and variance > 0 else None
    sigma = float(np.sqrt(variance)) if df > 0 else None
    return rows, int(n), df, sigma, r2, adjusted, f, rank - 1


def fit(df: DataFrame, response: str, terms: Sequence[Term], by: Sequence[str] = ()) -> DataFrame:
    """One row per group: coefficient structs and fit statistics.

    An intercept is always included.  A term that is a combination of earlier ones gets
    NULLs.
    """
    statistics = moments(df, response, terms, by)
    if not by:
        statistics = statistics.where(F.col("n") > 0)
    names = [n for n, _ in terms]
    keys = list(by)
    key_part = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType([statistics.schema[k] for k in keys]))
    schema = f"{key_part}, {_FIT}" if key_part else _FIT
    columns = [*keys, *StructType.fromDDL(_FIT).fieldNames()]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            solved = []
            for record in batch.to_dict("records"):
                terms_, *rest = _solve(names, record["n"], record["means"], record["covariances"])
                labelled = [
                    dict(zip(("term", "estimate", "std_error", "t_value", "p_value"), row)) for row in terms_
                ]
                solved.append((*[record[k] for k in keys], labelled, *rest))
            yield pd.DataFrame(solved, columns=columns)

    return statistics.mapInPandas(solve, schema)


def coefficients(fitted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group and term."""
    return fitted.select(*by, F.inline("terms"))


def with_residuals(
    df: DataFrame, fitted: DataFrame, response: str, terms: Sequence[Term], by: Sequence[str] = (), name: str = "residual"
) -> DataFrame:
    """Residual of every row; aliased terms count as zero.

    ``fitted`` should be a staged table, so that its size decides how it is joined.
    """
    weights = fitted.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("terms.estimate").alias("__b"))
    if by:
        match = F.lit(True)
        for k in by:
            match = match & df[k].eqNullSafe(weights[f"__{k}"])
        rows = df.join(weights, match).drop(*[f"__{k}" for k in by])
    else:
        rows = df.withColumn("__b", weights.scalar())
    predicted = F.col("__b")[0]
    for i, (_, c) in enumerate(terms, 1):
        predicted = predicted + F.coalesce(F.col("__b")[i], F.lit(0.0)) * c
    return rows.withColumn(name, F.col(response) - predicted).drop("__b")


def simple_regressions(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """Slope, intercept and R² of y on x per group, entirely from built-in aggregates."""
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r_squared"),
        F.regr_avgx(y, x).alias("mean_x"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_syy(y, x).alias("syy"),
    )


def correlations(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """Pearson correlation of complete pairs per group."""
    return df.groupBy(*by).agg(F.corr(y, x).alias("correlation"))
