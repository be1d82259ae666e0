"""Exact grouped quantiles (type 7) for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.sources.staging import Scratch, stage

BINS = 2048


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for key in keys:
        test = test & left[key].eqNullSafe(right[f"__{key}"])
    return test


def _order_statistics(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], value: str, bins: int, scratch: Scratch) -> list[DataFrame]:
    """Tables (keys, __rank, __value): the finite values at given 0-based ranks.

    ``wanted`` holds one search interval per key and rank: the smallest and largest value
    that can have the rank, and how many values lie below the interval.  Each pass counts
    the interval's values in bins, with the smallest and largest value of each bin, and
    moves to the bin that holds the rank; a bin with one distinct value is the answer.
    The ends of an interval fall in different bins, so it shrinks in every pass, by a factor
    of ``bins`` at least.  A pass is one scan with a small aggregation, so no group is sorted or
    gathered.
    """
    found, interval = [], wanted
    while True:
        found.append(interval.where(F.col("__lo") == F.col("__hi")).select(*keys, "__rank", F.col("__lo").alias("__value")))
        open_ = interval.where(F.col("__lo") < F.col("__hi"))
        if open_.isEmpty():
            return found
        # Ranks that share an interval share its rows.
        spans = open_.select(*[F.col(k).alias(f"__{k}") for k in keys], "__below", "__lo", "__hi").distinct()
        inside = rows.join(spans, _same(rows, spans, keys)).where(F.col(value).between(F.col("__lo"), F.col("__hi")))
        # Halved before subtracting, so that no difference overflows; neighbouring tiny numbers may then have no difference.
        width = F.col("__hi") / 2 - F.col("__lo") / 2
        share = (F.col(value) / 2 - F.col("__lo") / 2) / F.nullif(width, F.lit(0.0))
        bin_ = F.coalesce(F.floor(share * F.lit(bins)), F.when(F.col(value) > F.col("__lo"), bins).otherwise(0))
        binned = (
            inside.groupBy(*keys, "__below", bin_.alias("__bin"))
            .agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
        )
        # At most ``bins`` + 1 rows for one interval.
        packed = binned.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], "__below").agg(
            F.sort_array(F.collect_list(F.struct("__bin", "__n", "__lo", "__hi"))).alias("__bins")
        )
        ranked = open_.join(
            packed.withColumnRenamed("__below", "__from"),
            _same(open_, packed, keys) & (open_["__below"] == F.col("__from")),
        ).select(*[open_[k] for k in keys], "__rank", "__below", "__bins")
        nothing = F.lit(None).cast("double")
        start = F.struct(F.col("__below").alias("below"), nothing.alias("lo"), nothing.alias("hi"))
        reached = F.aggregate(
            "__bins",
            start,
            lambda acc, b: F.when(acc["lo"].isNotNull(), acc)
            .when(acc["below"] + b["__n"] > F.col("__rank"),
                  F.struct(acc["below"].alias("below"), b["__lo"].alias("lo"), b["__hi"].alias("hi")))
            .otherwise(F.struct((acc["below"] + b["__n"]).alias("below"), acc["lo"].alias("lo"), acc["hi"].alias("hi"))),
        )
        interval = scratch.stage(
            ranked.select(*keys, "__rank", reached.alias("__r")).select(
                *keys, "__rank", F.col("__r.below").alias("__below"),
                F.col("__r.lo").alias("__lo"), F.col("__r.hi").alias("__hi"),
            ),
            "rank-intervals",
        )


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    names: Sequence[str],
    bins: int = BINS,
    staged: bool = False,
) -> DataFrame:
    """Quantile columns ``names`` for each group, interpolated between order statistics.

    Missing values and NaN are left out; infinities count and take their places at the ends.
    Groups of every size are searched by counting, in the same few passes for all.  The rows are
    read several times and are staged first, unless ``staged`` says they are; what is staged
    on the way is removed, and the result is one small staged row per group.
    """
    if not by:
        whole = grouped_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probabilities, names, bins)
        return whole.drop("__all")
    x = F.col(value).cast("double")
    rows = df.select(*by, x.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    infinite = float("inf")
    with Scratch(df.sparkSession) as scratch:
        rows = rows if staged else scratch.stage(rows, "quantiles")
        finite = F.when(F.abs("__x") < infinite, F.col("__x"))
        sizes = scratch.stage(
            rows.groupBy(*by).agg(
                F.count(F.lit(1)).alias("__n"), F.min(finite).alias("__lo"), F.max(finite).alias("__hi"),
                F.count_if(F.col("__x") == -infinite).alias("__first"), F.count_if(F.col("__x") == infinite).alias("__last"),
            ),
            "quantile-sizes",
        )
        position = F.col("__p") * (F.col("__n") - 1)
        wanted = sizes.select(
            "*", F.explode(F.array(*[F.lit(float(p)) for p in sorted(set(probabilities))])).alias("__p")
        ).select(*sizes.columns, "__p", (position - F.floor(position)).alias("__w"), F.floor(position).alias("__down"), F.ceil(position).alias("__up"))
        ranks = wanted.select(*sizes.columns, F.explode(F.array("__down", "__up")).alias("__rank")).distinct()
        ranks = ranks.withColumns({"__finite": F.col("__rank") - F.col("__first"), "__number": F.col("__n") - F.col("__first") - F.col("__last")})
        outside = F.when(F.col("__finite") < 0, -infinite).when(F.col("__finite") >= F.col("__number"), infinite)
        ends = ranks.where(outside.isNotNull()).select(*by, F.col("__rank"), outside.alias("__value"))
        inside = ranks.where(outside.isNull())
        start = inside.select(*by, F.col("__finite").alias("__rank"), F.lit(0).cast("bigint").alias("__below"), "__lo", "__hi").distinct()
        only = rows.where(F.abs("__x") < infinite)
        found = _order_statistics(only, scratch.stage(start, "rank-intervals"), by, "__x", bins, scratch)
        placed = found[0]
        for part in found[1:]:
            placed = placed.unionByName(part)
        shifted = sizes.select(*[F.col(k).alias(f"__{k}") for k in by], "__first")
        back = placed.join(shifted, _same(placed, shifted, by)).select(*[placed[k] for k in by], (F.col("__rank") + F.col("__first")).alias("__rank"), "__value")
        statistics = scratch.stage(back.unionByName(ends), "order-statistics")
        low = statistics.withColumnsRenamed({**{k: f"__{k}" for k in by}, "__rank": "__r1", "__value": "__v1"})
        high = statistics.withColumnsRenamed({**{k: f"__{k}" for k in by}, "__rank": "__r2", "__value": "__v2"})
        joined = wanted.join(low, _same(wanted, low, by) & (wanted["__down"] == low["__r1"])).select(*wanted.columns, "__v1")
        joined = joined.join(high, _same(joined, high, by) & (joined["__up"] == high["__r2"]))
        at = F.when(F.col("__w") == 0, F.col("__v1")).when(F.col("__v1") == F.col("__v2"), F.col("__v1")).otherwise(
            F.col("__v1") * (1 - F.col("__w")) + F.col("__v2") * F.col("__w")
        )
        flat = joined.select(*[joined[k] for k in by], "__p", at.alias("__q"))
        return stage(
            flat.groupBy(*by).agg(
                *[F.max(F.when(F.col("__p") == F.lit(float(p)), F.col("__q"))).alias(n) for p, n in zip(probabilities, names, strict=True)]
            ),
            "group-quantiles",
        )
