"""Lenient casts that say what they rejected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairlab.sources.staging import stage

MISSING = "missing"


def cast_audited(
    df: DataFrame, types: Mapping[str, str], place: Mapping[str, Column], marks: Sequence[str] = ("", "NA"), drop: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, dict[tuple[str, str], int]]:
    """``df`` with text columns cast to ``types``, the rejected cells, and counts by (column, reason).

    Rejected cells have the columns of ``place``, which say where a row is from, and column, cell, reason.  A null, a
    mark of a missing value, or NaN is missing and no rejected cell; any other text that does not fit is one, and
    NULL in the result.  Rows are read once: the counts are observed while the result is written, and both tables are
    read from that.
    """
    values, rejected, counts = [], [], []
    for name, kind in types.items():
        text = F.col(f"`{name}`").cast("string")
        value = text if kind == "string" else text.try_cast(kind)
        missing = text.isNull() | text.isin(*marks)
        if kind in ("double", "float"):
            missing = missing | F.coalesce(F.isnan(value), F.lit(False))
        bad = ~missing & value.isNull()
        reason = f"not {kind}"
        values.append(F.when(~missing, value).alias(name))
        rejected.append(F.when(bad, F.struct(F.lit(name).alias("column"), text.alias("cell"), F.lit(reason).alias("reason"))))
        counts += [((name, MISSING), F.count_if(missing)), ((name, reason), F.count_if(bad))]
    seen = Observation()
    others = [c for c in df.columns if c not in types and c not in drop]
    each = {c: v for c, v in zip(types, values, strict=True)}
    columns = [each[c] if c in each else F.col(f"`{c}`") for c in df.columns if c in each or c in others]
    where = F.struct(*[c.alias(n) for n, c in place.items()]).alias("__place")
    marked = df.observe(seen, *[c.alias(f"n{k}") for k, (_, c) in enumerate(counts)])
    staged = stage(marked.select(*columns, where, F.array_compact(F.array(*rejected)).alias("__rejected")), "audited")
    told = seen.get
    found = {key: int(told[f"n{k}"]) for k, (key, _) in enumerate(counts)}
    quarantine = staged.where(F.size("__rejected") > 0).select("__place.*", F.explode("__rejected").alias("r")).select(*place, "r.*")
    return staged.drop("__place", "__rejected"), quarantine, found
