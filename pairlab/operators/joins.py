"""Joins of ratings, pairs, verbs and model scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.operators.reshape import only_value, to_wide


def _condition(left: DataFrame, right: DataFrame, keys: Mapping[str, str], null_keys_match: bool) -> Column:
    tests = [
        left[a].eqNullSafe(right[b]) if null_keys_match else left[a] == right[b] for a, b in keys.items()
    ]
    return reduce(lambda a, b: a & b, tests)


def _mapping(on: Sequence[str] | Mapping[str, str]) -> dict[str, str]:
    return dict(on) if isinstance(on, Mapping) else {k: k for k in on}


def _listed(listed: DataFrame, keys: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Key columns only, under names the other side cannot have."""
    renamed = listed.select(*[F.col(b).alias(f"__{b}") for b in keys.values()])
    return renamed, {a: f"__{b}" for a, b in keys.items()}


def keep_matching(df: DataFrame, listed: DataFrame, on, null_keys_match: bool = True) -> DataFrame:
    """Rows whose key is listed (left semi)."""
    right, keys = _listed(listed, _mapping(on))
    return df.join(right, _condition(df, right, keys, null_keys_match), "left_semi")


def drop_matching(df: DataFrame, listed: DataFrame, on, null_keys_match: bool = True) -> DataFrame:
    """Rows whose key is not listed (left anti)."""
    right, keys = _listed(listed, _mapping(on))
    return df.join(right, _condition(df, right, keys, null_keys_match), "left_anti")


def attach(df: DataFrame, other: DataFrame, on, null_keys_match: bool = True, how: str = "left") -> DataFrame:
    """Left join keeping the left key columns; ``on`` may map left names to right names."""
    keys = _mapping(on)
    renamed = other.withColumnsRenamed({b: f"__{b}" for b in keys.values()})
    test = _condition(df, renamed, {a: f"__{b}" for a, b in keys.items()}, null_keys_match)
    return df.join(renamed, test, how).drop(*[f"__{b}" for b in keys.values()])


def match_text(
    df: DataFrame,
    catalogue: DataFrame,
    text: str = "sentence",
    catalogue_text: str | None = None,
    on_duplicate: str = "keep",
    compare: str = "text",
) -> DataFrame:
    """Inner join on the text itself.

    With ``compare="text"`` equality is on a 64-bit hash and the text, so sorting and probing
    compare the hash first.  ``compare="digest"`` joins on the SHA-256 of the text instead, so
    that long texts are not shuffled unless a later step reads them.  A text listed more than once in ``catalogue`` multiplies its rows when
    ``on_duplicate`` is "keep"; "error" fails the job instead.
    """
    right_text = catalogue_text or text
    right = catalogue.withColumnRenamed(right_text, "__text")
    if on_duplicate == "error":
        # Counted by digest, so that the texts themselves are shuffled once at most.
        right = right.withColumn("__digest", F.unhex(F.sha2("__text", 256)))
        listed = right.groupBy("__digest").agg(F.count(F.lit(1)).alias("__copies"))
        guard = F.when(F.col("__copies") > 1, F.raise_error(F.lit("text listed more than once")).cast("boolean"))
        right = attach(right, listed, ["__digest"]).where(guard.isNull()).drop("__copies", "__digest")
    elif on_duplicate != "keep":
        raise ValueError("on_duplicate is 'keep' or 'error'")
    if compare == "digest":
        left = df.withColumn("__hash", F.unhex(F.sha2(text, 256)))
        right = right.withColumn("__right_hash", F.unhex(F.sha2("__text", 256)))
        test = left["__hash"] == right["__right_hash"]
    elif compare == "text":
        left = df.withColumn("__hash", F.xxhash64(text))
        right = right.withColumn("__right_hash", F.xxhash64("__text"))
        test = (left["__hash"] == right["__right_hash"]) & (left[text] == right["__text"])
    else:
        raise ValueError("compare is 'text' or 'digest'")
    return left.join(right, test, "inner").drop("__hash", "__right_hash", "__text")


def line_up_replicas(
    scores: DataFrame, keys: Sequence[str], replica: str, replicas: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """One row per key with every replica's values side by side, inner-join style.

    The long table is folded in a single shuffle instead of one join per replica; keys
    that some replica lacks are dropped, as a chain of inner joins would.  A second row of one key and replica fails
    the job: such a chain would multiply it.
    """
    wide = to_wide(
        scores, keys, replica, replicas, {v: only_value for v in values}, "{value}_{level}",
        extra={f"__{r}": F.count(F.when(F.col(replica) == F.lit(r), F.lit(1))) for r in replicas},
    )
    present = reduce(lambda a, b: a & b, [F.col(f"__{r}") > 0 for r in replicas])
    return wide.where(present).drop(*[f"__{r}" for r in replicas])


def union_replicas(tables: Mapping[str, DataFrame], name_column: str = "model") -> DataFrame:
    """Stack per-model tables into one long table with the model as a column."""
    tagged = [t.withColumn(name_column, F.lit(m)) for m, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)
