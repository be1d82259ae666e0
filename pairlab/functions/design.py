"""Model formulas as numeric columns: treatment coding, interactions, covariates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Term = tuple[str, Column]

INTERCEPT = "(Intercept)"


def factor(column: str, levels: Sequence[str]) -> list[Term]:
    """0/1 columns for every level but the alphabetically first; NULL for a value that isn't listed, so its row drops out."""
    value = F.col(column)
    return [
        (f"{column}{level}", F.when(value.isin(*levels), (value == F.lit(level)).cast("double")))
        for level in sorted(levels)[1:]
    ]


def numeric(column: str) -> list[Term]:
    return [(column, F.col(column).cast("double"))]


def interaction(a: Sequence[Term], b: Sequence[Term]) -> list[Term]:
    """Both main effects and all products, as ``a * b`` in a formula."""
    products = [(f"{na}:{nb}", ca * cb) for nb, cb in b for na, ca in a]
    return [*a, *b, *products]
