"""Least squares by a tall-skinny QR, for terms that cross products can't tell apart.

Each task folds its rows into one triangular factor of [1, terms, response] per group: a batch is stacked under
the factor so far and factored again.  Factors are merged in a tree, some at a time, and the last one is solved.  Rows
are read once, and the condition of the terms is never squared, as it is in ``ols``, which is cheaper.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructType

from pairlab.functions.design import INTERCEPT, Term
from pairlab.functions.tdist import two_sided_p
from pairlab.operators.ols import _FIT

#: Factors that a task keeps before it passes them on, and branches of the merging tree.
HELD, BRANCHES = 5_000, 64
#: A term is a combination of earlier ones if no more than this share of its length is left beside them.
TOLERANCE = 1e-7


def triangle(rows: np.ndarray) -> np.ndarray:
    """Triangular factor of a matrix, square even for few rows."""
    r = np.linalg.qr(rows, mode="r")
    full = np.zeros((rows.shape[1], rows.shape[1]))
    full[: len(r)] = r
    return full


def solve_triangle(names: Sequence[str], n: int, r: np.ndarray) -> tuple:
    """Coefficient rows and fit statistics from the factor of [1, terms, response]."""
    columns, y = r[:, :-1], r[:, -1]
    kept, basis = [], np.zeros((len(r), 0))
    for j in range(columns.shape[1]):
        rest = columns[:, j].copy()
        for _ in range(2):
            rest -= basis @ (basis.T @ rest)
        size = np.linalg.norm(rest)
        if size > TOLERANCE * np.linalg.norm(columns[:, j]):
            kept.append(j)
            basis = np.column_stack([basis, rest / size])
    upper = basis.T @ columns[:, kept]
    estimates = np.linalg.solve(np.triu(upper), basis.T @ y)
    rss = float(np.linalg.norm(y - basis @ (basis.T @ y)) ** 2)
    syy = float(np.linalg.norm(y - basis[:, 0] * (basis[:, 0] @ y)) ** 2)
    rank, df = len(kept), int(n) - len(kept)
    variance = rss / df if df > 0 else np.nan
    inverse = np.linalg.inv(np.triu(upper))
    errors = np.sqrt(variance * (inverse**2).sum(axis=1))
    rows, where = [], {j: i for i, j in enumerate(kept)}
    for j, name in enumerate([INTERCEPT, *names]):
        if j not in where:
            rows.append((name, None, None, None, None))
            continue
        b, se = float(estimates[where[j]]), float(errors[where[j]])
        t = b / se if se > 0 else np.nan
        rows.append((name, b, *(None if np.isnan(v) else float(v) for v in (se, t, two_sided_p(t, df)))))
    r2 = 1.0 - rss / syy if syy > 0 else None
    adjusted = 1.0 - (1.0 - r2) * (n - 1) / df if r2 is not None and df > 0 else None
    f = (syy - rss) / (rank - 1) / variance if rank > 1 and df > 0 and variance > 0 else None
    return rows, int(n), df, float(np.sqrt(variance)) if df > 0 else None, r2, adjusted, f, rank - 1


def _codes(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row of a batch, and a row of each group."""
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for key in keys:
        encoded = batch.column(key).dictionary_encode()
        code = code * (len(encoded.dictionary) + 1) + np.array(encoded.indices.fill_null(-1)) + 1
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return group, first


def _fold(keys: Sequence[str], width: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, np.ndarray]] = {}

        def emit() -> pa.RecordBatch:
            columns = [[k[i] for k in held] for i in range(len(keys))] + [[n for n, _ in held.values()], [r.ravel() for _, r in held.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            group, first = _codes(batch, keys)
            names = list(zip(*[batch.column(k).take(pa.array(first)).to_pylist() for k in keys], strict=True)) if keys else [()]
            matrix = np.column_stack([np.ones(batch.num_rows), *[batch.column(f"__c{i}").to_numpy(zero_copy_only=False) for i in range(width - 1)]])
            order = np.argsort(group, kind="stable")
            for name, part in zip(names, np.split(matrix[order], np.flatnonzero(np.diff(group[order])) + 1), strict=True):
                n, r = held.get(name, (0, np.zeros((0, width))))
                held[name] = (n + len(part), triangle(np.vstack([r, part])))
            if len(held) > HELD:
                yield emit()
                held.clear()
        if held:
            yield emit()

    return run


def _merge(keys: Sequence[str], width: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            factors, counts = [], []
            for one in batch.column("parts").to_pylist():
                factors.append(triangle(np.vstack([np.reshape(p["r"], (width, width)) for p in one])).ravel())
                counts.append(sum(p["n"] for p in one))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(counts, pa.int64()), pa.array(factors, pa.list_(pa.float64()))], schema=schema)

    return run


def fit_qr(df: DataFrame, response: str, terms: Sequence[Term], by: Sequence[str] = ()) -> DataFrame:
    """One row per group, as ``ols.fit`` gives it: coefficient structs and fit statistics, an intercept included.

    Rows with a missing value are left out.  A term that is a combination of earlier ones gets NULLs.
    """
    names, keys, width = [n for n, _ in terms], list(by), len(terms) + 2
    cells = [c.cast("double").alias(f"__c{i}") for i, c in enumerate([*[c for _, c in terms], F.col(response)])]
    rows = df.select(*keys, *cells).dropna(subset=[f"__c{i}" for i in range(width - 1)])
    factor = StructType([rows.schema[k] for k in keys]).add("n", "long").add("r", ArrayType(DoubleType()))
    arrow = to_arrow_schema(factor)
    factors = rows.mapInArrow(_fold(keys, width, arrow), factor).withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(BRANCHES)))
    for more in (["branch"], []):
        listed = factors.groupBy(*keys, *more).agg(F.collect_list(F.struct("n", "r")).alias("parts"))
        factors = listed.select(*keys, "parts").mapInArrow(_merge(keys, width, arrow), factor)
    fit = StructType.fromDDL(_FIT)
    schema = StructType([*[rows.schema[k] for k in keys], *fit.fields])
    out = to_arrow_schema(schema)
    struct = ("term", "estimate", "std_error", "t_value", "p_value")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved = []
            for n, r in zip(batch.column("n").to_pylist(), batch.column("r").to_pylist(), strict=True):
                rows_, *rest = solve_triangle(names, n, np.reshape(r, (width, width)))
                solved.append(([dict(zip(struct, row, strict=True)) for row in rows_], *rest))
            columns = [pa.array([s[i] for s in solved], out.field(len(keys) + i).type) for i in range(len(fit.fields))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *columns], schema=out)

    return factors.mapInArrow(solve, schema)
