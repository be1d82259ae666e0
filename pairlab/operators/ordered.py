"""Reductions that see a sentence's token scores in order, for callables that no aggregate column can say.

Rows are dealt by key and sorted by position inside tasks, where they stream past a reduction in Arrow batches.  A
reduction holds its own state only, so a text of any length takes one batch of memory; a key's tokens have to
come through one task, since their order matters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Reduction(Protocol):
    """One sentence's reduction: gets positions and scores in order, some at a time, and gives a number at the end."""

    def add(self, positions: np.ndarray, scores: np.ndarray) -> None: ...

    def value(self) -> float | None: ...


class WholeReduction:
    """A reduction from a callable over all scores of a sentence, which are held until its end."""

    def __init__(self, of: Callable[[np.ndarray], float]):
        self.of, self.parts = of, []

    def add(self, positions: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append(scores)

    def value(self) -> float | None:
        return self.of(np.concatenate(self.parts))


class WeightedMean:
    """Mean of scores by a weight of their positions."""

    def __init__(self, weight: Callable[[np.ndarray], np.ndarray]):
        self.weight, self.total, self.weights = weight, 0.0, 0.0

    def add(self, positions: np.ndarray, scores: np.ndarray) -> None:
        w = self.weight(positions)
        self.total += float(w @ scores)
        self.weights += float(w.sum())

    def value(self) -> float | None:
        return self.total / self.weights if self.weights else None


def _edges(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Rows of a batch whose key differs from the row before."""
    changed = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for key in keys:
        codes = np.array(batch.column(key).dictionary_encode().indices.fill_null(-1))
        changed |= codes[1:] != codes[:-1]
    return np.flatnonzero(changed) + 1


def reduce_in_order(
    tokens: DataFrame, keys: Sequence[str], position: str, make: Callable[[], Reduction], score: str = "logprob", name: str = "score", rows: int = 10_000
) -> DataFrame:
    """One row per key: ``name``, the reduction that ``make`` starts for it, over its rows in order of ``position``.

    Defined cases: null scores are left out, and a key with null scores only is reduced over nothing; null keys
    are keys; equal positions come in order of their scores; a key's rows come at most ``rows`` at a time; an empty table
    gives an empty table.
    """
    keys = list(keys)
    slim = tokens.select(*keys, tokens[position].cast("long").alias("__at"), tokens[score].cast("double").alias("__score"))
    ordered = slim.repartition(*keys).sortWithinPartitions(*keys, "__at", "__score")
    schema = StructType([slim.schema[k] for k in keys]).add(name, "double")
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, reduction = None, None, None

        def close(done: list) -> None:
            done.append((held, reduction.value()))

        def told(done: list) -> pa.RecordBatch:
            columns = [pa.concat_arrays([d[0].column(k) for d in done]) for k in keys]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.float64())], schema=out)

        for batch in batches:
            done: list = []
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                edges = _edges(part, keys)
                for a, b in zip([0, *edges], [*edges, part.num_rows], strict=True):
                    piece = part.slice(a, b - a)
                    key = tuple(piece.column(k)[0].as_py() for k in keys)
                    if reduction is None or key != now:
                        if reduction is not None:
                            close(done)
                        now, held, reduction = key, piece.slice(0, 1).select(keys), make()
                    scores = piece.column("__score")
                    known = np.array(scores.is_valid())
                    if known.any():
                        reduction.add(piece.column("__at").to_numpy(zero_copy_only=False)[known], scores.fill_null(0.0).to_numpy()[known])
            if done:
                yield told(done)
        if reduction is not None:
            done = []
            close(done)
            yield told(done)

    return ordered.mapInArrow(run, schema)
