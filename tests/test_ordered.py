"""Reductions over token scores in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.operators import ordered as O


def alternating():
    """Made inside a function, so that it travels to the workers with the job."""

    class Alternating:
        """Scores with signs that alternate by place: wrong as soon as the order is."""

        def __init__(self):
            self.total, self.n, self.most = 0.0, 0, 0

        def add(self, positions, scores):
            signs = np.where((self.n + np.arange(len(scores))) % 2, -1.0, 1.0)
            self.total += float(signs @ scores)
            self.n += len(scores)
            self.most = max(self.most, len(scores))
            assert (np.diff(positions) >= 0).all() and len(scores) <= 10_000

        def value(self):
            return self.total if self.n else None

    return Alternating


@pytest.mark.parametrize("rows", [3, 10_000])
def test_order_and_keys_hold_over_batches(spark, rows):
    rng = np.random.default_rng(1)
    data = [(k, name, p, float(rng.normal())) for k in range(40) for name in ("a", None) for p in range(rng.integers(1, 30))]
    df = spark.createDataFrame(data, "k int, name string, pos int, logprob double").repartition(9)
    got = {(r["k"], r["name"]): r["score"] for r in O.reduce_in_order(df, ["k", "name"], "pos", alternating(), rows=rows).collect()}
    want = {}
    for k, name, p, s in sorted(data, key=lambda r: (r[0], str(r[1]), r[2])):
        want[k, name] = want.get((k, name), 0.0) + (s if p % 2 == 0 else -s)
    assert got == pytest.approx(want)
    last = O.reduce_in_order(df, ["k", "name"], "pos", lambda: O.WholeReduction(lambda s: float(s[-1]))).collect()
    assert {(r["k"], r["name"]): r["score"] for r in last} == {(k, n): s for k, n, _, s in sorted(data, key=lambda r: r[2])}


def test_a_million_tokens_stream_past(spark):
    df = spark.range(1_000_000).select(F.lit("long").alias("doc"), "id", (F.col("id") % 7).cast("double").alias("logprob"))
    df = df.union(spark.range(5).select(F.lit("short"), "id", F.lit(1.0)))
    got = {r["doc"]: r["score"] for r in O.reduce_in_order(df, ["doc"], "id", alternating()).collect()}
    assert got["short"] == 1.0 and got["long"] == pytest.approx(sum((k % 7) * (-1) ** k for k in range(1_000_000)))


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, None), (2, 0, 2.0), (2, 1, None), (2, None, 5.0)], "k int, pos int, logprob double")
    got = {r["k"]: r["score"] for r in O.reduce_in_order(df.na.fill({"pos": 9}), ["k"], "pos", alternating()).collect()}
    assert got == {1: None, 2: -3.0}
    empty = O.reduce_in_order(df.limit(0), ["k"], "pos", alternating())
    assert empty.collect() == [] and empty.columns == ["k", "score"]
