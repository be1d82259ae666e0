"""Least squares by QR against dense QR, where cross products fail."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlab.functions import design as D
from pairlab.operators import ols as O
from pairlab.operators import qr as Q


def close_terms(n=4000, gap=1e-7, seed=0):
    """Two columns that differ by ``gap`` only, so that the terms' condition number is about 2 / gap."""
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n), rng.normal(size=n)
    pdf = pd.DataFrame({"x": x, "near": x + gap * z, "g": rng.integers(0, 3, n)})
    return pdf.assign(y=2 + x + 3 * z + rng.normal(0, 0.01, n))


def test_condition_of_1e8_equals_dense_qr_where_moments_fail(spark):
    pdf = close_terms(gap=2e-8 * 5)
    x = np.column_stack([np.ones(len(pdf)), pdf.x, pdf.near])
    assert np.linalg.cond(x) > 1e7
    q, r = np.linalg.qr(x)
    want = np.linalg.solve(r, q.T @ pdf.y)
    df = spark.createDataFrame(pdf).repartition(7)
    terms = D.numeric("x") + D.numeric("near")
    old = Q.TOLERANCE
    Q.TOLERANCE = 1e-9
    try:
        got = Q.fit_qr(df, "y", terms).first()
    finally:
        Q.TOLERANCE = old
    assert [t["estimate"] for t in got["terms"]] == pytest.approx(want, rel=1e-6)
    e = pdf.y - x @ want
    s2 = e @ e / (len(pdf) - 3)
    assert got["sigma"] == pytest.approx(np.sqrt(s2), rel=1e-6)
    spread = np.linalg.inv(r)
    assert [t["std_error"] for t in got["terms"]] == pytest.approx(np.sqrt(s2 * (spread**2).sum(axis=1)), rel=1e-6)
    assert O.fit(df, "y", terms).first()["terms"][2]["estimate"] is None  # cross products take the columns for one


def test_agrees_with_moments_on_sound_terms(spark):
    pdf = close_terms(gap=1.0)
    df = spark.createDataFrame(pdf).withColumn("y", F.when(F.col("x") < 2, F.col("y"))).withColumn("g", F.when(F.col("g") < 2, F.col("g")))
    terms = D.numeric("x") + D.numeric("near") + [("twice", F.col("x") * 2)]
    a = {r["g"]: r for r in O.fit(df, "y", terms, ["g"]).collect()}
    b = {r["g"]: r for r in Q.fit_qr(df, "y", terms, ["g"]).collect()}
    assert a.keys() == b.keys() == {0, 1, None}
    for g, row in a.items():
        assert (row["n"], row["df_residual"], row["f_df"]) == (b[g]["n"], b[g]["df_residual"], b[g]["f_df"])
        for name in ("sigma", "r_squared", "adj_r_squared", "f_value"):
            assert row[name] == pytest.approx(b[g][name], rel=1e-8)
        for s, t in zip(row["terms"], b[g]["terms"], strict=True):
            assert s["term"] == t["term"] and (s["estimate"] is None) == (t["estimate"] is None) == (s["term"] == "twice")
            if s["estimate"] is not None:
                assert [s[c] for c in ("estimate", "std_error", "t_value")] == pytest.approx([t[c] for c in ("estimate", "std_error", "t_value")], rel=1e-7)


def test_few_rows_many_groups_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(Q, "HELD", 10)
    df = spark.range(900).select((F.col("id") % 300).alias("g"), (F.col("id") / 7.0).alias("x"), (F.col("id") * 2 / 7.0 + 1).alias("y"))
    got = Q.fit_qr(df, "y", D.numeric("x"), ["g"]).collect()
    assert len(got) == 300 and all(r["n"] == 3 and r["terms"][1]["estimate"] == pytest.approx(2) for r in got)
    one = Q.fit_qr(df.limit(1), "y", D.numeric("x")).first()
    assert one["n"] == 1 and one["df_residual"] == 0 and one["sigma"] is None and one["terms"][1]["estimate"] is None
    assert Q.fit_qr(df.limit(0), "y", D.numeric("x"), ["g"]).collect() == []
