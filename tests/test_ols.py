"""Least squares against cell means and dense solutions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlab.functions import design as D
from pairlab.operators import ols as O


def data(seed=0, n=200):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "model": rng.choice(["m1", "m2"], n), "a": rng.choice(["p", "q"], n), "c": rng.choice(["D", "P"], n), "x": rng.normal(1e6, 1, n),
    })
    pdf["y"] = 1 + (pdf.a == "q") * 2.0 - (pdf.c == "P") * 0.5 + 0.3 * (pdf.x - 1e6) + rng.normal(0, 1, n)
    return pdf


def dense(x, y):
    x = np.column_stack([np.ones(len(y)), *x])
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    s2 = e @ e / (len(y) - x.shape[1])
    return b, np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2), e


def test_interaction_gives_cell_mean_contrasts(spark):
    pdf = data()
    terms = D.interaction(D.factor("a", ["q", "p"]), D.factor("c", ["D", "P"]))
    assert [n for n, _ in terms] == ["aq", "cP", "aq:cP"]
    got = {r["term"]: r["estimate"] for r in O.coefficients(O.fit(spark.createDataFrame(pdf), "y", terms)).collect()}
    m = pdf.groupby(["a", "c"]).y.mean()
    assert got["(Intercept)"] == pytest.approx(m["p", "D"])
    assert got["aq"] == pytest.approx(m["q", "D"] - m["p", "D"])
    assert got["cP"] == pytest.approx(m["p", "P"] - m["p", "D"])
    assert got["aq:cP"] == pytest.approx(m["q", "P"] - m["q", "D"] - m["p", "P"] + m["p", "D"])


def test_groups_fit_separately_and_large_means_keep_digits(spark):
    pdf = data(1)
    fitted = O.fit(spark.createDataFrame(pdf), "y", D.numeric("x"), ["model"]).collect()
    for row in fitted:
        part = pdf[pdf.model == row["model"]]
        b, se, e = dense([part.x - 1e6], part.y.to_numpy())
        slope = row["terms"][1]
        assert slope["estimate"] == pytest.approx(b[1], rel=1e-6)
        assert slope["std_error"] == pytest.approx(se[1], rel=1e-6)
        assert row["r_squared"] == pytest.approx(1 - e @ e / ((part.y - part.y.mean()) ** 2).sum(), rel=1e-6)
        assert row["f_value"] == pytest.approx((b[1] / se[1]) ** 2, rel=1e-6)
        assert row["n"] == len(part)


def test_missing_rows_leave_and_aliased_terms_are_missing(spark):
    pdf = data(2)
    df = spark.createDataFrame(pdf).withColumn("y", F.when(F.col("a") == "p", F.col("y")))
    rows = O.coefficients(O.fit(df, "y", D.factor("a", ["p", "q"]) + D.numeric("x"))).collect()
    got = {r["term"]: r["estimate"] for r in rows}
    assert got["aq"] is None and got["x"] is not None


def test_residuals(spark):
    pdf = data(3)
    df = spark.createDataFrame(pdf)
    terms = D.factor("a", ["p", "q"]) + D.factor("c", ["D", "P"])
    _, _, e = dense([pdf.a == "q", pdf.c == "P"], pdf.y.to_numpy())
    whole = O.with_residuals(df, O.fit(df, "y", terms), "y", terms)
    assert np.sort([r["residual"] for r in whole.collect()]) == pytest.approx(np.sort(e))
    grouped = O.with_residuals(df, O.fit(df, "y", terms, ["model"]), "y", terms, ["model"])
    assert grouped.groupBy("model").agg(F.avg("residual").alias("m")).agg(F.max(F.abs("m"))).first()[0] < 1e-10
