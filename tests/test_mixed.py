"""Mixed models against dense linear algebra on small data."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlab.functions import design as D
from pairlab.operators import mixed as M
from pairlab.plans import standin as V
from pairlab.plans.model_queries import class_by_construct

TERMS = ["(Intercept)", "x", "w"]


def simulate(seed, verbs=12, per_verb=3, raters=10, share=0.6, sd=(1.2, 0.8, 1.0, 0.7)):
    rng = np.random.default_rng(seed)
    rows = []
    rater = rng.normal(0, sd[2], raters)
    for v in range(verbs):
        ve = rng.normal(0, sd[1])
        w = float(rng.integers(1, 9))
        for k in range(per_verb):
            pe = rng.normal(0, sd[0])
            for r in range(raters):
                for x in (0.0, 1.0):
                    if rng.random() < share:
                        y = 3 + 0.7 * x - 0.2 * w + ve + pe + rater[r] + rng.normal(0, sd[3])
                        rows.append((r, v * 100 + k, v, x, w, y))
    return pd.DataFrame(rows, columns=["rater", "pair", "verb", "x", "w", "y"])


def terms():
    return D.numeric("x") + D.numeric("w")


def dummies(values):
    levels = np.unique(values)
    return (np.asarray(values)[:, None] == levels[None, :]).astype(float)


def dense_reml(pdf, factors, ratios):
    """(criterion, beta, cov, sigma2) by dense algebra at given sd ratios."""
    x = np.column_stack([np.ones(len(pdf)), pdf.x, pdf.w])
    v = np.eye(len(pdf))
    for f, r in zip(factors, ratios):
        z = dummies(pdf[f])
        v += r * r * z @ z.T
    vi = np.linalg.inv(v)
    xvx = x.T @ vi @ x
    beta = np.linalg.solve(xvx, x.T @ vi @ pdf.y)
    e = pdf.y - x @ beta
    df = len(pdf) - 3
    s2 = float(e @ vi @ e) / df
    value = df * math.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1]
    return value, beta, np.linalg.inv(xvx) * s2, s2


def by_term(result):
    return {r["term"]: r for r in result.collect()}


def test_nested_reaches_the_dense_optimum(spark):
    pdf = simulate(1)
    got = by_term(M.fit_nested(spark.createDataFrame(pdf), "y", terms(), "pair", "verb"))
    row = got["x"]
    ratios = [math.sqrt(row["var_inner"] / row["var_residual"]), math.sqrt(row["var_outer"] / row["var_residual"])]
    value, beta, cov, s2 = dense_reml(pdf, ["pair", "verb"], ratios)
    for shift in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
        assert dense_reml(pdf, ["pair", "verb"], [r + d for r, d in zip(ratios, shift)])[0] > value
    assert row["reml"] == pytest.approx(value + (len(pdf) - 3) * (1 + math.log(2 * math.pi)), rel=1e-9)
    for i, name in enumerate(TERMS):
        assert got[name]["estimate"] == pytest.approx(beta[i], rel=1e-8)
        assert got[name]["std_error"] == pytest.approx(math.sqrt(cov[i, i]), rel=1e-8)
    assert row["var_residual"] == pytest.approx(s2, rel=1e-9)
    # A within-pair term has residual-like degrees of freedom, a verb-level one about verbs - 2.
    assert 150 < got["x"]["df"] < len(pdf)
    assert 5 < got["w"]["df"] < 14


def test_one_intercept_balanced_closed_form(spark):
    # Balanced one-way layout: REML equals the analysis-of-variance estimates, and the
    # intercept has groups - 1 degrees of freedom.
    rng = np.random.default_rng(4)
    groups, size = 15, 6
    y = np.repeat(rng.normal(0, 2, groups), size) + rng.normal(0, 1, groups * size)
    pdf = pd.DataFrame({"g": np.repeat(np.arange(groups), size), "y": y})
    got = M.fit_nested(spark.createDataFrame(pdf), "y", [], "g").collect()[0]
    means = pdf.groupby("g").y.mean()
    within = pdf.groupby("g").y.var().mean()
    between = size * means.var()
    assert got["var_residual"] == pytest.approx(within, rel=1e-6)
    assert got["var_inner"] == pytest.approx((between - within) / size, rel=1e-5)
    assert got["std_error"] == pytest.approx(math.sqrt(between / (groups * size)), rel=1e-5)
    assert got["df"] == pytest.approx(groups - 1, rel=1e-2)


def test_boundary_fit_and_groups(spark):
    rng = np.random.default_rng(9)
    flat = simulate(2, sd=(0.0, 0.0, 0.0, 1.0))
    flat["y"] = rng.normal(0, 1, len(flat))
    both = pd.concat([flat.assign(model="flat"), simulate(3).assign(model="real")])
    got = M.fit_nested(spark.createDataFrame(both), "y", terms(), "pair", "verb", by=["model"])
    rows = {(r["model"], r["term"]): r for r in got.collect()}
    assert len(rows) == 6
    flat_row = rows[("flat", "x")]
    assert flat_row["var_inner"] < 0.15 and flat_row["var_outer"] < 0.15
    alone = by_term(M.fit_nested(spark.createDataFrame(simulate(3)), "y", terms(), "pair", "verb"))
    assert rows[("real", "w")]["estimate"] == pytest.approx(alone["w"]["estimate"], rel=1e-6)


def test_crossed_matches_generalised_least_squares(spark):
    pdf = simulate(5)
    variances = (1.0, 1.44, 0.64, 0.49)
    got = by_term(
        M.fit_crossed(spark.createDataFrame(pdf), "y", terms(), "rater", "pair", "verb", variances, tolerance=1e-9)
    )
    ratios = [math.sqrt(v / variances[3]) for v in variances[:3]]
    _, beta, cov, s2 = dense_reml(pdf, ["rater", "pair", "verb"], ratios)
    for i, name in enumerate(TERMS):
        assert got[name]["estimate"] == pytest.approx(beta[i], rel=1e-6)
        assert got[name]["std_error"] == pytest.approx(math.sqrt(cov[i, i] / s2 * variances[3]), rel=1e-6)


def test_crossed_moments_recover_known_variances(spark):
    pdf = simulate(6, verbs=60, per_verb=4, raters=60, share=0.35, sd=(1.2, 0.8, 1.0, 0.7))
    design = M.Crossed.build(spark.createDataFrame(pdf), "y", terms(), "rater", "pair", "verb")
    rows = design.moment_table().collect()
    rater, pair, verb, error = M.solve_moments(
        [[r["ssw"], r["coef_rater"], r["coef_pair"], r["coef_verb"], r["coef_error"]] for r in rows]
    )
    assert error == pytest.approx(0.49, rel=0.1)
    assert pair == pytest.approx(1.44, rel=0.3)
    assert verb == pytest.approx(0.64, rel=0.6)
    assert rater == pytest.approx(1.0, rel=0.5)


def test_moment_solution_clips_negative_components():
    table = [[10.0, 0, 5, 5, 8], [12.0, 5, 0, 0, 8], [11.0, 5, 3, 0, 9], [9.0, 6, 6, 6, 9]]
    assert min(M.solve_moments(table)) >= 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test data not present")
def test_no_small_move_of_a_ratio_lowers_the_criterion(spark):
    """The registered nested fit, whose surface is flat enough to stop a search too early."""
    scores = V.scores(spark, "/root/testdata/sf0.01").withColumn("score", F.col("score") / 1000)
    terms = class_by_construct() + D.numeric("frequency_rank")
    fitted = {r["model"]: r for r in M.fit_nested(scores, "score", terms, "sent_pair_id", "verb_id", by=["model"]).where("term = '(Intercept)'").collect()}
    assert fitted["N"]["var_inner"] == pytest.approx(9.613, abs=0.01) and fitted["N"]["var_outer"] == pytest.approx(3.904, abs=0.01)

    def criteria(ratios):
        rows = M.nested_cross_products(scores.where("model = 'N'"), "score", terms, "sent_pair_id", "verb_id", ["model"], ratios).collect()
        n = max(r["j"] for r in rows) + 1
        matrix, log_det = np.zeros((n, n)), 0.0
        for r in rows:
            if r["i"] < 0:
                log_det = r["value"]
            else:
                matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["value"]
        xx, xy = matrix[:-1, :-1], matrix[:-1, -1]
        df = scores.where("model = 'N'").count() - len(xx)
        rss = matrix[-1, -1] - xy @ np.linalg.solve(xx, xy)
        return df * np.log(rss / df) + log_det + np.linalg.slogdet(xx)[1]

    row = fitted["N"]
    at = (np.sqrt(row["var_inner"] / row["var_residual"]), np.sqrt(row["var_outer"] / row["var_residual"]))
    here = criteria(at)
    for move in ((1.02, 1), (0.98, 1), (1, 1.02), (1, 0.98)):
        assert criteria((at[0] * move[0], at[1] * move[1])) > here


def test_a_fit_that_has_not_settled_fails(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.repeat(np.arange(40), 5), "x": rng.normal(size=200)})
    pdf["y"] = pdf.x + rng.normal(0, 1, 40)[pdf.g] + rng.normal(0, 1, 200)
    with pytest.raises(RuntimeError, match="no settled fit"):
        M.fit_nested(spark.createDataFrame(pdf), "y", D.numeric("x"), "g", looks=1)
