"""Random slopes: fixed effects against dense GLS at the fitted covariances, and recovery."""

import numpy as np
import pandas as pd
import pytest

from pairlab.functions import design as D
from pairlab.operators import slopes as S
from pairlab.sources import staging
from pairlab.sources.staging import Scratch


def simulate(seed=3, raters=30, pairs=40, share=0.5):
    rng = np.random.default_rng(seed)
    rater_cov = np.array([[1.0, 0.3], [0.3, 0.6]])
    pair_cov = np.array([[0.8, -0.2], [-0.2, 0.5]])
    br = rng.multivariate_normal([0, 0], rater_cov, raters)
    bp = rng.multivariate_normal([0, 0], pair_cov, pairs)
    rank = rng.integers(1, 50, pairs)
    rows = []
    for r in range(raters):
        for p in range(pairs):
            for c in (0.0, 1.0):
                if rng.random() < share:
                    y = 2 + 0.5 * c - 0.03 * rank[p] + br[r] @ [1, c] + bp[p] @ [1, c] + rng.normal(0, 0.7)
                    rows.append((f"r{r}", p, c, float(rank[p]), y))
    return pd.DataFrame(rows, columns=["rater", "pair", "c", "rank", "y"])


def test_random_slopes(spark):
    pdf = simulate()
    terms = D.numeric("c") + D.numeric("rank")
    rows = S.fit_slopes(
        spark.createDataFrame(pdf), "y", terms, ("rater", ["c"]), ("pair", ["c"]), tolerance=1e-3
    ).collect()
    fixed = {r["term"]: r for r in rows if r["part"] == "fixed"}
    cov = {
        part: {(r["term"], r["with_term"]): r["estimate"] for r in rows if r["part"] == part} for part in ("rater", "pair")
    }
    sigma2 = next(r["estimate"] for r in rows if r["part"] == "residual")
    assert sigma2 == pytest.approx(0.49, rel=0.15)
    one = "(Intercept)"
    assert cov["rater"][(one, one)] == pytest.approx(1.0, rel=0.6)
    assert cov["pair"][("c", "c")] == pytest.approx(0.5, rel=0.6)
    assert cov["rater"][("c", one)] > 0 > cov["pair"][("c", one)]

    x = np.column_stack([np.ones(len(pdf)), pdf.c, pdf["rank"]])
    v = sigma2 * np.eye(len(pdf))
    z = x[:, :2]
    for part in ("rater", "pair"):
        g = cov[part]
        block = np.array([[g[(one, one)], g[("c", one)]], [g[("c", one)], g[("c", "c")]]])
        same = pdf[part].to_numpy()[:, None] == pdf[part].to_numpy()[None, :]
        v += same * (z @ block @ z.T)
    vi = np.linalg.inv(v)
    xvx = x.T @ vi @ x
    beta = np.linalg.solve(xvx, x.T @ vi @ pdf.y)
    errors = np.sqrt(np.diag(np.linalg.inv(xvx)))
    for i, name in enumerate((one, "c", "rank")):
        assert fixed[name]["estimate"] == pytest.approx(beta[i], abs=0.02 * errors[i])
        assert fixed[name]["std_error"] == pytest.approx(errors[i], rel=0.01)


def test_a_sweep_shuffles_no_cells_and_writes_no_sums_by_level(spark):
    pdf = simulate(raters=8, pairs=20)
    with Scratch(spark) as scratch:
        model = S._Model(spark.createDataFrame(pdf), "y", D.numeric("c") + D.numeric("rank"), [("rater", ["c"]), ("pair", ["c"])], scratch)
        first, second = model.blocks
        effects = scratch.stage(first.table.selectExpr("level", "zy AS b"), "effects")
        plan = model.cross_sums(effects, first, second, 1)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "hashpartitioning(second" not in plan and "hashpartitioning(level" not in plan
        solved = S._ridge(second.table, None, second.size, model.p, 1, np.eye(2), 1.0, np.zeros((model.p, 1)), True)
        rows = solved.collect()
        levels, sums = [r for r in rows if r["level"] is not None], [r for r in rows if r["level"] is None]
        assert len(levels) == pdf.pair.nunique() and all(r["s"] is None for r in levels) and all(r["b"] is None for r in sums)
        assert S._read(solved, second.size, model.p, 1).effects[:, 0] == pytest.approx(np.sum([r["b"] for r in levels], axis=0))
    assert not staging._tables
