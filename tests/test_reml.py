"""REML variances of crossed intercepts against dense algebra."""

import numpy as np
import pytest

from pairlab.operators import reml as R
from pairlab.operators.mixed import Crossed
from pairlab.sources import staging
from pairlab.sources.staging import Scratch
from tests.test_mixed import dummies, simulate, terms


def dense(pdf, v):
    """(score, average information, P y) at stated variances, with the n x n matrix written out."""
    x = np.column_stack([np.ones(len(pdf)), pdf.x, pdf.w])
    parts = [dummies(pdf[f]) @ dummies(pdf[f]).T for f in ("rater", "pair", "verb")] + [np.eye(len(pdf))]
    inverse = np.linalg.inv(sum(a * k for a, k in zip(v, parts, strict=True)))
    p = inverse - inverse @ x @ np.linalg.solve(x.T @ inverse @ x, x.T @ inverse)
    py = p @ pdf.y.to_numpy()
    working = [k @ py for k in parts]
    score = np.array([-0.5 * ((p * k).sum() - py @ w) for k, w in zip(parts, working, strict=True)])
    return score, 0.5 * np.array([[a @ p @ b for b in working] for a in working])


def dense_reml(pdf):
    v = np.ones(4)
    for _ in range(60):
        score, information = dense(pdf, v)
        new = np.maximum(v + np.linalg.solve(information, score), 0.1 * v)
        if np.abs(new - v).max() < 1e-7:
            return new
        v = new
    raise AssertionError("dense fit not settled")


DESIGNS = [simulate(7, verbs=20, per_verb=4, raters=20, share=0.25), simulate(8, verbs=25, per_verb=2, raters=30, share=0.2, sd=(0.5, 1.5, 0.4, 1.0)),
           simulate(9, verbs=30, per_verb=3, raters=12, share=0.3, sd=(1.0, 0.6, 2.0, 0.5))]


@pytest.mark.parametrize("which", range(3))
def test_variances_match_dense_reml_on_unbalanced_designs(spark, which):
    pdf = DESIGNS[which]
    pdf = pdf[(pdf.rater + pdf.pair) % 5 != which]
    want = dense_reml(pdf)
    got = R.fit_crossed_reml(spark.createDataFrame(pdf), "y", terms(), "rater", "pair", "verb").first()
    assert [got[f"var_{f}"] for f in ("rater", "pair", "verb", "residual")] == pytest.approx(want, rel=0.01)
    assert got["probe_error_pair"] == 0  # small designs are traced exactly


def test_probes_state_their_error(spark, monkeypatch):
    monkeypatch.setattr(R, "TRACE_WORK", 0)
    pdf, errors = DESIGNS[0], []
    want = dense_reml(pdf)
    gram = None
    with Scratch(spark) as scratch:
        design = Crossed.build(spark.createDataFrame(pdf), "y", terms(), "rater", "pair", "verb", scratch.stage, scratch.stage_bucketed)
        gram = design.centre.gram()
        cells = design.cells.toPandas()
    for seed in range(6):
        whole = R.WholeDesign(*[cells[c].to_numpy() for c in ("rater", "pair", "verb")], cells[["n", "w1", "w2", "wy"]].to_numpy(dtype=float), gram, 16, seed)
        v, e = R._climb(np.ones(4), whole.take, 40, 1e-6)
        errors.append(np.abs(v - want)[:3] / np.maximum(e[:3], 1e-12))
        assert v == pytest.approx(want, rel=0.1)
    assert np.median(np.array(errors)[:, 1:]) < 2


def test_tables_give_the_same_step_as_dense_algebra(spark):
    pdf = DESIGNS[2]
    v = np.array([1.5, 1.2, 0.5, 0.3])
    score, information = dense(pdf, v)
    with Scratch(spark) as scratch:
        design = Crossed.build(spark.createDataFrame(pdf), "y", terms(), "rater", "pair", "verb", scratch.stage, scratch.stage_bucketed)
        scratch.next_round()
        step = R._Step(design, v, 3, scratch)
        got, info, noise, _ = step.take(*step.first_sides(), [None, None])
    assert info == pytest.approx(information, rel=1e-3, abs=1e-3 * np.abs(information).max() * 0.01)
    assert np.all(np.abs(got - score) <= 4 * np.sqrt(np.diag(noise)) + 0.02 * np.abs(score) + 0.05)


def test_a_pass_does_not_shuffle_the_cells(spark):
    """Cells staged in buckets of pairs meet pair effects, and are summed by pair, where they lie."""
    pdf = DESIGNS[0]
    with Scratch(spark) as scratch:
        design = Crossed.build(spark.createDataFrame(pdf), "y", terms(), "rater", "pair", "verb", scratch.stage, scratch.stage_bucketed)
        equations = R.Equations(design, [1.0, 1.0, 1.0], scratch)
        effects = scratch.stage(design.raters.selectExpr("rater", "wy AS a0"), "effects")
        pairs = design.pairs.join(equations._to_pairs(effects, ["a0"]), "pair")
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(pair" not in plan and "Bucketed: true" in plan
        items = scratch.stage_bucketed(design.pairs.selectExpr("pair", "1D AS b0", "0D AS c0"), "items", "pair")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = equations._to_raters(items, 1)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "SortMergeJoin" in plan and "hashpartitioning(pair" not in plan
    assert not staging._tables


def test_a_factor_without_variance_settles_near_zero(spark):
    pdf = simulate(12, verbs=20, per_verb=3, raters=15, share=0.3, sd=(1.0, 0.0, 0.0, 1.0))
    got = R.fit_crossed_reml(spark.createDataFrame(pdf), "y", terms(), "rater", "pair", "verb").first()
    assert got["var_verb"] < 0.4 and got["var_rater"] < 0.1 and got["var_pair"] == pytest.approx(1.0, rel=0.5)


def test_blocks_give_the_step_of_dense_algebra_and_the_whole_fit(spark, monkeypatch):
    pdf = DESIGNS[0]
    v = np.array([1.5, 1.2, 0.5, 0.3])
    score, information = dense(pdf, v)
    with Scratch(spark) as scratch:
        design = Crossed.build(spark.createDataFrame(pdf), "y", terms(), "rater", "pair", "verb", scratch.stage, scratch.stage_bucketed)
        blocks = R._in_blocks(design, scratch, 8)
        got, info, noise = R._step_in_blocks(blocks, v)
        again = R._step_in_blocks(blocks, v)[0]  # from the solutions
    assert info == pytest.approx(information, rel=1e-6, abs=1e-6 * np.abs(information).max())
    assert np.all(np.abs(got - score) <= 4 * np.sqrt(np.diag(noise)) + 1e-6 * np.abs(score))
    assert again == pytest.approx(got, rel=1e-6)

    df = spark.createDataFrame(pdf)
    variances = dense_reml(pdf)
    monkeypatch.setattr(R, "reml_variances", lambda *_, **__: (variances, np.zeros(4)))
    want = R.fit_crossed_reml(df, "y", terms(), "rater", "pair", "verb", tolerance=1e-9).collect()
    monkeypatch.setattr(R, "WHOLE", 0)
    monkeypatch.setattr(R, "_sweep_crossed", lambda *_: pytest.fail("the raters' equations were solved over tables"))
    for a, b in zip(want, R.fit_crossed_reml(df, "y", terms(), "rater", "pair", "verb").collect(), strict=True):
        assert (a["term"], a["df"]) == (b["term"], b["df"])
        assert [b["estimate"], b["std_error"]] == pytest.approx([a["estimate"], a["std_error"]], rel=1e-5)


def test_a_large_design_iterates_by_one_job_each(spark, monkeypatch):
    monkeypatch.setattr(R, "WHOLE", 0)
    monkeypatch.setattr(R, "_Step", lambda *_: pytest.fail("a step ran over tables"))
    pdf = DESIGNS[1]
    got = R.fit_crossed_reml(spark.createDataFrame(pdf), "y", terms(), "rater", "pair", "verb", probes=40).first()
    assert [got[f"var_{f}"] for f in ("rater", "pair", "verb", "residual")] == pytest.approx(dense_reml(pdf), rel=0.1, abs=0.03)
    assert not staging._tables


def test_no_size_decides_how_traces_are_found(spark, monkeypatch):
    monkeypatch.setattr(R, "WHOLE", 0)
    pdf = DESIGNS[2]
    got = R.fit_crossed_reml(spark.createDataFrame(pdf), "y", terms(), "rater", "pair", "verb").first()
    assert [got[f"var_{f}"] for f in ("rater", "pair", "verb", "residual")] == pytest.approx(dense_reml(pdf), rel=1e-3)
    assert [got[f"probe_error_{f}"] for f in ("rater", "pair", "verb", "residual")] == [0, 0, 0, 0]


def test_tables_and_blocks_solve_the_same_equations_with_the_same_probes(spark):
    pdf = DESIGNS[1]
    v = np.array([0.4, 1.5, 0.3, 1.1])
    with Scratch(spark) as scratch:
        design = Crossed.build(spark.createDataFrame(pdf), "y", terms(), "rater", "pair", "verb", scratch.stage, scratch.stage_bucketed)
        blocks = R._in_blocks(design, scratch, 3)
        want = R._step_in_blocks(blocks, v)
        scratch.next_round()
        step = R._Step(design, v, 3, scratch)
        *got, _ = step.take(*step.first_sides(), [None, None])
        fixed = R._fixed_over_tables(design, scratch, v[:3] / v[3], 1e-8)
        assert fixed == pytest.approx(blocks.fixed_effects(v[:3] / v[3]), rel=1e-6, abs=1e-9)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-5, abs=1e-6 * np.abs(b).max())
    score, information = dense(pdf, v)
    assert want[1] == pytest.approx(information, rel=1e-6, abs=1e-6 * np.abs(information).max())
    assert np.all(np.abs(want[0] - score) <= 6 * np.sqrt(np.diag(want[2])) + 1e-6 * np.abs(score))


def test_probes_are_added_until_they_hardly_count(spark, monkeypatch):
    asked, noise = [], np.diag([1e-2, 0, 0, 0])

    class Held:
        def probe(self, table):
            asked.append(table.shape)

    design = type("Design", (), {"n_raters": 1000})()
    monkeypatch.setattr(R, "_probe_table", lambda design, count: np.zeros((design.n_raters, min(count, design.n_raters))))
    monkeypatch.setattr(R, "_step_in_blocks", lambda blocks, v: (1.0 - v, np.eye(4), noise * (10.0 if len(asked) < 2 else 1e-3)))
    monkeypatch.setattr(R, "SHARE", 0.05)
    v, error = R.reml_variances(design, None, np.ones(4), blocks=Held())
    assert asked[0][1] >= R.SETTLED and asked[1] == (1000, 1000) and len(asked) == 2 and v == pytest.approx(np.ones(4))
    asked.clear()
    monkeypatch.setattr(R, "_step_in_blocks", lambda blocks, v: (1.0 - v, np.eye(4), noise * 1e-3))
    R.reml_variances(design, None, np.ones(4), blocks=Held())
    assert asked == [(1000, R.SETTLED)]
