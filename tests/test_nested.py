"""Nested intercepts: groups without number, in tasks and over tables."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlab.functions import design as D
from pairlab.operators import nested as N
from pairlab.sources.staging import Scratch
from tests.test_mixed import dense_reml, simulate, terms

VALUES = ("estimate", "std_error", "df", "t_value", "p_value", "var_inner", "var_outer", "var_residual", "reml")


def by_group(result):
    return {(r["model"], r["term"]): tuple(r[v] for v in VALUES) for r in result.collect()}


def numbers(row):
    return [-1e9 if v is None else v for v in row]


@pytest.fixture(scope="module")
def several():
    return pd.concat([simulate(s, verbs=8 + s % 5, per_verb=2 + s % 3, raters=4).assign(model=f"m{s}") for s in range(20, 29)])


def test_tasks_and_tables_take_the_same_steps(spark, several):
    df = spark.createDataFrame(several)
    inside = by_group(N.fit_nested(df, "y", terms(), "pair", "verb", by=["model"]))
    tables = by_group(N.fit_nested(df, "y", terms(), "pair", "verb", by=["model"], whole=0))
    mixed = by_group(N.fit_nested(df, "y", terms(), "pair", "verb", by=["model"], whole=24))
    assert inside.keys() == tables.keys() == mixed.keys() and len(inside) == 27
    for key, row in inside.items():
        assert numbers(row) == pytest.approx(numbers(tables[key]), rel=1e-6, abs=1e-8)
        assert numbers(row) == pytest.approx(numbers(mixed[key]), rel=1e-6, abs=1e-8)


def test_one_intercept_over_tables(spark, several):
    df = spark.createDataFrame(several)
    inside = by_group(N.fit_nested(df, "y", terms(), "pair", by=["model"]))
    tables = by_group(N.fit_nested(df, "y", terms(), "pair", by=["model"], whole=0))
    for key, row in inside.items():
        assert row[6] is None and numbers(row) == pytest.approx(numbers(tables[key]), rel=1e-6, abs=1e-8)


def test_twenty_thousand_groups_in_one_run(spark):
    """Small groups, made in Spark; ten of them against their optimum by dense algebra."""
    cells = spark.range(20_000 * 24).select(
        (F.col("id") % 20_000).cast("string").alias("model"), (F.col("id") / 20_000 % 8).cast("int").alias("pair"), F.col("id").alias("row")
    ).withColumn("verb", (F.col("pair") / 2).cast("int"))

    def noise(*of):
        return (F.pmod(F.xxhash64(*of), F.lit(1 << 20)).cast("double") / (1 << 19) - 1) * math.sqrt(3)

    df = cells.withColumn("x", noise("row", F.lit(1))).withColumn("w", noise("row", F.lit(2))).withColumn(
        "y", 1 + F.col("x") + noise("model", "pair", F.lit("p")) + noise("model", "verb", F.lit("v")) + noise("row", F.lit(3))
    ).drop("row")
    fitted = N.fit_nested(df, "y", terms(), "pair", "verb", by=["model"])
    assert fitted.count() == 60_000 and fitted.select("model").distinct().count() == 20_000
    names = [str(k * 1999) for k in range(10)]
    rows = df.where(F.col("model").isin(names)).toPandas()
    got = by_group(fitted.where(F.col("model").isin(names)))
    tables = by_group(N.fit_nested(df.where(F.col("model").isin(names)), "y", terms(), "pair", "verb", by=["model"], whole=0))
    for name in names:
        one = rows[rows.model == name]
        row = dict(zip(VALUES, got[name, "x"], strict=True))
        ratios = [math.sqrt(row["var_inner"] / row["var_residual"]), math.sqrt(row["var_outer"] / row["var_residual"])]
        value, beta, cov, s2 = dense_reml(one, ["pair", "verb"], ratios)
        assert row["reml"] == pytest.approx(value + (len(one) - 3) * (1 + math.log(2 * math.pi)), rel=1e-9)
        assert row["estimate"] == pytest.approx(beta[1], rel=1e-7) and row["var_residual"] == pytest.approx(s2, rel=1e-8)
        for a, b in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
            if all(r + d >= 0 for r, d in zip(ratios, (a, b), strict=True)):
                assert dense_reml(one, ["pair", "verb"], [ratios[0] + a, ratios[1] + b])[0] >= value - 1e-9
        for term in ("(Intercept)", "x", "w"):
            assert got[name, term] == pytest.approx(tables[name, term], rel=1e-6, abs=1e-8)


def test_null_keys_tiny_groups_and_perfect_fits(spark):
    rng = np.random.default_rng(3)
    real = simulate(31).drop(columns=["rater"])
    line = pd.DataFrame({"pair": np.arange(8), "verb": np.arange(8) // 2, "x": np.arange(8.0), "w": rng.normal(size=8)})
    line["y"] = 2 + 3 * line.x
    tiny = pd.DataFrame({"pair": [1, 2], "verb": [1, 1], "x": [0.0, 1.0], "w": [1.0, 5.0], "y": [1.0, 2.0]})
    lost = pd.DataFrame({"pair": [1], "verb": [1], "x": [None], "w": [1.0], "y": [1.0]})
    both = pd.concat([real.assign(model=None), line.assign(model="line"), tiny.assign(model="tiny"), lost.assign(model="lost")])
    df = spark.createDataFrame(both.astype({"x": float}), "pair long, verb long, x double, w double, y double, model string")
    df = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    for whole in (None, 0):
        got = by_group(N.fit_nested(df, "y", terms(), "pair", "verb", by=["model"], whole=whole))
        assert {k[0] for k in got} == {None, "line", "tiny"}
        assert got[None, "x"][5] > 0 and got[None, "x"][8] is not None
        assert got["line", "x"][0] == pytest.approx(3) and got["line", "x"][1:] == (None,) * 8
        assert got["tiny", "x"][0] == pytest.approx(1) and got["tiny", "w"][0] is None
    empty = N.fit_nested(df.limit(0), "y", terms(), "pair", "verb", by=["model"])
    assert empty.collect() == [] and empty.columns[0] == "model"


def test_unsettled_groups_fail_by_name(spark, several):
    df = spark.createDataFrame(several)
    for whole in (None, 0):
        with pytest.raises(RuntimeError, match="no settled fit for .*m2"):
            N.fit_nested(df, "y", terms(), "pair", "verb", by=["model"], looks=1, whole=whole)


def test_outer_ids_beyond_double_precision(spark):
    pdf = simulate(33).drop(columns=["rater"])
    wide = pdf.assign(verb=pdf.verb + 2**60, pair=pdf.pair + 2**60)
    a, b = (N.fit_nested(spark.createDataFrame(p), "y", terms(), "pair", "verb").orderBy("term").collect() for p in (pdf, wide))
    for x, y in zip(a, b, strict=True):
        assert [v for v in x[1:]] == pytest.approx([v for v in y[1:]], rel=1e-7)
    assert D.numeric("x")


def test_evaluations_dont_shuffle_level_rows(spark):
    rows = [(v, 2 * v + k % 2, float(k % 3), float((v * 7 + k * 5) % 11)) for v in range(60) for k in range(6)]
    df = spark.createDataFrame(rows, "verb int, pair int, x double, y double")
    with Scratch(spark) as scratch:
        design = N.Design.build(df, "y", D.numeric("x"), "pair", "verb", [], scratch.stage, scratch.stage_bucketed)
        points = scratch.stage(N._first_state(design, design.centres), "points").select("g", "points")
        seen = design.profiles(design.levels, points)
        plan = seen._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" in plan and not re.search(r"Exchange hashpartitioning\([^)]*outer", plan)
        assert len(seen.first()["seen"]) == len(N._grid(True))
