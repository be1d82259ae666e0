"""Column expressions, missing-value rules and the t distribution."""

import math

import pytest
from pyspark.sql import functions as F

from pairlab.functions import exprs as X
from pairlab.functions import tdist


@pytest.mark.parametrize(
    "p, df, expected",
    [  # published table values
        (0.975, 1, 12.706), (0.975, 2, 4.303), (0.975, 5, 2.571), (0.975, 10, 2.228), (0.975, 30, 2.042),
        (0.975, 120, 1.980), (0.95, 4, 2.132), (0.995, 8, 3.355), (0.9, 15, 1.341),
    ],
)
def test_t_quantiles(p, df, expected):
    assert tdist.quantile(p, df) == pytest.approx(expected, abs=6e-4)
    assert tdist.quantile(1 - p, df) == pytest.approx(-expected, abs=6e-4)


def test_t_tails():
    assert tdist.two_sided_p(0.0, 7) == pytest.approx(1.0)
    # One degree of freedom is the Cauchy distribution.
    assert tdist.two_sided_p(1.0, 1) == pytest.approx(0.5)
    assert tdist.two_sided_p(3.0, 1) == pytest.approx(1 - 2 * math.atan(3.0) / math.pi)
    assert tdist.two_sided_p(1.959964, math.inf) == pytest.approx(0.05, abs=1e-6)
    assert tdist.two_sided_p(1.959964, 5e7) == pytest.approx(0.05, abs=1e-6)
    assert math.isnan(tdist.two_sided_p(1.0, 0))


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("v")).first()["v"]


def test_text_to_number(spark):
    assert one(spark, X.number("a"), a="3.5") == 3.5
    assert one(spark, X.number("a"), a="n/a") is None
    assert one(spark, X.number("a"), a="NaN") is None
    assert one(spark, X.number("a"), a="") is None


def test_zero_denominator_is_missing(spark):
    assert one(spark, X.ratio("a", "b"), a=1.0, b=0.0) is None
    assert one(spark, X.ratio("a", "b"), a=1.0, b=4.0) == 0.25


def test_strict_and_skipping_means(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 3.0)], "g string, x double")
    got = {r["g"]: (r["s"], r["m"]) for r in rows.groupBy("g").agg(X.mean_strict("x").alias("s"), F.avg("x").alias("m")).collect()}
    assert got == {"a": (None, 1.0), "b": (2.0, 2.0)}


def test_conditionals(spark):
    pick = X.choose("c", {"PDsentence": "p", "DOsentence": "d"})
    assert one(spark, pick, c="PDsentence", p=1.0, d=2.0) == 1.0
    assert one(spark, pick, c="DOsentence", p=1.0, d=2.0) == 2.0
    assert one(spark, pick, c="filler", p=1.0, d=2.0) is None
    assert one(spark, X.recode("c", {"longIndefinite": "Long"}), c="longIndefinite") == "Long"
    assert one(spark, X.recode("c", {"longIndefinite": "Long"}), c="other") == "other"
    assert one(spark, X.level_position("c", ["x", "y"]), c="y") == 2
    assert one(spark, X.level_position("c", ["x", "y"]), c="z") is None


@pytest.mark.parametrize("z, kind, expected", [(-1.0, "low", 1), (0.0, "low", 0), (0.5, "high", 1), (0.0, "high", 0), (2.0, "low", 0)])
def test_correct_answers(spark, z, kind, expected):
    assert one(spark, X.answered_correctly("z", "k"), z=z, k=kind) == expected


def test_missing_score_has_no_verdict(spark):
    row = spark.sql("select cast(null as double) z, 'low' k")
    assert row.select(X.answered_correctly("z", "k").alias("v")).first()["v"] is None


def test_row_mean_skips_missing(spark):
    row = spark.sql("select 1.0D a, cast(null as double) b, 4.0D c, cast(null as double) d")
    assert row.select(X.row_mean(["a", "b", "c"]).alias("v")).first()["v"] == 2.5
    assert row.select(X.row_mean(["b", "d"]).alias("v")).first()["v"] is None


@pytest.mark.parametrize(
    "code, name",
    [("gpt2", "gpt2"), ("gpt2m", "gpt2-medium"), ("gpt2l", "gpt2-large"), ("gpt2xl", "gpt2-xl"),
     ("100M_3", "models/100M_3/checkpoint-7"), ("gptxl", None), ("s", None)],
)
def test_model_names(spark, code, name):
    assert one(spark, X.model_name("c", "7"), c=code) == name
