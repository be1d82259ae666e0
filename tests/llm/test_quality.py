import math

import pytest
from pyspark.sql import functions as F

from pairlab.llm import quality as Q


def tail(n, k, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


@pytest.mark.parametrize("n, k", [(1, 0), (100, 0), (500, 3), (5000, 20), (200000, 1500)])
def test_exact_binomial_tail(spark, n, k):
    got = spark.range(1).select(Q.log_binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), 0.01).alias("t")).first()["t"]
    if n <= 5000:
        assert math.isclose(math.exp(got), tail(n, k, 0.01), rel_tol=1e-9)
    else:
        assert -200 < got < -20  # the floating-point sum above underflows


def test_cutoffs_are_certified_and_lowest(spark):
    good = [("en", 0, 0, 0, 20, 20)] * 1500 + [("en", 9, 0, 0, 20, 20)] * 3 + [("en", 5, 0, 0, 20, 20)] * 40 + [("xx", 0, 0, 0, 20, 20)] * 20
    df = spark.createDataFrame(good, "stratum string, symbols int, lines int, repeats int, long_words int, short_words int")
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in Q.cutoffs(df).collect()}
    limit, error = Q.RISK / len(Q.RULES), Q.ERROR / 10
    assert tail(1543, 3, limit) <= error < tail(1543, 43, limit)
    assert got[("en", "symbols")] == 6 and got[("en", "lines")] == 1 and got[("en", "long_words")] == 21
    assert not any(s == "xx" for s, _ in got)


def test_defined_cases(spark):
    good = "plain words that say something useful about the world and its many things today"
    rows = [(1, good, "en", 0), (1, good, "en", 0), (2, None, "en", 0), (3, "", None, 0), (None, good, None, 0), (4, "a b c d e " * 6, "en", 0), (5, "x\ny\nx\n\n \nx $ # " + good, "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = sorted(map(tuple, Q.judge_quality(docs, labels).drop("rejected_by").collect()), key=str)
    n, chars = len(good.split()), len(good.replace(" ", ""))
    assert got == sorted([
        (1, n, chars, 0, 0, 0, False, True), (1, n, chars, 0, 0, 0, False, True), (2, 0, 0, 0, 0, 0, True, False), (3, 0, 0, 0, 0, 0, True, False),
        (None, n, chars, 0, 0, 0, False, True), (4, 30, 30, 0, 0, 30, True, False), (5, n + 6, chars + 6, 2, 1, 0, False, True),
    ], key=str)
    assert Q.judge_quality(docs.limit(0), labels).collect() == []
    assert Q.judge_quality(docs, labels.limit(0)).count() == len(rows)
