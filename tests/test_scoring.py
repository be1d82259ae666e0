"""Sentence scoring on small texts."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlab.operators import scoring as C


@pytest.fixture
def lengths():
    return lambda: lambda texts: [float(len(t)) for t in texts]


def test_batch_scores(spark, lengths):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, t string").repartition(3)
    got = {r["id"]: r["score"] for r in C.score_texts(df, "t", lengths).collect()}
    assert got == {1: 3.0, 2: None, 3: 0.0}
    empty = C.score_texts(df.where("id > 9"), "t", lengths)
    assert empty.count() == 0 and empty.columns == ["id", "t", "score"]


def test_pair_scores_in_one_pass(spark, lengths):
    df = spark.createDataFrame([(1, "ab", "abcd"), (2, None, "x")], "id int, d string, p string")
    got = {r["id"]: (r["d_score"], r["p_score"], r["diff"]) for r in C.pair_scores(df, ["id"], ["d", "p"], lengths).collect()}
    assert got == {1: (2.0, 4.0, 2.0), 2: (None, 1.0, None)}


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Ann, gave Bob-the pen!"), (2, "")], "id int, t string")
    rows = C.token_table(df, ["id"], "t").orderBy("id", "pos").collect()
    assert [r["token"] for r in rows if r["id"] == 1] == ["<s>", "ann", "gave", "bob", "the", "pen", "</s>"]
    assert [r["token"] for r in rows if r["id"] == 2] == ["<s>", "</s>"]


def words(text):
    out, word = [], ""
    for ch in text.lower() + " ":
        if "a" <= ch <= "z":
            word += ch
        elif word:
            out.append(word)
            word = ""
    return ["<s>", *out, "</s>"]


def test_bigram_model_against_brute_force(spark):
    train = ["the man gave the dog a bone", "the dog ate", "", "A man, a dog."]
    probe = ["the man ate a fish", "zzz", ""]
    pairs, before = Counter(), Counter()
    for t in train:
        w = words(t)
        pairs.update(zip(w, w[1:]))
        before.update(w[:-1])
    size = len({b for _, b in pairs})
    model = C.BigramModel.train(spark.createDataFrame([(t,) for t in train], "t string"), "t")
    df = spark.createDataFrame(list(enumerate(probe)), "id int, t string")
    tokens = model.log_probs(df, ["id"], "t")
    mean = {r["id"]: r["score"] for r in C.reduce_scores(tokens, ["id"], C.mean_log_prob).collect()}
    lme = {r["id"]: r["score"] for r in C.reduce_scores(tokens, ["id"], C.log_mean_exp).collect()}
    for i, t in enumerate(probe):
        w = words(t)
        lp = [math.log((pairs[p] + 1) / (before[p[0]] + size)) for p in zip(w, w[1:])]
        assert mean[i] == pytest.approx(np.mean(lp))
        assert lme[i] == pytest.approx(math.log(np.exp(lp).sum()) - math.log(len(lp)))


@pytest.mark.parametrize("shift", [0.0, -900.0, -2000.0, -1e6])
def test_log_mean_exp_does_not_underflow(spark, shift):
    lp = [-1.0 + shift, -2.5 + shift, -0.3 + shift]
    df = spark.createDataFrame([(v, 1) for v in lp], "logprob double, n int")
    got = df.agg(C.log_mean_exp().alias("v")).first()["v"]
    top = max(lp)
    assert got == pytest.approx(top + math.log(sum(math.exp(v - top) for v in lp)) - math.log(3), abs=1e-9)


def test_log_softmax(spark):
    logits = [1000.0, 999.0, -1000.0]
    df = spark.createDataFrame([(logits, 1), (logits, 7)], "l array<double>, i int")
    got = [r["v"] for r in df.select(C.log_softmax_at("l", "i").alias("v")).collect()]
    assert got[0] == pytest.approx(-1 - math.log(1 + math.exp(-1)))
    assert got[1] is None


def test_alignment_and_mask(spark):
    df = spark.createDataFrame([([5, 6, 7], [1, 0, 1])], "ids array<int>, m array<int>")
    row = df.select(
        C.shifted_targets("ids").alias("next"), C.shifted_targets("ids", 0).alias("same"), C.keep_unmasked("ids", "m").alias("kept")
    ).first()
    assert (row["next"], row["same"], row["kept"]) == ([6, 7], [5, 6, 7], [5, 7])


def test_letter_model(spark):
    df = spark.createDataFrame([("ab a",), ("ba",), (None,)], "t string")
    model = C.train_letter_model(df, "t")
    assert model[97, 98] == pytest.approx(math.log(2 / 257))  # a to b: once of one step from a
    scorer = C.letter_scorer(model)()
    assert scorer(pd.Series(["ab", "", "ba"])).tolist()[::2] == pytest.approx([model[97, 98], model[98, 97]])
    assert math.isnan(scorer(pd.Series(["a"]))[0])


def test_keys_beyond_doubles_survive_beside_nulls(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, "ab", "ba"), (None, None, "a"), (3, "b", None)], "id long, a string, b string")
    make = C.letter_scorer(np.zeros((C.SYMBOLS, C.SYMBOLS)))
    assert {r["id"] for r in C.score_texts(df, "a", make).collect()} == {big, None, 3}
    assert {r["id"] for r in C.pair_scores(df, ["id"], ["a", "b"], make).collect()} == {big, None, 3}


def test_letters_are_met_some_at_a_time(spark, monkeypatch):
    texts = ["", "a", "Äb c" * 40, "ab", "xyz", "", "q" * 13, "ba" * 7]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").coalesce(1)
    model = C.train_letter_model(df, "t")
    assert np.array_equal(C.train_letter_model(df, "t", 7), model)
    met, steps = [], C._letter_steps
    monkeypatch.setattr(C, "_letter_steps", lambda some: met.append(sum(map(len, some))) or steps(some))
    low = C.letter_scorer(model, 7)()(pd.Series(texts))
    assert max(met) == 7
    want = [np.mean([model[ord(a) % 256, ord(b) % 256] for a, b in zip(t.lower(), t.lower()[1:])]) if len(t) > 1 else math.nan for t in texts]
    assert low == pytest.approx(want, nan_ok=True, rel=1e-12)
    assert np.isnan(C.letter_scorer(model)()(pd.Series(["", ""]))).all()


def test_own_texts_travel_without_their_words(spark):
    texts = [(1, "the man gave the dog a bone"), (2, "the dog ate"), (2, "the dog"), (None, "a man"), (3, ""), (4, None)]
    df = spark.createDataFrame(texts, "id int, t string")
    tokens = C.BigramModel.score_own(df, ["id"], "t")
    assert tokens.columns == ["id", "n", "logprob"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.BigramModel.score_own(df, ["id"], "t")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(pair" in plan and "hashpartitioning(prev#" in plan and "token#" not in plan.split("hashpartitioning(pair")[0]
    pairs, before = Counter(), Counter()
    for _, t in texts[:-1]:
        w = words(t)
        pairs.update(zip(w, w[1:]))
        before.update(w[:-1])
    size = len({b for _, b in pairs})
    lp = {}
    for i, t in texts[:-1]:
        w = words(t)
        lp.setdefault(i, []).extend(math.log((pairs[p] + 1) / (before[p[0]] + size)) for p in zip(w, w[1:]))
    got = {r["id"]: r["score"] for r in C.reduce_scores(tokens, ["id"], C.mean_log_prob).collect()}
    assert got == pytest.approx({i: np.mean(v) for i, v in lp.items()})


def test_own_places_travel_by_digest(spark):
    texts = ["the man gave the dog a bone", "the dog ate", "", None, "the dog ate", "A man, a dog. The man"]
    df = spark.createDataFrame([(i % 5 if i else None, t) for i, t in enumerate(texts)], "id int, t string")
    model = C.BigramModel.train(df, "t")
    want = sorted(map(tuple, model.placed_log_probs(df, ["id"], "t").na.fill(-1).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = model.placed_log_probs(df, ["id"], "t", own=True)
        plan = own._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, own.na.fill(-1).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and "hashpartitioning(pair" in plan and "hashpartitioning(prev" not in plan
