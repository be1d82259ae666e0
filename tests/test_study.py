"""The study's workflow end to end on invented rows, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlab.operators.ols import simple_regressions
from pairlab.plans import study as S
from pairlab.sources import tables as T


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(11)
    stimuli, raw = [], []
    names = {1: ("alternating", "lent"), 3: ("non-alternating", "donated"), 5: ("alternating", "threw")}
    for item, (kind, verb) in names.items():
        for length in ("longIndefinite", "shortIndefinite"):
            for form, text in (("DOsentence", f"Ann {verb} a {length} man a pen."), ("PDsentence", f"Ann {verb} a pen to a {length} man.")):
                stimuli.append((item, False, kind, item * 2, length, "g", form, text))
    for r in range(9):
        for item, _, kind, _, length, group, form, text in stimuli:
            if rng.random() < 0.85:
                raw.append(("experimental_trial", "test", "Choice", str(rng.integers(-3, 4)), f"p{r}", text, form, kind, length, group, str(item)))
        for k in range(14):
            kind = "high" if k < 6 else "low"
            good = rng.random() < (0.4 if r == 0 else 0.97)
            value = 3 if (kind == "high") == good else -3
            raw.append(("filler", "test", "Choice", str(value), f"p{r}", f"filler {k}", "filler", kind, None, group, str(900 + k)))
        raw.append(("experimental_trial", "other", "Choice", "100", f"p{r}", "noise", "DOsentence", "alternating", None, "g", "1"))
        raw.append(("experimental_trial", "test", "Choice", "oops", f"p{r}", "bad text", "DOsentence", "alternating", None, "g", "1"))
    columns = ["Label", "PennElementName", "Parameter", "Value", "partid", "sentence", "construct", "classification", "IO", "group", "item"]
    pdf = pd.DataFrame(raw, columns=columns)
    pdf["counter"] = "0"
    frame = spark.createDataFrame(pdf)
    sentences = spark.createDataFrame(
        stimuli, "item int, plural boolean, classification string, frequency_rank int, recipient_id string, `group` string, sent_construct string, sentence string"
    )
    fillers = spark.createDataFrame([(900 + k,) for k in range(14)], "item int")
    verbs = spark.createDataFrame([(i, v) for i, (_, v) in names.items()], "verb_id int, verb string")
    return pdf, frame, sentences, fillers, verbs


def test_from_raw_ratings_to_regression(spark, made):
    pdf, raw, sentences, fillers, verbs = made
    choices = S.standardised_choices(raw)
    failed = S.raters_to_drop(choices, fillers)
    trials = S.experiment_rows(choices, failed)
    pairs = S.number_pairs(S.pairs_from_sentences(sentences))
    assert [r["sent_pair_id"] for r in pairs.orderBy("item", "recipient_id").collect()] == [1, 2, 3, 4, 5, 6]
    rated = S.with_verbs(S.with_pair_ids(trials, pairs, on_duplicate="error"), verbs)

    # The same in pandas.
    want = pdf[(pdf.PennElementName == "test") & (pdf.Parameter == "Choice")].copy()
    want["Value"] = pd.to_numeric(want.Value, errors="coerce")
    by = want.groupby("partid").Value
    want["z"] = (want.Value - by.transform("mean")) / by.transform("std")
    items = want[want.Label == "filler"].copy()
    items["ok"] = np.where(items.classification == "low", items.z < 0, items.z > 0)
    right = items.pivot_table(index="partid", columns="classification", values="ok", aggfunc="sum")
    bad = set(right.index[(right.high < 5) | (right.low < 7)])
    assert bad and {r["partid"] for r in failed.collect()} == bad
    want = want[(want.Label == "experimental_trial") & ~want.partid.isin(bad) & (want.sentence != "bad text")]
    assert rated.count() == len(want)
    means = want.pivot_table(index=["item", "IO"], columns="construct", values=["z", "Value"], aggfunc="mean")

    human = {(str(r["verb_id"]), r["IO"]): r for r in S.human_differences(rated).collect()}
    assert set(human) == set(means.index)
    for key, row in human.items():
        assert row["human_zdiff"] == pytest.approx(means.loc[key, ("z", "PDsentence")] - means.loc[key, ("z", "DOsentence")])
        assert row["human_sdiff"] == pytest.approx(means.loc[key, ("Value", "PDsentence")] - means.loc[key, ("Value", "DOsentence")])
    assert {r["verb"] for r in human.values()} == {"lent", "donated", "threw"}

    # Models: two replicas averaged, one public model; scores written and read per model.
    def scorer(seed):
        return lambda: lambda texts: [((len(t) * seed) % 17) / 3 for t in texts]

    from pairlab.sources.staging import new_folder

    folder = new_folder(spark, "study")
    for model, seed in (("100M_1", 5), ("100M_2", 7), ("gpt2", 11)):
        scored = S.score_pairs(pairs, scorer(seed))
        T.write_csv(scored.select("sent_pair_id", "DO_score", "PD_score", "diff"), f"{folder}/scored_{model}_x")
    scores = T.read_replicas(
        spark, f"{folder}/scored_*_x", "sent_pair_id bigint, DO_score double, PD_score double, diff double", r"scored_(.+)_x/"
    )
    merged = S.merge_replicas(scores, ["100M_1", "100M_2"], "GPT2_100M")
    got = {(r["sent_pair_id"], r["model"]): r for r in merged.collect()}
    assert len(got) == 12
    for p in pairs.collect():
        one, two = ([(len(p[c]) * s) % 17 / 3 for c in ("DOsentence", "PDsentence")] for s in (5, 7))
        row = got[(p["sent_pair_id"], "GPT2_100M")]
        assert row["DO_score"] == pytest.approx((one[0] + two[0]) / 2)
        assert row["diff"] == pytest.approx((one[1] - one[0] + two[1] - two[0]) / 2)
    with_scores = S.with_scores(rated, merged)
    assert with_scores.count() == 2 * rated.count()
    some = with_scores.where("model = 'gpt2'").first()
    assert some["score"] == pytest.approx((len(some["sentence"]) * 11) % 17 / 3)
    both = S.differences_by_model(rated, merged)
    assert both.count() == 12
    slopes = {r["model"]: r["slope"] for r in simple_regressions(both, "diff", "human_sdiff", ["model"]).collect()}
    frame = both.where("model = 'gpt2'").toPandas()
    assert slopes["gpt2"] == pytest.approx(np.polyfit(frame.human_sdiff, frame["diff"], 1)[0])
