"""Sources, joins, ratings, reshaping, numbering and quantiles on small invented rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlab.operators import joins as J
from pairlab.operators import plotdata as P
from pairlab.operators import ratings as R
from pairlab.operators import reshape as S
from pairlab.operators.numbering import number_as_read, number_rows
from pairlab.operators.quantiles import grouped_quantiles
from pairlab.operators.summaries import class_means, pair_means
from pairlab.sources import staging
from pairlab.sources import tables as T

# --- sources -----------------------------------------------------------------------


def test_csv_with_quotes_blanks_and_crlf(spark, tmp_path):
    file = tmp_path / "verbs.csv"
    file.write_bytes(
        b"classification,verb_id,frequency_rank,verb,def_1,def_2,indef_3,indef_4,something_5,extra theme,POSSESSIVE,plural recipent,notes\r\n"
        b'alternating,1,4,handed,the tea,the cup,a tea,a cup,something,,1,,"said ""here"", then left"\r\n'
        b"alternating,2,5,posted,the card,the box,a card,a box,something,a form,,,\r\n"
    )
    first, second = T.read_csv(spark, str(file), T.VERBS_SCHEMA).orderBy("verb_id").collect()
    assert first["notes"] == 'said "here", then left'
    assert first["extra theme"] is None and first["POSSESSIVE"] == 1
    assert second["notes"] is None and second["plural recipent"] is None


def test_unnamed_index_column(spark, tmp_path):
    file = tmp_path / "pairs.csv"
    file.write_text(
        '"","item","plural","classification","frequency_rank","recipient_id","DOsentence","PDsentence"\r\n'
        '"1",7,FALSE,"alternating",3,"shortIndefinite","Ann lent a man a pen.","Ann lent a pen to a man."\r\n'
    )
    row = T.read_csv(spark, str(file), T.PAIRS_SCHEMA).first()
    assert (row["row_id"], row["item"], row["plural"]) == (1, 7, False)


def test_csv_round_trip_with_index(spark):
    df = spark.createDataFrame([(3, 'a "b", c'), (1, "x\ny"), (2, None)], "k int, t string")
    path = staging.new_folder(spark, "test")
    T.write_csv(df, path, index_by=["k"])
    got = T.read_csv(spark, path, "row_id bigint, k int, t string", multi_line=True).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, "x\ny"), (2, 2, None), (3, 3, 'a "b", c')]


def test_replicas_are_tagged_from_their_path(spark, tmp_path):
    for model, score in (("100M_1", 1.5), ("gpt2", 2.5)):
        (tmp_path / f"scored_{model}_x.csv").write_text(f"pair,score\n1,{score}\n")
    got = T.read_replicas(spark, f"{tmp_path}/scored_*_x.csv", "pair int, score double", r"scored_(.+)_x\.csv")
    assert {(r["model"], r["score"]) for r in got.collect()} == {("100M_1", 1.5), ("gpt2", 2.5)}


def test_stage_returns_the_written_table(spark):
    df = spark.range(10).withColumn("r", F.rand())
    staged = staging.stage(df)
    assert staged.collect() == staged.collect()
    assert staging.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_standardise(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", None), ("b", 5.0), ("b", 5.0), ("c", 1.0), (None, 2.0), (None, 4.0)],
        "partid string, value double",
    )
    got = sorted(((r["partid"] or "", r["value"] or 0, r["zscores"]) for r in R.standardise(df, ["partid"], "value").collect()))
    half = 1 / np.sqrt(2)
    assert got == [
        ("", 2.0, pytest.approx(-half)), ("", 4.0, pytest.approx(half)),
        ("a", 0, None), ("a", 1.0, -1.0), ("a", 2.0, 0.0), ("a", 3.0, 1.0),
        ("b", 5.0, None), ("b", 5.0, None), ("c", 1.0, None),
    ]


def test_fillers_count_towards_the_rater(spark):
    df = spark.createDataFrame([("a", "trial", 1.0), ("a", "trial", 3.0), ("a", "high", 5.0)], "partid string, kind string, value double")
    z = R.standardise(df, ["partid"], "value").where("kind = 'trial'")
    assert sorted(r["zscores"] for r in z.collect()) == [-1.0, 0.0]


def test_attention_checks(spark):
    rows = [("good", "high", 1)] * 5 + [("good", "low", 1)] * 7
    rows += [("bad_high", "high", 1)] * 4 + [("bad_high", "low", 1)] * 9
    rows += [("bad_low", "high", 1)] * 6 + [("bad_low", "low", 1)] * 6 + [("bad_low", "low", 0)] * 3
    rows += [("only_high", "high", 1)] * 8
    checks = spark.createDataFrame(rows, "partid string, classification string, correct int")
    failed = R.failed_raters(checks)
    assert sorted(r["partid"] for r in failed.collect()) == ["bad_high", "bad_low"]
    kept = J.drop_matching(checks, failed, ["partid"])
    assert {r["partid"] for r in kept.select("partid").distinct().collect()} == {"good", "only_high"}
    # Asking one row to be high and low at once keeps nothing.
    both = (F.col("classification") == "high") & (F.col("classification") == "low")
    assert checks.where(both).count() == 0


def test_two_level_means_weigh_pairs_alike(spark):
    rows = [(1, "DOsentence", 1.0), (1, "PDsentence", 2.0), (1, "PDsentence", 4.0), (2, "DOsentence", 5.0),
            (2, "PDsentence", 5.0), (3, "DOsentence", 9.0), (4, "DOsentence", None), (4, "PDsentence", 1.0)]
    df = spark.createDataFrame(rows, "pair int, construct string, value double").withColumn("zscores", F.col("value"))
    pairs = pair_means(df, ["pair"], ["DOsentence", "PDsentence"])
    got = {r["pair"]: r["human_sdiff"] for r in pairs.collect()}
    assert got == {1: 2.0, 2: 0.0, 3: None, 4: None}
    summary = class_means(pairs.withColumn("k", F.lit(1)), ["k"]).first()
    assert summary["mean_diff"] == 1.0 and summary["mean_DO"] == 5.0


def test_above_overall_mean(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,), (None,)], "x double")
    assert [r["x"] for r in R.above_overall_mean(df, "x").collect()] == [6.0]


# --- joins -------------------------------------------------------------------------


def test_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    right = spark.createDataFrame([(None, 10), (2, 20)], "k int, w int")
    assert [r["v"] for r in J.keep_matching(left, right, ["k"]).collect()] == ["b"]
    assert J.keep_matching(left, right, ["k"], null_keys_match=False).count() == 0
    assert [r["v"] for r in J.drop_matching(left, right, ["k"]).collect()] == ["a"]
    attached = {(r["v"], r["w"]) for r in J.attach(left, right, ["k"]).collect()}
    assert attached == {("a", None), ("b", 10)}


def test_text_match_fans_out_or_fails(spark):
    said = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, sentence string")
    listed = spark.createDataFrame([("x", 10), ("x", 11), ("y", 12)], "sentence string, pair int")
    got = sorted((r["id"], r["pair"]) for r in J.match_text(said, listed).collect())
    assert got == [(1, 10), (1, 11), (2, 12)]
    with pytest.raises(Exception, match="more than once"):
        J.match_text(said, listed, on_duplicate="error").collect()
    once = listed.where("pair <> 11")
    assert J.match_text(said, once, on_duplicate="error").count() == 2


def test_replicas_line_up_like_inner_joins(spark):
    scores = spark.createDataFrame([(1, "A", 1.0), (1, "B", 2.0), (2, "A", 3.0)], "pair int, model string, s double")
    got = J.line_up_replicas(scores, ["pair"], "model", ["A", "B"], ["s"]).collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 2.0)]


# --- reshaping ---------------------------------------------------------------------


def test_wide_and_long(spark):
    df = spark.createDataFrame([(1, "D", "d1", 1.0), (1, "P", "p1", 2.0), (2, "D", "d2", 3.0)], "k int, c string, t string, x double")
    texts = S.to_wide(df, ["k"], "c", ["D", "P"], {"t": S.only_value}, "{level}")
    assert {tuple(r) for r in texts.collect()} == {(1, "d1", "p1"), (2, "d2", None)}
    two = S.to_wide(df, ["k"], "c", ["D", "P"], {"t": S.first_value, "x": S.mean_value})
    assert two.columns == ["k", "t_D", "t_P", "x_D", "x_P"]
    long = S.to_long(texts, ["k"], ["D", "P"], "c", "t")
    assert {tuple(r) for r in long.collect()} == {(1, "D", "d1"), (1, "P", "p1"), (2, "D", "d2"), (2, "P", None)}
    grouped = S.to_long_grouped(two, ["k"], {"D": ["t_D", "x_D"], "P": ["t_P", "x_P"]}, "c", ["t", "x"])
    assert {tuple(r) for r in grouped.collect()} == {(1, "D", "d1", 1.0), (1, "P", "p1", 2.0), (2, "D", "d2", 3.0), (2, "P", None, None)}
    assert S.relocate(two, "x_D", after="k").columns == ["k", "x_D", "t_D", "t_P", "x_P"]
    with pytest.raises(Exception, match="more than one row"):
        S.to_wide(df.unionAll(df), ["k"], "c", ["D", "P"], {"t": S.only_value}).collect()


# --- numbering and quantiles -------------------------------------------------------


def test_row_numbers_are_contiguous_and_ordered(spark):
    df = spark.range(0, 5000, 1, 13).select(((F.col("id") * 7919) % 5000).alias("k"))
    got = number_rows(df, ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 5001))
    assert number_rows(df.where("k < 0"), ["k"], "n").count() == 0
    first = number_rows(df, [F.col("k").desc()], "n").where("n = 1").first()
    assert first["k"] == 4999


@pytest.mark.parametrize("bins", [5, 64])
def test_quantiles_of_large_groups_match_brute_force(spark, bins):
    rng = np.random.default_rng(0)
    hot = np.concatenate([np.full(400, 3.0), rng.normal(0, 1, 300), rng.normal(0, 1e-9, 50), [1e300, -1e300]])
    pdf = pd.concat([
        pd.DataFrame({"g": "hot", "x": hot}),
        pd.DataFrame({"g": "flat", "x": 2.0}, index=range(60)),
        pd.DataFrame({"g": None, "x": rng.exponential(5, 101)}),
        pd.DataFrame({"g": "small", "x": [4.0, 1.0, 2.0, 3.0]}),
    ])
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    names = [f"q{i}" for i in range(len(probabilities))]
    df = spark.createDataFrame(pdf).repartition(7)
    got = {r["g"]: [r[n] for n in names] for r in grouped_quantiles(df, ["g"], "x", probabilities, names, bins=bins).collect()}
    for g in ("hot", "flat", None, "small"):
        x = pdf.x[pdf.g.isna() if g is None else pdf.g == g].to_numpy()
        assert got[g] == pytest.approx(np.quantile(x, probabilities), rel=1e-12)


def test_whole_table_quantiles(spark):
    x = np.random.default_rng(2).normal(0, 1, 500)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    row = grouped_quantiles(df, [], "x", (0.25, 0.9), ["a", "b"]).collect()
    assert [tuple(r) for r in row] == [pytest.approx(tuple(np.quantile(x, (0.25, 0.9))))]


def test_quantiles_end_on_nan_infinities_and_tiny_numbers(spark):
    inf, tiny = float("inf"), 5e-324
    rows = [("a", v) for v in (-inf, -inf, 1.0, 2.0, 3.0, 1e308, -1e308, float("nan"), None, inf)]
    rows += [("b", k * tiny) for k in range(5)] + [("c", inf)] * 3 + [("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in grouped_quantiles(df, ["g"], "x", (0, 0.5, 1), ["lo", "mid", "hi"], bins=2).collect()}
    assert got == {"a": (-inf, 1.5, inf), "b": (0.0, 2 * tiny, 4 * tiny), "c": (inf, inf, inf)}


def test_hot_group_survives_without_broadcast(spark):
    # A third of all rows in one group, and every join as a shuffle join.
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"partid": np.where(rng.random(6000) < 1 / 3, 0, rng.integers(1, 50, 6000)), "value": rng.normal(5, 2, 6000)})
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = R.standardise(spark.createDataFrame(pdf), ["partid"], "value").toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(got) == 6000
    hot = pdf[pdf.partid == 0].value
    want = np.sort((hot - hot.mean()) / hot.std())
    assert np.sort(got[got.partid == 0].zscores) == pytest.approx(want)


# --- plot data ---------------------------------------------------------------------


def test_box(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 30.0, -25.0]
    df = spark.createDataFrame([("a", v) for v in x] + [("a", None)], "g string, x double")
    box = P.boxes(df, ["g"], "x").first()
    assert (box["lower"], box["middle"], box["upper"]) == (2.0, 4.0, 6.0)
    assert (box["whisker_low"], box["whisker_high"], box["n_outliers"]) == (1.0, 7.0, 2)
    assert sorted(r["x"] for r in P.box_outliers(df, ["g"], "x").collect()) == [-25.0, 30.0]


def test_histogram_bins_are_centred_and_right_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 0.5, 0.6, 29, 28.5)], "x double")
    got = {r["bin"]: r["n"] for r in P.histogram(df, "x").collect()}
    assert got == {**dict.fromkeys(range(30), 0), 0: 3, 1: 1, 28: 1, 29: 1}
    assert P.histogram(df.limit(0), "x").collect() == []
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [(r["bin"], r["n"]) for r in P.histogram(flat, "x").collect()] == [(0, 2)]


def test_smooth_band(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 12)
    y = 2 + 0.5 * x + rng.normal(0, 1, 12)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x, "y": y}))
    got = P.linear_smooth(df, ["g"]).orderBy("step").collect()
    assert len(got) == 80 and got[0]["x"] == x.min() and got[-1]["x"] == pytest.approx(x.max())
    slope, intercept = np.polyfit(x, y, 1)
    s = np.sqrt(((y - intercept - slope * x) ** 2).sum() / 10)
    at = got[40]
    se = s * np.sqrt(1 / 12 + (at["x"] - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
    assert at["y"] == pytest.approx(intercept + slope * at["x"])
    assert at["se"] == pytest.approx(se)
    # 2.228 is the table value for 10 degrees of freedom.
    assert (at["ymax"] - at["y"]) / se == pytest.approx(2.228, abs=1e-3)
    two = P.linear_smooth(df.limit(2), ["g"]).first()
    assert two["y"] is not None and two["se"] is None and two["ymin"] is None


def test_csv_is_read_by_name_and_missing_values_are_null(spark, tmp_path):
    (tmp_path / "one.csv").write_text('b,a,c\nNA,1,NaN\n"x, ""y""",,2.5\n')
    got = T.read_csv(spark, str(tmp_path / "one.csv"), "a INT, b STRING, c DOUBLE").collect()
    assert [tuple(r) for r in got] == [(1, None, None), (None, 'x, "y"', 2.5)]
    with pytest.raises(ValueError, match="columns missing"):
        T.read_csv(spark, str(tmp_path / "one.csv"), "a INT, other STRING")
    (tmp_path / "two.csv").write_text("a,b,c\nseven,u,1\n")
    with pytest.raises(Exception, match="seven"):
        T.read_csv(spark, str(tmp_path / "two.csv"), "a INT, b STRING, c DOUBLE").collect()
    assert T.read_csv(spark, str(tmp_path / "two.csv"), "a INT", strict=False).first()["a"] is None


def test_a_second_row_of_one_replica_fails(spark):
    scores = spark.createDataFrame([(1, "A", 1.0), (1, "A", 9.0), (1, "B", 2.0)], "pair int, model string, s double")
    with pytest.raises(Exception, match="more than one row"):
        J.line_up_replicas(scores, ["pair"], "model", ["A", "B"], ["s"]).collect()


def test_a_rater_who_answers_everything_alike_fails(spark):
    rows = [("flat", k, 3.0) for k in ["high"] * 6 + ["low"] * 8] + [("good", "high", 5.0)] * 6 + [("good", "low", -5.0)] * 8 + [("unseen", "other", 1.0)]
    checks = R.flag_correct(R.standardise(spark.createDataFrame(rows, "partid string, classification string, value double"), ["partid"], "value"))
    assert [tuple(r) for r in R.failed_raters(checks).collect()] == [("flat", 0, 0)]


def test_unlisted_levels_are_missing(spark):
    from pairlab.functions.design import factor

    df = spark.createDataFrame([("a",), ("b",), ("zzz",), (None,)], "k string")
    assert [r[0] for r in df.select(factor("k", ["a", "b"])[0][1].alias("v")).collect()] == [0.0, 1.0, None, None]


def test_staged_tables_are_released(spark):
    import os

    from pairlab.sources.staging import release, shared_dir, stage

    stage(spark.range(3), "left-behind").count()
    release(spark)
    assert not [f for f in os.listdir(shared_dir(spark)) if f.startswith("left-behind")]


def test_rows_of_several_files_and_splits_are_numbered_as_written(spark, tmp_path):
    rows = [(k, f"text {k * 7919 % 1000}") for k in range(6000)]
    for part in range(3):
        lines = ["k,t", *[f'{k},"{t}"' for k, t in rows[part * 2000: (part + 1) * 2000]]]
        (tmp_path / f"part-{part}.csv").write_text("\n".join(lines) + "\n")
    for size in ("16k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = T.read_csv(spark, str(tmp_path), "k INT, t STRING")
            parts = df.rdd.getNumPartitions()
            got = number_as_read(df).orderBy("row_id").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(r["k"], r["t"], r["row_id"]) for r in got] == [(k, t, k + 1) for k, t in rows]
        assert size != "16k" or parts > 3
    assert number_as_read(T.read_csv(spark, str(tmp_path), "k INT, t STRING").where("k < 0")).collect() == []


def test_an_audited_read_says_what_it_rejected(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v,t\n1,2.5,x\ntwo,NA,\n3,NaN,z\n")
    (tmp_path / "b.csv").write_text("k,v,t\n4,4.0.1,w\n")
    kept, rejected, counts = T.read_csv_audited(spark, str(tmp_path), "k INT, v DOUBLE, t STRING")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, 2.5, "x"), (None, None, None), (3, None, "z"), (4, None, "w")], key=str)
    got = {(r["file"].rsplit("/", 1)[-1], r["row"], r["column"], r["cell"], r["reason"]) for r in rejected.collect()}
    assert got == {("a.csv", 2, "k", "two", "not int"), ("b.csv", 1, "v", "4.0.1", "not double")}
    assert counts == {("k", "missing"): 0, ("k", "not int"): 1, ("v", "missing"): 2, ("v", "not double"): 1, ("t", "missing"): 1, ("t", "not string"): 0}


def test_replicas_whose_headers_differ_are_one_table(spark, tmp_path):
    (tmp_path / "scored_m1_x.csv").write_text("pair,score,note\n1,0.5,a\n2,0.25,b\n")
    (tmp_path / "scored_m2_x.csv").write_text("score,pair,note\n1.5,1,c\n")
    (tmp_path / "scored_m3_x.csv").write_text("pair,extra,note\n7,zzz,d\n")
    (tmp_path / "scored_m4_x.csv").write_text("pair,score,note\n9,9.0,e\n")
    got = T.read_replicas(spark, f"{tmp_path}/scored_*_x.csv", "pair INT, score DOUBLE, note STRING", r"scored_(.+)_x\.csv")
    assert got.columns == ["pair", "score", "note", "model"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 0.5, "a", "m1"), (2, 0.25, "b", "m1"), (1, 1.5, "c", "m2"), (7, None, "d", "m3"), (9, 9.0, "e", "m4")], key=str)
    with pytest.raises(ValueError, match="missing in every file"):
        T.read_replicas(spark, f"{tmp_path}/scored_*_x.csv", "pair INT, lost DOUBLE", r"scored_(.+)_x\.csv")
