"""Registered queries: sources, projections, filters, joins, summaries, windows, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.functions import exprs as X
from pairlab.operators import joins as J
from pairlab.operators import ratings as R
from pairlab.operators import reshape as S
from pairlab.operators import summaries as A
from pairlab.operators.audit import cast_audited
from pairlab.operators.numbering import number_as_read, number_rows
from pairlab.plans import standin as V
from pairlab.plans.registry import query, rounded
from pairlab.sources.staging import new_folder, stage
from pairlab.sources.tables import read_csv, read_replicas, write_csv

# --- sources and sinks -------------------------------------------------------------


@query("scan_csv", """
select c_custkey, c_name || ' says "hi", twice' as quoted, c_nationkey, c_acctbal, c_mktsegment
from customer""")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = V.table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(' says "hi", twice')).alias("quoted"),
        "c_nationkey", "c_acctbal", "c_mktsegment",
    )
    path = new_folder(spark, "scan-csv")
    write_csv(customer, path)
    return read_csv(spark, path, customer.schema)


@query("scan_replicas", f"""
with {V.SCORES_SQL}
select sent_pair_id, construct, round(score, 6) as score, model from scores""")
def scan_replicas(spark, sf_dir):
    scores = V.scores(spark, sf_dir).select("model", "sent_pair_id", "construct", "score")
    path = new_folder(spark, "replicas")
    write_csv(scores, path, partition_by=["model"])
    found = read_replicas(
        spark, f"{path}/model=*", "sent_pair_id BIGINT, construct STRING, score DOUBLE", r"model=([^/]+)/"
    )
    return rounded(found, "score")


@query("sink_csv", """
select row_number() over (order by o_orderkey) as row_id,
       o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
from orders""")
def sink_csv(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    path = new_folder(spark, "sink-csv")
    write_csv(orders, path, index_by=["o_orderkey"])
    return read_csv(
        spark, path,
        "row_id BIGINT, o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
        "o_totalprice DOUBLE, o_orderpriority STRING",
    )


@query("stage_parquet", f"""
with {V.RATINGS_SQL}
select partid, construct, count(*) as n, round(avg(value), 6) as mean_value
from ratings group by all""")
def stage_parquet(spark, sf_dir):
    cleaned = V.ratings(spark, sf_dir).select("partid", "sent_pair_id", "construct", "value")
    means = stage(cleaned, "cleaned").groupBy("partid", "construct").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")
    )
    return rounded(means, "mean_value")


# --- projections and scalar expressions --------------------------------------------


@query("proj_select", f"with {V.PAIRS_SQL} select sent_pair_id, classification, frequency_rank from pairs")
def proj_select(spark, sf_dir):
    return V.pairs(spark, sf_dir).select("sent_pair_id", "classification", "frequency_rank")


@query("proj_drop", f"with {V.PAIRS_SQL} select sent_pair_id, verb_id, classification from pairs")
def proj_drop(spark, sf_dir):
    return V.pairs(spark, sf_dir).drop("io", "frequency_rank")


@query("proj_rename", f"""
with {V.SCORE_PAIRS_SQL}
select sent_pair_id, round(any_value("DO_score") filter (where model = 'A'), 6) as "DO_score_A", round(any_value("PD_score") filter (where model = 'A'), 6) as "PD_score_A",
       round(any_value("DO_score") filter (where model = 'N'), 6) as "DO_score_N", round(any_value("PD_score") filter (where model = 'N'), 6) as "PD_score_N",
       round(any_value("DO_score") filter (where model = 'R'), 6) as "DO_score_R", round(any_value("PD_score") filter (where model = 'R'), 6) as "PD_score_R"
from score_pairs group by sent_pair_id""")
def proj_rename(spark, sf_dir):
    # Every model's two scores under names with the model as suffix, side by side.
    wide = S.to_wide(V.score_pairs(spark, sf_dir), ["sent_pair_id"], "model", V.MODELS, {"DO_score": S.only_value, "PD_score": S.only_value}, "{level}_{value}")
    renamed = wide.withColumnsRenamed({f"{m}_{c}": f"{c}_{m}" for m in V.MODELS for c in ("DO_score", "PD_score")})
    return rounded(renamed, *[c for c in renamed.columns if c != "sent_pair_id"])


@query("proj_relocate", f"with {V.PAIRS_SQL} select io, sent_pair_id, frequency_rank, verb_id, classification from pairs")
def proj_relocate(spark, sf_dir):
    return S.relocate(S.relocate(V.pairs(spark, sf_dir), "io"), "frequency_rank", after="sent_pair_id")


@query("expr_pair_diff", f"""
with {V.SCORE_PAIRS_SQL}
select model, sent_pair_id, round("PD_score" - "DO_score", 6) as diff from score_pairs""")
def expr_pair_diff(spark, sf_dir):
    scored = V.score_pairs(spark, sf_dir)
    return rounded(scored.select("model", "sent_pair_id", (F.col("PD_score") - F.col("DO_score")).alias("diff")), "diff")


@query("expr_negate", f"with {V.PAIRS_SQL} select sent_pair_id, -frequency_rank as x from pairs")
def expr_negate(spark, sf_dir):
    return V.pairs(spark, sf_dir).select("sent_pair_id", (-F.col("frequency_rank")).alias("x"))


_DIRTY = "case when event_id % 7 = 0 then 'n/a' when event_id % 7 = 1 then 'NaN' when event_id % 7 = 2 then null else cast(value as varchar) end"


@query("cast_lenient", f"""
with dirty as (select event_id, {_DIRTY} as answer from events)
select event_id, case when not isnan(try_cast(answer as double)) then try_cast(answer as double) end as value
from dirty""")
def cast_lenient(spark, sf_dir):
    seventh = F.col("event_id") % 7
    answer = (
        F.when(seventh == 0, "n/a").when(seventh == 1, "NaN").when(seventh == 2, None)
        .otherwise(F.col("value").cast("string"))
    )
    dirty = V.table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))
    return dirty.select("event_id", X.number("answer").alias("value"))


@query("cast_key", f"""
with {V.RATINGS_SQL}
select cast(partid as varchar) as partid, cast(verb_id as varchar) as verb_id, count(*) as n
from ratings group by all""")
def cast_key(spark, sf_dir):
    keys = V.ratings(spark, sf_dir).select(F.col("partid").cast("string"), F.col("verb_id").cast("string"))
    return keys.groupBy("partid", "verb_id").agg(F.count(F.lit(1)).alias("n"))


@query("factor_levels", f"""
with {V.SCORES_SQL}
select model, case model when 'R' then 1 when 'A' then 2 end as level_ord,
       count(*) as n, round(avg(score), 6) as mean_score
from scores group by all""")
def factor_levels(spark, sf_dir):
    placed = V.scores(spark, sf_dir).withColumn("level_ord", X.level_position("model", ["R", "A"]))
    counted = placed.groupBy("model", "level_ord").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    return rounded(counted, "mean_score")


@query("expr_case_pick", f"""
with {V.SCORE_PAIRS_SQL}, cells as (
  select distinct sent_pair_id, construct from ratings)
select c.sent_pair_id, c.construct, s.model,
       round(case c.construct when 'PDsentence' then "PD_score" when 'DOsentence' then "DO_score" end, 6) as rel_score
from cells c left join score_pairs s on c.sent_pair_id = s.sent_pair_id""")
def expr_case_pick(spark, sf_dir):
    cells = V.ratings(spark, sf_dir).select("sent_pair_id", "construct").distinct()
    scored = V.score_pairs(spark, sf_dir).select("sent_pair_id", "model", "DO_score", "PD_score")
    joined = J.attach(cells, scored, ["sent_pair_id"], null_keys_match=False)
    picked = X.choose("construct", {"PDsentence": "PD_score", "DOsentence": "DO_score"})
    return rounded(joined.select("sent_pair_id", "construct", "model", picked.alias("rel_score")), "rel_score")


# Standardised values of trials and attention items.
_Z_SQL = V.CHECKS_SQL + """, z as (
  select *, (value - avg(value) over w) / nullif(stddev_samp(value) over w, 0) as zscores
  from checks window w as (partition by partid)), flagged as (
  select *, case when zscores is null then null
                 when classification = 'low' then cast(zscores < 0 as int)
                 else cast(zscores > 0 as int) end as correct
  from z where classification <> 'trial')"""


def _standardised_checks(spark, sf_dir):
    return R.standardise(V.checks(spark, sf_dir), ["partid"], "value")


def _flagged(spark, sf_dir):
    return R.flag_correct(_standardised_checks(spark, sf_dir).where(F.col("classification") != "trial"))


@query("expr_correct_flag", f"with {_Z_SQL} select partid, item, classification, correct from flagged")
def expr_correct_flag(spark, sf_dir):
    return _flagged(spark, sf_dir).select("partid", "item", "classification", "correct")


@query("expr_recode", f"""
with {V.PAIRS_SQL}
select sent_pair_id, case io when 'longIndefinite' then 'Long' else io end as io from pairs""")
def expr_recode(spark, sf_dir):
    return V.pairs(spark, sf_dir).select("sent_pair_id", X.recode("io", {"longIndefinite": "Long"}).alias("io"))


def _models_wide(spark, sf_dir, keys=("sent_pair_id",)):
    """One row per pair with a difference column per model."""
    return V.model_differences(spark, sf_dir).select(*keys, *[f"diff_{m}" for m in V.MODELS])


_WIDE_SQL = V.SCORE_PAIRS_SQL + """, wide as (
  select sent_pair_id, verb_id, classification, io, frequency_rank,
         max("PD_score" - "DO_score") filter (where model = 'A') as "diff_A",
         max("PD_score" - "DO_score") filter (where model = 'N') as "diff_N",
         max("PD_score" - "DO_score") filter (where model = 'R') as "diff_R"
  from score_pairs group by all)"""


@query("expr_row_mean", f"""
with {_WIDE_SQL}
select sent_pair_id,
       round((coalesce("diff_A", 0) + coalesce("diff_N", 0) + coalesce("diff_R", 0))
             / nullif(("diff_A" is not null)::int + ("diff_N" is not null)::int + ("diff_R" is not null)::int, 0), 6)
         as diff_avg
from wide""")
def expr_row_mean(spark, sf_dir):
    wide = _models_wide(spark, sf_dir)
    return rounded(wide.select("sent_pair_id", X.row_mean(["diff_A", "diff_N", "diff_R"]).alias("diff_avg")), "diff_avg")


# A model code for each order priority; the last is unknown on purpose.
_CODES = {"1-URGENT": "gpt2", "2-HIGH": "gpt2m", "3-MEDIUM": "gpt2l", "4-NOT SPECIFIED": "100M_1"}
_UNKNOWN_CODE = "gptl"


@query("expr_model_name", """
with coded as (
  select case o_orderpriority when '1-URGENT' then 'gpt2' when '2-HIGH' then 'gpt2m'
           when '3-MEDIUM' then 'gpt2l' when '4-NOT SPECIFIED' then '100M_1' else 'gptl' end as code
  from orders)
select code, split_part(code, '_', 1) as family,
       case when code = 'gpt2' then 'gpt2' when code = 'gpt2m' then 'gpt2-medium'
            when code = 'gpt2l' then 'gpt2-large' when code = 'gpt2xl' then 'gpt2-xl'
            when split_part(code, '_', 1) = '100M' then 'models/' || code || '/checkpoint-166800' end as model_name,
       count(*) as n
from coded group by all""")
def expr_model_name(spark, sf_dir):
    code = F.coalesce(X.choose("o_orderpriority", {k: F.lit(v) for k, v in _CODES.items()}), F.lit(_UNKNOWN_CODE))
    coded = V.table(spark, sf_dir, "orders").groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return coded.select(
        "code", X.model_family("code").alias("family"), X.model_name("code", "166800").alias("model_name"), "n"
    )


# --- filters -----------------------------------------------------------------------


@query("filter_conj", """
select l_orderkey, l_linenumber, l_quantity from lineitem where l_linestatus = 'F' and l_returnflag = 'R'""")
def filter_conj(spark, sf_dir):
    lineitem = V.table(spark, sf_dir, "lineitem")
    kept = lineitem.where((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"))
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_eq", f"with {V.CHECKS_SQL} select partid, item, value from checks where classification = 'trial'")
def filter_eq(spark, sf_dir):
    return V.checks(spark, sf_dir).where(F.col("classification") == "trial").select("partid", "item", "value")


@query("filter_mixed", f"""
with {V.CHECKS_SQL} select partid, item, value from checks where classification = 'high' and value > 20""")
def filter_mixed(spark, sf_dir):
    checks = V.checks(spark, sf_dir)
    return checks.where((F.col("classification") == "high") & (F.col("value") > 20)).select("partid", "item", "value")


@query("filter_col_eq", "select doc_id, lang, n_chars from documents where n_chars = length(text)")
def filter_col_eq(spark, sf_dir):
    documents = V.table(spark, sf_dir, "documents")
    return documents.where(F.col("n_chars") == F.char_length("text")).select("doc_id", "lang", "n_chars")


@query("filter_gt_global_mean", f"""
with {V.SCORE_PAIRS_SQL}, d as (select model, sent_pair_id, "PD_score" - "DO_score" as diff from score_pairs)
select model, sent_pair_id, round(diff, 6) as diff from d where diff > (select avg(diff) from d)""")
def filter_gt_global_mean(spark, sf_dir):
    scored = V.score_pairs(spark, sf_dir)
    d = scored.select("model", "sent_pair_id", (F.col("PD_score") - F.col("DO_score")).alias("diff"))
    return rounded(R.above_overall_mean(stage(d, "pair-differences"), "diff"), "diff")


_FAILED_SQL = _Z_SQL + """, judged as (
  select partid, cast(case when count(*) filter (where classification = 'high') > 0
                      then coalesce(sum(correct) filter (where classification = 'high'), 0) end as bigint) as high_correct,
         cast(case when count(*) filter (where classification = 'low') > 0
                      then coalesce(sum(correct) filter (where classification = 'low'), 0) end as bigint) as low_correct
  from flagged group by partid), failed as (
  select * from judged where high_correct < 5 or low_correct < 7)"""


@query("qc_failed_raters", f"with {_FAILED_SQL} select partid, high_correct, low_correct from failed")
def qc_failed_raters(spark, sf_dir):
    return R.failed_raters(_flagged(spark, sf_dir))


# --- joins -------------------------------------------------------------------------


@query("join_semi", f"""
with {V.CHECKS_SQL} select partid, item, value from checks
where item in (select item from checks where classification <> 'trial')""")
def join_semi(spark, sf_dir):
    checks = V.checks(spark, sf_dir)
    listed = checks.where(F.col("classification") != "trial").select("item")
    return J.keep_matching(checks.select("partid", "item", "value"), listed, ["item"])


@query("join_anti", f"""
with {_FAILED_SQL} select partid, item, value from checks where partid not in (select partid from failed)""")
def join_anti(spark, sf_dir):
    failed = stage(R.failed_raters(_flagged(spark, sf_dir)).select("partid"), "failed-raters")
    return J.drop_matching(V.checks(spark, sf_dir).select("partid", "item", "value"), failed, ["partid"])


@query("join_text_inner", """
with catalogue as (select text, lang, min(doc_id) as sent_pair_id from documents group by text, lang)
select d.doc_id, d.source, c.lang as listed_lang, c.sent_pair_id
from documents d join catalogue c on d.text = c.text""")
def join_text_inner(spark, sf_dir):
    documents = V.table(spark, sf_dir, "documents")
    by_digest = documents.groupBy(F.sha2("text", 256).alias("digest"), F.col("lang").alias("listed_lang"))
    catalogue = by_digest.agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("sent_pair_id")).drop("digest")
    matched = J.match_text(documents.select("doc_id", "source", "text"), catalogue, "text", compare="digest")
    return matched.select("doc_id", "source", "listed_lang", "sent_pair_id")


@query("join_replica_chain", f"""
with {V.SCORE_PAIRS_SQL}
select a.sent_pair_id, round(a."DO_score", 6) as "DO_score_A", round(n."DO_score", 6) as "DO_score_N",
       round(r."DO_score", 6) as "DO_score_R", round(a."PD_score", 6) as "PD_score_A",
       round(n."PD_score", 6) as "PD_score_N", round(r."PD_score", 6) as "PD_score_R"
from score_pairs a join score_pairs n on a.sent_pair_id = n.sent_pair_id
                   join score_pairs r on a.sent_pair_id = r.sent_pair_id
where a.model = 'A' and n.model = 'N' and r.model = 'R'""")
def join_replica_chain(spark, sf_dir):
    scored = V.score_pairs(spark, sf_dir)
    lined = J.line_up_replicas(scored, ["sent_pair_id"], "model", V.MODELS, ["DO_score", "PD_score"])
    return rounded(lined, *[c for c in lined.columns if c != "sent_pair_id"])


@query("join_left", f"""
with {V.SCORE_PAIRS_SQL}, pairs as (
  select distinct sent_pair_id, verb_id, classification, io, frequency_rank from ratings)
select p.sent_pair_id, p.classification, round(a."PD_score" - a."DO_score", 6) as "diff_A",
       round(n."PD_score" - n."DO_score", 6) as "diff_N", round(r."PD_score" - r."DO_score", 6) as "diff_R"
from pairs p left join (select * from score_pairs where model = 'A') a on p.sent_pair_id = a.sent_pair_id
             left join (select * from score_pairs where model = 'N') n on p.sent_pair_id = n.sent_pair_id
             left join (select * from score_pairs where model = 'R') r on p.sent_pair_id = r.sent_pair_id""")
def join_left(spark, sf_dir):
    # Every model's difference, folded to one row per pair before the one join.
    diffs = V.score_pairs(spark, sf_dir).select("sent_pair_id", "model", (F.col("PD_score") - F.col("DO_score")).alias("diff"))
    wide = S.to_wide(diffs, ["sent_pair_id"], "model", V.MODELS, {"diff": S.only_value})
    joined = J.attach(V.pairs(spark, sf_dir).select("sent_pair_id", "classification"), wide, ["sent_pair_id"], null_keys_match=False)
    return rounded(joined, *[f"diff_{m}" for m in V.MODELS])


@query("join_left_renamed", f"""
with {V.PAIRS_SQL}, {V.VERBS_SQL}
select p.sent_pair_id, p.verb_id as item, v.verb from pairs p left join verbs v on p.verb_id = v.verb_id""")
def join_left_renamed(spark, sf_dir):
    pairs = V.pairs(spark, sf_dir).select("sent_pair_id", F.col("verb_id").alias("item"))
    return J.attach(pairs, V.verbs(spark, sf_dir).select("verb_id", "verb"), {"item": "verb_id"}, null_keys_match=False)


# --- aggregations ------------------------------------------------------------------


@query("agg_mean_skipna", f"""
with {V.RATINGS_SQL}, z as (
  select *, (value - avg(value) over w) / nullif(stddev_samp(value) over w, 0) as zscores
  from ratings window w as (partition by partid))
select construct, classification, round(avg(zscores), 6) as mean_z, round(avg(value), 6) as mean_rating
from z group by all""")
def agg_mean_skipna(spark, sf_dir):
    z = R.standardise(V.ratings(spark, sf_dir), ["partid"], "value")
    named = z.withColumnsRenamed({"zscores": "z", "value": "rating"})
    return rounded(A.means(named, ["construct", "classification"], ["z", "rating"]), "mean_z", "mean_rating")


@query("agg_model_summary", f"""
with {V.SCORE_PAIRS_SQL}
select model, classification, round(avg("PD_score" - "DO_score"), 6) as mean_diff,
       round(stddev_samp("PD_score" - "DO_score"), 6) as std_diff,
       round(avg("DO_score"), 6) as "mean_DO", round(avg("PD_score"), 6) as "mean_PD"
from score_pairs group by all""")
def agg_model_summary(spark, sf_dir):
    return rounded(A.model_summary(V.score_pairs(spark, sf_dir)), "mean_diff", "std_diff", "mean_DO", "mean_PD")


@query("agg_mean_strict", f"""
with {V.SCORE_PAIRS_SQL}
select verb_id, classification, case when count("DO_score") = count(*) then round(avg("DO_score"), 6) end as "mean_DO_score",
       case when count("PD_score") = count(*) then round(avg("PD_score"), 6) end as "mean_PD_score"
from score_pairs group by all""")
def agg_mean_strict(spark, sf_dir):
    summary = A.strict_means(V.score_pairs(spark, sf_dir), ["verb_id", "classification"], ["DO_score", "PD_score"])
    return rounded(summary, "mean_DO_score", "mean_PD_score")


@query("agg_many_keys", f"""
with {V.SCORE_PAIRS_SQL}, {V.VERBS_SQL}, wide as (
  select sent_pair_id, max("PD_score" - "DO_score") filter (where model = 'A') as "diff_A",
         max("PD_score" - "DO_score") filter (where model = 'N') as "diff_N",
         max("PD_score" - "DO_score") filter (where model = 'R') as "diff_R"
  from score_pairs group by all)
select r.sent_pair_id, r.verb_id, v.verb, r.construct, r.classification, r.io, r.frequency_rank,
       round(w."diff_A", 6) as "diff_A", round(w."diff_N", 6) as "diff_N", round(w."diff_R", 6) as "diff_R",
       round(avg(r.value), 6) as mean_scores
from ratings r left join verbs v on r.verb_id = v.verb_id left join wide w on r.sent_pair_id = w.sent_pair_id
group by r.sent_pair_id, r.verb_id, v.verb, r.construct, r.classification, r.io, r.frequency_rank,
         w."diff_A", w."diff_N", w."diff_R\"""")
def agg_many_keys(spark, sf_dir):
    # Group by the key alone, then join the attributes that depend on it.
    cells = V.ratings(spark, sf_dir).groupBy(*V.PAIR_COLUMNS, "construct").agg(X.mean_strict("value").alias("mean_scores"))
    with_scores = J.attach(cells, _models_wide(spark, sf_dir), ["sent_pair_id"], null_keys_match=False)
    with_verbs = J.attach(with_scores, V.verbs(spark, sf_dir).select("verb_id", "verb"), ["verb_id"], null_keys_match=False)
    return rounded(with_verbs, "diff_A", "diff_N", "diff_R", "mean_scores")


def pair_table(spark, sf_dir):
    """Standardised ratings folded to one row per pair."""
    z = R.standardise(V.ratings(spark, sf_dir), ["partid"], "value")
    return A.pair_means(z, list(V.PAIR_COLUMNS), V.CONSTRUCTS)


PAIR_TABLE_SQL = V.RATINGS_SQL + """, z as (
  select *, (value - avg(value) over w) / nullif(stddev_samp(value) over w, 0) as zscores
  from ratings window w as (partition by partid)), cells as (
  select sent_pair_id, verb_id, classification, io, frequency_rank, construct,
         case when count(zscores) = count(*) then avg(zscores) end as mean_z,
         case when count(value) = count(*) then avg(value) end as mean_scores
  from z group by all), pair_table as (
  select sent_pair_id, verb_id, classification, io, frequency_rank,
         max(mean_z) filter (where construct = 'DOsentence') as "mean_z_DOsentence",
         max(mean_z) filter (where construct = 'PDsentence') as "mean_z_PDsentence",
         max(mean_scores) filter (where construct = 'DOsentence') as "mean_scores_DOsentence",
         max(mean_scores) filter (where construct = 'PDsentence') as "mean_scores_PDsentence",
         "mean_z_PDsentence" - "mean_z_DOsentence" as human_zdiff,
         "mean_scores_PDsentence" - "mean_scores_DOsentence" as human_sdiff
  from cells group by sent_pair_id, verb_id, classification, io, frequency_rank)"""


@query("agg_two_level", f"""
with {PAIR_TABLE_SQL}
select classification, io, round(avg("mean_scores_DOsentence"), 6) as "mean_DO",
       round(avg("mean_scores_PDsentence"), 6) as "mean_PD", round(avg(human_sdiff), 6) as mean_diff,
       round(avg("mean_z_DOsentence"), 6) as "mean_DO_z", round(avg("mean_z_PDsentence"), 6) as "mean_PD_z",
       round(avg(human_zdiff), 6) as mean_diff_z
from pair_table group by all""")
def agg_two_level(spark, sf_dir):
    summary = A.class_means(pair_table(spark, sf_dir))
    return rounded(summary, *summary.columns[2:])


# --- windows -----------------------------------------------------------------------


@query("win_row_number", """
select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) as sent_pair_id from orders""")
def win_row_number(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return number_rows(orders, ["o_orderkey"], "sent_pair_id")


@query("scan_numbered", """
select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) as row_id from orders""")
def scan_numbered(spark, sf_dir):
    """Rows of several files numbered as they lie, without a key to order them by."""
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    path = new_folder(spark, "numbered-csv")
    write_csv(orders.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey"), path)
    return number_as_read(read_csv(spark, path, orders.schema))


_ODD_EVENTS = """case event_id % 11 when 0 then 'NA' when 1 then cast(event_id as varchar) || 'x' when 2 then '' when 3 then 'NaN'
         when 4 then cast(cast(floor(value) as bigint) as varchar) || ' 1' else cast(event_id as varchar) end"""


@query("cast_quarantine", f"""
with e as (select event_id, {_ODD_EVENTS} as cell from events)
select event_id, 'value' as column, cell, 'not double' as reason from e where cell <> '' and cell not in ('NA', 'NaN') and try_cast(cell as double) is null""")
def cast_quarantine(spark, sf_dir):
    """Cells of a text column that a lenient cast rejects, with where they are from and why."""
    events = V.table(spark, sf_dir, "events").select("event_id", F.expr(_ODD_EVENTS.replace("varchar", "string")).alias("value"))
    return cast_audited(events, {"value": "double"}, {"event_id": F.col("event_id")})[1]


@query("cast_audit", f"""
with e as (select {_ODD_EVENTS} as cell from events)
select 'value' as column, 'missing' as reason, count(*) filter (where cell in ('', 'NA', 'NaN')) as n, count(*) filter (where try_cast(cell as double) is not null and cell <> 'NaN') as n_cast from e
union all select 'value', 'not double', count(*) filter (where cell not in ('', 'NA', 'NaN') and try_cast(cell as double) is null),
       count(*) filter (where try_cast(cell as double) is not null and cell <> 'NaN') from e""")
def cast_audit(spark, sf_dir):
    """How many cells a lenient cast left out, by column and reason, and how many it kept."""
    events = V.table(spark, sf_dir, "events").select("event_id", F.expr(_ODD_EVENTS.replace("varchar", "string")).alias("value"))
    kept, _, counts = cast_audited(events, {"value": "double"}, {"event_id": F.col("event_id")})
    told = spark.createDataFrame([(*key, n) for key, n in counts.items()], "column string, reason string, n bigint")
    return told.crossJoin(F.broadcast(kept.agg(F.count("value").alias("n_cast"))))


@query("win_zscore", f"with {_Z_SQL} select partid, item, value, round(zscores, 6) as zscores from z")
def win_zscore(spark, sf_dir):
    return rounded(_standardised_checks(spark, sf_dir).select("partid", "item", "value", "zscores"), "zscores")


@query("win_group_sum", f"""
with {_Z_SQL}
select partid, item, classification,
       cast(sum(correct) over (partition by partid, classification) as bigint) as n_correct
from flagged""")
def win_group_sum(spark, sf_dir):
    spread = R.spread_aggregates(
        _flagged(spark, sf_dir), ["partid", "classification"], {"n_correct": F.sum("correct")}
    )
    return spread.select("partid", "item", "classification", "n_correct")


# --- reshaping ---------------------------------------------------------------------


@query("pivot_text", """
with numbered as (
  select conv_id, role, text, turn, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as pair from conversations)
select conv_id, cast(pair as bigint) as pair, min(text) filter (where role = 'user') as "user", min(text) filter (where role = 'assistant') as assistant
from numbered where role in ('user', 'assistant') group by conv_id, pair""")
def pivot_text(spark, sf_dir):
    # A user turn opens a pair; every turn of either role comes out, and a second text of one cell fails the job.
    talk = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    opened = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn"))
    numbered = talk.withColumn("pair", opened.cast("bigint")).where(F.col("role").isin("user", "assistant"))
    return S.to_wide(numbered, ["conv_id", "pair"], "role", ["user", "assistant"], {"text": S.only_value}, "{level}")


@query("pivot_one", f"""
with {V.SCORES_SQL}
select model, sent_pair_id, round(avg(score) filter (where construct = 'DOsentence'), 6) as "DOsentence",
       round(avg(score) filter (where construct = 'PDsentence'), 6) as "PDsentence"
from scores group by all""")
def pivot_one(spark, sf_dir):
    wide = S.to_wide(
        V.scores(spark, sf_dir), ["model", "sent_pair_id"], "construct", V.CONSTRUCTS, {"score": S.mean_value}, "{level}"
    )
    return rounded(wide, *V.CONSTRUCTS)


@query("pivot_two", f"""
with {PAIR_TABLE_SQL}
select sent_pair_id, round("mean_z_DOsentence", 6) as "mean_z_DOsentence", round("mean_z_PDsentence", 6) as "mean_z_PDsentence",
       round("mean_scores_DOsentence", 6) as "mean_scores_DOsentence",
       round("mean_scores_PDsentence", 6) as "mean_scores_PDsentence"
from pair_table""")
def pivot_two(spark, sf_dir):
    values = [f"{v}_{c}" for v in ("mean_z", "mean_scores") for c in V.CONSTRUCTS]
    return rounded(pair_table(spark, sf_dir).select("sent_pair_id", *values), *values)


@query("unpivot_two", f"""
with {V.SCORE_PAIRS_SQL}
select model, sent_pair_id, 'DO_score' as construct, round("DO_score", 6) as score from score_pairs
union all
select model, sent_pair_id, 'PD_score', round("PD_score", 6) from score_pairs""")
def unpivot_two(spark, sf_dir):
    scored = V.score_pairs(spark, sf_dir)
    return rounded(S.to_long(scored, ["model", "sent_pair_id"], ["DO_score", "PD_score"], "construct", "score"), "score")


@query("unpivot_models", f"""
with {_WIDE_SQL}
select sent_pair_id, 'diff_A' as model, round("diff_A", 6) as diff from wide
union all select sent_pair_id, 'diff_N', round("diff_N", 6) from wide
union all select sent_pair_id, 'diff_R', round("diff_R", 6) from wide""")
def unpivot_models(spark, sf_dir):
    wide = _models_wide(spark, sf_dir)
    return rounded(S.to_long(wide, ["sent_pair_id"], ["diff_A", "diff_N", "diff_R"], "model", "diff"), "diff")


def combined_sources(spark, sf_dir):
    """Human and model differences of each pair, one row per source."""
    human = pair_table(spark, sf_dir).select(*V.PAIR_COLUMNS, F.col("human_zdiff").alias("Human"))
    joined = J.attach(human, _models_wide(spark, sf_dir), ["sent_pair_id"], null_keys_match=False)
    named = joined.withColumn("io", X.recode("io", {"longIndefinite": "Long", "shortIndefinite": "Short"}))
    return S.to_long(named, list(V.PAIR_COLUMNS), ["Human", "diff_A", "diff_N", "diff_R"], "source", "diff")


COMBINED_SQL = PAIR_TABLE_SQL + """, score_pairs as (
  select model, sent_pair_id, avg(price) filter (where construct = 'PDsentence')
                            - avg(price) filter (where construct = 'DOsentence') as diff
  from ratings group by all), wide as (
  select p.*, max(s.diff) filter (where model = 'A') as "diff_A", max(s.diff) filter (where model = 'N') as "diff_N",
         max(s.diff) filter (where model = 'R') as "diff_R"
  from (select sent_pair_id, verb_id, classification,
               case io when 'longIndefinite' then 'Long' else 'Short' end as io, frequency_rank, human_zdiff
        from pair_table) p left join score_pairs s on p.sent_pair_id = s.sent_pair_id
  group by all), combined as (
  select sent_pair_id, verb_id, classification, io, frequency_rank, 'Human' as source, human_zdiff as diff from wide
  union all select sent_pair_id, verb_id, classification, io, frequency_rank, 'diff_A', "diff_A" from wide
  union all select sent_pair_id, verb_id, classification, io, frequency_rank, 'diff_N', "diff_N" from wide
  union all select sent_pair_id, verb_id, classification, io, frequency_rank, 'diff_R', "diff_R" from wide)"""


@query("unpivot_sources", f"""
with {COMBINED_SQL}
select sent_pair_id, verb_id, classification, io, frequency_rank, source, round(diff, 6) as diff from combined""")
def unpivot_sources(spark, sf_dir):
    return rounded(combined_sources(spark, sf_dir), "diff")


def _both_scores_wide(spark, sf_dir):
    scored = V.score_pairs(spark, sf_dir)
    values = {"DO_score": S.first_value, "PD_score": S.first_value}
    return S.to_wide(scored, ["sent_pair_id", "classification"], "model", V.MODELS, values)


_PAIRED_SQL = V.SCORE_PAIRS_SQL + """, models as (select distinct model from score_pairs), paired as (
  select p.sent_pair_id, p.classification, m.model, s."DO_score" as "DOsentence", s."PD_score" as "PDsentence"
  from (select distinct sent_pair_id, classification from score_pairs) p, models m
  left join score_pairs s on s.sent_pair_id = p.sent_pair_id and s.model = m.model)"""


def paired_models(spark, sf_dir):
    groups = {m: [f"DO_score_{m}", f"PD_score_{m}"] for m in V.MODELS}
    wide = _both_scores_wide(spark, sf_dir)
    return S.to_long_grouped(wide, ["sent_pair_id", "classification"], groups, "model", list(V.CONSTRUCTS))


@query("unpivot_paired", f"""
with {_PAIRED_SQL}
select sent_pair_id, classification, model, round("DOsentence", 6) as "DOsentence",
       round("PDsentence", 6) as "PDsentence" from paired""")
def unpivot_paired(spark, sf_dir):
    return rounded(paired_models(spark, sf_dir), *V.CONSTRUCTS)


@query("unpivot_nested", f"""
with {_PAIRED_SQL}
select sent_pair_id, classification, model, 'DOsentence' as construct, round("DOsentence", 6) as scores from paired
union all select sent_pair_id, classification, model, 'PDsentence', round("PDsentence", 6) from paired""")
def unpivot_nested(spark, sf_dir):
    keys = ["sent_pair_id", "classification", "model"]
    return rounded(S.to_long(paired_models(spark, sf_dir), keys, list(V.CONSTRUCTS), "construct", "scores"), "scores")
