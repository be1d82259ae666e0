"""Registered queries: sentence scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlab.operators import scoring as C
from pairlab.operators.causal import network_scorer, train_network
from pairlab.operators.ordered import WeightedMean, reduce_in_order
from pairlab.operators.reshape import mean_value, only_value, to_wide
from pairlab.plans import standin as V
from pairlab.plans import study
from pairlab.plans.registry import query, rounded
from pairlab.sources.staging import new_folder, stage
from pairlab.sources.tables import read_replicas, write_csv

_WORDS = "list_concat(['<s>'], [x for x in regexp_split_to_array(lower(text), '[^\\p{L}]+') if x <> ''], ['</s>'])"

_BIGRAM_SQL = f"""words as (select doc_id, {_WORDS} as w from documents), bigrams as (
  select doc_id, unnest(w[1:len(w) - 1]) as prev, unnest(w[2:]) as token from words), pair_counts as (
  select prev, token, count(*) as c from bigrams group by all), word_counts as (
  select prev, sum(c) as c from pair_counts group by prev), v as (
  select count(distinct token) as v from pair_counts)"""

_LOGPROB_SQL = _BIGRAM_SQL + """, scored as (
  select b.doc_id, ln((p.c + 1.0) / (w.c + v.v)) as lp
  from bigrams b join pair_counts p on b.prev = p.prev and b.token = p.token
  join word_counts w on b.prev = w.prev, v)"""

# A letter model: log-probability of each letter (code point modulo 256) after each letter.
_LETTER_SQL = """letters as (
  select doc_id, [unicode(c) % 256 for c in string_split(lower(text), '')] as w from documents), steps as (
  select doc_id, unnest(w[1:len(w) - 1]) as a, unnest(w[2:]) as b from letters), cells as (
  select a, b, count(*) as c from steps group by all), rows as (
  select a, sum(c) as c from cells group by a)"""


def _documents(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", "text")


@query("score_batch", f"""
with {_LETTER_SQL}
select doc_id, round(avg(ln((cells.c + 1.0) / (rows.c + 256.0))), 6) as score
from steps s join cells on s.a = cells.a and s.b = cells.b join rows on s.a = rows.a group by doc_id""")
def score_batch(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    model = C.train_letter_model(documents, "text")
    scored = C.score_texts(documents, "text", C.letter_scorer(model))
    return rounded(scored.select("doc_id", "score"), "score")


@query("score_network")
def score_network(spark, sf_dir):
    """Pairs of a conversation's texts scored by a causal network that all documents have trained."""
    weights = train_network(_documents(spark, sf_dir), "text", rounds=1)
    talk = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return rounded(C.score_texts(talk, "text", network_scorer(spark, weights)).drop("text"), "score")


@query("score_tokens", f"""
with words as (select doc_id, {_WORDS} as w from documents)
select doc_id, cast(unnest(range(0, len(w))) as integer) as pos, unnest(w) as token from words""")
def score_tokens(spark, sf_dir):
    return C.token_table(_documents(spark, sf_dir), ["doc_id"], "text")


@query("score_logsoftmax", """
with d as (select vec_id, label, [cast(x as double) for x in embedding] as e from embeddings)
select vec_id, round(e[label + 1] - list_max(e) - ln(list_sum([exp(x - list_max(e)) for x in e])), 6) as logprob
from d""")
def score_logsoftmax(spark, sf_dir):
    embeddings = V.table(spark, sf_dir, "embeddings")
    return rounded(embeddings.select("vec_id", C.log_softmax_at("embedding", "label").alias("logprob")), "logprob")


def _token_scores(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    return C.BigramModel.score_own(documents, ["doc_id"], "text")


@query("score_mean_logprob", f"with {_LOGPROB_SQL} select doc_id, round(avg(lp), 6) as score from scored group by doc_id")
def score_mean_logprob(spark, sf_dir):
    return rounded(C.reduce_scores(_token_scores(spark, sf_dir), ["doc_id"], C.mean_log_prob), "score")


@query("score_logmeanexp", f"""
with {_LOGPROB_SQL}, top as (select doc_id, max(lp) as m from scored group by doc_id)
select s.doc_id, round(any_value(m) + ln(sum(exp(lp - m))) - ln(count(*)), 6) as score
from scored s join top t on s.doc_id = t.doc_id group by s.doc_id""")
def score_logmeanexp(spark, sf_dir):
    return rounded(C.reduce_scores(_token_scores(spark, sf_dir), ["doc_id"], C.log_mean_exp), "score")


@query("score_position_weighted", f"""
with {_BIGRAM_SQL}, placed as (
  select doc_id, unnest(range(1, len(w))) as pos, unnest(w[1:len(w) - 1]) as prev, unnest(w[2:]) as token from words), scored as (
  select b.doc_id, b.pos, ln((p.c + 1.0) / (w.c + v.v)) as lp
  from placed b join pair_counts p on b.prev = p.prev and b.token = p.token join word_counts w on b.prev = w.prev, v)
select doc_id, round(sum(lp / sqrt(pos)) / sum(1 / sqrt(pos)), 6) as score from scored group by doc_id""")
def score_position_weighted(spark, sf_dir):
    """Mean token log-probability that weighs a token by its place: a reduction that sees tokens in order."""
    documents = _documents(spark, sf_dir)
    tokens = C.BigramModel.train(documents, "text").placed_log_probs(documents, ["doc_id"], "text", own=True)
    return rounded(reduce_in_order(tokens, ["doc_id"], "pos", lambda: WeightedMean(lambda at: 1 / np.sqrt(at))), "score")


@query("score_masked", """
with d as (select vec_id, unnest([cast(x as double) for x in embedding]) as x,
                  unnest(range(0, len(embedding))) as i, label from embeddings)
select vec_id, count(*) as n, round(avg(x), 6) as score from d where i >= label group by vec_id""")
def score_masked(spark, sf_dir):
    # The first ``label`` positions stand for padding.
    embeddings = V.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"), "label"
    )
    mask = F.transform("v", lambda x, i: (i >= F.col("label")).cast("int"))
    kept = embeddings.select("vec_id", F.explode(C.keep_unmasked("v", mask)).alias("x"))
    summary = kept.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("score"))
    return rounded(summary, "score")


@query("score_pair_diff", f"""
with {_BIGRAM_SQL}, talk as (
  select conv_id, role, {_WORDS} as w from conversations where role in ('user', 'assistant')), spoken as (
  select conv_id, role, unnest(w[1:len(w) - 1]) as prev, unnest(w[2:]) as token from talk), scored as (
  select s.conv_id, s.role, avg(ln((coalesce(p.c, 0) + 1.0) / (coalesce(w.c, 0) + v.v))) as score
  from spoken s left join pair_counts p on s.prev = p.prev and s.token = p.token
  left join word_counts w on s.prev = w.prev, v group by all), wide as (
  select conv_id, max(score) filter (where role = 'user') as user_score,
         max(score) filter (where role = 'assistant') as assistant_score from scored group by conv_id)
select conv_id, round(user_score, 6) as user_score, round(assistant_score, 6) as assistant_score,
       round(assistant_score - user_score, 6) as diff from wide""")
def score_pair_diff(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    model = C.BigramModel.train(documents, "text")
    talk = V.table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    tokens = model.log_probs(talk, ["conv_id", "role"], "text")
    scored = C.reduce_scores(tokens, ["conv_id", "role"], C.mean_log_prob)
    wide = to_wide(scored, ["conv_id"], "role", ["user", "assistant"], {"score": mean_value}, "{level}_{value}")
    wide = wide.withColumn("diff", F.col("assistant_score") - F.col("user_score"))
    return rounded(wide, "user_score", "assistant_score", "diff")


@query("score_sequences", """
with p as (select vec_id, vec_id // 8 as sentence, vec_id % 8 as pos, label, [cast(x as double) for x in embedding] as e from embeddings), t as (
  select p.sentence, p.pos, p.e, n.label as target from p join p n on p.sentence = n.sentence and n.pos = p.pos + 1)
select sentence, count(*) as n_scored, round(avg(e[target + 1] - list_max(e) - ln(list_sum([exp(x - list_max(e)) for x in e]))), 6) as score
from t where target <> 0 group by sentence""")
def score_sequences(spark, sf_dir):
    """Mean log-probability of sentences of eight positions: logits of each predict the next token; token 0 is padding."""
    rows = V.table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 8").alias("sentence"), (F.col("vec_id") % 8).alias("pos"), "label", F.col("embedding").cast("array<double>").alias("logits")
    )
    sentences = rows.groupBy("sentence").agg(F.sort_array(F.collect_list(F.struct("pos", "label", "logits"))).alias("at"))  # eight positions each
    targets = sentences.select("sentence", "at", C.shifted_targets(F.transform("at", lambda p: p["label"])).alias("target"))
    scored = targets.select("sentence", F.posexplode("target").alias("i", "target"), "at").select(
        "sentence", "target", C.log_softmax_at(F.col("at")[F.col("i")]["logits"], F.col("target")).alias("logprob")
    ).where("target <> 0")
    return rounded(scored.groupBy("sentence").agg(F.count(F.lit(1)).alias("n_scored"), F.avg("logprob").alias("score")), "score")


_FILE_MODELS = ("gpt2", "nobody")


@query("score_files", f"""
with {_LETTER_SQL}, numbered as (
  select conv_id, role, text, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as pair from conversations), pair as (
  select conv_id, cast(pair as bigint) as pair, min(text) filter (where role = 'user') as "DOsentence", min(text) filter (where role = 'assistant') as "PDsentence"
  from numbered where role in ('user', 'assistant') group by conv_id, pair), long as (
  select conv_id, pair, 'DO' as form, "DOsentence" as text from pair union all select conv_id, pair, 'PD', "PDsentence" from pair), spelt as (
  select conv_id, pair, form, [unicode(c) % 256 for c in string_split(lower(text), '')] as w from long where text is not null), taken as (
  select conv_id, pair, form, unnest(w[1:len(w) - 1]) as a, unnest(w[2:]) as b from spelt), scored as (
  select t.conv_id, t.pair, t.form, avg(ln((coalesce(cells.c, 0) + 1.0) / (coalesce(rows.c, 0) + 256.0))) as s
  from taken t left join cells on t.a = cells.a and t.b = cells.b left join rows on t.a = rows.a group by t.conv_id, t.pair, t.form), wide as (
  select conv_id, pair, max(s) filter (where form = 'DO') as d, max(s) filter (where form = 'PD') as p from scored group by conv_id, pair)
select pair.conv_id, pair.pair, 'gpt2' as model, round(d, 6) as "DO_score", round(p, 6) as "PD_score", round(p - d, 6) as diff
from pair left join wide on pair.conv_id = wide.conv_id and pair.pair = wide.pair""")
def score_files(spark, sf_dir):
    """From a file of pairs to a scored file per model and back; a model nobody knows is reported and left out."""
    talk = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    opened = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn"))
    numbered = talk.withColumn("pair", opened.cast("bigint")).where(F.col("role").isin("user", "assistant"))
    pairs = to_wide(numbered, ["conv_id", "pair"], "role", ["user", "assistant"], {"text": only_value}, "{level}")
    source = new_folder(spark, "pairs")
    write_csv(pairs.withColumnsRenamed({"user": "DOsentence", "assistant": "PDsentence"}), source)
    model = C.train_letter_model(_documents(spark, sf_dir), "text")
    schema = "conv_id BIGINT, pair BIGINT, DOsentence STRING, PDsentence STRING"
    written, unknown = study.score_pair_files(
        spark, source, schema, dict.fromkeys(_FILE_MODELS, C.letter_scorer(model)), new_folder(spark, "scored"), multi_line=True
    )
    assert unknown == ["nobody"]
    found = read_replicas(
        spark, f"{written}/model=*", "conv_id BIGINT, pair BIGINT, DO_score DOUBLE, PD_score DOUBLE, diff DOUBLE", r"model=([^/]+)/"
    )
    return rounded(found, "DO_score", "PD_score", "diff")


_CHOICES = """raw as (
  select user_id as partid, event_id as item, value, case event_type when 'signup' then 'high' when 'error' then 'low' else 'trial' end as kind,
         case when event_id % 2 = 0 then 'DOsentence' else 'PDsentence' end as construct, event_id // 2 % 50 as pair from events), z as (
  select *, (value - avg(value) over r) / nullif(stddev_samp(value) over r, 0) as zscores from raw window r as (partition by partid)), flagged as (
  select *, case when zscores is null then null when kind = 'low' then cast(zscores < 0 as integer) else cast(zscores > 0 as integer) end as correct
  from z where kind <> 'trial'), failed as (
  select partid from flagged group by partid
  having coalesce(sum(correct) filter (where kind = 'high'), case when count(*) filter (where kind = 'high') > 0 then 0 end) < 5
      or coalesce(sum(correct) filter (where kind = 'low'), case when count(*) filter (where kind = 'low') > 0 then 0 end) < 7)"""


@query("study_pair_differences", f"""
with {_CHOICES}, kept as (select * from z where kind = 'trial' and partid not in (select partid from failed))
select pair as sent_pair_id, round(avg(zscores) filter (where construct = 'PDsentence') - avg(zscores) filter (where construct = 'DOsentence'), 5) as human_zdiff,
       round(cast(sum(cents) filter (where construct = 'PDsentence') as double) / count(*) filter (where construct = 'PDsentence')
         - cast(sum(cents) filter (where construct = 'DOsentence') as double) / count(*) filter (where construct = 'DOsentence'), 5) as human_sdiff
from (select *, cast(value as decimal(18, 2)) as cents from kept) group by pair""")
def study_pair_differences(spark, sf_dir):
    """The study from raw form rows: standardise, check attention, keep trials, find pairs by sentence, fold to differences."""
    events = V.table(spark, sf_dir, "events")
    pair = F.expr("event_id div 2 % 50").cast("int")
    form = F.when(F.col("event_id") % 2 == 0, "DOsentence").otherwise("PDsentence")
    kind = F.when(F.col("event_type") == "signup", "high").when(F.col("event_type") == "error", "low")
    raw = events.select(
        F.when(kind.isNull(), "experimental_trial").otherwise("filler").alias("Label"), F.lit("test").alias("PennElementName"),
        F.lit("Choice").alias("Parameter"), F.col("value").cast("string").alias("Value"), F.col("user_id").cast("string").alias("partid"),
        F.when(kind.isNull(), F.format_string("pair %d as %s", pair, form)).alias("sentence"), form.alias("construct"),
        F.coalesce(kind, F.lit("alternating")).alias("classification"), F.lit("longIndefinite").alias("IO"), F.lit("0").alias("counter"),
        F.lit("g").alias("group"), F.when(kind.isNull(), pair.cast("string")).otherwise(F.concat(F.lit("f"), F.col("event_id").cast("string"))).alias("item"),
    )
    fillers = raw.where("Label = 'filler'").select("item").distinct()
    choices = study.standardised_choices(raw)
    failed = stage(study.raters_to_drop(choices, fillers).select("partid"), "failed-raters")
    pairs = spark.range(50).select(
        F.col("id").cast("int").alias("sent_pair_id"), F.lit(0).alias("frequency_rank"),
        *[F.format_string(f"pair %d as {c}", "id").alias(c) for c in study.CONSTRUCTS],
    )
    rated = study.with_pair_ids(study.experiment_rows(choices, failed), pairs, on_duplicate="error")
    means = study.human_differences(rated.withColumns({"verb_id": F.col("item"), "verb": F.col("item")}), places=2)
    return rounded(means.select(F.col("sent_pair_id").cast("bigint").alias("sent_pair_id"), "human_zdiff", "human_sdiff"), "human_zdiff", "human_sdiff", places=5)
