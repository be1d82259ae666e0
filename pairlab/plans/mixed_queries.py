"""Registered queries: mixed models."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import design as D
from pairlab.functions.exprs import pair_difference
from pairlab.operators import mixed as M
from pairlab.operators.joins import union_replicas
from pairlab.operators.reml import fit_crossed_reml
from pairlab.operators.reshape import mean_value, to_wide
from pairlab.operators.slopes import fit_slopes
from pairlab.plans import standin as V
from pairlab.plans.model_queries import class_by_construct
from pairlab.plans.registry import query, rounded


def _with_rank() -> list[D.Term]:
    return class_by_construct() + D.numeric("frequency_rank")


def _differences(spark, sf_dir):
    """Human and model difference of every pair, by source."""
    wide = to_wide(V.ratings(spark, sf_dir), list(V.PAIR_COLUMNS), "construct", V.CONSTRUCTS, {"value": mean_value}, "{level}")
    human = wide.select("verb_id", "classification", "frequency_rank", pair_difference().alias("diff"))
    scored = V.score_pairs(spark, sf_dir)
    models = scored.select(
        "verb_id", "classification", "frequency_rank", ((F.col("PD_score") - F.col("DO_score")) / 1000).alias("diff"),
        F.col("model").alias("source"),
    )
    return union_replicas({"Human": human}, "source").unionByName(models)


@query("lmm_one_intercept")
def lmm_one_intercept(spark, sf_dir):
    """Human and model difference on class and frequency, with a verb intercept, per source."""
    both = _differences(spark, sf_dir)
    terms = D.factor("classification", V.CLASSES) + D.numeric("frequency_rank")
    return M.fit_nested(both, "diff", terms, "verb_id", by=["source"])


@query("lmm_nested")
def lmm_nested(spark, sf_dir):
    """Model score on class, construct and frequency with pair-in-verb intercepts, all models at once."""
    scores = V.scores(spark, sf_dir).withColumn("score", F.col("score") / 1000)
    return M.fit_nested(scores, "score", _with_rank(), "sent_pair_id", "verb_id", by=["model"])


@query("lmm_nested_plain")
def lmm_nested_plain(spark, sf_dir):
    """Model score on class and construct with pair-in-verb intercepts, without frequency."""
    scores = V.scores(spark, sf_dir).withColumn("score", F.col("score") / 1000)
    return M.fit_nested(scores, "score", class_by_construct(), "sent_pair_id", "verb_id", by=["model"])


_RATIOS = (0.15, 0.1)


@query("lmm_nested_criterion", f"""
with {V.SCORES_SQL}, w as (
  select model, sent_pair_id, verb_id, cast(classification = 'non-alternating' as double) as a, cast(construct = 'PDsentence' as double) as b,
         cast(classification = 'non-alternating' and construct = 'PDsentence' as double) as ab, cast(frequency_rank as double) as f, score / 1000 as y
  from scores), c as (
  select model, sent_pair_id, verb_id, [1.0, a - avg(a) over m, b - avg(b) over m, ab - avg(ab) over m, f - avg(f) over m, y - avg(y) over m] as x
  from w window m as (partition by model)), cell as (
  select model, sent_pair_id, verb_id, i, sum(x[i + 1]) as s, count(*) as n from c, range(0, 6) t(i) group by all), pair as (
  select p.model, p.sent_pair_id, p.verb_id, p.i, q.i as j, p.s, q.s as s2, p.n, {_RATIOS[0]**2} / (1 + p.n * {_RATIOS[0]**2}) as q, 1 / (1 + p.n * {_RATIOS[0]**2}) as u
  from cell p join cell q on p.model = q.model and p.sent_pair_id = q.sent_pair_id where p.i <= q.i), verb as (
  select model, verb_id, i, sum(s / (1 + n * {_RATIOS[0]**2})) as c, sum(n / (1 + n * {_RATIOS[0]**2})) as w from cell group by all), wide as (
  select model, i, j, sum(q * s * s2) as v from pair group by all union all
  select p.model, p.i, q.i, sum({_RATIOS[1]**2} / (1 + {_RATIOS[1]**2} * p.w) * p.c * q.c)
  from verb p join verb q on p.model = q.model and p.verb_id = q.verb_id where p.i <= q.i group by all), gram as (
  select model, i, j, sum(x[i + 1] * x[j + 1]) as v from c, range(0, 6) t(i), range(0, 6) r(j) where i <= j group by all), gone as (
  select model, i, j, sum(v) as v from wide group by all)
select g.model, cast(g.i as integer) as i, cast(g.j as integer) as j, round(g.v - o.v, 3) as value
from gram g join gone o on g.model = o.model and g.i = o.i and g.j = o.j union all
select model, -1, -1, round(sum(ld), 3) from (
  select model, ln(1 + n * {_RATIOS[0]**2}) as ld from cell where i = 0 union all
  select model, ln(1 + {_RATIOS[1]**2} * w) from verb where i = 0) group by model""")
def lmm_nested_criterion(spark, sf_dir):
    """What the criterion of ``lmm_nested`` is made of, at one stated pair of ratios."""
    scores = V.scores(spark, sf_dir).withColumn("score", F.col("score") / 1000)
    table = M.nested_cross_products(scores, "score", _with_rank(), "sent_pair_id", "verb_id", ["model"], _RATIOS)
    return table.withColumn("value", F.round("value", 3) + 0.0)


_ONE_RATIO = 0.3


@query("lmm_one_intercept_criterion", f"""
with {V.RATINGS_SQL}, human as (
  select 'Human' as source, sent_pair_id, classification, io, frequency_rank,
         avg(value) filter (where construct = 'PDsentence') - avg(value) filter (where construct = 'DOsentence') as y from ratings group by all), models as (
  select model as source, sent_pair_id, classification, io, frequency_rank,
         (avg(price) filter (where construct = 'PDsentence') - avg(price) filter (where construct = 'DOsentence')) / 1000 as y from ratings group by all), rows as (
  select source, sent_pair_id // 2 as verb, cast(classification = 'non-alternating' as double) as a, cast(frequency_rank as double) as f, y
  from (select * from human union all select * from models) where y is not null), c as (
  select source, verb, [1.0, a - avg(a) over s, f - avg(f) over s, y - avg(y) over s] as x from rows window s as (partition by source)), cell as (
  select source, verb, i, sum(x[i + 1]) as s, count(*) as n from c, range(0, 4) t(i) group by all), gone as (
  select p.source, p.i, q.i as j, sum({_ONE_RATIO**2} / (1 + p.n * {_ONE_RATIO**2}) * p.s * q.s) as v
  from cell p join cell q on p.source = q.source and p.verb = q.verb where p.i <= q.i group by all), gram as (
  select source, i, j, sum(x[i + 1] * x[j + 1]) as v from c, range(0, 4) t(i), range(0, 4) r(j) where i <= j group by all)
select g.source, cast(g.i as integer) as i, cast(g.j as integer) as j, round(g.v - o.v, 3) as value
from gram g join gone o on g.source = o.source and g.i = o.i and g.j = o.j union all
select source, -1, -1, round(sum(ln(1 + n * {_ONE_RATIO**2})), 3) from cell where i = 0 group by source""")
def lmm_one_intercept_criterion(spark, sf_dir):
    """What the criterion of ``lmm_one_intercept`` is made of, at one stated ratio."""
    terms = D.factor("classification", V.CLASSES) + D.numeric("frequency_rank")
    table = M.nested_cross_products(_differences(spark, sf_dir), "diff", terms, "verb_id", None, ["source"], (_ONE_RATIO, 0.0))
    return table.withColumn("value", F.round("value", 3) + 0.0)


_MOMENTS_SQL = V.RATINGS_SQL + """, r as (
  select partid as rater, sent_pair_id as pair, verb_id as verb,
         value - avg(value) over (partition by classification, construct) as e from ratings), t as (
  select sum(e * e) as rss, cast(count(*) as double) as n from r), per as (
  select 'rater' as f, rater as id, sum(e) as s, count(*) as n from r group by rater
  union all select 'pair', pair, sum(e), count(*) from r group by pair
  union all select 'verb', verb, sum(e), count(*) from r group by verb), tot as (
  select f, sum(s * s / n) as between_ss, count(*) as levels, sum(cast(n as double) * n) as n2 from per group by f), rp as (
  select rater, pair, count(*) as n from r group by all), rv as (
  select rater, verb, count(*) as n from r group by all), pv as (
  select pair, verb, count(*) as n from r group by all), ov as (
  select 'rater' as f, 'pair' as h, sum(q) as s from (select sum(cast(n as double) * n) / sum(n) as q from rp group by rater)
  union all select 'pair', 'rater', sum(q) from (select sum(cast(n as double) * n) / sum(n) as q from rp group by pair)
  union all select 'rater', 'verb', sum(q) from (select sum(cast(n as double) * n) / sum(n) as q from rv group by rater)
  union all select 'verb', 'rater', sum(q) from (select sum(cast(n as double) * n) / sum(n) as q from rv group by verb)
  union all select 'verb', 'pair', sum(q) from (select sum(cast(n as double) * n) / sum(n) as q from pv group by verb)
  union all select 'pair', 'verb', sum(q) from (select sum(cast(n as double) * n) / sum(n) as q from pv group by pair)
  union all select f, f, n from tot, t
  union all select 'none', f, n2 / n from tot, t)
select k.f as grouping, round(t.rss - k.between_ss, 3) as ssw, k.levels as n_levels,
       round(t.n - max(ov.s) filter (where ov.h = 'rater'), 6) as coef_rater,
       round(t.n - max(ov.s) filter (where ov.h = 'pair'), 6) as coef_pair,
       round(t.n - max(ov.s) filter (where ov.h = 'verb'), 6) as coef_verb,
       round(t.n - k.levels, 6) as coef_error
from (select f, between_ss, levels from tot union all select 'none', 0, 1) k join ov on ov.f = k.f, t
group by k.f, k.between_ss, k.levels, t.rss, t.n"""


@query("lmm_crossed_moments", f"with {_MOMENTS_SQL}")
def lmm_crossed_moments(spark, sf_dir):
    design = M.Crossed.build(
        V.ratings(spark, sf_dir), "value", class_by_construct(), "partid", "sent_pair_id", "verb_id"
    )
    table = rounded(design.moment_table(), "ssw", places=3)
    return rounded(table, "coef_rater", "coef_pair", "coef_verb", "coef_error")


@query("lmm_crossed_fixed")
def lmm_crossed_fixed(spark, sf_dir):
    """Rating on class, construct and frequency with rater, pair and verb intercepts."""
    return M.fit_crossed(V.ratings(spark, sf_dir), "value", _with_rank(), "partid", "sent_pair_id", "verb_id")


@query("lmm_crossed_reml")
def lmm_crossed_reml(spark, sf_dir):
    """The same at the REML variances of the three intercepts."""
    return fit_crossed_reml(V.ratings(spark, sf_dir), "value", _with_rank(), "partid", "sent_pair_id", "verb_id")


@query("lmm_crossed_plain")
def lmm_crossed_plain(spark, sf_dir):
    """Rating on class and construct with rater, pair and verb intercepts, without frequency."""
    return M.fit_crossed(V.ratings(spark, sf_dir), "value", class_by_construct(), "partid", "sent_pair_id", "verb_id")


@query("lmm_random_slopes")
def lmm_random_slopes(spark, sf_dir):
    """Slopes of class, construct and their product per rater, of construct per pair."""
    terms = _with_rank()
    names = [n for n, _ in class_by_construct()]
    construct = [n for n, _ in D.factor("construct", V.CONSTRUCTS)]
    return fit_slopes(
        V.ratings(spark, sf_dir), "value", terms, ("partid", names), ("sent_pair_id", construct)
    )
