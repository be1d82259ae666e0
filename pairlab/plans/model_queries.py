"""Registered queries: least squares, mixed models, plot data."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import design as D
from pairlab.functions.exprs import level_position
from pairlab.operators import ols as O
from pairlab.operators import plotdata as P
from pairlab.operators.qr import fit_qr
from pairlab.operators.quantiles import grouped_quantiles
from pairlab.operators import ratings as R
from pairlab.operators import joins as J
from pairlab.plans import standin as V
from pairlab.plans.rating_queries import COMBINED_SQL, PAIR_TABLE_SQL, combined_sources, pair_table
from pairlab.plans.registry import query, rounded
from pairlab.sources.staging import stage


def class_by_construct() -> list[D.Term]:
    """Terms of ``classification * construct``."""
    return D.interaction(D.factor("classification", V.CLASSES), D.factor("construct", V.CONSTRUCTS))


# --- least squares -----------------------------------------------------------------


@query("ols_interaction", f"""
with {V.RATINGS_SQL}, cell as (
  select avg(value) filter (where classification = 'alternating' and construct = 'DOsentence') as m00,
         avg(value) filter (where classification <> 'alternating' and construct = 'DOsentence') as m10,
         avg(value) filter (where classification = 'alternating' and construct = 'PDsentence') as m01,
         avg(value) filter (where classification <> 'alternating' and construct = 'PDsentence') as m11
  from ratings)
select '(Intercept)' as term, round(m00, 6) as estimate from cell
union all select 'classificationnon-alternating', round(m10 - m00, 6) from cell
union all select 'constructPDsentence', round(m01 - m00, 6) from cell
union all select 'classificationnon-alternating:constructPDsentence', round(m11 - m10 - m01 + m00, 6) from cell""")
def ols_interaction(spark, sf_dir):
    fitted = O.fit(V.ratings(spark, sf_dir), "value", class_by_construct())
    return rounded(O.coefficients(fitted).select("term", "estimate"), "estimate")


_CELL = "case when classification = 'alternating' then 0 else 2 end + case when construct = 'DOsentence' then 0 else 1 end"


@query("ols_interaction_summary", f"""
with {V.RATINGS_SQL}, r as (
  select value as y, {_CELL} as cell from ratings), c as (
  select cell, count(*) as n, avg(y) as m from r group by cell), e as (
  select y - m as e from r join c using (cell)), s as (
  select sum(e * e) as rss, count(*) as n, quantile_cont(e, [0, 0.25, 0.5, 0.75, 1]) as q from e), t as (
  select rss, n, q, rss / (n - 4) as s2, (select sum((y - (select avg(y) from r)) * (y - (select avg(y) from r))) from r) as tss from s), w as (
  select max(m) filter (cell = 0) as m0, max(m) filter (cell = 1) as m1, max(m) filter (cell = 2) as m2, max(m) filter (cell = 3) as m3,
         max(n) filter (cell = 0) as n0, max(n) filter (cell = 1) as n1, max(n) filter (cell = 2) as n2, max(n) filter (cell = 3) as n3 from c), terms as (
  select '(Intercept)' as term, m0 as estimate, 1 / n0 as v from w union all
  select 'classificationnon-alternating', m2 - m0, 1 / n0 + 1 / n2 from w union all
  select 'constructPDsentence', m1 - m0, 1 / n0 + 1 / n1 from w union all
  select 'classificationnon-alternating:constructPDsentence', m3 - m2 - m1 + m0, 1 / n0 + 1 / n1 + 1 / n2 + 1 / n3 from w)
select term, round(estimate, 6) as estimate, round(sqrt(s2 * v), 6) as std_error, round(estimate / sqrt(s2 * v), 6) as t_value, n,
       round(sqrt(s2), 6) as sigma, round(1 - rss / tss, 6) as r_squared, round(1 - rss / tss * (n - 1) / (n - 4), 6) as adj_r_squared,
       round((tss - rss) / 3 / s2, 6) as f_value, round(q[1], 6) as res_min, round(q[2], 6) as res_q1, round(q[3], 6) as res_median,
       round(q[4], 6) as res_q3, round(q[5], 6) as res_max
from terms, t""")
def ols_interaction_summary(spark, sf_dir):
    """The whole summary of rating on class by construct: errors, fit statistics and residual quartiles."""
    rows = stage(V.ratings(spark, sf_dir).select("classification", "construct", "value"), "ratings")
    terms = class_by_construct()
    fitted = stage(O.fit(rows, "value", terms), "fits")
    residuals = O.with_residuals(rows, fitted, "value", terms)
    names = ["res_min", "res_q1", "res_median", "res_q3", "res_max"]
    spread = grouped_quantiles(residuals.withColumn("whole", F.lit(1)), ["whole"], "residual", (0, 0.25, 0.5, 0.75, 1), names)
    statistics = ["n", "sigma", "r_squared", "adj_r_squared", "f_value"]
    table = fitted.select(F.lit(1).alias("whole"), *statistics, F.inline("terms")).join(spread, "whole").drop("whole", "p_value")
    return rounded(table, "estimate", "std_error", "t_value", *statistics[1:], *names)


@query("ols_close_terms", """
with r as (
  select cast(l_quantity as double) as x, cast(l_discount as double) as z, cast(l_extendedprice as double) / 1000 as y from lineitem), s as (
  select regr_sxx(y, x) as xx, regr_sxx(y, z) as zz, regr_sxy(z, x) as xz, regr_sxy(y, x) as xy, regr_sxy(y, z) as zy from r), b as (
  select (xy * zz - zy * xz) / (xx * zz - xz * xz) as bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) as bz from s)
select 'quantity' as term, round(bx - bz * 1000, 3) as estimate from b union all select 'near', round(bz * 1000, 3) from b""")
def ols_close_terms(spark, sf_dir):
    """Price on quantity and on quantity plus a thousandth of the discount: terms whose cross products hardly differ."""
    items = V.table(spark, sf_dir, "lineitem")
    quantity, discount = (F.col(c).cast("double") for c in ("l_quantity", "l_discount"))
    rows = items.select(quantity.alias("quantity"), (quantity + discount / 1000).alias("near"), (F.col("l_extendedprice").cast("double") / 1000).alias("price"))
    fitted = fit_qr(rows, "price", D.numeric("quantity") + D.numeric("near"))
    return rounded(O.coefficients(fitted).where("term <> '(Intercept)'").select("term", "estimate"), "estimate", places=3)


def _human_and_model(spark, sf_dir):
    """Human and model difference of every pair and model."""
    human = V.ratings(spark, sf_dir).groupBy("sent_pair_id").agg(
        (F.avg(F.when(F.col("construct") == "PDsentence", F.col("value")))
         - F.avg(F.when(F.col("construct") == "DOsentence", F.col("value")))).alias("human_sdiff")
    )
    scored = V.score_pairs(spark, sf_dir)
    diffs = scored.select(
        "model", *V.PAIR_COLUMNS, ((F.col("PD_score") - F.col("DO_score")) / 1000).alias("diff")
    )
    return J.attach(diffs, human, ["sent_pair_id"], null_keys_match=False)


_HUMAN_SQL = V.RATINGS_SQL + """, human as (
  select sent_pair_id, avg(value) filter (where construct = 'PDsentence')
                     - avg(value) filter (where construct = 'DOsentence') as human_sdiff
  from ratings group by sent_pair_id), score_pairs as (
  select model, sent_pair_id, classification, io, frequency_rank,
         (avg(price) filter (where construct = 'PDsentence')
        - avg(price) filter (where construct = 'DOsentence')) / 1000 as diff
  from ratings group by all), joined as (
  select s.*, h.human_sdiff from score_pairs s left join human h on s.sent_pair_id = h.sent_pair_id)"""


@query("ols_simple_by_model", f"""
with {_HUMAN_SQL}
select model, cast(regr_count(diff, human_sdiff) as bigint) as n, round(regr_slope(diff, human_sdiff), 6) as slope,
       round(regr_intercept(diff, human_sdiff), 6) as intercept, round(regr_r2(diff, human_sdiff), 6) as r_squared
from joined group by model""")
def ols_simple_by_model(spark, sf_dir):
    fitted = O.simple_regressions(_human_and_model(spark, sf_dir), "diff", "human_sdiff", ["model"])
    return rounded(fitted.select("model", "n", "slope", "intercept", "r_squared"), "slope", "intercept", "r_squared")


@query("corr_by_model", f"""
with {_HUMAN_SQL} select model, round(corr(diff, human_sdiff), 6) as correlation from joined group by model""")
def corr_by_model(spark, sf_dir):
    both = _human_and_model(spark, sf_dir)
    return rounded(O.correlations(both, "diff", "human_sdiff", ["model"]), "correlation")


@query("ols_summary", f"""
with {_HUMAN_SQL}, xy as (
  select model, diff as y, human_sdiff as x from joined where diff is not null and human_sdiff is not null), s as (
  select model, count(*) as n, regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_sxx(y, x) as sxx,
         regr_syy(y, x) as syy, regr_sxy(y, x) as sxy, avg(x) as mx from xy group by model), f as (
  select *, (syy - sxy * sxy / sxx) as rss, (syy - sxy * sxy / sxx) / (n - 2) as s2 from s), e as (
  select xy.model, quantile_cont(y - a - b * x, [0, 0.25, 0.5, 0.75, 1]) as q
  from xy join f on xy.model = f.model group by xy.model), rows as (
  select model, '(Intercept)' as term, a as estimate, sqrt(s2 * (1.0 / n + mx * mx / sxx)) as std_error from f
  union all select model, 'human_sdiff', b, sqrt(s2 / sxx) from f)
select r.model, r.term, round(r.estimate, 6) as estimate, round(r.std_error, 6) as std_error,
       round(r.estimate / r.std_error, 6) as t_value, f.n, round(sqrt(f.s2), 6) as sigma,
       round(1 - f.rss / f.syy, 6) as r_squared,
       round(1 - f.rss / f.syy * (f.n - 1) / (f.n - 2), 6) as adj_r_squared,
       round((f.syy - f.rss) / f.s2, 6) as f_value, round(q[1], 6) as res_min, round(q[2], 6) as res_q1,
       round(q[3], 6) as res_median, round(q[4], 6) as res_q3, round(q[5], 6) as res_max
from rows r join f on r.model = f.model join e on r.model = e.model""")
def ols_summary(spark, sf_dir):
    both = stage(_human_and_model(spark, sf_dir).select("model", "diff", "human_sdiff"), "human-model")
    terms = D.numeric("human_sdiff")
    fitted = stage(O.fit(both, "diff", terms, ["model"]), "fits")
    residuals = O.with_residuals(both, fitted, "diff", terms, ["model"])
    names = ["res_min", "res_q1", "res_median", "res_q3", "res_max"]
    spread = grouped_quantiles(residuals, ["model"], "residual", (0, 0.25, 0.5, 0.75, 1), names)
    statistics = ["n", "sigma", "r_squared", "adj_r_squared", "f_value"]
    table = J.attach(fitted.select("model", *statistics, F.inline("terms")), spread, ["model"])
    table = table.select("model", "term", "estimate", "std_error", "t_value", *statistics, *names)
    return rounded(table, *[c for c in table.columns if c not in ("model", "term", "n")])


# --- plot data ---------------------------------------------------------------------


@query("plot_points", f"""
with {PAIR_TABLE_SQL}
select classification, io, cast(-frequency_rank as double) as x, round(human_zdiff, 6) as y from pair_table""")
def plot_points(spark, sf_dir):
    return rounded(P.points(pair_table(spark, sf_dir), -F.col("frequency_rank"), "human_zdiff", "classification", "io"), "y")


@query("plot_lm_smooth", f"""
with {COMBINED_SQL}, xy as (
  select source, classification, -frequency_rank as x, diff as y from combined where diff is not null), s as (
  select source, classification, count(*) as n, regr_slope(y, x) as b, avg(x) as mx, avg(y) as my,
         regr_sxx(y, x) as sxx, regr_sxy(y, x) as sxy, regr_syy(y, x) as syy, min(x) as lo, max(x) as hi
  from xy group by all), g as (
  select *, unnest(range(0, 80)) as step, (syy - sxy * sxy / sxx) / (n - 2) as s2 from s), p as (
  select *, lo + (hi - lo) * step / 79.0 as x from g)
select source, classification, case source when 'Human' then 1 when 'diff_A' then 2 when 'diff_N' then 3
         when 'diff_R' then 4 end as facet_ord,
       cast(step as integer) as step, round(x, 6) as x, round(my + b * (x - mx), 6) as y,
       round(sqrt(s2 * (1.0 / n + (x - mx) * (x - mx) / sxx)), 6) as se
from p""")
def plot_lm_smooth(spark, sf_dir):
    xy = P.points(combined_sources(spark, sf_dir), -F.col("frequency_rank"), "diff", "source", "classification")
    smooth = P.linear_smooth(xy, ["source", "classification"])
    order = level_position("source", ["Human", "diff_A", "diff_N", "diff_R"]).alias("facet_ord")
    return rounded(smooth.select("source", "classification", order, "step", "x", "y", "se"), "x", "y", "se")


_BOX_SQL = V.RATINGS_SQL + """, z as (
  select classification, construct, sent_pair_id,
         (value - avg(value) over w) / nullif(stddev_samp(value) over w, 0) as zscores
  from ratings window w as (partition by partid)), q as (
  select classification, construct, quantile_cont(zscores, [0.25, 0.5, 0.75]) as q from z group by all), f as (
  select *, q[1] - 1.5 * (q[3] - q[1]) as lo, q[3] + 1.5 * (q[3] - q[1]) as hi from q), j as (
  select z.*, f.q, f.lo, f.hi from z join f on z.classification = f.classification and z.construct = f.construct
  where zscores is not null)"""


def _rater_z(spark, sf_dir):
    z = R.standardise(V.ratings(spark, sf_dir), ["partid"], "value")
    return z.select("classification", "construct", "sent_pair_id", "zscores")


@query("plot_box", f"""
with {_BOX_SQL}
select classification, construct, round(min(zscores) filter (where zscores between lo and hi), 6) as whisker_low,
       round(any_value(q)[1], 6) as lower, round(any_value(q)[2], 6) as middle, round(any_value(q)[3], 6) as upper,
       round(max(zscores) filter (where zscores between lo and hi), 6) as whisker_high,
       count(*) filter (where zscores not between lo and hi) as n_outliers
from j group by classification, construct""")
def plot_box(spark, sf_dir):
    boxes = P.boxes(_rater_z(spark, sf_dir), ["classification", "construct"], "zscores")
    return rounded(boxes, "whisker_low", "lower", "middle", "upper", "whisker_high")


_OUTLIER_SQL = V.SCORE_PAIRS_SQL + """, d as (
  select model, classification, sent_pair_id, "PD_score" - "DO_score" as diff from score_pairs), q as (
  select model, classification, quantile_cont(diff, [0.25, 0.75]) as q from d group by all)"""


@query("plot_box_outliers", f"""
with {_OUTLIER_SQL}
select d.model, d.classification, sent_pair_id, round(diff, 6) as diff
from d join q on d.model = q.model and d.classification = q.classification
where diff not between q[1] - 1.5 * (q[2] - q[1]) and q[2] + 1.5 * (q[2] - q[1])""")
def plot_box_outliers(spark, sf_dir):
    scored = V.score_pairs(spark, sf_dir)
    diffs = scored.select("model", "classification", "sent_pair_id", (F.col("PD_score") - F.col("DO_score")).alias("diff"))
    return rounded(P.box_outliers(diffs, ["model", "classification"], "diff"), "diff")


@query("plot_bar_range", f"""
with {COMBINED_SQL}
select source, io, classification, round(min(diff), 6) as low, round(max(diff), 6) as high
from combined group by all""")
def plot_bar_range(spark, sf_dir):
    bars = P.ranges(combined_sources(spark, sf_dir), ["source", "io", "classification"], "diff")
    return rounded(bars, "low", "high")


@query("plot_hist", f"""
with {V.SCORE_PAIRS_SQL}, d as (
  select cast(-frequency_rank as double) as x, "PD_score" - "DO_score" as diff, classification from score_pairs), k as (
  select x from d where classification = 'alternating' and diff > (select avg(diff) from d)), b as (
  select min(x) as lo, (max(x) - min(x)) / 29.0 as w from k)
select i as bin, round(lo + i * w, 6) as centre, count(x) as n
from b, range(0, 30) t(i) left join k on cast(ceil((x - (select lo from b)) / (select w from b) - 0.5) as bigint) = i
group by i, lo, w""")
def plot_hist(spark, sf_dir):
    scored = V.score_pairs(spark, sf_dir)
    diffs = scored.select("classification", "frequency_rank", (F.col("PD_score") - F.col("DO_score")).alias("diff"))
    kept = R.above_overall_mean(stage(diffs, "pair-differences"), "diff").where(F.col("classification") == "alternating")
    kept = stage(kept.select((-F.col("frequency_rank")).alias("x")), "histogram")
    return rounded(P.histogram(kept, "x"), "centre")


@query("plot_facet_range", f"""
with {COMBINED_SQL}
select source, round(min(diff), 6) as low, round(max(diff), 6) as high from combined group by all""")
def plot_facet_range(spark, sf_dir):
    return rounded(P.ranges(combined_sources(spark, sf_dir), ["source"], "diff"), "low", "high")
