"""Mixed models with crossed random intercepts, fitted from level totals; nested ones are in ``nested``.

Crossed intercepts (raters x pairs in verbs): variances from within-group sums of squares,
then fixed effects from the mixed-model equations, solved by alternating between the
raters and the (fixed effects, pairs, verbs) block, which has a closed form.  Level tables
stay distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairlab.functions.design import Term
from pairlab.operators.nested import Centre, coefficient_rows, fit_nested, nested_cross_products  # noqa: F401
from pairlab.operators.ols import moments
from pairlab.sources.staging import Scratch, stage

def _centre(df: DataFrame, response: str, terms: Sequence[Term]) -> Centre:
    """Means and cross products of all complete rows: p x p numbers."""
    row = moments(df, response, terms).first()
    return Centre.of(row["n"], row["means"], row["covariances"])


def _centred_rows(df: DataFrame, response: str, terms: Sequence[Term], centre: Centre, levels: Mapping[str, str]) -> DataFrame:
    """Complete rows as (levels, w1..wp centred terms, wy centred response)."""
    names = [*[f"w{i + 1}" for i in range(len(terms))], "wy"]
    raw = df.select(
        *[F.col(c).alias(a) for a, c in levels.items()],
        *[c.cast("double").alias(n) for n, (_, c) in zip(names, terms, strict=False)], F.col(response).cast("double").alias("wy"),
    ).dropna(subset=names)
    return raw.select(*levels, *[(F.col(n) - F.lit(float(m))).alias(n) for n, m in zip(names, centre.means, strict=True)])


def _fold(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns])


def result_schema(extra: Sequence[str]) -> StructType:
    schema = StructType().add("term", "string")
    for name in ("estimate", "std_error", "df", "t_value", "p_value", *extra):
        schema = schema.add(name, "double")
    return schema


# --- crossed intercepts ------------------------------------------------------------

FACTORS = ("rater", "pair", "verb")


@dataclass
class Crossed:
    """Level totals of a crossed design, staged."""

    centre: Centre
    terms: Sequence[Term]
    names: list[str]
    cells: DataFrame
    raters: DataFrame
    pairs: DataFrame
    n_raters: int
    n_pairs: int

    @classmethod
    def build(
        cls, df: DataFrame, response: str, terms: Sequence[Term], rater: str, pair: str, verb: str,
        keep: Callable[[DataFrame, str], DataFrame] = stage, keep_by_pair: Callable[[DataFrame, str, str], DataFrame] | None = None,
    ) -> Crossed:
        """Fold rows to (rater, pair) cells once; every later pass reads counts from them.

        With ``keep_by_pair`` cells and pairs are staged in buckets of pairs, so that passes don't shuffle the cells.
        """
        by_pair = keep_by_pair or (lambda table, label, key: keep(table, label))
        df = df.dropna(subset=[rater, pair, verb])
        centre = _centre(df, response, terms)
        names = [*[f"w{i + 1}" for i in range(len(terms))], "wy"]
        rows = _centred_rows(df, response, terms, centre, {"rater": rater, "pair": pair, "verb": verb})
        cells = by_pair(_fold(rows, ["rater", "pair", "verb"], names), "cells", "pair")
        totals = [F.sum(c).alias(c) for c in ("n", *names)]
        raters = keep(cells.groupBy("rater").agg(*totals), "raters")
        pairs = by_pair(cells.groupBy("pair", "verb").agg(*totals), "pairs", "pair")
        return cls(centre, terms, names, cells, raters, pairs, raters.count(), pairs.count())

    def moment_table(self) -> DataFrame:
        """Within-group sums of squares and their expectation's coefficients, four rows.

        Row f has SSW_f of the least-squares residuals and what each variance component adds
        to its expectation.  Coefficients are sums of squared counts over counts.
        """
        kept, gram = self.centre.kept, self.centre.gram()
        beta = np.linalg.solve(gram[1:-1, 1:-1], gram[1:-1, -1]) if kept else np.zeros(0)
        rss = float(gram[-1, -1] - gram[1:-1, -1] @ beta)
        n = self.centre.n
        residual = F.col("wy")
        for b, j in zip(beta, kept):
            residual = residual - F.lit(float(b)) * F.col(f"w{j + 1}")

        def squares(table: DataFrame) -> DataFrame:
            return table.agg(
                F.sum(residual * residual / F.col("n")).alias("between"),
                F.count(F.lit(1)).alias("levels"),
                F.sum(F.col("n") * F.col("n")).alias("n2"),
            )

        def overlap(counts: DataFrame, level: str) -> DataFrame:
            per_level = counts.groupBy(level).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("s"))
            return per_level.agg(F.sum("s").alias("s"))

        verbs = self.pairs.groupBy("verb").agg(*[F.sum(c).alias(c) for c in ("n", *self.names)])
        by_verb = self.cells.groupBy("rater", "verb").agg(F.sum("n").alias("n"))
        tables = {"rater": self.raters, "pair": self.pairs, "verb": verbs}
        overlaps = {
            ("rater", "pair"): overlap(self.cells, "rater"), ("pair", "rater"): overlap(self.cells, "pair"),
            ("rater", "verb"): overlap(by_verb, "rater"), ("verb", "rater"): overlap(by_verb, "verb"),
            ("verb", "pair"): overlap(self.pairs, "verb"),
        }
        parts = [squares(t).select(F.lit(f).alias("f"), F.lit("").alias("h"), "between", F.col("levels").cast("double").alias("levels"), F.col("n2").cast("double").alias("s")) for f, t in tables.items()]
        parts += [o.select(F.lit(f).alias("f"), F.lit(h).alias("h"), F.lit(0.0).alias("between"), F.lit(0.0).alias("levels"), "s") for (f, h), o in overlaps.items()]
        got = {(r["f"], r["h"]): r for r in reduce(lambda a, b: a.unionAll(b), parts).collect()}
        rows = []
        for f in FACTORS:
            own = got[(f, "")]
            coefficients = [
                0.0 if h == f else float(n) - (float(n) if (f, h) == ("pair", "verb") else got[(f, h)]["s"])
                for h in FACTORS
            ]
            rows.append((f, rss - own["between"], int(own["levels"]), *coefficients, float(n) - own["levels"]))
        rows.append(("none", rss, 1, *[float(n) - got[(h, "")]["s"] / n for h in FACTORS], float(n) - 1))
        return self.cells.sparkSession.createDataFrame(
            rows,
            "grouping string, ssw double, n_levels bigint, coef_rater double, coef_pair double, "
            "coef_verb double, coef_error double",
        )


def solve_moments(table: Sequence[Sequence[float]]) -> np.ndarray:
    """Variances (rater, pair, verb, error) from (ssw, coefficients...) rows; none negative.

    A component that would be negative is set to zero and the rest are solved again by
    least squares, each equation scaled by its degrees of freedom.
    """
    values = np.asarray(table, dtype=float)
    scale = np.maximum(values[:, 4], 1.0)
    left, right = values[:, 1:] / scale[:, None], values[:, 0] / scale
    free = [0, 1, 2, 3]
    while True:
        solved = np.zeros(4)
        solved[free] = np.linalg.lstsq(left[:, free], right, rcond=None)[0]
        negative = [k for k in free if k != 3 and solved[k] < 0]
        if not negative:
            return solved
        free.remove(min(negative, key=lambda k: solved[k]))


def _sum_products(left: Sequence[str], right: Sequence[str], weight: str = "1", name: str = "s") -> list[Column]:
    """sum(weight * left_i * right_k) for every i and k, as ``name``i_k."""
    return [F.expr(f"sum({weight} * {a} * {c}) AS {name}{i}_{k}") for i, a in enumerate(left) for k, c in enumerate(right)]


def _matrix(row, height: int, width: int, name: str = "s") -> np.ndarray:
    return np.array([[row[f"{name}{i}_{k}"] for k in range(width)] for i in range(height)])


def _number(value: float) -> str:
    return f"({float(value)!r}D)"


def fit_crossed(
    df: DataFrame, response: str, terms: Sequence[Term], rater: str, pair: str, verb: str,
    variances: Sequence[float] | None = None, sweeps: int = 2000, tolerance: float = 1e-6,
    design: Crossed | None = None,
) -> DataFrame:
    """``response ~ terms + (1 | rater) + (1 | pair) + (1 | verb)``: coefficients and variances.

    Right-hand sides for the response and for every column of the fixed-effect covariance
    are swept together.  A sweep reads the (rater, pair, n) cells twice; sums over a hot
    rater or pair combine on the map side, and level tables join by their known size.  A fit that has
    not settled to ``tolerance`` after ``sweeps`` sweeps fails.
    """
    with Scratch(df.sparkSession) as scratch:
        d = design or Crossed.build(df, response, terms, rater, pair, verb, scratch.stage, scratch.stage_bucketed)
        return _sweep_crossed(d, scratch, variances, sweeps, tolerance)


def _sweep_crossed(
    d: Crossed, scratch: Scratch, variances: Sequence[float] | None, sweeps: int, tolerance: float
) -> DataFrame:
    terms, spark = d.terms, scratch.spark
    if variances is None:
        variances = solve_moments([[r["ssw"], r["coef_rater"], r["coef_pair"], r["coef_verb"], r["coef_error"]] for r in d.moment_table().collect()])
    vr, vp, vv, ve = (float(v) for v in variances)
    tr, tp, tv = vr / ve, vp / ve, vv / ve
    centre, p = d.centre, d.centre.size
    sides = p + 1
    x = ["n", *[f"w{j + 1}" for j in centre.kept]]  # column totals of [1, kept terms]
    b = [f"b{k}" for k in range(sides)]
    z = [f"z{k}" for k in range(sides)]
    gram = centre.gram()
    xx, xy = gram[:-1, :-1], gram[:-1, -1]
    # Right-hand sides in the order: response, then one unit vector per coefficient.
    fx = np.column_stack([xy, np.eye(p)])
    # 1 / (1 + n θ_pair) and θ_pair / (1 + n θ_pair) of a pair; θ_verb / (1 + θ_verb w) of a verb.
    u, q = f"(1 / (1 + n * {_number(tp)}))", f"({_number(tp)} / (1 + n * {_number(tp)}))"
    weight = f"({_number(tv)} / (1 + {_number(tv)} * vw))"

    def by_verb(table: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
        folded = [F.expr(f"sum({u} * {c}) AS v_{c}") for c in columns]
        return table.groupBy("verb").agg(F.expr(f"sum(n * {u}) AS vw"), *folded, *more)

    def absorbed_sums(verbs: DataFrame, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
        """X'Z M⁻¹ Z'(right) of the nested block from verb rows that carry the within-pair sums."""
        sums = [
            F.expr(f"sum(s{i}_{k} + {weight} * v_{a} * v_{c}) AS s{i}_{k}")
            for i, a in enumerate(left) for k, c in enumerate(right)
        ]
        return _matrix(verbs.agg(*sums).first(), len(left), len(right))

    # X'V⁻¹X for the nested block alone, fixed over the sweeps.
    solve_fixed = np.linalg.inv(xx - absorbed_sums(by_verb(d.pairs, x, *_sum_products(x, x, q)), x, x))

    incidence = d.cells.select("rater", "pair", "n")
    response_side = ["wy", *["0D"] * p]
    effects = explained = beta = None
    for _ in range(sweeps):
        scratch.next_round()
        # Pair-level right-hand sides, with the raters' current effects taken out.
        if effects is None:
            sides_table = d.pairs.selectExpr("pair", "verb", *x, *[f"{c} AS {n}" for c, n in zip(response_side, z)])
            fx_now = fx
        else:
            taken = incidence.join(effects.select("rater", *b), "rater").groupBy("pair").agg(
                *[F.expr(f"sum(n * {c}) AS t{k}") for k, c in enumerate(b)]
            )
            sides_table = scratch.stage(
                d.pairs.join(taken, "pair").selectExpr(
                    "pair", "verb", *x, *[f"{c} - t{k} AS {z[k]}" for k, c in enumerate(response_side)]
                ),
                "sides",
            )
            fx_now = fx - explained
        verbs = by_verb(sides_table, [*x, *z], *_sum_products(x, z, q))
        new_beta = solve_fixed @ (fx_now - absorbed_sums(verbs, x, z))

        def less_fixed(column: str, k: int, prefix: str = "") -> str:
            fitted = " + ".join(f"{_number(new_beta[i, k])} * {prefix}{c}" for i, c in enumerate(x))
            return f"({column} - ({fitted}))"

        # Closed-form pair and verb effects, then the raters given those.
        verb_effects = by_verb(sides_table, [*x, *z]).selectExpr(
            "verb", *[f"{weight} * {less_fixed(f'v_{c}', k, 'v_')} AS e{k}" for k, c in enumerate(z)]
        )
        item = sides_table.join(verb_effects, "verb").selectExpr(
            "pair", *[f"e{k} + {q} * ({less_fixed(c, k)} - n * e{k}) AS e{k}" for k, c in enumerate(z)]
        )
        seen = incidence.join(item, "pair").groupBy("rater").agg(
            *[F.expr(f"sum(n * e{k}) AS u{k}") for k in range(sides)]
        )
        shrink = f"({_number(tr)} / (1 + n * {_number(tr)}))"
        raw = scratch.stage(
            d.raters.join(seen, "rater").selectExpr(
                "rater", *x, *[f"{shrink} * {less_fixed(f'({f} - u{k})', k)} AS {b[k]}" for k, f in enumerate(response_side)]
            ),
            "rater-effects",
        )
        # The solution's effects are known to add up to 0, or to -θ for the intercept's side.
        sums = raw.agg(*[F.sum(c).alias(c) for c in (*x, *b)], *_sum_products(x, b)).first()
        wanted = [0.0, -tr, *[0.0] * (p - 1)]
        lift = [(w - sums[c]) / d.n_raters for w, c in zip(wanted, b)]
        explained = _matrix(sums, p, sides) + np.outer([sums[c] for c in x], lift)
        effects = raw.selectExpr("rater", *x, *[f"{c} + {_number(v)} AS {c}" for c, v in zip(b, lift)])
        done = beta is not None and _settled(beta, new_beta, xx, tolerance)
        beta = new_beta
        if done or tr == 0.0:
            break
    else:
        raise RuntimeError(f"not settled after {sweeps} sweeps")
    covariance = beta[:, 1:] * ve
    covariance = (covariance + covariance.T) / 2
    rows = coefficient_rows([n for n, _ in terms], centre, beta[:, 0], covariance, None, vr, vp, vv, ve)
    return spark.createDataFrame(rows, result_schema(["var_rater", "var_pair", "var_verb", "var_residual"]))


def _settled(old: np.ndarray, new: np.ndarray, xx: np.ndarray, tolerance: float) -> bool:
    """Has every right-hand side moved less than ``tolerance`` of its size?"""
    scale = np.sqrt(np.diag(xx))[:, None]
    change, size = np.abs(scale * (new - old)).max(axis=0), np.abs(scale * new).max(axis=0)
    return bool(np.all(change <= tolerance * np.maximum(size, 1e-300)))
