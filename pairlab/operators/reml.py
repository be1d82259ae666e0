"""REML variances of crossed intercepts, matrix-free.

``response ~ terms + (1 | rater) + (1 | pair) + (1 | verb)``, pairs nested in verbs.  Variances follow average-information
steps.  What a step needs are solutions of the mixed-model equations for several right-hand sides: the
response, probes on the raters, and the working variates of the average information.  Fixed effects, pairs and verbs
are eliminated in closed form, and preconditioned conjugate gradients run on the raters' equations that remain, all right-hand
sides together and from the last step's solutions, until they are solved.

The traces of pairs and verbs are known but for a part that goes through the raters, so that probes on raters give all three.  Probes
are random signs; if there would be as many as raters, they are the raters themselves, and traces are exact.  How many are
taken does not depend on the size of a design but on what they add to the variances' errors: a fit settles with ``SETTLED`` of them, or
more until that is at most ``SHARE`` of the standard error of each variance.

Cells lie in blocks of whole verbs and an iteration is one job (``reml_blocks``).  With too many raters or cells of a verb for that,
level tables stay distributed and the driver sees sums of products only; probes, equations and tolerances are the same.

An intercept is always in the model, so each trace matrix has the vector of ones in its kernel; probes are centred and
scaled to their length, which makes their estimate exact for balanced designs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.design import Term
from pairlab.operators.mixed import FACTORS, Crossed, _matrix, _number, _sum_products, _sweep_crossed, result_schema, solve_moments  # noqa: F401
from pairlab.operators.nested import coefficient_rows
from pairlab.operators.reml_blocks import ITERATIONS, Blocks
from pairlab.operators.reml_blocks import TOLERANCE as SOLVED
from pairlab.sources.staging import Scratch

#: Of ``WholeDesign``, which no fit takes: cells that it is meant for, products of cells and vectors that its exact traces may take, signs a factor.
WHOLE, TRACE_WORK, PROBES_WHOLE = 1_000_000, 50_000_000, 32
#: Probes that a fit climbs with, those that it settles with at least, and the most that they may add to a variance's standard error, as a share of it.
PROBES, SETTLED, SHARE = 12, 32, 0.01
#: Steps before a fit fails; it is settled when no variance moves by more than this share of itself.
STEPS, TOLERANCE = 40, 1e-4


@dataclass
class Sides:
    """Right-hand sides Z'ρ and X'ρ of several data vectors ρ: columns f0.. of raters and pairs, and a p x k matrix."""

    raters: DataFrame
    pairs: DataFrame
    fixed: np.ndarray

    @property
    def count(self) -> int:
        return self.fixed.shape[1]


@dataclass
class Solved:
    """Solutions: fixed effects (p x k), raters' a0.., pairs' own b0.. and verbs' c0.. effects."""

    beta: np.ndarray
    raters: DataFrame
    pairs: DataFrame


def score_and_information(n: int, p: int, v: np.ndarray, ypy: float, squares: np.ndarray, traces: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the REML log-likelihood in (rater, pair, verb, residual), and its average information.

    ``squares`` are the factors' sums of squared effects, ``traces`` those of Z_f'P Z_f, and ``products`` (3 x 4) each factor's
    s_f = Z_f'P y times the effects that the working variates (Z_f s_f of each factor, and P y) have on it; P is in
    units of the residual variance.
    """
    theta, s2 = v[:3] / v[3], float(v[3])
    residual = ypy - float((squares / theta).sum())  # |P y|²
    score = np.zeros(4)
    score[:3] = -0.5 * (traces / s2 - squares / theta**2 / s2**2)
    score[3] = -0.5 * ((n - p - float(theta @ traces)) / s2 - residual / s2**2)
    information = np.zeros((4, 4))
    information[:3] = products / theta[:, None]
    information[3, :3] = information[:3, 3]
    # P y: its square less what effects explain of it
    information[3, 3] = residual - float(products[:, 3].sum())
    return score, (information + information.T) / 4 / s2**3


def probed(m: int, products: np.ndarray, sums: np.ndarray) -> tuple[float, float]:
    """Trace of a matrix with the ones in its kernel, from quadratic forms of sign vectors with these sums; and its variance."""
    each = (m - 1) * products / np.maximum(m - sums**2 / m, 1e-9)
    return float(each.mean()), float(each.var(ddof=1)) / len(each) if len(each) > 1 else 0.0


def traced(m: int, known: np.ndarray, forms: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Traces from their known parts and from each probe's forms (factors x probes); and the covariance that probing adds.

    ``sums`` are those of the probes, over m raters; as many probes as raters are the raters themselves.
    """
    if forms.shape[1] == m:
        return known + forms.sum(axis=1), np.zeros((3, 3))
    each = (m - 1) * forms / np.maximum(m - sums**2 / m, 1e-9)
    return known + each.mean(axis=1), np.cov(each) / each.shape[1]


def probe_noise(v: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Covariance of the score that the traces' errors, of covariance ``spread``, add."""
    by_trace = np.vstack([-0.5 / v[3] * np.eye(3), 0.5 / v[3] * v[:3] / v[3]])
    return by_trace @ spread @ by_trace.T


class WholeDesign:
    """A design held on arrays, with probes of each factor: what steps are checked against."""

    def __init__(self, rater: np.ndarray, pair: np.ndarray, verb: np.ndarray, totals: np.ndarray, gram: np.ndarray, probes: int = PROBES_WHOLE, seed: int = 11):
        # totals of each cell: count, kept terms, response
        self.rater, self.pair = (np.unique(x, return_inverse=True)[1] for x in (rater, pair))
        first = np.unique(self.pair, return_index=True)[1]
        self.verb = np.unique(verb[first], return_inverse=True)[1]
        self.m = np.array([self.rater.max() + 1, len(first), self.verb.max() + 1])
        self.count = totals[:, 0]
        self.r, self.p = (np.column_stack([np.bincount(k, weights=c, minlength=m) for c in totals.T]) for k, m in ((self.rater, self.m[0]), (self.pair, self.m[1])))
        self.gram, self.n = gram, int(round(gram[0, 0]))
        rng = np.random.default_rng(seed)
        self.exact = [int(m) * len(totals) <= TRACE_WORK for m in self.m]
        self.probes = [np.eye(m) if exact else rng.choice([-1.0, 1.0], (m, probes)) for m, exact in zip(self.m, self.exact, strict=True)]
        self.starts: list[np.ndarray | None] = [None, None]

    def _sum(self, by: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(by, weights=c, minlength=size) for c in values.T])

    def to_pairs(self, raters: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(self.pair, weights=self.count * c[self.rater], minlength=self.m[1]) for c in raters.T])

    def to_raters(self, pairs: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(self.rater, weights=self.count * c[self.pair], minlength=self.m[0]) for c in pairs.T])

    def at(self, theta: np.ndarray) -> None:
        x = self.p[:, :-1]
        self.theta, self.u = theta, 1 / (1 + x[:, 0] * theta[1])
        self.vx = self._sum(self.verb, self.m[2], self.u[:, None] * x)
        self.share = theta[2] / (1 + theta[2] * np.bincount(self.verb, weights=self.u * x[:, 0]))
        self.fixed_inverse = np.linalg.inv(self.gram[:-1, :-1] - self._absorbed(x, self.vx))

    def _absorbed(self, right: np.ndarray, verbs: np.ndarray) -> np.ndarray:
        x = self.p[:, :-1]
        return (x * (self.theta[1] * self.u)[:, None]).T @ right + (self.vx * self.share[:, None]).T @ verbs

    def lower(self, z: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.p[:, :-1]
        vz = self._sum(self.verb, self.m[2], self.u[:, None] * z)
        beta = self.fixed_inverse @ (fixed - self._absorbed(z, vz))
        c = self.share[:, None] * (vz - self.vx @ beta)
        b = (self.theta[1] * self.u)[:, None] * (z - x @ beta - x[:, :1] * c[self.verb])
        return beta, b, c

    def solve(self, raters: np.ndarray, pairs: np.ndarray, fixed: np.ndarray, start: np.ndarray | None, tolerance: float = 1e-10, most: int = 200):
        """(β, a, b, c) for the right-hand sides, by the same conjugate gradients, to a tolerance."""
        xr = self.r[:, :-1]
        diagonal = (xr[:, 0] + 1 / self.theta[0])[:, None]
        a = np.zeros_like(raters) if start is None else start

        def rest(beta, b, c):
            return xr @ beta + self.to_raters(b + c[self.verb])

        r = raters - diagonal * a - rest(*self.lower(pairs - self.to_pairs(a), fixed - xr.T @ a))
        d = r / diagonal
        size = (r * d).sum(axis=0)
        least = tolerance**2 * np.maximum((raters**2 / diagonal).sum(axis=0), 1e-300)
        for _ in range(most):
            if (size <= least).all():
                break
            q = diagonal * d - rest(*self.lower(self.to_pairs(d), xr.T @ d))
            step = size / np.maximum((d * q).sum(axis=0), 1e-300)
            a, r = a + step * d, r - step * q
            after = (r * r / diagonal).sum(axis=0)
            d = r / diagonal + after / np.maximum(size, 1e-300) * d
            size = after
        beta, b, c = self.lower(pairs - self.to_pairs(a), fixed - xr.T @ a)
        return beta, a, b, c

    def levels(self, raters: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        xr, xp = self.r[:, :-1], self.p[:, :-1]
        return xr[:, :1] * raters + self.to_raters(pairs), xp[:, :1] * pairs + self.to_pairs(raters), xr.T @ raters + xp.T @ pairs

    def take(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        theta = v[:3] / v[3]
        self.at(theta)
        widths = [s.shape[1] for s in self.probes]
        edge = np.cumsum([1, *widths])
        signs_r = np.hstack([self.probes[0], np.zeros((self.m[0], widths[1] + widths[2]))])
        signs_p = np.hstack([np.zeros((self.m[1], widths[0])), self.probes[1], self.probes[2][self.verb]])
        fr, fp, fx = self.levels(signs_r, signs_p)
        beta, a, b, c = self.solve(np.column_stack([self.r[:, -1], fr]), np.column_stack([self.p[:, -1], fp]), np.column_stack([self.gram[:-1, -1], fx]), self.starts[0])
        self.starts[0] = a
        effects = (a, b, c)
        squares = np.array([(e[:, 0] ** 2).sum() for e in effects])
        ypy = float(self.gram[-1, -1] - self.gram[:-1, -1] @ beta[:, 0] - self.r[:, -1] @ a[:, 0] - self.p[:, -1] @ (b[:, 0] + c[self.verb, 0]))
        forms = [(e[:, edge[f]: edge[f + 1]] * s).sum(axis=0) / theta[f] for f, (e, s) in enumerate(zip(effects, self.probes, strict=True))]
        found = [(float(x.sum()), 0.0) if exact else probed(m, x, s.sum(axis=0)) for m, x, s, exact in zip(self.m, forms, self.probes, self.exact, strict=True)]
        s = [e[:, 0] / t for e, t in zip(effects, theta, strict=True)]
        zero_r, zero_p = np.zeros(self.m[0]), np.zeros(self.m[1])
        fr, fp, fx = self.levels(np.column_stack([s[0], zero_r, zero_r]), np.column_stack([zero_p, s[1], s[2][self.verb]]))
        _, *working = self.solve(np.column_stack([fr, s[0]]), np.column_stack([fp, s[1]]), np.column_stack([fx, np.zeros(len(fx))]), self.starts[1])
        self.starts[1] = working[0]
        products = np.array([one @ w for one, w in zip(s, working, strict=True)])
        score, information = score_and_information(self.n, len(fx), v, ypy, squares, np.array([t for t, _ in found]), products)
        return score, information, probe_noise(v, np.diag([e for _, e in found]))


class Equations:
    """The mixed-model equations at stated variance ratios (rater, pair, verb over residual)."""

    def __init__(self, design: Crossed, ratios: Sequence[float], scratch: Scratch):
        self.d, self.scratch = design, scratch
        self.ratios = [float(r) for r in ratios]
        tr, tp, tv = self.ratios
        self.x = ["n", *[f"w{j + 1}" for j in design.centre.kept]]
        self.u, self.q = f"(1 / (1 + n * {_number(tp)}))", f"({_number(tp)} / (1 + n * {_number(tp)}))"
        self.weight = f"({_number(tv)} / (1 + {_number(tv)} * vw))"
        self.diagonal = f"(n + {_number(1 / tr)})"
        xx = design.centre.gram()[:-1, :-1]
        verbs = self._by_verb(design.pairs, self.x, _sum_products(self.x, self.x, self.q))
        self.fixed_inverse = np.linalg.inv(xx - self._absorbed(verbs, self.x, self.x))

    def _by_verb(self, table: DataFrame, columns: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
        folded = [F.expr(f"sum({self.u} * {c}) AS v_{c}") for c in columns]
        return table.groupBy("verb").agg(F.expr(f"sum(n * {self.u}) AS vw"), *folded, *more)

    def _absorbed(self, verbs: DataFrame, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
        """X'Z M⁻¹ Z'(right) of pairs and verbs, from verb rows that carry the sums within pairs."""
        sums = [F.expr(f"sum(s{i}_{k} + {self.weight} * v_{a} * v_{c}) AS s{i}_{k}") for i, a in enumerate(left) for k, c in enumerate(right)]
        return _matrix(verbs.agg(*sums).first(), len(left), len(right))

    def known_traces(self) -> np.ndarray:
        """Parts of the traces (rater, pair, verb) that don't go through the raters."""
        p, theta, verbs = len(self.x), self.ratios, self._by_verb(self.d.pairs, self.x)
        own = [f"{self.q} * ({c} - n * {self.weight} * v_{c}) AS b{i}" for i, c in enumerate(self.x)]
        pairs = self.d.pairs.select("pair", "verb", *self.x).join(verbs, "verb").selectExpr(f"n * {self.u} - n * {self.u} * n * {self.u} * {self.weight} AS t", *own)
        verbs = verbs.selectExpr(f"vw / (1 + {_number(theta[2])} * vw) AS t", *[f"{self.weight} * v_{c} AS b{i}" for i, c in enumerate(self.x)])
        names = [f"b{i}" for i in range(p)]
        rows = [t.agg(F.sum("t").alias("t"), *_sum_products(names, names)).first() for t in (pairs, verbs)]
        return np.array([0.0, *[r["t"] - float((self.fixed_inverse * _matrix(r, p, p)).sum()) / v**2 for r, v in zip(rows, theta[1:], strict=True)]])

    def of_raters(self, sides: Sides, skip: int) -> DataFrame:
        """Pairs' and verbs' effects p0.., q0.. if the raters' columns behind ``sides``, less the first ``skip``, were all there is."""
        columns = range(skip, sides.count)
        rest = self.d.pairs.select("pair", "verb", *self.x).join(sides.pairs, "pair").selectExpr("pair", "verb", *self.x, *[f"f{k} AS z{k - skip}" for k in columns])
        lower = self._lower(rest, sides.fixed[:, skip:])[1]
        return lower.selectExpr("pair", *[f"b{k - skip} AS p{k}" for k in columns], *[f"c{k - skip} AS q{k}" for k in columns])

    def _less_fixed(self, column: str, beta: np.ndarray, k: int, prefix: str = "") -> str:
        return f"({column} - (" + " + ".join(f"{_number(beta[i, k])} * {prefix}{c}" for i, c in enumerate(self.x)) + "))"

    def _lower(self, sides: DataFrame, fixed: np.ndarray) -> tuple[np.ndarray, DataFrame]:
        """Fixed effects, and pairs with own effects b0.. and their verbs' c0.., given right-hand sides z0.. without the raters."""
        z = [f"z{k}" for k in range(fixed.shape[1])]
        sides = self.scratch.stage(sides, "sides")
        verbs = self.scratch.stage(self._by_verb(sides, [*self.x, *z], _sum_products(self.x, z, self.q)), "verbs")
        beta = self.fixed_inverse @ (fixed - self._absorbed(verbs, self.x, z))
        effects = verbs.selectExpr("verb", *[f"{self.weight} * {self._less_fixed(f'v_{c}', beta, k, 'v_')} AS c{k}" for k, c in enumerate(z)])
        own = [f"{self.q} * ({self._less_fixed(c, beta, k)} - n * c{k}) AS b{k}" for k, c in enumerate(z)]
        return beta, sides.join(effects, "verb").selectExpr("pair", "verb", "n", *own, *[f"c{k}" for k in range(len(z))])

    def _to_pairs(self, raters: DataFrame, names: Sequence[str]) -> DataFrame:
        """Sums over a pair's cells of its raters' columns, as t0.."""
        return self.d.cells.select("rater", "pair", "n").withColumnRenamed("n", "m").join(raters.select("rater", *names), "rater").groupBy("pair").agg(
            *[F.expr(f"sum(m * {c}) AS t{k}") for k, c in enumerate(names)]
        )

    def _to_raters(self, pairs: DataFrame, count: int) -> DataFrame:
        """Sums over a rater's cells of its pairs' effects, as u0.."""
        total = pairs.selectExpr("pair", *[f"b{k} + c{k} AS e{k}" for k in range(count)])
        return self.d.cells.select("rater", "pair", "n").withColumnRenamed("n", "m").join(total, "pair").groupBy("rater").agg(
            *[F.expr(f"sum(m * e{k}) AS u{k}") for k in range(count)]
        )

    def _fixed_of(self, raters: DataFrame, names: Sequence[str]) -> np.ndarray:
        """X'Z of rater columns: one row of p x k sums."""
        return _matrix(raters.agg(*_sum_products(self.x, names)).first(), len(self.x), len(names))

    def _minus_explained(self, raters: DataFrame, column: str, beta: np.ndarray, k: int) -> str:
        return self._less_fixed(f"({column} - u{k})", beta, k)

    def solve(self, sides: Sides, start: DataFrame | None, tolerance: float = SOLVED, most: int = ITERATIONS) -> Solved:
        """Conjugate gradients on the raters' equations, from the effects a0.. of ``start`` or from nothing, until they are solved."""
        count = sides.count
        a, r, d = ([f"{c}{k}" for k in range(count)] for c in "ard")
        f = [f"f{k}" for k in range(count)]
        base = self.d.raters.select("rater", *self.x)
        known = base.join(sides.raters, "rater")
        known = known.join(start.select("rater", *a), "rater") if start is not None else known.selectExpr("*", *[f"0D AS {c}" for c in a])
        known = self.scratch.stage(known, "known")

        def given(raters: DataFrame) -> tuple[np.ndarray, DataFrame]:
            taken = self._to_pairs(raters, a)
            rest = self.d.pairs.select("pair", "verb", *self.x).join(sides.pairs.select("pair", *f), "pair").join(taken, "pair")
            rest = rest.selectExpr("pair", "verb", *self.x, *[f"f{k} - t{k} AS z{k}" for k in range(count)])
            return self._lower(rest, sides.fixed - self._fixed_of(raters, a))

        beta, lower = given(known)
        left = [f"{self._minus_explained(known, f'(f{k} - {self.diagonal} * a{k})', beta, k)} AS r{k}" for k in range(count)]
        state = known.join(self._to_raters(lower, count), "rater").selectExpr("rater", *self.x, *a, *left)
        state = self.scratch.stage(state.selectExpr("*", *[f"r{k} / {self.diagonal} AS d{k}" for k in range(count)]), "gradient")
        size = state.agg(*[F.expr(f"sum(r{k} * d{k}) AS v{k}") for k in range(count)]).first()
        size = np.array([size[f"v{k}"] for k in range(count)])
        whole = known.agg(*[F.expr(f"sum(f{k} * f{k} / {self.diagonal}) AS v{k}") for k in range(count)]).first()
        whole = np.array([whole[f"v{k}"] for k in range(count)])
        # a right-hand side may lie in the fixed effects alone
        least = tolerance**2 * np.maximum(np.maximum(whole, size if start is None else 0.0), 1e-300)
        for turn in range(most + 1):
            if (size <= least).all():
                break
            if turn == most:
                raise RuntimeError(f"equations not solved after {most} iterations")
            rest = self.d.pairs.select("pair", "verb", *self.x).join(self._to_pairs(state, d), "pair")
            rest = rest.selectExpr("pair", "verb", *self.x, *[f"t{k} AS z{k}" for k in range(count)])
            beta, lower = self._lower(rest, self._fixed_of(state, d))
            image = [f"{self._minus_explained(state, f'{self.diagonal} * d{k}', beta, k)} AS q{k}" for k in range(count)]
            moved = self.scratch.stage(state.join(self._to_raters(lower, count), "rater").selectExpr("rater", *self.x, *a, *r, *d, *image), "image")
            sums = moved.agg(*[F.expr(e) for k in range(count) for e in (
                f"sum(r{k} * r{k} / {self.diagonal}) AS rr{k}", f"sum(d{k} * q{k}) AS dq{k}", f"sum(r{k} * q{k} / {self.diagonal}) AS rq{k}", f"sum(q{k} * q{k} / {self.diagonal}) AS qq{k}")]).first()
            rr, dq, rq, qq = (np.array([sums[f"{c}{k}"] for k in range(count)]) for c in ("rr", "dq", "rq", "qq"))
            open_ = (size > least) & (dq > 0)  # a solved right-hand side stays as it is
            size = rr  # as summed now: differences of sums would carry the first ones' rounding on
            step = np.where(open_, size / np.where(open_, dq, 1), 0.0)
            after = np.where(open_, np.maximum(size - 2 * step * rq + step**2 * qq, 0.0), 0.0)
            back = np.where(open_, after / np.where(open_, size, 1), 0.0)
            size = after
            new_a = [f"a{k} + {_number(step[k])} * d{k} AS a{k}" for k in range(count)]
            new_r = [f"r{k} - {_number(step[k])} * q{k} AS r{k}" for k in range(count)]
            moved = moved.selectExpr("rater", *self.x, *new_a, *new_r, *d)
            state = moved.selectExpr("rater", *self.x, *a, *r, *[f"r{k} / {self.diagonal} + {_number(back[k])} * d{k} AS d{k}" for k in range(count)])
        raters = self.scratch.stage(state.select("rater", *self.x, *a), "solved-raters")
        beta, lower = given(raters)
        return Solved(beta, raters, self.scratch.stage(lower, "solved-pairs"))


def _signs(key: str, factor: str, probe: int) -> Column:
    return F.when(F.pmod(F.xxhash64(F.lit(f"{factor}{probe}"), key), F.lit(2)) == 0, 1.0).otherwise(-1.0)


def _probes(design: Crossed, count: int) -> list[Column]:
    """Probes on the raters: random signs, or each rater where there are no more of them."""
    if count < design.n_raters:
        return [_signs("rater", "rater", j) for j in range(count)]
    raters = [r["rater"] for r in design.raters.select("rater").orderBy("rater").collect()]
    return [F.when(F.col("rater") == F.lit(r), 1.0).otherwise(0.0) for r in raters]


def _probe_table(design: Crossed, count: int) -> np.ndarray:
    """The same as an array, raters in order of their keys."""
    if count >= design.n_raters:
        return np.eye(design.n_raters, dtype=np.int8)
    columns = [c.cast("byte").alias(f"s{j}") for j, c in enumerate(_probes(design, count))]
    return design.raters.select("rater", *columns).orderBy("rater").drop("rater").toPandas().to_numpy(dtype=np.int8)


class _Step:
    """One step's quantities at given variances (rater, pair, verb, residual)."""

    def __init__(self, design: Crossed, variances: np.ndarray, probes: int, scratch: Scratch):
        self.d, self.v, self.probes, self.scratch = design, variances, probes, scratch
        self.equations = Equations(design, variances[:3] / variances[3], scratch)
        gram = design.centre.gram()
        self.xy, self.yy, self.n, self.p = gram[:-1, -1], float(gram[-1, -1]), design.centre.n, design.centre.size

    def _of_levels(self, raters: DataFrame, pairs: DataFrame, count: int) -> Sides:
        """Right-hand sides of ρ = Z_r s + Z_p s' for level columns s0.. of raters and pairs (a verb's are its pairs')."""
        x, d, s = self.equations.x, self.d, [f"s{k}" for k in range(count)]
        cells = d.cells.select("rater", "pair", "n").withColumnRenamed("n", "m")
        to_pairs = cells.join(raters.select("rater", *s), "rater").groupBy("pair").agg(*[F.expr(f"sum(m * s{k}) AS t{k}") for k in range(count)])
        to_raters = cells.join(pairs.select("pair", *s), "pair").groupBy("rater").agg(*[F.expr(f"sum(m * s{k}) AS t{k}") for k in range(count)])
        held_r = self.scratch.stage(d.raters.select("rater", *x).join(raters.select("rater", *s), "rater").join(to_raters, "rater"), "sides-raters")
        held_p = self.scratch.stage(d.pairs.select("pair", *x).join(pairs.select("pair", *s), "pair").join(to_pairs, "pair"), "sides-pairs")
        fixed = sum(_matrix(t.agg(*_sum_products(x, s)).first(), len(x), count) for t in (held_r, held_p))
        each = [f"n * s{k} + t{k} AS f{k}" for k in range(count)]
        return Sides(held_r.selectExpr("rater", *each), held_p.selectExpr("pair", *each), fixed)

    def first_sides(self) -> tuple[Sides, DataFrame]:
        """The response, then the probes; and the probes on raters."""
        probes = _probes(self.d, self.probes)
        count = len(probes) + 1
        raters = self.d.raters.select("rater", *[c.alias(f"s{j}") for j, c in enumerate([F.lit(0.0), *probes])])
        pairs = self.d.pairs.select("pair", *[F.lit(0.0).alias(f"s{j}") for j in range(count)])
        of_probes = self._of_levels(raters, pairs, count)
        names = [f"f{j}" for j in range(1, count)]
        sides = Sides(
            self.d.raters.select("rater", F.col("wy").alias("f0")).join(of_probes.raters.select("rater", *names), "rater"),
            self.d.pairs.select("pair", F.col("wy").alias("f0")).join(of_probes.pairs.select("pair", *names), "pair"),
            np.column_stack([self.xy, of_probes.fixed[:, 1:]]),
        )
        held = (self.scratch.stage(t, "first-sides", every_round=True) for t in (sides.raters, sides.pairs))
        return Sides(*held, sides.fixed), raters

    def take(self, sides: Sides, raters: DataFrame, starts: Sequence[DataFrame | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[DataFrame]]:
        """(score, average information, covariance of the score that probing adds, solutions to start from), in variances."""
        theta = self.v[:3] / self.v[3]
        solved = self.equations.solve(sides, starts[0])
        columns = range(1, sides.count)
        one = solved.raters.join(raters, "rater").join(self.d.raters.select("rater", "wy"), "rater")
        got = one.agg(F.sum(F.col("a0") ** 2).alias("uu"), F.sum(F.col("a0") * F.col("wy")).alias("uy"),
                      *[F.sum(F.col(f"a{j}") * F.col(f"s{j}")).alias(f"us{j}") for j in columns], *[F.sum(f"s{j}").alias(f"s{j}") for j in columns]).first()
        alone = self.equations.of_raters(sides, 1)
        by_pair = self.scratch.stage(solved.pairs.join(alone, "pair").join(self.d.pairs.select("pair", "wy"), "pair"), "probed-pairs")
        pair = by_pair.agg(F.sum(F.col("b0") ** 2).alias("uu"), F.sum((F.col("b0") + F.col("c0")) * F.col("wy")).alias("uy"),
                           *[F.sum(F.col(f"b{j}") * F.col(f"p{j}")).alias(f"us{j}") for j in columns]).first()
        verbs = by_pair.groupBy("verb").agg(F.first("c0").alias("c0"), *[F.first(F.col(f"c{j}") * F.col(f"q{j}")).alias(f"us{j}") for j in columns])
        verb = verbs.agg(F.sum(F.col("c0") ** 2).alias("uu"), *[F.sum(f"us{j}").alias(f"us{j}") for j in columns]).first()
        rows = (got, pair, verb)
        ypy = self.yy - float(self.xy @ solved.beta[:, 0]) - got["uy"] - pair["uy"]
        squares = np.array([r["uu"] for r in rows])  # |û_f|²
        scale = np.array([1 / theta[0], -theta[0] / theta[1] ** 2, -theta[0] / theta[2] ** 2])
        forms = scale[:, None] * np.array([[r[f"us{j}"] for j in columns] for r in rows])
        traces, spread = traced(self.d.n_raters, self.equations.known_traces(), forms, np.array([got[f"s{j}"] for j in columns]))

        # working variates: Z_f s_f for each factor, and P_H y
        zero = F.lit(0.0)
        s_raters = solved.raters.select("rater", (F.col("a0") / float(theta[0])).alias("s0"), zero.alias("s1"), zero.alias("s2"))
        s_pairs = solved.pairs.select("pair", "verb", zero.alias("s0"), (F.col("b0") / float(theta[1])).alias("s1"), (F.col("c0") / float(theta[2])).alias("s2"))
        levels = self._of_levels(s_raters, s_pairs, 3)
        second = Sides(
            levels.raters.join(s_raters.select("rater", F.col("s0").alias("f3")), "rater"),
            levels.pairs.join(s_pairs.select("pair", F.col("s1").alias("f3")), "pair"),
            np.column_stack([levels.fixed, np.zeros(len(self.xy))]),
        )
        working = self.equations.solve(second, starts[1])
        pairs_s = working.pairs.join(s_pairs.drop("verb"), "pair")
        in_raters = working.raters.join(s_raters, "rater").agg(*[F.sum(F.col("s0") * F.col(f"a{j}")).alias(f"m{j}") for j in range(4)]).first()
        in_pairs = pairs_s.agg(*[F.sum(F.col("s1") * F.col(f"b{j}")).alias(f"m{j}") for j in range(4)]).first()
        in_verbs = pairs_s.groupBy("verb").agg(F.first("s2").alias("s2"), *[F.first(f"c{j}").alias(f"c{j}") for j in range(4)])
        in_verbs = in_verbs.agg(*[F.sum(F.col("s2") * F.col(f"c{j}")).alias(f"m{j}") for j in range(4)]).first()
        products = np.array([[row[f"m{j}"] for j in range(4)] for row in (in_raters, in_pairs, in_verbs)])
        score, information = score_and_information(self.n, self.p, self.v, ypy, squares, traces, products)
        return score, information, probe_noise(self.v, spread), [solved.raters, working.raters]


def _climb(start: Sequence[float], take, steps: int, tolerance: float, more: Callable[[float], bool] | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Average-information steps from ``start``; ``take`` gives score, information and the score's probe noise at variances.

    Once settled, ``more`` is told how many times the probes would keep what probing adds at ``SHARE`` of each variance's standard error,
    and the steps go on if it takes more.
    """
    v = np.array(start, dtype=float)
    v[:3] = np.maximum(v[:3], 1e-3 * v[3])
    for _ in range(steps):
        score, information, noise = take(v)
        free = np.ones(4, dtype=bool)
        free[:3] = (v[:3] > 1e-6 * v[3]) | (score[:3] > 0)
        inverse = np.linalg.pinv(information[np.ix_(free, free)])
        move = np.zeros(4)
        move[free] = inverse @ score[free]
        new = np.maximum(v + move, 0.1 * v)
        new[:3] = np.maximum(new[:3], 1e-7 * new[3])
        small = np.abs(new - v) <= tolerance * np.maximum(v, 1e-4 * v[3])
        v = new
        if small.all():
            error = np.zeros(4)
            error[free] = np.sqrt(np.maximum(np.diag(inverse @ noise[np.ix_(free, free)] @ inverse), 0.0))
            usual = np.sqrt(np.maximum(np.diag(inverse), 1e-300))
            times = float(((error[free] / usual / SHARE) ** 2).max())
            if more is None or not more(times):
                return v, error
    return None


def _in_blocks(design: Crossed, scratch: Scratch, probes: int) -> Blocks | None:
    blocks = Blocks.of(design, scratch)
    if blocks is not None:
        blocks.probe(_probe_table(design, probes))
    return blocks


def _step_in_blocks(blocks: Blocks, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ypy, squares, known, forms, products = blocks.step(v[:3] / v[3])
    centre = blocks.d.centre
    traces, spread = traced(blocks.d.n_raters, known, forms, blocks.signs.sum(axis=0, dtype=float))
    score, information = score_and_information(centre.n, centre.size, v, ypy, squares, traces, products)
    return score, information, probe_noise(v, spread)


def reml_variances(
    design: Crossed, scratch: Scratch, start: Sequence[float] | None = None, probes: int | None = None, steps: int = STEPS, tolerance: float = TOLERANCE, blocks: Blocks | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Variances (rater, pair, verb, residual) and the standard error that probing adds to each; over tables without ``blocks``.

    Starts from the moment estimates.  A variance on its way to zero shrinks at most tenfold a step and settles
    near zero.  A fit that doesn't settle fails.
    """
    if start is None:
        rows = design.moment_table().collect()
        start = solve_moments([[r["ssw"], r["coef_rater"], r["coef_pair"], r["coef_verb"], r["coef_error"]] for r in rows])
        start[3] = max(start[3], 0.02 * design.centre.rss() / design.centre.n)  # moments may leave the residual nothing
    count = max(probes or PROBES, 2)
    starts: list[DataFrame | None] = [None, None]
    sides = None

    def more(times: float) -> bool:
        nonlocal count, starts, sides
        if count >= design.n_raters or (count >= SETTLED and times <= 1):
            return False
        count, starts, sides = max(SETTLED, math.ceil(1.2 * max(times, 1) * count)), [None, None], None
        if blocks is not None:
            blocks.probe(_probe_table(design, count))
        return True

    def over_tables(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal starts, sides
        scratch.next_round()
        step = _Step(design, v, count, scratch)
        sides = sides or step.first_sides()
        *found, starts = step.take(*sides, starts)
        return tuple(found)

    found = _climb(start, over_tables if blocks is None else lambda v: _step_in_blocks(blocks, v), steps, tolerance, more)
    if found is None:
        raise RuntimeError(f"variances not settled after {steps} steps")
    return found


def _fixed_over_tables(design: Crossed, scratch: Scratch, ratios: Sequence[float], tolerance: float) -> np.ndarray:
    """p x (1 + p): fixed effects, then their covariance over the residual variance."""
    scratch.next_round()
    p, gram = design.centre.size, design.centre.gram()
    names = [F.col("wy").alias("f0"), *[F.lit(0.0).alias(f"f{k + 1}") for k in range(p)]]
    sides = Sides(design.raters.select("rater", *names), design.pairs.select("pair", *names), np.column_stack([gram[:-1, -1], np.eye(p)]))
    return Equations(design, ratios, scratch).solve(sides, None, tolerance).beta


def fit_crossed_reml(
    df: DataFrame, response: str, terms: Sequence[Term], rater: str, pair: str, verb: str, probes: int | None = None, tolerance: float = SOLVED
) -> DataFrame:
    """Coefficients with z tests at the REML variances; probe_error_* is what probing adds to each variance's error."""
    with Scratch(df.sparkSession) as scratch:
        design = Crossed.build(df, response, terms, rater, pair, verb, scratch.stage, scratch.stage_bucketed)
        blocks = _in_blocks(design, scratch, max(probes or PROBES, 2))
        variances, errors = reml_variances(design, scratch, probes=probes, blocks=blocks)
        ratios = variances[:3] / variances[3]
        fixed = _fixed_over_tables(design, scratch, ratios, tolerance) if blocks is None else blocks.fixed_effects(ratios, tolerance)
        covariance = (fixed[:, 1:] + fixed[:, 1:].T) / 2 * variances[3]
        rows = coefficient_rows([n for n, _ in terms], design.centre, fixed[:, 0], covariance, None, *[float(v) for v in variances])
        fitted = df.sparkSession.createDataFrame(rows, result_schema(["var_rater", "var_pair", "var_verb", "var_residual"]))
    names = [*FACTORS, "residual"]
    return reduce(lambda out, one: out.withColumn(f"probe_error_{one[0]}", F.lit(float(one[1]))), zip(names, errors, strict=True), fitted)
