"""Random intercepts, nested or single, by exact REML for any number of groups.

Rows are folded once to level rows: one per group, inner level and outer level, with its count and centred
totals.  Everything the REML criterion needs at a pair of standard-deviation ratios is a sum over them.

A group's search is a small record: where it is, how high the criterion is there, its step and what it
wants to know next.  Groups of at most ``WHOLE`` level rows are searched to the end inside a task.  Larger ones keep
their record in a staged table: in each round one aggregation over the level rows evaluates all points that open
groups ask for, tasks advance the records, and settled groups leave the table.  Both take the same steps,
and neither rows nor groups pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairlab.functions.design import INTERCEPT, Term
from pairlab.functions.tdist import two_sided_p
from pairlab.operators.ols import independent_columns, moments, unpack
from pairlab.sources.staging import Scratch, stage

#: Level rows of a group that one task may hold: some 10 MB at ten terms.
WHOLE = 100_000
# First look at each standard-deviation ratio (random effect over residual).
COARSE_RATIOS = (0.0, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4)
# Fractions and multiples of a step that are tried at once.
LADDER = (1 / 64, 1 / 16, 1 / 4, 1 / 2, 1.0, 2.0, 4.0, 16.0)
# A fit that has not settled after so many looks fails; it never returns an unsettled answer.
LOOKS = 200

Ratios = tuple[float, float]


@dataclass
class Centre:
    """Row statistics of one group, with terms and response centred on their means."""

    n: int
    means: np.ndarray
    cross: np.ndarray
    kept: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, n: int, means: Sequence[float], covariances: Sequence[float]) -> Centre:
        mean, cross = unpack(n, means, covariances)
        return cls(int(n), mean, cross, independent_columns(cross[:-1, :-1]))

    @property
    def size(self) -> int:
        """Number of estimable fixed effects, intercept included."""
        return len(self.kept) + 1

    def gram(self) -> np.ndarray:
        """W'W for W = [1, kept terms, response], all but the intercept centred."""
        k = [*self.kept, len(self.means) - 1]
        full = np.zeros((len(k) + 1, len(k) + 1))
        full[0, 0] = self.n
        full[1:, 1:] = self.cross[np.ix_(k, k)]
        return full

    def uncentre(self, beta: np.ndarray, covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and their covariance on the original scale."""
        shift = self.contrasts()
        moved = shift @ beta
        moved[0] += self.means[-1]
        return moved, shift @ covariance @ shift.T

    def contrasts(self) -> np.ndarray:
        shift = np.eye(self.size)
        shift[0, 1:] = -self.means[self.kept]
        return shift

    def rss(self) -> float:
        """Residual sum of squares of plain least squares."""
        gram = self.gram()[1:, 1:]
        xx, xy = gram[:-1, :-1], gram[:-1, -1]
        return float(gram[-1, -1] - xy @ np.linalg.solve(xx, xy)) if len(xx) else float(gram[-1, -1])

    def fits(self) -> bool:
        """Is there a residual to model?  Not with as many coefficients as rows, or a perfect fit."""
        return self.n > self.size and self.rss() > 1e-13 * max(float(self.cross[-1, -1]), 1e-300)


@dataclass
class Profile:
    """Pieces of the REML criterion at one pair of ratios."""

    centre: Centre
    matrix: np.ndarray
    log_det: float

    def __post_init__(self):
        xx, xy = self.matrix[:-1, :-1], self.matrix[:-1, -1]
        self.inverse = np.linalg.inv(xx)
        self.beta = self.inverse @ xy
        self.rss = max(float(self.matrix[-1, -1] - xy @ self.beta), 1e-300)
        self.log_det_x = float(np.linalg.slogdet(xx)[1])
        self.df = self.centre.n - self.centre.size

    @classmethod
    def of(cls, centre: Centre, removed: np.ndarray, log_det: float) -> Profile:
        """From what the random effects take off W'W, over [1, all terms, response]."""
        k = [0, *[i + 1 for i in centre.kept], len(removed) - 1]
        return cls(centre, centre.gram() - removed[np.ix_(k, k)], log_det)

    @property
    def criterion(self) -> float:
        return self.df * math.log(self.rss / self.df) + self.log_det + self.log_det_x

    def deviance(self, log_sigma2: float) -> float:
        return self.df * log_sigma2 + self.log_det + self.log_det_x + self.rss * math.exp(-log_sigma2)


# --- the search of one group -------------------------------------------------------


def _stencil(at: Ratios, step: Ratios, nested: bool) -> list[list[Ratios]]:
    """3 x 3 ratios around a point; the criterion is even in a ratio, so signs are dropped."""
    first = [abs(at[0] + k * step[0]) for k in (-1, 0, 1)]
    second = [abs(at[1] + k * step[1]) for k in (-1, 0, 1)] if nested else [0.0] * 3
    return [[(a, b) for b in second] for a in first]


def _slopes(values: np.ndarray, step: Ratios, nested: bool) -> tuple[np.ndarray, np.ndarray]:
    """Central first and second differences of a 3 x 3 block."""
    h, k = step
    gradient = np.array([(values[2, 1] - values[0, 1]) / (2 * h), (values[1, 2] - values[1, 0]) / (2 * k)])
    hessian = np.array([
        [(values[2, 1] - 2 * values[1, 1] + values[0, 1]) / h**2, 0.0],
        [0.0, (values[1, 2] - 2 * values[1, 1] + values[1, 0]) / k**2],
    ])
    hessian[0, 1] = hessian[1, 0] = (values[2, 2] - values[2, 0] - values[0, 2] + values[0, 0]) / (4 * h * k)
    return (gradient, hessian) if nested else (gradient[:1], hessian[:1, :1])


def _move(values: np.ndarray, step: Ratios, nested: bool) -> np.ndarray:
    """The Newton step, or one towards the lowest neighbour where the surface bends down."""
    gradient, hessian = _slopes(values, step, nested)
    if np.linalg.eigvalsh(hessian).min() <= 0:
        i, j = np.unravel_index(np.argmin(values), values.shape)
        return np.array([4 * (i - 1) * step[0], 4 * (j - 1) * step[1] if nested else 0.0])
    move = -np.linalg.solve(hessian, gradient)
    return move if nested else np.array([move[0], 0.0])


def _rungs(at: Ratios, move: Ratios) -> list[Ratios]:
    """Points along a move; the criterion is even in a ratio, so signs are dropped, and a tiny ratio is zero."""
    points = [tuple(abs(a + k * m) for a, m in zip(at, move, strict=True)) for k in LADDER]
    return [tuple(0.0 if r < 1e-5 else float(r) for r in point) for point in points]


def _grid(nested: bool) -> list[Ratios]:
    return [(a, b) for a in COARSE_RATIOS for b in (COARSE_RATIOS if nested else (0.0,))]


@dataclass
class Search:
    """Where the search of one group is, and what it looks at next.

    It starts at the lowest point of a coarse grid.  A look takes a 3 x 3 block of points around the place and
    then points along the move that the block suggests.  A move is taken only if the criterion falls.  A group is
    settled when no point along its Newton step is lower and the step itself is tiny, or promises nothing
    that the criterion's digits could show.
    """

    at1: float = 0.0
    at2: float = 0.0
    height: float = 0.0
    width: float = 0.01
    move1: float = 0.0
    move2: float = 0.0
    promised: float = 0.0
    phase: str = "grid"

    @property
    def at(self) -> Ratios:
        return self.at1, self.at2

    def step(self) -> Ratios:
        width = 0.02 if self.phase == "settled" else self.width
        return tuple(width * max(a, 0.25) for a in self.at)

    def block(self, nested: bool) -> list[list[Ratios]]:
        return _stencil(self.at, self.step(), nested)

    def wanted(self, nested: bool) -> list[Ratios]:
        """Points whose profiles the next advance needs, or the result if the search is settled."""
        if self.phase == "grid":
            return _grid(nested)
        if self.phase == "rungs":
            return sorted(set(_rungs(self.at, (self.move1, self.move2))))
        return sorted({r for row in self.block(nested) for r in row})

    def advance(self, seen: Mapping[Ratios, Profile], nested: bool) -> Search:
        state = asdict(self)
        if self.phase == "grid":
            best = min(_grid(nested), key=lambda r: seen[r].criterion)
            return Search(*best, seen[best].criterion, phase="block")
        if self.phase == "block":
            values = np.array([[seen[r].criterion for r in row] for row in self.block(nested)])
            move = _move(values, self.step(), nested)
            gradient, _ = _slopes(values, self.step(), nested)
            promised = abs(float(gradient @ move[: len(gradient)]))
            return Search(**state | {"move1": float(move[0]), "move2": float(move[1]), "promised": promised, "phase": "rungs"})
        move = (self.move1, self.move2)
        best = min(_rungs(self.at, move), key=lambda r: seen[r].criterion)
        size = max(abs(m) / max(a, 0.25) for m, a in zip(move, self.at, strict=True))
        tiny = size < 3e-5 or self.promised < 1e-12 * abs(self.height)
        state["phase"] = "block"
        if seen[best].criterion < self.height:
            moved = max(abs(t - a) / max(a, 0.25) for t, a in zip(best, self.at, strict=True))
            state |= {"at1": best[0], "at2": best[1], "height": seen[best].criterion, "width": max(min(0.01, moved), 0.001)}
            if tiny and moved < 3e-5:
                state["phase"] = "settled"
        elif tiny or self.width <= 1e-4:
            state["phase"] = "settled"
        else:
            state["width"] = self.width / 4
        return Search(**state)


def _degrees_of_freedom(block: np.ndarray, step: Ratios, nested: bool, at: Ratios) -> np.ndarray:
    """Satterthwaite degrees of freedom of every coefficient from a 3 x 3 block of profiles.

    Parameters are the ratios and the log residual variance.  A ratio at zero is on the
    boundary and is left out.
    """
    middle: Profile = block[1, 1]
    log_sigma2 = math.log(middle.rss / middle.df)
    deviance = np.vectorize(lambda p: p.deviance(log_sigma2))(block)
    _, curvature = _slopes(deviance, step, nested)
    shift = middle.centre.contrasts()
    variance = np.array([[np.diag(shift @ p.inverse @ shift.T) for p in row] for row in block]) * math.exp(log_sigma2)
    here = variance[1, 1]
    moved = [(variance[2, 1] - variance[0, 1]) / (2 * step[0])]
    by_sigma = [-(block[2, 1].rss - block[0, 1].rss) / (2 * step[0]) * math.exp(-log_sigma2)]
    if nested:
        moved.append((variance[1, 2] - variance[1, 0]) / (2 * step[1]))
        by_sigma.append(-(block[1, 2].rss - block[1, 0].rss) / (2 * step[1]) * math.exp(-log_sigma2))
    free = [i for i in range(len(moved)) if at[i] > 1e-4]
    size = len(free) + 1
    hessian = np.zeros((size, size))
    hessian[:-1, :-1] = curvature[np.ix_(free, free)]
    hessian[-1, :-1] = hessian[:-1, -1] = [by_sigma[i] for i in free]
    hessian[-1, -1] = middle.df
    gradients = np.array([*[moved[i] for i in free], here])
    spread = 2 * np.linalg.pinv(hessian)
    return 2 * here**2 / np.einsum("ik,ij,jk->k", gradients, spread, gradients)


def coefficient_rows(names: Sequence[str], centre: Centre, beta, covariance, dfs, *rest) -> list[tuple]:
    """(term, estimate, std_error, df, t_value, p_value, *rest) of every term; nulls for one that earlier ones give."""
    estimate, spread = centre.uncentre(beta, covariance)
    where = {0: 0, **{j + 1: i + 1 for i, j in enumerate(centre.kept)}}
    rest = [None if v is None else float(v) for v in rest]
    rows = []
    for j, name in enumerate([INTERCEPT, *names]):
        if j not in where:
            rows.append((name, *[None] * 5, *rest))
            continue
        i = where[j]
        se = math.sqrt(spread[i, i])
        t = float(estimate[i]) / se
        df = None if dfs is None else float(dfs[i])
        rows.append((name, float(estimate[i]), se, df, t, two_sided_p(t, math.inf if df is None else df), *rest))
    return rows


def _fitted(names: Sequence[str], search: Search, seen: Mapping[Ratios, Profile], nested: bool) -> list[tuple]:
    block = np.empty((3, 3), dtype=object)
    for i, line in enumerate(search.block(nested)):
        for j, r in enumerate(line):
            block[i, j] = seen[r]
    middle: Profile = block[1, 1]
    sigma2 = middle.rss / middle.df
    dfs = _degrees_of_freedom(block, search.step(), nested, search.at)
    reml = middle.criterion + middle.df * (1 + math.log(2 * math.pi))
    variances = (search.at1**2 * sigma2, search.at2**2 * sigma2 if nested else None, sigma2)
    return coefficient_rows(names, middle.centre, middle.beta, middle.inverse * sigma2, dfs, *variances, reml)


def _unfitted(names: Sequence[str], centre: Centre) -> list[tuple]:
    """Estimates alone, where there is no residual to model; none where they aren't determined."""
    rest = [None] * 8
    if centre.n < centre.size:
        return [(name, None, *rest) for name in (INTERCEPT, *names)]
    gram = centre.gram()
    beta = np.linalg.solve(gram[:-1, :-1], gram[:-1, -1])
    estimate, _ = centre.uncentre(beta, np.zeros_like(gram[:-1, :-1]))
    where = dict(zip([0, *[j + 1 for j in centre.kept]], estimate, strict=True))
    return [(name, float(where[j]) if j in where else None, *rest) for j, name in enumerate([INTERCEPT, *names])]


# --- groups that fit a task --------------------------------------------------------


class Levels:
    """Level rows of one group: counts and totals of every inner level, and its outer level."""

    def __init__(self, totals: np.ndarray, outer: np.ndarray | None):
        self.totals = totals  # count, centred terms, centred response
        self.outer = None if outer is None else np.unique(outer, return_inverse=True)[1]

    def profiles(self, centre: Centre, points: Sequence[Ratios]) -> dict[Ratios, Profile]:
        found, n = {}, self.totals[:, 0]
        for first in sorted({p[0] for p in points}):
            weight = 1 / (1 + n * first**2)
            inner = (self.totals * (first**2 * weight)[:, None]).T @ self.totals
            log_det = float(np.log1p(n * first**2).sum())
            if self.outer is None:
                found[first, 0.0] = Profile.of(centre, inner, log_det)
                continue
            shrunk = self.totals * weight[:, None]
            order = np.argsort(self.outer, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(self.outer[order]) != 0])
            verbs = np.add.reduceat(shrunk[order], edge, axis=0)
            for second in sorted({p[1] for p in points if p[0] == first}):
                share = second**2 / (1 + second**2 * verbs[:, 0])
                removed = inner + (verbs * share[:, None]).T @ verbs
                found[first, second] = Profile.of(centre, removed, log_det + float(np.log1p(second**2 * verbs[:, 0]).sum()))
        return found


def search_whole(centre: Centre, levels: Levels, names: Sequence[str], looks: int) -> list[tuple] | None:
    """Coefficient rows of one group, or nothing if its search doesn't settle."""
    if not centre.fits():
        return _unfitted(names, centre)
    nested, search, left = levels.outer is not None, Search(), 2 * looks + 1
    while search.phase != "settled":
        if not left:
            return None
        search = search.advance(levels.profiles(centre, search.wanted(nested)), nested)
        left -= 1
    return _fitted(names, search, levels.profiles(centre, search.wanted(nested)), nested)


# --- tables ------------------------------------------------------------------------


@dataclass
class Design:
    """Staged centres (one row per group, ``g`` its number) and level rows of a fit."""

    by: list[str]
    names: list[str]
    nested: bool
    centres: DataFrame
    levels: DataFrame

    @classmethod
    def build(
        cls, df: DataFrame, response: str, terms: Sequence[Term], inner: str, outer: str | None, by: Sequence[str], keep: Callable[[DataFrame, str], DataFrame],
        keep_by: Callable[[DataFrame, str, str], DataFrame] | None = None,
    ) -> Design:
        """With ``keep_by`` nested level rows are staged in buckets of outer levels, so that evaluations don't shuffle them."""
        levels = {"inner": inner, **({"outer": outer} if outer else {})}
        df = df.dropna(subset=list(levels.values()))
        found = moments(df, response, terms, by).where("n > 0").withColumn("g", F.monotonically_increasing_id())
        centres = keep(found, "centres")
        columns = [f"w{i + 1}" for i in range(len(terms))] + ["wy"]
        raw = df.select(
            *[F.col(k).alias(f"by{i}") for i, k in enumerate(by)], *[F.col(c).alias(a) for a, c in levels.items()],
            *[c.cast("double").alias(n) for n, (_, c) in zip(columns, terms, strict=False)], F.col(response).cast("double").alias("wy"),
        ).dropna(subset=columns)
        named = centres.select("g", "means", *[F.col(k).alias(f"of{i}") for i, k in enumerate(by)])
        same = [F.col(f"by{i}").eqNullSafe(F.col(f"of{i}")) for i in range(len(by))]
        placed = raw.join(named, reduce(lambda a, b: a & b, same)) if by else raw.crossJoin(F.broadcast(named))  # one row without groups
        centred = placed.select("g", *levels, *[(F.col(n) - F.col("means")[i]).alias(n) for i, n in enumerate(columns)])
        folded = centred.groupBy("g", *levels).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns])
        return cls(list(by), [n for n, _ in terms], outer is not None, centres, keep_by(folded, "levels", "outer") if keep_by and outer else keep(folded, "levels"))

    def profiles(self, levels: DataFrame, points: DataFrame) -> DataFrame:
        """(g, seen): what the random effects take off W'W at each of a group's points, in one aggregation.

        ``points`` has g and points, an array of (r1, r2s).  Rows are expanded over the distinct inner ratios only; the
        outer ratios are applied to the folded outer levels.  Rows in buckets of outer levels are folded where they lie, and only
        sums over outer levels are shuffled; all sums are partial aggregations.
        """
        cells = ["n", *[c for c in levels.columns if c.startswith("w")]]
        upper = [(i, j) for i in range(len(cells)) for j in range(i, len(cells))]
        spread = levels.join(points, "g").select(*levels.columns, F.posexplode("points").alias("at", "point")).select(*levels.columns, "at", F.col("point.r1").alias("r1"))
        weighed = spread.selectExpr("*", "1 / (1 + n * r1 * r1) AS u", "r1 * r1 / (1 + n * r1 * r1) AS q")
        sums = [F.expr(f"sum(q * {cells[i]} * {cells[j]}) AS a{i}_{j}") for i, j in upper]
        logs = F.expr("sum(log1p(n * r1 * r1)) AS ld")
        if self.nested:
            folds = [F.expr(f"sum(u * {c}) AS c{i}") for i, c in enumerate(cells)]
            verbs = weighed.groupBy("g", "at", "r1", "outer").agg(*sums, logs, *folds)
            asked = points.select("g", F.posexplode("points").alias("at", "point")).select("g", "at", F.col("point.r2s").alias("r2s"))
            per_verb = verbs.join(asked, ["g", "at"]).withColumn("r2", F.explode("r2s")).selectExpr("*", "r2 * r2 / (1 + r2 * r2 * c0) AS q2")
            totals = per_verb.groupBy("g", "r1", "r2").agg(
                *[F.expr(f"sum(a{i}_{j} + q2 * c{i} * c{j}) AS a{i}_{j}") for i, j in upper], F.expr("sum(ld + log1p(r2 * r2 * c0)) AS ld")
            )
        else:
            totals = weighed.groupBy("g", "r1").agg(*sums, logs).withColumn("r2", F.lit(0.0))
        one = F.struct("r1", "r2", "ld", F.array(*[f"a{i}_{j}" for i, j in upper]).alias("a"))
        return totals.groupBy("g").agg(F.collect_list(one).alias("seen"))  # as many entries as points were asked for


_POINTS = "array<struct<r1:double,r2s:array<double>>>"
_STATE = "at1 double, at2 double, height double, width double, move1 double, move2 double, promised double, phase string"
_RESULT = "term string, estimate double, std_error double, df double, t_value double, p_value double, var_inner double, var_outer double, var_residual double, reml double"
_STATE_NAMES = [c.split()[0] for c in _STATE.split(", ")]
_RESULT_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def _asked(points: Sequence[Ratios]) -> list[dict]:
    return [{"r1": float(a), "r2s": sorted(float(q[1]) for q in points if q[0] == a)} for a in sorted({p[0] for p in points})]


def _read(row: Mapping) -> tuple[Centre, dict[Ratios, Profile]]:
    """Centre and profiles of one group from its row."""
    centre = Centre.of(row["n"], row["means"], row["covariances"])
    width = len(row["means"]) + 1
    found = {}
    for point in row["seen"]:
        removed = np.zeros((width, width))
        removed[np.triu_indices(width)] = point["a"]
        removed += np.triu(removed, 1).T
        found[point["r1"], point["r2"]] = Profile.of(centre, removed, point["ld"])
    return centre, found


def _rows(batches: Iterator[pd.DataFrame], each: Callable[[dict], Sequence[tuple]], columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([row for record in batch.to_dict("records") for row in each(record)], columns=list(columns))


def _first_state(design: Design, large: DataFrame) -> DataFrame:
    """Records of the groups in ``large`` that have a residual to model, with the grid as their first points."""
    nested = design.nested
    points = _asked(_grid(nested))

    def each(row: dict) -> list[tuple]:
        if not Centre.of(row["n"], row["means"], row["covariances"]).fits():
            return []
        return [(row["g"], *asdict(Search()).values(), points)]

    names = ["g", *_STATE_NAMES, "points"]
    return design.centres.join(large.select("g"), "g", "left_semi").mapInPandas(lambda batches: _rows(batches, each, names), f"g long, {_STATE}, points {_POINTS}")


def _advanced(design: Design, state: DataFrame, seen: DataFrame) -> DataFrame:
    nested = design.nested

    def each(row: dict) -> list[tuple]:
        search = Search(**{k: row[k] for k in _STATE_NAMES}).advance(_read(row)[1], nested)
        return [(row["g"], *asdict(search).values(), _asked(search.wanted(nested)))]

    joined = state.drop("points").join(seen, "g").join(design.centres.select("g", "n", "means", "covariances"), "g")
    return joined.mapInPandas(lambda batches: _rows(batches, each, ["g", *_STATE_NAMES, "points"]), f"g long, {_STATE}, points {_POINTS}")


def _search_tables(design: Design, levels: DataFrame, large: DataFrame, looks: int, scratch: Scratch) -> DataFrame:
    """(g, result columns) of large groups: rounds of evaluation over the level rows of the groups still open."""
    nested, names = design.nested, design.names
    state, settled = scratch.stage(_first_state(design, large), "search"), []
    for _ in range(2 * looks + 1):
        moved = scratch.stage(_advanced(design, state, design.profiles(levels, state.select("g", "points"))), "search")
        settled.append(moved.where("phase = 'settled'"))
        state = moved.where("phase <> 'settled'")
        if not state.limit(1).count():
            break
    done = reduce(DataFrame.unionAll, settled)
    done = scratch.stage(done, "settled")

    def each(row: dict) -> list[tuple]:
        search = Search(**{k: row[k] for k in _STATE_NAMES})
        return [(row["g"], *r, True) for r in _fitted(names, search, _read(row)[1], nested)]

    def plain(row: dict) -> list[tuple]:
        centre = Centre.of(row["n"], row["means"], row["covariances"])
        return [] if centre.fits() else [(row["g"], *r, True) for r in _unfitted(names, centre)]

    def failed(row: dict) -> list[tuple]:
        return [(row["g"], "", *[None] * 9, False)]

    columns, schema = ["g", *_RESULT_NAMES, "settled"], f"g long, {_RESULT}, settled boolean"
    centres = design.centres.select("g", "n", "means", "covariances")
    full = done.drop("points").join(design.profiles(levels, done.select("g", "points")), "g").join(centres, "g")
    out = full.mapInPandas(lambda batches: _rows(batches, each, columns), schema)
    out = out.unionAll(centres.join(large.select("g"), "g", "left_semi").mapInPandas(lambda batches: _rows(batches, plain, columns), schema))
    return out.unionAll(state.select("g").mapInPandas(lambda batches: _rows(batches, failed, columns), schema))


def _search_whole(design: Design, centres: DataFrame, levels: DataFrame, looks: int) -> DataFrame:
    """(g, result columns) of groups that fit a task; a task meets a group's centre first and then its level rows."""
    nested, names = design.nested, design.names
    cells = ["n", *[c for c in levels.columns if c.startswith("w")]]
    columns = ["g", *_RESULT_NAMES, "settled"]

    def solve(rows: pd.DataFrame) -> list[tuple]:
        first, rest = rows.iloc[0], rows.iloc[1:]
        g, centre = int(first["g"]), Centre.of(first["rows"], first["means"], first["covariances"])
        found = search_whole(centre, Levels(rest[cells].to_numpy(dtype=float), rest["outer"].to_numpy() if nested else None), names, looks)
        return [(g, "", *[None] * 9, False)] if found is None else [(g, *r, True) for r in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            out: list[tuple] = []
            edges = np.flatnonzero(batch["kind"].to_numpy() == 0)
            for a, b in zip([0, *edges], [*edges, len(batch)], strict=True):
                if a in edges and held:
                    out += solve(pd.concat(held))
                    held = []
                if a < b:
                    held.append(batch.iloc[a:b])
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame(solve(pd.concat(held)), columns=columns)

    heads = centres.select("g", F.lit(0).alias("kind"), F.col("n").alias("rows"), "means", "covariances")
    if nested and levels.schema["outer"].dataType.typeName() in ("byte", "short", "integer", "long"):
        heads = heads.withColumn("outer", F.lit(0).cast(levels.schema["outer"].dataType))  # no null, which would turn numbers into doubles
    both = heads.unionByName(levels.drop("inner").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("g").sortWithinPartitions("g", "kind").mapInPandas(run, f"g long, {_RESULT}, settled boolean")


def fit_nested(
    df: DataFrame, response: str, terms: Sequence[Term], inner: str, outer: str | None = None,
    by: Sequence[str] = (), looks: int = LOOKS, whole: int | None = None,
) -> DataFrame:
    """REML fit of ``response ~ terms + (1 | inner) [+ (1 | outer)]`` for every group of ``by``, however many.

    ``inner`` levels are nested in ``outer`` levels.  One row per group and coefficient, with
    Satterthwaite degrees of freedom and the variance components.

    A group of at most ``whole`` level rows is searched inside a task, larger ones by rounds over tables.  If a
    group is not settled after ``looks`` looks, the fit fails.  A group without residual degrees of freedom, or that
    its terms fit perfectly, has estimates alone, and nulls where those aren't determined.
    """
    whole = WHOLE if whole is None else whole
    with Scratch(df.sparkSession) as scratch:
        design = Design.build(df, response, terms, inner, outer, by, scratch.stage, scratch.stage_bucketed)
        sizes = scratch.stage(design.levels.groupBy("g").agg(F.count(F.lit(1)).alias("m")), "sizes")
        large = sizes.where(F.col("m") > whole)
        n_large, n_all = large.count(), sizes.count()
        parts = []
        if n_large < n_all:
            centres, levels = ((t.join(large.select("g"), "g", "left_anti") if n_large else t) for t in (design.centres, design.levels))
            parts.append(_search_whole(design, centres, levels, looks))
        if n_large:
            levels = design.levels
            if n_large < n_all:
                levels = levels.join(large.select("g"), "g", "left_semi")
                levels = scratch.stage_bucketed(levels, "large", "outer") if design.nested else scratch.stage(levels, "large")
            parts.append(_search_tables(design, levels, large, looks, scratch))
        if not parts:
            return df.sparkSession.createDataFrame([], _schema(df, by))
        found = reduce(DataFrame.unionAll, parts).join(design.centres.select("g", *by), "g")
        result = stage(found.select(*by, *_RESULT_NAMES, "settled"), "nested-fit")
    bad = result.where(~F.col("settled")).select(*by).limit(5).collect()
    if bad:
        raise RuntimeError(f"no settled fit for {[tuple(row) for row in bad]}")
    return result.drop("settled")


def _schema(df: DataFrame, by: Sequence[str]) -> StructType:
    return StructType([*[df.schema[k] for k in by], *StructType.fromDDL(_RESULT).fields])


def nested_cross_products(
    df: DataFrame, response: str, terms: Sequence[Term], inner: str, outer: str | None, by: Sequence[str], ratios: Ratios
) -> DataFrame:
    """(by, i, j, value) of W'V⁻¹W at stated sd ratios, and log|V| as i = j = -1.

    W is the intercept, the terms and the response, all but the intercept centred on their group's
    means; V is in units of the residual variance.  These are what the REML criterion is made of.
    """
    with Scratch(df.sparkSession) as scratch:
        design = Design.build(df, response, terms, inner, outer, by, scratch.stage)
        point = F.array(F.struct(F.lit(float(ratios[0])).alias("r1"), F.array(F.lit(float(ratios[1]))).alias("r2s")))
        seen = design.profiles(design.levels, design.centres.select("g", point.alias("points")))

        def each(row: dict) -> list[tuple]:
            (profile,) = _read(row)[1].values()
            n = len(profile.matrix)
            return [(row["g"], -1, -1, float(profile.log_det)), *[(row["g"], i, j, float(profile.matrix[i, j])) for i in range(n) for j in range(i, n)]]

        joined = seen.join(design.centres.select("g", "n", "means", "covariances"), "g")
        found = joined.mapInPandas(lambda batches: _rows(batches, each, ["g", "i", "j", "value"]), "g long, i int, j int, value double")
        return stage(found.join(design.centres.select("g", *by), "g").select(*by, "i", "j", "value"), "cross-products")
