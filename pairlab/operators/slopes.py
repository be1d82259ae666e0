"""Mixed models with correlated random slopes for two crossed factors.

``response ~ terms + (1 + slopes | first) + (1 + slopes | second)``.  Fixed effects and
random effects come from alternating block solves, as for crossed intercepts, with one small
ridge system per level.  Covariances are updated by variational EM: each block contributes
its estimates and its own posterior covariance.

Data passes are joins and grouped sums over cells; the ridge systems are solved in batches
inside tasks, on level rows that Spark has already folded.  Cells and the second factor's tables lie in buckets of its levels, so
a sweep does not shuffle the cells while the first factor's effects are small enough to broadcast by their real size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions.design import INTERCEPT, Term
from pairlab.functions.tdist import two_sided_p
from pairlab.operators.ols import moments, unpack
from pairlab.sources.staging import Scratch


@dataclass
class Block:
    """One grouping factor: its level totals and which design columns vary by level."""

    name: str
    columns: list[int]
    table: DataFrame
    levels: int
    covariance: np.ndarray

    @property
    def size(self) -> int:
        return len(self.columns)


@dataclass
class Sums:
    """What one block solve adds up over its levels."""

    spread: np.ndarray  # sum of b b' + posterior covariance
    trace: float  # sum of tr(Z'Z posterior covariance)
    effects: np.ndarray  # sum of b
    fixed: np.ndarray  # sum of X'Z b
    own: float  # sum of b'Z'y
    self_: float  # sum of b'Z'Z b
    cross: float  # sum of b' (other block's Z'Z b)


def _ridge(table: DataFrame, other: DataFrame | None, q: int, p: int, k: int, penalty: np.ndarray, sigma2: float,
           beta: np.ndarray, with_response: bool) -> DataFrame:
    """Per level: effects b (q x k, flat); and a row of each task without a level, with the flat pieces of ``Sums`` over its levels."""
    joined = table if other is None else table.join(other, "level", "left")
    if other is None:
        joined = joined.withColumn("taken", F.lit(None).cast("array<double>"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for batch in batches:
            if batch.empty:
                continue
            rows = len(batch)
            zz = np.stack(batch["zz"].to_numpy()).reshape(rows, q, q)
            zx = np.stack(batch["zx"].to_numpy()).reshape(rows, q, p)
            right = -zx @ beta
            zy = np.stack(batch["zy"].to_numpy())
            if with_response:
                right[:, :, 0] += zy
            taken = np.zeros((rows, q, k))
            present = batch["taken"].notna().to_numpy()
            if present.any():
                taken[present] = np.stack(batch["taken"][present].to_numpy()).reshape(-1, q, k)
            posterior = np.linalg.inv(zz + penalty)
            b = posterior @ (right - taken)
            lead = b[:, :, 0]
            spread = lead[:, :, None] * lead[:, None, :] + sigma2 * posterior
            pieces = np.concatenate(
                [
                    spread.reshape(rows, -1),
                    sigma2 * np.einsum("rij,rji->r", zz, posterior)[:, None],
                    b.reshape(rows, -1),
                    (zx.transpose(0, 2, 1) @ b).reshape(rows, -1),
                    np.einsum("rq,rq->r", lead, zy)[:, None],
                    np.einsum("ri,rij,rj->r", lead, zz, lead)[:, None],
                    np.einsum("rq,rq->r", lead, taken[:, :, 0])[:, None],
                ],
                axis=1,
            )
            total += pieces.sum(axis=0)
            yield pd.DataFrame({"level": batch["level"], "b": list(b.reshape(rows, -1)), "s": None})
        if isinstance(total, np.ndarray):
            yield pd.DataFrame({"level": [None], "b": [None], "s": [total]})

    kind = table.schema["level"].dataType.simpleString()
    return joined.select("level", "zz", "zx", "zy", "taken").mapInPandas(
        solve, f"level {kind}, b array<double>, s array<double>"
    )


def _absorbed(table: DataFrame, other: DataFrame | None, q: int, p: int, k: int, penalty: np.ndarray, with_response: bool) -> np.ndarray:
    """Sums over levels of X'Z M⁻¹ [Z'X, right side]: a p x (p + k) matrix, one row per task shuffled."""
    joined = table.withColumn("taken", F.lit(None).cast("array<double>")) if other is None else table.join(other, "level", "left")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p + k))
        for batch in batches:
            if batch.empty:
                continue
            rows = len(batch)
            zz = np.stack(batch["zz"].to_numpy()).reshape(rows, q, q)
            zx = np.stack(batch["zx"].to_numpy()).reshape(rows, q, p)
            right = np.zeros((rows, q, k))
            if with_response:
                right[:, :, 0] = np.stack(batch["zy"].to_numpy())
            present = batch["taken"].notna().to_numpy()
            if present.any():
                right[present] -= np.stack(batch["taken"][present].to_numpy()).reshape(-1, q, k)
            solved = np.linalg.solve(zz + penalty, np.concatenate([zx, right], axis=2))
            total += np.einsum("rqp,rqc->pc", zx, solved)
        yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

    cells = joined.select("zz", "zx", "zy", "taken").mapInPandas(fold, "cell bigint, value double")
    out = np.zeros(p * (p + k))
    for row in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[row["cell"]] = row["value"]
    return out.reshape(p, p + k)


def _read(solved: DataFrame, q: int, p: int, k: int) -> Sums:
    width = q * q + 1 + q * k + p * k + 3
    row = solved.where("level is null").agg(*[F.expr(f"sum(s[{i}]) AS s{i}") for i in range(width)]).first()
    v = np.array([0.0 if x is None else x for x in row])
    cut = np.cumsum([q * q, 1, q * k, p * k, 1, 1, 1])
    a, t, e, x, o, s, c = np.split(v, cut[:-1])
    return Sums(a.reshape(q, q), float(t[0]), e.reshape(q, k), x.reshape(p, k), float(o[0]), float(s[0]), float(c[0]))


class _Model:
    def __init__(self, df: DataFrame, response: str, terms: Sequence[Term], groups: Sequence[tuple[str, Sequence[str]]], scratch: Scratch):
        self.scratch = scratch
        levels = [g for g, _ in groups]
        df = df.dropna(subset=levels)
        names = [n for n, _ in terms]
        row = moments(df, response, terms).first()
        self.n = row["n"]
        means, cross = unpack(self.n, row["means"], row["covariances"])
        varying = {t for _, ts in groups for t in ts}
        # Columns that vary by level keep their coding; the others and the response are centred.
        self.shift = np.array([0.0 if n in varying else m for n, m in zip(names, means)])
        self.ybar = float(means[-1])
        self.p = len(terms) + 1
        off = np.concatenate([means[:-1] - self.shift, [0.0]])
        raw = cross + self.n * np.outer(off, off)
        self.xx = np.zeros((self.p, self.p))
        self.xx[0, 0], self.xx[0, 1:] = self.n, self.n * off[:-1]
        self.xx[1:, 0], self.xx[1:, 1:] = self.n * off[:-1], raw[:-1, :-1]
        self.xy = np.concatenate([[0.0], raw[:-1, -1]])
        self.yy = float(raw[-1, -1])
        x = [f"x{i + 1}" for i in range(len(terms))]
        columns = [(c.cast("double") - F.lit(float(s))).alias(n) for n, (_, c), s in zip(x, terms, self.shift)]
        rows = df.select(
            *[F.col(g).alias(a) for a, g in zip(("first", "second"), levels)], *columns,
            (F.col(response).cast("double") - F.lit(self.ybar)).alias("y"),
        ).dropna(subset=[*x, "y"])
        self.cells = self.scratch.stage_bucketed(
            rows.groupBy("first", "second", *x).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("y")),
            "slope-cells", "second",
        )
        column = ["1D", *x]
        self.sigma2 = self.yy / self.n
        self.blocks = []
        for name, (_, slopes) in zip(("first", "second"), groups):
            at = [0, *[names.index(s) + 1 for s in slopes]]
            zz = ", ".join(f"sum(n * {column[i]} * {column[j]})" for i in at for j in at)
            zx = ", ".join(f"sum(n * {column[i]} * {column[j]})" for i in at for j in range(self.p))
            zy = ", ".join(f"sum(y * {column[i]})" for i in at)
            table = self.cells.groupBy(F.col(name).alias("level")).agg(
                F.expr(f"array({zz})").alias("zz"), F.expr(f"array({zx})").alias("zx"), F.expr(f"array({zy})").alias("zy")
            )
            table = self.scratch.stage_bucketed(table, f"{name}-levels", "level") if name == "second" else self.scratch.stage(table, f"{name}-levels")
            self.blocks.append(Block(name, at, table, table.count(), np.eye(len(at))))
        ordinary = np.linalg.solve(self.xx, self.xy)
        for block in self.blocks:
            block.covariance = self.starting_covariance(block, ordinary)

    def cross_sums(self, effects: DataFrame, source: Block, target: Block, k: int) -> DataFrame:
        """Z_target' Z_source b per target level: one join on the source level, one grouped sum."""
        column = ["1D", *[f"x{i + 1}" for i in range(self.p - 1)]]
        fitted = [
            " + ".join(f"{column[j]} * b[{s * k + c}]" for s, j in enumerate(source.columns)) + f" AS f{c}" for c in range(k)
        ]
        joined = self.cells.join(effects.select(F.col("level").alias(source.name), "b"), source.name)
        rows = joined.selectExpr(f"{target.name} AS level", "n", *column[1:], *fitted)
        sums = [f"sum(n * {column[i]} * f{c})" for i in target.columns for c in range(k)]
        return rows.groupBy("level").agg(F.expr(f"array({', '.join(sums)})").alias("taken"))

    def starting_covariance(self, block: Block, beta: np.ndarray) -> np.ndarray:
        """Spread of per-level least-squares effects beyond their sampling error.

        Levels whose own data cannot identify every effect are left out of this first guess.
        """
        q, p, sigma2 = block.size, self.p, self.sigma2

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(q * q + 1)
            for batch in batches:
                if batch.empty:
                    continue
                rows = len(batch)
                zz = np.stack(batch["zz"].to_numpy()).reshape(rows, q, q)
                zx = np.stack(batch["zx"].to_numpy()).reshape(rows, q, p)
                zy = np.stack(batch["zy"].to_numpy())
                values = np.linalg.eigvalsh(zz)
                good = values[:, 0] > 1e-6 * values[:, -1]
                if not good.any():
                    continue
                inverse = np.linalg.inv(zz[good])
                b = np.einsum("rij,rj->ri", inverse, zy[good] - zx[good] @ beta)
                excess = b[:, :, None] * b[:, None, :] - sigma2 * inverse
                weight = zz[good][:, 0, 0]
                total[:-1] += np.einsum("r,rij->ij", weight, excess).ravel()
                total[-1] += weight.sum()
            yield pd.DataFrame({"cell": np.arange(len(total)), "value": total})

        cells = block.table.select("zz", "zx", "zy").mapInPandas(fold, "cell bigint, value double")
        total = np.zeros(q * q + 1)
        for row in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect():
            total[row["cell"]] = row["value"]
        guess = total[:-1].reshape(q, q) / total[-1] if total[-1] > 0 else 0.2 * sigma2 * np.eye(q)
        values, vectors = np.linalg.eigh((guess + guess.T) / 2)
        return (vectors * np.maximum(values, 1e-3 * sigma2)) @ vectors.T

    def sweep(self, effects: DataFrame | None, moved: np.ndarray, right: np.ndarray, response: bool, sums_wanted: np.ndarray):
        """One round: (fixed, second block) given the first, then the first given both."""
        self.scratch.next_round()
        first, second = self.blocks
        k = right.shape[1]
        taken = None if effects is None else self.scratch.stage_bucketed(self.cross_sums(effects, first, second, k), "taken", "level")
        penalty = self.sigma2 * np.linalg.inv(second.covariance)
        folded = _absorbed(second.table, taken, second.size, self.p, k, penalty, response)
        beta = np.linalg.solve(self.xx - folded[:, : self.p], right - moved - folded[:, self.p:])
        solved2 = self.scratch.stage(_ridge(second.table, taken, second.size, self.p, k, penalty, self.sigma2, beta, response), "second")
        sums2 = _read(solved2, second.size, self.p, k)
        taken1 = self.cross_sums(solved2.where("level is not null"), second, first, k)
        penalty1 = self.sigma2 * np.linalg.inv(first.covariance)
        solved1 = self.scratch.stage(_ridge(first.table, taken1, first.size, self.p, k, penalty1, self.sigma2, beta, response), "first")
        sums1 = _read(solved1, first.size, self.p, k)
        # Shift the first block to the total it has at the solution.
        lift = (sums_wanted - sums1.effects) / first.levels
        flat = F.array(*[F.lit(float(v)) for v in lift.ravel()])
        shifted = solved1.where("level is not null").select("level", F.zip_with("b", flat, lambda a, c: a + c).alias("b"))
        # X'Z of the first block adds up to X'X over its columns.
        moved = sums1.fixed + self.xx[:, first.columns] @ lift
        return beta, shifted, moved, sums1, sums2


def fit_slopes(
    df: DataFrame, response: str, terms: Sequence[Term], first: tuple[str, Sequence[str]], second: tuple[str, Sequence[str]],
    iterations: int = 1000, tolerance: float = 1e-3, error_sweeps: int = 1000,
) -> DataFrame:
    """Coefficients with z tests, then the covariance of every random effect and the residual.

    ``first`` and ``second`` are (grouping column, terms whose effect varies by level); an
    intercept always varies.  Stops when no coefficient moves by more than ``tolerance`` of
    its standard error and the residual variance has settled; a fit that never does fails.
    """
    with Scratch(df.sparkSession) as scratch:
        model = _Model(df, response, terms, [first, second], scratch)
        one, two = model.blocks
        effects, moved = None, np.zeros((model.p, 1))
        beta = np.zeros((model.p, 1))
        for _ in range(iterations):
            new_beta, effects, moved, sums1, sums2 = model.sweep(
                effects, moved, model.xy[:, None], True, np.zeros((one.size, 1))
            )
            # Residual sum of squares from totals: no pass over the rows.
            b = new_beta[:, 0]
            rss = (
                model.yy - 2 * b @ model.xy + b @ model.xx @ b
                - 2 * (sums1.own + sums2.own) + 2 * b @ (sums1.fixed[:, 0] + sums2.fixed[:, 0])
                + sums1.self_ + sums2.self_ + 2 * sums1.cross
            )
            sigma2 = max((rss + sums1.trace + sums2.trace) / (model.n - model.p), 1e-12 * model.yy / model.n)
            settled = abs(sigma2 - model.sigma2) <= tolerance * model.sigma2
            scale = np.sqrt(sigma2 * np.diag(np.linalg.inv(model.xx)))
            settled = settled and bool(np.all(np.abs(new_beta - beta)[:, 0] <= tolerance * scale))
            floor = 1e-8 * sigma2
            drift = 0.0
            for block, sums in ((one, sums1), (two, sums2)):
                updated = sums.spread / block.levels + floor * np.eye(block.size)
                drift = max(drift, float(np.abs(updated - block.covariance).max() / sigma2))
                block.covariance = updated
            model.sigma2, beta = sigma2, new_beta
            if settled and drift <= tolerance:
                break
        else:
            raise RuntimeError(f"not settled after {iterations} iterations")
        covariance = _fixed_covariance(model, error_sweeps)
    shift = np.eye(model.p)
    shift[0, 1:] = -model.shift
    estimate = shift @ beta[:, 0]
    estimate[0] += model.ybar
    errors = np.sqrt(np.diag(shift @ covariance @ shift.T))
    names = [INTERCEPT, *[n for n, _ in terms]]
    rows = []
    for name, b, se in zip(names, estimate, errors):
        z = float(b / se)
        rows.append(("fixed", name, None, float(b), float(se), z, two_sided_p(z, math.inf)))
    for (group, _), block in zip((first, second), model.blocks):
        for i, a in enumerate(block.columns):
            for j, c in enumerate(block.columns[: i + 1]):
                rows.append((group, names[a], names[c], float(block.covariance[i, j]), None, None, None))
    rows.append(("residual", None, None, float(model.sigma2), None, None, None))
    return df.sparkSession.createDataFrame(
        rows, "part string, term string, with_term string, estimate double, std_error double, z_value double, p_value double"
    )


def _fixed_covariance(model: _Model, sweeps: int) -> np.ndarray:
    """Covariance of the fixed effects: the same sweeps on unit right-hand sides."""
    one = model.blocks[0]
    right = np.eye(model.p)
    wanted = -(one.covariance / model.sigma2) @ right[one.columns, :]
    effects, moved, old = None, np.zeros((model.p, model.p)), None
    for _ in range(sweeps):
        inverse, effects, moved, _, _ = model.sweep(effects, moved, right, False, wanted)
        if old is not None and np.abs(inverse - old).max() <= 1e-4 * np.abs(inverse).max():
            break
        old = inverse
    else:
        raise RuntimeError(f"standard errors not settled after {sweeps} sweeps")
    return model.sigma2 * (inverse + inverse.T) / 2
