"""The mixed-model equations of crossed intercepts on blocks of whole verbs: one job a pass.

``response ~ terms + (1 | rater) + (1 | pair) + (1 | verb)``, pairs nested in verbs.  Cells lie in blocks, each with all cells of
its verbs, as arrays in rows of a staged table.  Given the raters' effects, a block works out its pairs' and verbs' effects by
itself; what it sends on is sums by rater and a small matrix.  The fixed effects enter those sums linearly, so one pass
gives both, and an iteration of the conjugate gradients on the raters' equations is one pass.

The raters' vectors are held by the driver and broadcast to the tasks, so a design has at most ``LEVELS`` raters here, and a
block at most ``BLOCK`` cells; ``Blocks.of`` gives None for others, whose same equations ``reml.Equations`` solves over tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.operators.mixed import Crossed
from pairlab.sources.staging import Scratch

#: Raters whose vectors travel to every task: some 54 MB for 17 right-hand sides.
LEVELS = 400_000
#: Cells that a block aims at, and that it may have at most.
AIM, BLOCK = 250_000, 2_000_000
#: Raters in a row of sums.
PIECE = 8192
#: A solution's residual, as a share of its right-hand side's, and iterations before a fit fails.
TOLERANCE, ITERATIONS = 1e-8, 500

#: Probes that are solved together: 17 right-hand sides with the response.
GROUP = 16

_SCHEMA = "rater binary, pair binary, n binary, verb binary, totals binary"


def _by(at: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    return np.column_stack([np.bincount(at, weights=c, minlength=size) for c in values.T])


class _Block:
    """A block's cells and pairs at stated variance ratios."""

    def __init__(self, row: dict[str, bytes], theta: np.ndarray, n_raters: int):
        self.rater, self.pair, self.verb = (np.frombuffer(row[c], dtype=np.int32) for c in ("rater", "pair", "verb"))
        self.count, self.theta, self.m = np.frombuffer(row["n"]), theta, (n_raters, len(self.verb), int(self.verb.max()) + 1)
        totals = np.frombuffer(row["totals"]).reshape(len(self.verb), -1)
        self.x, self.y = np.ascontiguousarray(totals[:, :-1]), totals[:, -1:]
        self.u = (1 / (1 + self.x[:, :1] * theta[1]))
        self.vx = self.to_verbs(self.x)
        self.share = theta[2] / (1 + theta[2] * self.vx[:, :1])

    def to_verbs(self, z: np.ndarray) -> np.ndarray:
        return _by(self.verb, self.m[2], self.u * z)

    def to_pairs(self, raters: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(self.pair, weights=self.count * c[self.rater], minlength=self.m[1]) for c in raters.T])

    def to_raters(self, pairs: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(self.rater, weights=self.count * c[self.pair], minlength=self.m[0]) for c in pairs.T])

    def absorbed(self, z: np.ndarray) -> np.ndarray:
        return (self.x * (self.theta[1] * self.u)).T @ z + (self.vx * self.share).T @ self.to_verbs(z)

    def effects(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own effects of pairs, and of verbs, given right-hand sides without raters and fixed effects."""
        c = self.share * self.to_verbs(z)
        return self.theta[1] * self.u * (z - self.x[:, :1] * c[self.verb]), c

    def answer(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, c = self.effects(z)
        return self.to_raters(b + c[self.verb]), self.absorbed(z)

    def second_sides(self, a: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """s of pairs and verbs from the response's solution, and the working variates' right-hand sides."""
        b, c = self.effects(self.y - self.to_pairs(a) - self.x @ beta)
        s, t = b / self.theta[1], c / self.theta[2]
        n = self.x[:, :1]
        return s, t, np.hstack([self.to_pairs(a / self.theta[0]), n * s, n * t[self.verb], s])


# What a pass does with a block: sums by rater, and a flat list of other sums.


def _known(block: _Block, signs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Traces of pairs and verbs without raters and fixed effects, what the latter take off, and the signs as absorbed."""
    own, w = block.u * block.x[:, :1], block.vx[:, :1]
    pairs, verbs = block.effects(block.x)
    traces = [(own - own**2 * block.share[block.verb]).sum(), (w / (1 + block.theta[2] * w)).sum()]
    return np.zeros((0, 1)), [np.array(traces), pairs.T @ pairs, verbs.T @ verbs, block.absorbed(block.to_pairs(signs))]


def _response(block: _Block, moved: np.ndarray, kind: str) -> np.ndarray:
    """Right-hand sides of pairs, less what the raters' effects explain; the probes' come with the effects."""
    taken = -block.to_pairs(moved)
    if kind == "response":
        taken[:, :1] += block.y
    return taken


def _begin(block: _Block, at) -> tuple[np.ndarray, list[np.ndarray]]:
    raters, small = block.answer(np.hstack([block.x, _response(block, *at)]))
    return raters, [small]


def _image(block: _Block, direction: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    raters, small = block.answer(block.to_pairs(direction))
    return raters, [small]


def _probe_sums(block: _Block, at) -> tuple[np.ndarray, list[np.ndarray]]:
    """Products of the pairs' and verbs' effects in the probes' solutions with those that the signs alone would have."""
    moved, beta, signs, alone, kind = at
    b, c = block.effects(_response(block, moved, kind) - block.x @ beta)
    bs, cs = block.effects(block.to_pairs(signs) - block.x @ alone)
    k = signs.shape[1]
    return np.zeros((0, 1)), [(b[:, -k:] * bs).sum(axis=0), (c[:, -k:] * cs).sum(axis=0)]


def _first_sums(block: _Block, at) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of the response's solution, and the beginning of the second."""
    a, beta, start = at
    b, c = block.effects(_response(block, a, "response") - block.x @ beta)
    s, t, z = block.second_sides(a, beta)
    raters, small = block.answer(z - block.to_pairs(start))
    both = np.hstack([s, t[block.verb]])
    numbers = np.array([(b**2).sum(), (c**2).sum(), ((b + c[block.verb]) * block.y).sum()])
    return np.hstack([block.to_raters(both), raters]), [numbers, block.x.T @ both, small]


def _second_sums(block: _Block, at) -> tuple[np.ndarray, list[np.ndarray]]:
    a, beta, working, second = at
    s, t, z = block.second_sides(a, beta)
    b, c = block.effects(z - block.to_pairs(working) - block.x @ second)
    return np.zeros((0, 1)), [(s * b).sum(axis=0), (t * c).sum(axis=0)]


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(v) for v in rows["values"])
    return pd.DataFrame({"piece": rows["piece"].iloc[:1], "values": [total.tobytes()]})


class Blocks:
    def __init__(self, design: Crossed, table: DataFrame, raters: pd.DataFrame, names: Sequence[str]):
        self.d, self.table = design, table
        self.x, self.y = raters[list(names)].to_numpy(dtype=float), raters[["wy"]].to_numpy(dtype=float)
        self.gram, self.theta = design.centre.gram(), np.ones(3)
        self.xx, self.xy = self.gram[:-1, :-1], self.gram[:-1, -1:]
        self.signs, self.starts = np.zeros((len(self.x), 0)), [None, None]

    def probe(self, signs: np.ndarray) -> None:
        """Take these probes (raters in order of their keys x probes) from now on."""
        self.signs, self.starts = signs, [None, None]

    @classmethod
    def of(cls, design: Crossed, scratch: Scratch) -> Blocks | None:
        """Blocks of a design, without probes yet; None if it doesn't fit them."""
        if design.n_raters > LEVELS:
            return None
        names = ["n", *[f"w{j + 1}" for j in design.centre.kept]]
        context = design.cells.sparkSession.sparkContext
        count = max(4 * context.defaultParallelism, -(-design.cells.count() // AIM))
        block = F.pmod(F.xxhash64("verb"), F.lit(count))
        if (design.cells.groupBy(block).count().agg(F.max("count")).first()[0] or 0) > BLOCK:
            return None  # one verb with so many cells
        raters = design.raters.select("rater", *names, "wy").orderBy("rater").toPandas()
        known = context.broadcast(raters["rater"].to_numpy())

        def gather(cells: pd.DataFrame) -> pd.DataFrame:
            pair = cells.groupby(["verb", "pair"], sort=False).ngroup().to_numpy()
            first = np.unique(pair, return_index=True)[1]
            totals = _by(pair, len(first), cells[[*names, "wy"]].to_numpy(dtype=float))
            order = np.argsort(pair, kind="stable")
            arrays = {
                "rater": pd.Index(known.value).get_indexer(cells["rater"])[order].astype(np.int32), "pair": pair[order].astype(np.int32),
                "n": cells["n"].to_numpy(dtype=float)[order], "verb": pd.factorize(cells["verb"].to_numpy()[first])[0].astype(np.int32), "totals": totals,
            }
            return pd.DataFrame({k: [v.tobytes()] for k, v in arrays.items()})

        dealt = design.cells.select("rater", "pair", "verb", *names, "wy", block.alias("block")).repartition(count, "block")
        table = scratch.stage(dealt.groupBy("block").applyInPandas(gather, _SCHEMA), "blocks", every_round=True)
        return cls(design, table, raters, names)

    def _pass(self, work: Callable, at, width: int, shapes: Sequence[tuple[int, ...]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sums over all blocks of what ``work`` gives: (raters x width), and arrays of the other shapes."""
        context = self.d.cells.sparkSession.sparkContext
        shared = context.broadcast((at, self.theta))
        m = len(self.x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, theta = shared.value
            raters, small = 0.0, 0.0
            for batch in batches:
                for row in batch.to_pylist():
                    by_rater, others = work(_Block(row, theta, m), held)
                    raters, small = raters + by_rater, small + np.concatenate([o.ravel() for o in others])
            if isinstance(small, np.ndarray):
                pieces = [small, *[raters[i: i + PIECE] for i in range(0, len(raters), PIECE)]]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["piece", "values"])

        schema = "piece int, values binary"
        rows = sorted(self.table.mapInArrow(run, schema).groupBy("piece").applyInPandas(_add, schema).collect(), key=lambda r: r["piece"])
        shared.destroy()
        first, *rest = [np.frombuffer(r["values"]) for r in rows]
        cut = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        sums = [a.reshape(s) for a, s in zip(np.split(first, cut), shapes, strict=True)]
        return np.concatenate(rest).reshape(m, width) if rest else np.zeros((0, 0)), sums

    def _solve(self, begun: tuple[np.ndarray, np.ndarray], raters: np.ndarray, fixed: np.ndarray, a: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """(β, a): conjugate gradients from ``a``, where a pass has given the blocks' answer ``begun`` to what is left."""
        diagonal, k = self.x[:, :1] + 1 / self.theta[0], a.shape[1]
        answer, absorbed = begun

        def rest(answer: np.ndarray, beta: np.ndarray) -> np.ndarray:
            return self.x @ beta + answer - self.of_fixed @ beta

        beta = self.fixed_inverse @ (fixed - self.x.T @ a - absorbed)
        r = raters - diagonal * a - rest(answer, beta)
        d = r / diagonal
        size = (r * d).sum(axis=0)
        # a right-hand side may lie in the fixed effects alone
        least = tolerance**2 * np.maximum(np.maximum((raters**2 / diagonal).sum(axis=0), size if not a.any() else 0.0), 1e-300)
        for _ in range(ITERATIONS):
            if (size <= least).all():
                return self.fixed_inverse @ (fixed - self.x.T @ a - absorbed), a
            answer, (taken,) = self._pass(_image, d, k, [(self.x.shape[1], k)])
            q = diagonal * d - rest(answer, self.fixed_inverse @ (self.x.T @ d - taken))
            step = size / np.maximum((d * q).sum(axis=0), 1e-300)
            a, r, absorbed = a + step * d, r - step * q, absorbed - step * taken
            after = (r * r / diagonal).sum(axis=0)
            d = r / diagonal + after / np.maximum(size, 1e-300) * d
            size = after
        raise RuntimeError(f"equations not solved after {ITERATIONS} iterations")

    def _begin(self, theta: np.ndarray, moved: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
        self.theta = np.asarray(theta, dtype=float)
        c, k = self.x.shape[1], moved.shape[1]
        raters, (small,) = self._pass(_begin, (moved, kind), c + k, [(c, c + k)])
        self.of_fixed, self.fixed_inverse = raters[:, :c], np.linalg.inv(self.xx - small[:, :c])
        return raters[:, c:], small[:, c:]

    def step(self, theta: np.ndarray, tolerance: float = TOLERANCE) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(y'Py, squared effects by factor, known parts of the traces, what each probe says of the rest, products of the working variates).

        The traces of pairs and verbs are known but for what goes through the raters; the signs on raters that probe the raters' own
        trace probe that as well, so that the other factors need no signs.
        """
        c, m, parts = self.x.shape[1], len(self.x), []
        for at in range(0, self.signs.shape[1], GROUP):
            signs = self.signs[:, at: at + GROUP].astype(float)
            k, lead, kind = signs.shape[1], int(at == 0), "response" if at == 0 else "probes"
            sides, fixed = np.hstack([self.y[:, :lead], self.x[:, :1] * signs]), np.hstack([self.xy[:, :lead], self.x.T @ signs])
            shift = np.hstack([np.zeros((m, lead)), signs])  # signs reach the pairs as effects of raters do
            start = np.zeros_like(sides) if at or self.starts[0] is None else self.starts[0]
            beta, a = self._solve(self._begin(theta, start - shift, kind), sides, fixed, start, tolerance)
            _, (known, of_pairs, of_verbs, absorbed) = self._pass(_known, signs, 0, [(2,), (c, c), (c, c), (c, k)])
            alone = self.fixed_inverse @ (self.x.T @ signs - absorbed)
            _, through = self._pass(_probe_sums, (a - shift, beta, signs, alone, kind), 0, [(k,), (k,)])
            parts.append(np.vstack([(a[:, lead:] * signs).sum(axis=0) / self.theta[0], *[-self.theta[0] * t / v**2 for t, v in zip(through, self.theta[1:], strict=True)]]))
            if at == 0:
                self.starts[0], response, by_response = a, a[:, :1], beta[:, :1]
        less = [float((self.fixed_inverse * o).sum()) / v**2 for o, v in zip((of_pairs, of_verbs), self.theta[1:], strict=True)]
        second = np.zeros((m, 4)) if self.starts[1] is None else self.starts[1]
        raters, (squares, fixed, absorbed) = self._pass(_first_sums, (response, by_response, second), 6, [(3,), (c, 2), (c, 4)])
        ypy = float(self.gram[-1, -1] - self.xy[:, 0] @ by_response[:, 0] - self.y[:, 0] @ response[:, 0] - squares[2])
        s = response / self.theta[0]
        sides = np.hstack([self.x[:, :1] * s, raters[:, :2], s])
        fixed = np.hstack([self.x.T @ s, fixed, np.zeros((c, 1))])
        after, working = self._solve((raters[:, 2:], absorbed), sides, fixed, second, tolerance)
        self.starts[1] = working
        _, (in_pairs, in_verbs) = self._pass(_second_sums, (response, by_response, working, after), 0, [(4,), (4,)])
        products = np.array([s[:, 0] @ working, in_pairs, in_verbs])
        return ypy, np.array([(response**2).sum(), *squares[:2]]), np.array([0.0, *(known - less)]), np.hstack(parts), products

    def fixed_effects(self, theta: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
        """p x (1 + p): fixed effects, then their covariance over the residual variance."""
        p = self.x.shape[1]
        sides, start = np.hstack([self.y, np.zeros((len(self.y), p))]), np.zeros((len(self.y), p + 1))
        return self._solve(self._begin(theta, start, "response"), sides, np.hstack([self.xy, np.eye(p)]), start, tolerance)[0]
