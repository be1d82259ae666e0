"""A causal letter network as batch scorer: trained in tasks, averaged in Spark, scored in padded batches.

Every letter (code point modulo ``SYMBOLS``) is predicted from the ``CONTEXT`` letters before it: their embeddings go
through one hidden layer to a softmax.  Training runs over all texts in rounds.  A task fits a copy of
the weights by Adam to its texts, and copies are averaged in Spark, weighted by the letters they saw, in pieces and in two
steps, so that no group grows with the number of tasks.

Scoring sorts a batch's texts by length, fills those of about one length up to a matrix and masks the padding, so
neither the batch's size nor its order changes a score.  Weights travel to each executor once, as a file.
"""

from __future__ import annotations

import atexit
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.operators.scoring import BatchScorer

SYMBOLS, CONTEXT, EMBEDDING, HIDDEN = 256, 6, 12, 48
#: Rounds over all texts, letters of one step, step size, and cells of one padded batch.
ROUNDS, STEP, RATE, CELLS = 2, 4096, 0.01, 1 << 17
#: Places whose logits are held at a time, twice as many in single precision: half a megabyte.
BLOCK = 256
#: Pieces in which weights travel, and groups of the first step of their average.
PIECES, SPREAD = 8, 32
SEED = 3

Weights = dict[str, np.ndarray]
_SHAPES = {
    "embed": (SYMBOLS + 1, EMBEDDING), "w1": (CONTEXT * EMBEDDING, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, SYMBOLS), "b2": (SYMBOLS,),
}


def first_weights(seed: int = SEED) -> Weights:
    rng = np.random.default_rng(seed)
    return {k: rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s) for k, s in _SHAPES.items()}


def flatten(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in _SHAPES])


def unflatten(values: np.ndarray) -> Weights:
    cut = np.cumsum([int(np.prod(s)) for s in _SHAPES.values()])
    return {k: part.reshape(s) for (k, s), part in zip(_SHAPES.items(), np.split(values, cut[:-1]), strict=True)}


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) % SYMBOLS


def before(codes: np.ndarray) -> np.ndarray:
    """The letters before each place of a row of letters (or a matrix of rows), nearest first; ``SYMBOLS`` before the first."""
    rows = np.atleast_2d(codes)
    out = np.full((*rows.shape, CONTEXT), SYMBOLS, dtype=np.int64)
    for k in range(CONTEXT):
        out[:, k + 1:, k] = rows[:, : max(rows.shape[1] - k - 1, 0)]
    return out if codes.ndim > 1 else out[0]


def _bounded(weights: Weights) -> bool:
    """Can no logit overflow an exponential, nor a sum of them?  A hidden unit lies between -1 and 1."""
    most = 300 if weights["w2"].dtype == np.float64 else 70
    return float((np.abs(weights["w2"]).sum(axis=0) + np.abs(weights["b2"])).max()) < most


def _forward(weights: Weights, around: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, hidden units and logits of each place, less the largest where they may be large."""
    x = weights["embed"][around].reshape(len(around), -1)
    hidden = x @ weights["w1"]
    hidden += weights["b1"]
    np.tanh(hidden, out=hidden)
    out = hidden @ weights["w2"]
    out += weights["b2"]
    if not safe:
        out -= out.max(axis=1, keepdims=True)
    return x, hidden, out


def log_probs(weights: Weights, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(letter | letters before it) of each place; equal letters before a place are met once."""
    safe = _bounded(weights)
    coded = around @ ((SYMBOLS + 1) ** np.arange(CONTEXT, dtype=np.int64))
    _, first, which = np.unique(coded, return_index=True, return_inverse=True)
    order = np.argsort(which, kind="stable")
    edge = np.searchsorted(which[order], np.arange(0, len(first) + BLOCK, BLOCK))
    found = np.empty(len(target))
    for k in range(0, len(first), BLOCK):
        out = _forward(weights, around[first[k: k + BLOCK]], safe)[2]
        mine = order[edge[k // BLOCK]: edge[k // BLOCK + 1]]
        row = which[mine] - k
        logit = out[row, target[mine]]
        np.exp(out, out=out)
        found[mine] = logit - np.log(out.sum(axis=1))[row]
    return found


def _layers(weights: Weights, x: np.ndarray, target: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Gradient of the mean negative log-probability by both layers, and by each place's embeddings ``x``.

    Logits are held for blocks of places that stay in a core's cache; their exponentials are never divided by their sums, but the
    narrower hidden units that meet them are.
    """
    n, safe, kind = len(target), _bounded(weights), x.dtype
    hidden = np.ones((n, HIDDEN + 1), dtype=kind)  # the last one meets the biases
    slope = x @ weights["w1"]
    slope += weights["b1"]
    np.tanh(slope, out=slope)
    hidden[:, :-1] = slope
    above, across = np.concatenate([weights["w2"], weights["b2"][None]]), np.ascontiguousarray(weights["w2"].T)
    size = min(2 * BLOCK, n)
    held, scaled, row, ones = np.empty((size, SYMBOLS), dtype=kind), np.empty((size, HIDDEN + 1), dtype=kind), np.arange(size), np.ones(SYMBOLS, dtype=kind)
    top, back = np.zeros_like(above), np.empty((n, HIDDEN), dtype=kind)
    for a in range(0, n, size):
        mine = hidden[a: a + size]
        m = len(mine)
        out = np.matmul(mine, above, out=held[:m])
        if not safe:
            out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        total = out @ ones
        out[row[:m], target[a: a + size]] -= total
        share = (1 / (total * n))[:, None]
        top += np.multiply(mine, share, out=scaled[:m]).T @ out
        np.matmul(out, across, out=back[a: a + size])
        back[a: a + size] *= share
    np.multiply(slope, slope, out=slope)
    np.subtract(1, slope, out=slope)
    back *= slope
    return {"w1": x.T @ back, "b1": back.sum(axis=0), "w2": top[:-1], "b2": top[-1]}, back @ weights["w1"].T


def gradient(weights: Weights, around: np.ndarray, target: np.ndarray) -> Weights:
    """Gradient of the mean negative log-probability of places, given the letters before each, nearest first."""
    found, inner = _layers(weights, weights["embed"][around].reshape(len(around), -1), target)
    flat, inner = around.ravel(), inner.reshape(-1, EMBEDDING)
    return {"embed": np.stack([np.bincount(flat, inner[:, k], SYMBOLS + 1) for k in range(EMBEDDING)], axis=1), **found}


def stretch_gradient(weights: Weights, codes: np.ndarray) -> Weights:
    """The gradient for a stretch of a text, whose first ``CONTEXT`` letters are only met before others (``SYMBOLS`` before a text).

    Neighbouring places share all letters but one, so that a letter is looked up once, and its places' gradients are added up before
    they are counted by letter.
    """
    n = len(codes) - CONTEXT
    rows = weights["embed"][codes[:-1]]
    x = sliding_window_view(rows, CONTEXT, axis=0).transpose(0, 2, 1).reshape(n, -1)  # farthest first
    turned = weights["w1"].reshape(CONTEXT, EMBEDDING, HIDDEN)[::-1].reshape(-1, HIDDEN)
    found, inner = _layers({**weights, "w1": turned}, x, codes[CONTEXT:])
    found["w1"] = found["w1"].reshape(CONTEXT, EMBEDDING, HIDDEN)[::-1].reshape(-1, HIDDEN)
    by_place = np.zeros_like(rows)
    for k in range(CONTEXT):
        by_place[k: k + n] += inner[:, k * EMBEDDING: (k + 1) * EMBEDDING]
    by_place = by_place.T.astype(float, order="C")
    return {"embed": np.stack([np.bincount(codes[:-1], c, SYMBOLS + 1) for c in by_place], axis=1), **found}


def _fit(weights: Weights, rate: float, step: int):
    """Adam in double precision, on gradients in single precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = flatten(weights)
        mean, square = np.zeros_like(own), np.zeros_like(own)
        turn = seen = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                codes = np.concatenate([np.full(CONTEXT, SYMBOLS), letters(text or "")])
                for a in range(CONTEXT, len(codes), step):
                    # a long text is met a step at a time, with the letters before the step
                    g = flatten(stretch_gradient(unflatten(own.astype(np.float32)), codes[a - CONTEXT: a + step])).astype(float)
                    turn += 1
                    scale = rate * np.sqrt(1 - 0.999**turn) / (1 - 0.9**turn)
                    mean += 0.1 * (g - mean)
                    square += 0.001 * (g * g - square)
                    own -= scale * mean / (np.sqrt(square) + 1e-8)
                seen += len(codes) - CONTEXT
        if seen:
            task = TaskContext.get().partitionId()
            pieces = [p.tobytes() for p in np.array_split(own * seen, PIECES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PIECES), pa.int32()), pa.array([task % SPREAD] * PIECES, pa.int32()), pa.array([float(seen)] * PIECES), pa.array(pieces, pa.binary())],
                names=["piece", "part", "weight", "values"],
            )

    return run


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(v) for v in group["values"])
    return pd.DataFrame({"piece": group["piece"].iloc[:1], "part": group["part"].iloc[:1], "weight": [group["weight"].sum()], "values": [total.tobytes()]})


def train_network(df: DataFrame, text: str, rounds: int = ROUNDS, rate: float = RATE, step: int = STEP) -> Weights:
    """Weights from all letters of all texts; nulls and empty texts teach nothing."""
    weights, schema = first_weights(), "piece int, part int, weight double, values binary"
    for turn in range(rounds):
        copies = df.select(text).mapInArrow(_fit(weights, rate / (1 + turn), step), schema)
        total = copies.groupBy("piece", "part").applyInPandas(_add, schema).groupBy("piece").applyInPandas(_add, schema).orderBy("piece").collect()
        if total:  # PIECES rows of fixed size
            weights = unflatten(np.concatenate([np.frombuffer(r["values"]) / r["weight"] for r in total]))
    return weights


def padded_scores(weights: Weights, texts: list[str], cells: int = CELLS) -> np.ndarray:
    """Mean log-probability of each text's letters, NaN for an empty one: texts of like length share a padded matrix."""
    codes = [letters(t) for t in texts]
    sizes = np.array([len(c) for c in codes])
    out = np.full(len(texts), np.nan)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and sizes[order[stop]] * (stop + 1 - at) <= cells:
            stop += 1
        mine = order[at:stop]
        width = int(sizes[mine].max())
        total = np.zeros(len(mine))
        matrix = np.zeros((len(mine), width), dtype=np.int64)
        for row, k in enumerate(mine):
            matrix[row, : sizes[k]] = codes[k]
        mask = np.arange(width) < sizes[mine][:, None]
        columns = max(1, cells // len(mine))
        for a in range(0, width, columns):  # a text longer than a batch is met in stretches
            around = before(matrix[:, max(a - CONTEXT, 0): a + columns])[:, min(a, CONTEXT):]
            target = matrix[:, a: a + columns]
            found = log_probs(weights, around.reshape(-1, CONTEXT), target.ravel()).reshape(target.shape)
            total += np.where(mask[:, a: a + columns], found, 0.0).sum(axis=1)
        out[mine] = total / sizes[mine]
        at = stop
    return out


def network_scorer(spark: SparkSession, weights: Weights, cells: int = CELLS) -> Callable[[], BatchScorer]:
    """A batch scorer whose weights each executor fetches once, as a file that the driver serves until it ends."""
    handle, path = tempfile.mkstemp(prefix="weights-", suffix=".npz")
    with os.fdopen(handle, "wb") as file:
        np.savez(file, **weights)
    spark.sparkContext.addFile(path)
    atexit.register(lambda: os.path.exists(path) and os.unlink(path))
    name = os.path.basename(path)

    def make() -> BatchScorer:
        with np.load(SparkFiles.get(name)) as held:
            own = {k: held[k] for k in held.files}
        return lambda texts: padded_scores(own, list(texts), cells)

    return make
