"""Masked pseudo-likelihood of documents by a small window network, trained in numpy inside Spark tasks.

Every word of a document is predicted from two words on either side; the sum of the conditional
log-probabilities scores the document.  Word counts over all documents, added up by Spark, choose
the ``NAMED`` most frequent words; every other word is one of ``BUCKETS`` hash classes.  The softmax
has two steps, class and word within class, so it is exact over the whole vocabulary and cheap.

A hash class is no word yet: the network's probability of the class is multiplied by the word's share
of the class in the corpus counts.  The counts of all words stay in a distributed table.  Tasks know
the shares of the ``CACHED`` most frequent words; for all others a document is folded to its distinct
words, which are joined with the table, so every word of the corpus has a probability of its own.

Training reads every document in each of ``ROUNDS`` rounds, and every position is a target in one of them: round r
takes the positions whose place in their document is r modulo the number of rounds.  A task fits a
copy of the network by Adam, and the copies are averaged in Spark, weighted by their positions, in
two steps so that no group grows with the number of tasks.  Only the averaged network, of fixed
size, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm import words as W
from pairlab.llm.tables import Staged

CLASSES, PER_CLASS = 32, 32
VOCABULARY = CLASSES * PER_CLASS
BUCKETS = 256
NAMED = VOCABULARY - BUCKETS
SIDE, EMBEDDING, HIDDEN = 2, 16, 32
ROUNDS, BATCH, RATE, SEED = 2, 2048, 0.006, 5
#: Pieces in which networks travel, and groups of the first step of their average.
PIECES, SPREAD = 16, 64
#: Positions scored at a time, so that their arrays stay in cache.
SCORED = 1 << 13
#: Words whose share of their class travels to the tasks; the others' are joined, with equal results.
CACHED = 1 << 16

_SHAPES = {
    "embed": (VOCABULARY + 1, EMBEDDING), "w1": (2 * SIDE * EMBEDDING, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, CLASSES), "b2": (CLASSES,),
    "w3": (CLASSES, HIDDEN, PER_CLASS), "b3": (CLASSES, PER_CLASS),
}

Network = dict[str, np.ndarray]


class Model(NamedTuple):
    net: Network
    #: (hash, rank) of the named words, and (hash, log share of the class) of other frequent words, by hash.
    named: tuple[np.ndarray, np.ndarray]
    cached: tuple[np.ndarray, np.ndarray]
    #: Occurrences of each hash class.
    totals: np.ndarray
    #: (word, n) of all words, distributed.
    counts: DataFrame


def first_network() -> Network:
    rng = np.random.default_rng(SEED)
    return {k: (np.zeros(s) if k[0] == "b" else rng.normal(0, 0.1, s)).astype(np.float32) for k, s in _SHAPES.items()}


def flatten(net: Network) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in _SHAPES])


def unflatten(values: np.ndarray) -> Network:
    out, at = {}, 0
    for k, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[k] = values[at: at + n].reshape(shape).astype(np.float32)
        at += n
    return out


class Places:
    """Finds hashes in a sorted array of keys: a table of their leading bits names the first key to look at."""

    def __init__(self, keys: np.ndarray, bits: int = 16):
        self.keys, self.shift = keys, np.uint64(64 - bits)
        each = np.bincount((keys >> self.shift).astype(np.intp), minlength=1 << bits)
        self.first, self.most = (np.cumsum(each) - each).astype(np.int32), int(each.max())

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and which hashes are keys."""
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=np.int32), np.zeros(len(hashes), dtype=bool)
        last = np.int32(len(self.keys) - 1)
        at = np.minimum(self.first[(hashes >> self.shift).astype(np.intp)], last)
        for _ in range(self.most - 1):  # keys with the same leading bits
            at = np.minimum(at + (self.keys[at] < hashes), last)
        return at, self.keys[at] == hashes


def word_ids(hashes: np.ndarray, named: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of words by hash: rank of a named word (``named`` is (hash, rank) sorted by hash), else a bucket."""
    keys, ranks = named
    at, known = Places(keys).of(hashes)
    out = (hashes % np.uint64(BUCKETS)).astype(np.int32) + np.int32(NAMED)
    out[known] = ranks[at[known]]
    return out


def contexts(ids: np.ndarray, first: np.ndarray, positions: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Ids of the words around each position; the id ``VOCABULARY`` stands outside the document."""
    out = np.full((len(positions), 2 * SIDE), VOCABULARY, dtype=np.int32)
    for column, step in enumerate([s for s in range(-SIDE, SIDE + 1) if s]):
        at = positions + step
        inside = (at >= first[doc]) & (at < first[doc + 1])
        out[inside, column] = ids[at[inside]]
    return out


def _exp_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the rows of ``x``, from which a level is taken off in place, and their sums.

    The level is the largest of all numbers; only if a row's sum would be lost at that, each row's largest.
    """
    ones = np.ones((x.shape[1], 1), dtype=x.dtype)
    level = x.max() if x.size else x.dtype.type(0)
    out = np.exp(x - level)
    total = out @ ones
    if total.size and not total.min() > 1e-20:  # rows far below the largest: each has its own level
        level = x.max(axis=1, keepdims=True)
        out = np.exp(x - level)
        total = out @ ones
    x -= level
    return out, total


def _log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at one place; ``x`` is used up."""
    _, total = _exp_rows(x)
    return x[np.arange(len(x)), at] - np.log(total[:, 0])


def _softmax(x: np.ndarray) -> np.ndarray:
    """Softmax of each row; ``x`` is used up."""
    out, total = _exp_rows(x)
    out /= total
    return out


def _hidden_tables(net: Network) -> list[np.ndarray]:
    """What each context slot adds to the hidden layer, for every word."""
    parts = net["w1"].reshape(2 * SIDE, EMBEDDING, HIDDEN)
    return [net["embed"] @ part for part in parts]


def log_probs(net: Network, around: np.ndarray, target: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
    """log P(word | words around it) of each position."""
    tables = tables or _hidden_tables(net)
    hidden = np.tile(net["b1"], (len(target), 1))
    for slot, table in enumerate(tables):
        hidden += table.take(around[:, slot], axis=0)
    np.tanh(hidden, out=hidden)
    group, member = np.divmod(target, PER_CLASS)
    out = _log_share(hidden @ net["w2"] + net["b2"], group)
    order = np.argsort(group, kind="stable")
    cut = np.searchsorted(group[order], np.arange(CLASSES + 1))
    hidden, second = hidden[order], np.empty((len(target), PER_CLASS), dtype=hidden.dtype)
    for c, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        if b > a:
            np.matmul(hidden[a:b], net["w3"][c], out=second[a:b])
            second[a:b] += net["b3"][c]
    out[order] += _log_share(second, member[order])
    return out


def gradient(net: Network, around: np.ndarray, target: np.ndarray) -> Network:
    """Gradient of the mean negative log-probability."""
    n = len(target)
    x = net["embed"].take(around.ravel(), axis=0).reshape(n, -1)
    hidden = np.tanh(x @ net["w1"] + net["b1"])
    group, member = np.divmod(target, PER_CLASS)
    grad = {}
    first = _softmax(hidden @ net["w2"] + net["b2"])
    first[np.arange(n), group] -= 1
    first /= n
    grad["w2"], grad["b2"] = hidden.T @ first, first.sum(axis=0)
    back = first @ net["w2"].T
    grad["w3"], grad["b3"] = np.zeros_like(net["w3"]), np.zeros_like(net["b3"])
    order = np.argsort(group, kind="stable")
    cut = np.searchsorted(group[order], np.arange(CLASSES + 1))
    sorted_hidden, inner = np.ones((n, HIDDEN + 1), dtype=hidden.dtype), np.empty_like(hidden)  # the ones sum up b3's gradient
    np.take(hidden, order, axis=0, out=sorted_hidden[:, :-1])
    logits = np.empty((n, PER_CLASS), dtype=hidden.dtype)
    full = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
    for c, rows in full:
        np.matmul(sorted_hidden[rows, :-1], net["w3"][c], out=logits[rows])
    second = _softmax(logits + net["b3"][group[order]])
    second[np.arange(n), member[order]] -= 1
    second /= n
    for c, rows in full:
        both = sorted_hidden[rows].T @ second[rows]
        grad["w3"][c], grad["b3"][c] = both[:-1], both[-1]
        np.matmul(second[rows], net["w3"][c].T, out=inner[rows])
    back[order] += inner
    back *= 1 - hidden**2
    grad["w1"], grad["b1"] = x.T @ back, back.sum(axis=0)
    inner = (back @ net["w1"].T).reshape(-1, EMBEDDING).T.astype(np.float64, order="C")
    flat = around.ravel().astype(np.intp)
    grad["embed"] = np.stack([np.bincount(flat, column, VOCABULARY + 1) for column in inner], axis=1).astype(np.float32)
    return grad


class Adam:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.step = net, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in net.items()}
        self.square = {k: np.zeros_like(v) for k, v in net.items()}

    def update(self, grad: Network) -> None:
        self.step += 1
        scale = float(self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step))  # arrays stay in single precision
        for k, g in grad.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            self.net[k] -= scale * self.mean[k] / (np.sqrt(self.square[k]) + 1e-8)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch.column(0), 8 << 20):
            names, n = np.unique(part.hashes(lower=True), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): how often each word, by hash, occurs in all documents."""
    return texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _train(net: Network, named, rounds: int, rate: float, size: int, turn: int):
    out = pa.schema([("piece", pa.int32()), ("part", pa.int32()), ("weight", pa.float64()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        own = {k: v.copy() for k, v in net.items()}
        adam, rng, seen = Adam(own, rate), np.random.default_rng([SEED, turn, task]), 0
        for batch in batches:
            for part in W.slices(batch.column(0)):
                ids = word_ids(part.hashes(lower=True), named)
                doc = part.doc_of_word()
                chosen = np.flatnonzero((np.arange(len(ids)) - part.first[doc]) % rounds == turn)
                rng.shuffle(chosen)
                for a in range(0, len(chosen), size):
                    few = chosen[a: a + size]
                    adam.update(gradient(own, contexts(ids, part.first, few, doc[few]), ids[few]))
                seen += len(chosen)
        if seen:
            values = flatten(own).astype(np.float64) * seen
            pieces = np.array_split(values, PIECES)
            yield pa.RecordBatch.from_arrays([
                pa.array(range(PIECES), pa.int32()), pa.array([task % SPREAD] * PIECES, pa.int32()), pa.array([float(seen)] * PIECES),
                pa.array([p.tobytes() for p in pieces], pa.binary()),
            ], schema=out)

    return run


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(v, dtype=np.float64) for v in group["values"])
    return pd.DataFrame({"piece": group["piece"].iloc[:1], "part": group["part"].iloc[:1], "weight": [group["weight"].sum()], "values": [total.tobytes()]})


def _most_frequent(counts: DataFrame, most: int) -> list:
    """Words by falling count: the ``NAMED`` most frequent at least, and more while whole ranges of counts fit ``most``.

    Counts fall into at most 1,000 ranges; only those words reach the driver.
    """
    level = F.floor(F.log2("n") * 16)
    sizes = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, total = None, 0
    for at, words in sizes:
        if total + words > most:
            break
        least, total = at, total + words
    if total < NAMED:
        return counts.orderBy(F.desc("n"), "word").limit(NAMED).collect()
    return sorted(counts.where(level >= least).collect(), key=lambda r: (-r["n"], r["word"]))


def train(
    texts: DataFrame, rounds: int = ROUNDS, rate: float = RATE, batch: int = BATCH, cached: int = CACHED
) -> Model:
    """Network and word counts from all rows of the one-column table ``texts``."""
    counts = Staged(count_words(texts), "word_counts").read()
    top = _most_frequent(counts, cached)
    keys = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    often = np.array([r["n"] for r in top], dtype=np.int64)
    order = np.argsort(keys[:NAMED])
    named = (keys[:NAMED][order], order.astype(np.int64))
    totals = np.zeros(BUCKETS)
    for r in counts.groupBy(F.pmod("word", F.lit(BUCKETS)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        totals[r["bucket"]] = r["n"]
    np.subtract.at(totals, (keys[:NAMED] % np.uint64(BUCKETS)).astype(np.int64), often[:NAMED])
    order = NAMED + np.argsort(keys[NAMED:])
    shares = (keys[order], np.log(often[order] / (totals[(keys[order] % np.uint64(BUCKETS)).astype(np.int64)] + 1)))
    net = first_network()
    schema = "piece int, part int, weight double, values binary"
    for turn in range(rounds):
        copies = texts.mapInArrow(_train(net, named, rounds, rate / (1 + turn), batch, turn), schema)
        total = copies.groupBy("piece", "part").applyInPandas(_add, schema).groupBy("piece").applyInPandas(_add, schema).orderBy("piece").collect()
        if total:
            net = unflatten(np.concatenate([np.frombuffer(r["values"], dtype=np.float64) / r["weight"] for r in total]))
    return Model(net, named, shares, totals, counts)


def _score(shared):
    """A row of each document (``word`` is its key): tokens and log-probability as far as the task knows; a row of each other word in it."""
    out = pa.schema([("key", pa.int64()), ("word", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, named, (known, share) = shared.value
        tables, often = _hidden_tables(net), Places(known, 20)
        for batch in batches:
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            for part in W.slices(batch.column(1)):
                hashes, doc = part.hashes(lower=True), part.doc_of_word()
                ids = word_ids(hashes, named)
                total = np.zeros(part.n_docs)
                for a in range(0, len(ids), SCORED):
                    at = np.arange(a, min(a + SCORED, len(ids)))
                    found = log_probs(net, contexts(ids, part.first, at, doc[at]), ids[at], tables)
                    total += np.bincount(doc[at], found, part.n_docs)
                rest = np.flatnonzero(ids >= NAMED)
                if len(known):
                    at, hit = often.of(hashes[rest])
                    total += np.bincount(doc[rest[hit]], share[at[hit]], part.n_docs)
                    rest = rest[~hit]
                rest = rest[np.lexsort((hashes[rest], doc[rest]))]
                new = np.ones(len(rest), dtype=bool)
                new[1:] = (hashes[rest][1:] != hashes[rest][:-1]) | (doc[rest][1:] != doc[rest][:-1])
                begin = np.flatnonzero(new)
                own, rare = keys[part.at: part.at + part.n_docs], rest[begin]
                tokens = part.counts() - np.bincount(doc[rest], minlength=part.n_docs)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([own, own[doc[rare]]])), pa.array(np.concatenate([own, hashes[rare].view(np.int64)])),
                    pa.array(np.concatenate([tokens, np.diff(np.append(begin, len(rest)))]), pa.int64()),
                    pa.concat_arrays([batch.column(0).slice(part.at, part.n_docs), pa.nulls(len(rare), pa.int64())]),
                    pa.concat_arrays([pa.array(total), pa.nulls(len(rare), pa.float64())]),
                ], schema=out)

    return run


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, log_prob (sum over all words), mean_log_prob.

    Defined cases: null and empty texts have no tokens, a log_prob of 0 and a null mean; a text of
    one word is predicted from nothing; a null id is carried along; repeated rows score alike; a word
    that the corpus of the model lacks counts as one more occurrence in its class; an empty table
    gives an empty table.  Long texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model[:3])  # of fixed size
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    parts = source.mapInArrow(_score(shared), "key long, word long, n long, id long, value double")
    joined = parts.join(model.counts.withColumnRenamed("n", "often"), "word", "left")
    total = F.lit([float(x) + 1 for x in model.totals])[F.pmod("word", F.lit(BUCKETS))]
    rare = F.when(F.col("value").isNull(), F.col("n") * F.log(F.coalesce("often", F.lit(1)) / total))
    added = joined.select("key", "n", "id", F.coalesce("value", rare).alias("part"), F.col("value").isNotNull().cast("int").alias("copies"))
    added = added.groupBy("key").agg(F.max("id").alias("id"), F.sum("n").alias("n"), F.sum("part").alias("log_prob"), F.sum("copies").alias("copies"))
    scored = added.select(  # equal rows have one key
        "id", (F.col("n") / F.col("copies")).cast("long").alias("n_tokens"), (F.col("log_prob") / F.col("copies")).alias("log_prob"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))),
    )
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return scored.select(F.col("id").alias(id_column), "n_tokens", "log_prob", mean.alias("mean_log_prob"))


def pseudo_likelihood(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on all rows of ``docs`` and score them; see ``score`` for the result and the defined cases."""
    return score(docs, train(docs.select(text)), id_column, text)
