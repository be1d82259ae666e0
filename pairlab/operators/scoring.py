"""Sentence scoring: token tables, reductions, batch scorers, pair differences.

A score is built from log-probabilities of tokens.  They come from logits
(``log_softmax_at``), from an add-one bigram model counted by Spark, or from any Python
callable that scores a batch of texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pairlab.sources.staging import stage

# Sentence markers.
START, END = "<s>", "</s>"

BatchScorer = Callable[[pd.Series], Sequence[float]]


def _scores(scorer: BatchScorer, texts: pd.Series) -> pd.Series:
    """Scores of a batch, missing for missing texts and where the scorer gives NaN."""
    present = texts.notna().to_numpy()
    scores = np.full(len(texts), np.nan)
    if present.any():
        scores[present] = np.asarray(scorer(texts[present]), dtype=float)
    return pd.Series(pd.arrays.FloatingArray(scores, np.isnan(scores)), index=texts.index)


def text_scorer(make_scorer: Callable[[], BatchScorer]) -> Callable[[str | Column], Column]:
    """A column function that scores texts in Arrow batches.

    Only the text crosses to Python; other columns stay where they are.  ``make_scorer`` runs
    once per task, where it may load a model; the scorer it returns gets a batch of texts.
    """

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for texts in batches:
            yield _scores(scorer, texts)

    return run


def score_texts(df: DataFrame, text: str, make_scorer: Callable[[], BatchScorer], name: str = "score") -> DataFrame:
    """Add one double column, the score of ``text``; missing texts get a missing score."""
    return df.withColumn(name, text_scorer(make_scorer)(text))


def word_array(text: str | Column) -> Column:
    """Lower-case words (runs of letters of any script) of a text between start and end markers."""
    value = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(value), r"[^\p{L}]+"), lambda w: w != "")
    return F.concat(F.array(F.lit(START)), words, F.array(F.lit(END)))


def token_table(df: DataFrame, keys: Sequence[str], text: str, tokens: Callable[[str], Column] = word_array) -> DataFrame:
    """One row per token and position, markers included."""
    return df.select(*keys, F.posexplode(tokens(text)).alias("pos", "token"))


def bigram_table(df: DataFrame, keys: Sequence[str], text: str, tokens: Callable[[str], Column] = word_array) -> DataFrame:
    """One row per scored position: the token and the one before it.

    Neighbours are zipped inside the row's array, so no window or shuffle is needed.
    """
    words = df.select(*keys, tokens(text).alias("__w"))
    before = F.slice("__w", F.lit(1), F.size("__w") - 1)
    after = F.slice("__w", F.lit(2), F.size("__w") - 1)
    zipped = words.select(*keys, F.posexplode(F.arrays_zip(before.alias("prev"), after.alias("token"))))
    return zipped.select(*keys, (F.col("pos") + 1).alias("pos"), F.col("col.prev").alias("prev"), F.col("col.token").alias("token"))


class BigramModel:
    """Add-one bigram log-probabilities held in staged tables: never collected, joined by size.

    ``pairs`` has the finished log-probability of each bigram met in training, ``words`` that of
    any other word after a known one.
    """

    def __init__(self, pairs: DataFrame, words: DataFrame, vocabulary: int):
        self.pairs, self.words, self.vocabulary = pairs, words, vocabulary

    @classmethod
    def train(cls, df: DataFrame, text: str) -> BigramModel:
        """Count bigrams with map-side combine; word counts come from the bigram counts.

        The vocabulary is every token that can be predicted: all words and the end marker.
        Every word also precedes something, and the start marker stands in for the end
        marker, so its size is the number of word rows.
        """
        bigrams = bigram_table(df, [], text)
        counts = stage(bigrams.groupBy("prev", "token").agg(F.count(F.lit(1)).alias("n")), "bigrams")
        totals = stage(counts.groupBy("prev").agg(F.sum("n").alias("total")), "words")
        vocabulary = totals.count()
        finished = counts.join(totals, "prev").select("prev", "token", F.log((F.col("n") + 1.0) / (F.col("total") + vocabulary)).alias("logprob"))
        unseen = totals.select("prev", F.log(F.lit(1.0) / (F.col("total") + vocabulary)).alias("unseen"))
        return cls(stage(finished, "bigram-model"), stage(unseen, "word-model"), vocabulary)

    @staticmethod
    def score_own(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
        """(keys, n, logprob) of the texts that the model is trained on, one row per token; every bigram is in the model.

        Only a bigram's 64-bit digest travels with the keys, not its words.  Of m distinct bigrams about m² / 2⁶⁵ pairs share a
        digest, 3e-4 for a hundred million; the tokens of such a pair would count twice.
        """
        bigrams = bigram_table(df, keys, text)
        counts = stage(bigrams.groupBy("prev", "token").agg(F.count(F.lit(1)).alias("c")), "bigrams")
        totals = stage(counts.groupBy("prev").agg(F.sum("c").alias("total")), "words")
        vocabulary = totals.count()
        pair = F.xxhash64("prev", "token").alias("pair")
        model = counts.join(totals, "prev").select(pair, F.log((F.col("c") + 1.0) / (F.col("total") + vocabulary)).alias("logprob"))
        return bigrams.select(*keys, pair).join(model, "pair").select(*keys, F.lit(1).alias("n"), "logprob")

    def placed_log_probs(self, df: DataFrame, keys: Sequence[str], text: str, own: bool = False) -> DataFrame:
        """(keys, pos, logprob): one row per scored position, for reductions that depend on places.

        With ``own`` the texts are those that the model is trained on, so that every bigram is in it, and its 64-bit digest
        travels with the place instead of its words, as in ``score_own``.
        """
        placed = bigram_table(df, keys, text)
        if own:
            pair = F.xxhash64("prev", "token").alias("pair")
            return placed.select(*keys, "pos", pair).join(self.pairs.select(pair, "logprob"), "pair").select(*keys, "pos", "logprob")
        joined = placed.join(self.pairs, ["prev", "token"], "left").join(self.words, "prev", "left")
        return joined.select(*keys, "pos", F.coalesce("logprob", "unseen", F.lit(-math.log(max(self.vocabulary, 1)))).alias("logprob"))

    def log_probs(self, df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
        """(keys, prev, token, n, logprob): one row per key and distinct bigram, with its number.

        Bigrams are folded per key before they meet the model.
        """
        folded = bigram_table(df, keys, text).groupBy(*keys, "prev", "token").agg(F.count(F.lit(1)).alias("n"))
        joined = folded.join(self.pairs, ["prev", "token"], "left").join(self.words, "prev", "left")
        logprob = F.coalesce("logprob", "unseen", F.lit(-math.log(max(self.vocabulary, 1))))
        return joined.select(*keys, "prev", "token", "n", logprob.alias("logprob"))


def mean_log_prob(logprob: str = "logprob", n: str = "n") -> Column:
    """Aggregate: mean token log-probability, from rows that stand for ``n`` tokens."""
    return F.sum(F.col(logprob) * F.col(n)) / F.sum(n)


def log_mean_exp(logprob: str = "logprob", n: str = "n") -> Column:
    """Aggregate: logsumexp of token log-probabilities minus log of their number, exact at any scale.

    The distinct rows of a key, as many as its text has, are kept until the largest is known.
    """
    rows = F.collect_list(F.struct(F.col(logprob).alias("lp"), F.col(n).cast("double").alias("n")))
    top = F.max(logprob)
    total = F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + r["n"] * F.exp(r["lp"] - top))
    return top + F.log(total) - F.log(F.sum(n))


def reduce_scores(tokens: DataFrame, keys: Sequence[str], reduction: Callable[..., Column], name: str = "score", **columns) -> DataFrame:
    """One score per key, by any aggregate expression over its rows (logprob, n)."""
    return tokens.groupBy(*keys).agg(reduction(**columns).alias(name))


def log_softmax_at(logits: str | Column, position: str | Column) -> Column:
    """logit - logsumexp(logits) at a 0-based position, in double precision."""
    values = (F.col(logits) if isinstance(logits, str) else logits).cast("array<double>")
    at = (F.col(position) if isinstance(position, str) else position).cast("int")
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.try_element_at(values, at + 1) - top - F.log(total)


def shifted_targets(token_ids: str | Column, shift: int = 1) -> Column:
    """Token id that the logits at each position predict: the next one by default."""
    ids = F.col(token_ids) if isinstance(token_ids, str) else token_ids
    return F.slice(ids, F.lit(1 + shift), F.greatest(F.size(ids) - shift, F.lit(0)))


def keep_unmasked(values: str | Column, mask: str | Column) -> Column:
    """Elements of an array whose mask element is 1."""
    v = F.col(values) if isinstance(values, str) else values
    m = F.col(mask) if isinstance(mask, str) else mask
    zipped = F.arrays_zip(v.alias("v"), m.alias("m"))
    return F.transform(F.filter(zipped, lambda z: z["m"] == 1), lambda z: z["v"])


def pair_scores(
    df: DataFrame, keys: Sequence[str], texts: Sequence[str], make_scorer: Callable[[], BatchScorer]
) -> DataFrame:
    """Score two text columns in one pass and add their difference (second minus first).

    Only the two texts cross to Python, in one stage; keys of any type stay as they are.
    """
    first, second = texts

    @F.pandas_udf("first double, second double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for a, b in batches:
            yield pd.DataFrame({"first": _scores(scorer, a), "second": _scores(scorer, b)})

    scored = df.select(*keys, run(first, second).alias("__s"))
    scored = scored.select(*keys, F.col("__s.first").alias(f"{first}_score"), F.col("__s.second").alias(f"{second}_score"))
    return scored.withColumn("diff", F.col(f"{second}_score") - F.col(f"{first}_score"))


#: Symbols of the letter model: code points modulo this number.
SYMBOLS = 256
#: Letters that a task turns into numbers at a time: some 50 MB of arrays.
LETTERS = 1 << 20


def _stretches(texts: Sequence[str], most: int) -> Iterator[tuple[list[int], list[str]]]:
    """Texts by number, some at a time and of ``most`` letters at most; stretches of a longer text share its letter at the seam."""
    at, held, size = [], [], 0
    for k, text in enumerate(texts):
        for start in range(0, max(len(text) - 1, 1), most - 1):
            part = text if len(text) <= most else text[start: start + most]
            if held and size + len(part) > most:
                yield at, held
                at, held, size = [], [], 0
            at.append(k)
            held.append(part)
            size += len(part)
    if held:
        yield at, held


def _letter_steps(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of texts in one row, the number of letters of each text, and which letters have a next one in their text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64) % SYMBOLS
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    inside = np.ones(len(codes), dtype=bool)
    inside[np.cumsum(lengths)[lengths > 0] - 1] = False  # from one text's last letter to the next one's first
    return codes, lengths, inside


def train_letter_model(df: DataFrame, text: str, most: int = LETTERS) -> np.ndarray:
    """Log-probabilities of each letter (code point modulo ``SYMBOLS``) after each letter, add-one smoothed.

    A task counts whole texts, at most ``most`` letters at a time, into one table of that fixed size; Spark adds the tables up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
        for batch in batches:
            for _, texts in _stretches([t for t in batch.column(0).to_pylist() if t], most):
                codes, _, inside = _letter_steps(texts)
                steps = codes[:-1] * SYMBOLS + codes[1:]
                cells += np.bincount(steps[inside[:-1]], minlength=SYMBOLS * SYMBOLS)
        met = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(cells[met])], names=["cell", "n"])

    table = np.ones(SYMBOLS * SYMBOLS)
    counted = df.select(F.lower(text)).mapInArrow(count, "cell bigint, n bigint")
    for row in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[row["cell"]] += row["n"]
    table = table.reshape(SYMBOLS, SYMBOLS)
    return np.log(table / table.sum(axis=1, keepdims=True))


def letter_scorer(log_probs: np.ndarray, most: int = LETTERS) -> Callable[[], BatchScorer]:
    """A batch scorer: mean log-probability of a text's letters after the first, at most ``most`` letters at a time."""

    def make() -> BatchScorer:
        def score(texts: pd.Series) -> np.ndarray:
            low = [t.lower() for t in texts]
            lengths, total = np.array([len(t) for t in low], dtype=np.int64), np.zeros(len(low))
            for at, parts in _stretches(low, most):
                codes, sizes, inside = _letter_steps(parts)
                steps = np.append(log_probs[codes[:-1], codes[1:]], 0.0) if len(codes) else np.zeros(0)
                steps[~inside] = 0.0
                np.add.at(total, at, np.bincount(np.repeat(np.arange(len(parts)), sizes), weights=steps, minlength=len(parts)))
            return np.where(lengths > 1, total / np.maximum(lengths - 1, 1), np.nan)

        return score

    return make
