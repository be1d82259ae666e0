"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features are densities of a lexicon (words and beginnings of words, so that inflected forms
count), how near a second person stands to a lexicon word, capitals, punctuation, and
obfuscation (lexicon words spelt with digits, signs, spaces or repeated letters).  The lexicon
joins a short fixed list with units learned from labelled documents: at most ``LEXICON_SIZE`` units
that are far likelier in toxic ones.

The classifier is fitted on at most ``SAMPLE_ROWS`` labelled documents, those with the smallest
hash of their id: a documented bound.  Two thirds of them fit the trees, one third the isotonic
curve.  Scoring reads every whole text.  Labels, language, source and id are never features.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.tables import Staged

SAMPLE_ROWS = 24_000
LEXICON_SIZE = 400
#: A unit of the lexicon is in this share of the toxic documents, three of them at least, and so many times likelier in toxic ones.
TOXIC_SHARE, LEAST_TOXIC, LEAST_RATIO = 0.003, 3, 12.0
THRESHOLD = 0.3
TREES, DEPTH, SEED = 24, 4, 7

# Common insults, and second-person words of five languages.
BASE_LEXICON = frozenset("idiot moron loser clown scum trash stupid worthless pathetic disgusting dumb imbecile jerk bastard bitch asshole fuck shit".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tuyo vosotros usted ustedes voi".split())
LEET = str.maketrans("013457@$!|", "oieastasil")

STEM_LETTERS = (4, 5, 6)
CACHED_WORDS = 300_000
#: Words at the farthest that count as near a second person.
REACH = 10

_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?![^\W\d_])")
_ODD = re.compile(r"[0-9@$!|*]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_MARKS, _SIGNS = re.compile(r"[.,;:!?]"), re.compile(r"[#$%&*@|<>]")
_REPEAT = re.compile(r"(.)\1{2,}")

FEATURES = (
    "log_words", "lexicon_density", "lexicon_any", "lexicon_log", "stem_density", "stem_any", "stem_log", "second_density", "second_near",
    "capitals", "capital_words", "exclamations", "questions", "punctuation", "signs", "mixed_density", "hidden_density", "hidden_any", "repeats",
)


def units(text: str) -> set[str]:
    """Lower-case words of a text, and their beginnings of 4 to 6 letters marked by a star."""
    found = set(_WORD.findall(text.lower()))
    return found | {w[:n] + "*" for w in found for n in STEM_LETTERS if len(w) > n}


HIT, STEM, SECOND = 1, 2, 4


class Measure:
    """Features of texts for one lexicon; what a word is gets looked up once while it stays among ``CACHED_WORDS``."""

    def __init__(self, words: frozenset[str], stems: frozenset[str]):
        self.words, self.stems = words, stems
        self.kinds = _Kinds(words, stems)

    def __call__(self, text: str) -> list[float]:
        """One number for each of ``FEATURES``; all zero for an empty text."""
        words, stems = self.words, self.stems
        if len(self.kinds) > CACHED_WORDS:
            self.kinds = _Kinds(words, stems)
        low = text.lower()
        found = _WORD.findall(low)
        n, chars = max(len(found), 1), max(len(text), 1)
        kind = np.fromiter(map(self.kinds.__getitem__, found), dtype=np.uint8, count=len(found))
        hits, begun, second = (np.flatnonzero(kind & bit) for bit in (HIT, STEM, SECOND))
        near = 0.0
        places = np.flatnonzero(kind & (HIT | STEM))
        if len(places) and len(second):
            right = np.clip(np.searchsorted(second, places), 0, len(second) - 1)
            gap = np.minimum(np.abs(second[right] - places), np.abs(second[np.maximum(right - 1, 0)] - places)).min()
            near = max(0.0, 1 - float(gap) / REACH)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        hidden = mixed = repeats = 0
        if _ODD.search(low):
            for token in low.split():
                if _ODD.search(token) and any(c.isalpha() for c in token):
                    mixed += 1
                    plain = token.translate(LEET)
                    for w in (*_WORD.findall(plain), re.sub(r"[\W_]", "", plain)):
                        hidden += w in words or w[:5] in stems or w[:4] in stems
        alone = lengths == 1
        if len(found) > 3 and (alone[3:] & alone[2:-1] & alone[1:-2] & alone[:-3]).any():
            hidden += sum(re.sub(r"[ .*_-]", "", m) in words for m in _SPACED.findall(low))
        data = np.frombuffer(low.encode(), dtype=np.uint8)
        if len(data) > 2 and ((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])).any():
            repeats = sum(1 for _ in _REPEAT.finditer(low))
            hidden += sum(1 for w in found if w not in words and _REPEAT.search(w) and _REPEAT.sub(r"\1", w) in words)
        return [
            math.log1p(len(found)), len(hits) / n, float(len(hits) > 0), math.log1p(len(hits)), len(begun) / n, float(len(begun) > 0),
            math.log1p(len(begun)), len(second) / n, near, len(_UPPER.findall(text)) / max(int(lengths.sum()), 1), len(_SHOUT.findall(text)) / n,
            text.count("!") / n, text.count("?") / n, len(_MARKS.findall(text)) / n, len(_SIGNS.findall(text)) / chars,
            mixed / n, hidden / n, float(hidden > 0), repeats / n,
        ]


class _Kinds(dict):
    """What each word is: a lexicon word, one that begins like one, a second person."""

    def __init__(self, words: frozenset[str], stems: frozenset[str]):
        super().__init__()
        self.words, self.stems = words, stems

    def __missing__(self, word: str) -> int:
        stems = self.stems
        begins = len(word) > 4 and (word[:4] in stems or word[:5] in stems or word[:6] in stems)
        self[word] = kind = HIT * (word in self.words) | STEM * begins | SECOND * (word in SECOND_PERSON)
        return kind


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update(units(text or ""))
    names = list(toxic | clean)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([toxic[u] for u in names], pa.int64()), pa.array([clean[u] for u in names], pa.int64())],
        names=["unit", "toxic", "clean"],
    )


def learn_lexicon(sample: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """(words, stems) from the bounded sample (text, label); at most ``LEXICON_SIZE`` learned units reach the driver."""
    totals = sample.agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).first()
    toxic, clean = (totals["t"] or 0) + 1.0, (totals["c"] or 0) + 1.0
    texts = sample.dropDuplicates(["text"]).select("text", "label")
    counted = texts.mapInArrow(_count_units, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = (F.col("toxic") + 0.5) / toxic / ((F.col("clean") + 0.5) / clean)
    best = counted.where((F.col("toxic") >= max(LEAST_TOXIC, TOXIC_SHARE * toxic)) & (ratio >= LEAST_RATIO)).orderBy(F.desc("toxic"), "clean", "unit").limit(LEXICON_SIZE).collect()
    learned = [r["unit"] for r in best]
    return BASE_LEXICON | {u for u in learned if u[-1] != "*"}, frozenset(u[:-1] for u in learned if u[-1] == "*")


@lru_cache(maxsize=1)
def _measure(lexicon: tuple[frozenset[str], frozenset[str]]) -> Measure:
    """One per Python worker and lexicon."""
    return Measure(*lexicon)


def with_features(docs: DataFrame, lexicon: tuple[frozenset[str], frozenset[str]], keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and an array of features of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by LEXICON_SIZE

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        one = _measure(shared.value)
        return pd.Series([one(t or "") for t in texts], dtype=object)

    return docs.select(*keep, measure(text).alias("values"))


def held_out(id_column: str) -> Column:
    """Documents whose labels are never learned from."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2


class Classifier:
    """Lexicon, trees and calibration; every part is of bounded size."""

    def __init__(self, lexicon, trees, curve):
        self.lexicon, self.trees, self.curve = lexicon, trees, curve

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> Classifier:
        """Learn from the labels (id, toxic) of documents that aren't held out; one label per id, the highest."""
        chosen = labels.where(F.col("toxic").isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max("toxic").alias("label"))
        chosen = chosen.where(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
        chosen = Staged(chosen, "sampled-labels")
        sample = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(chosen.read(), "id").select("id", "text", F.col("label").cast("double").alias("label"))
        staged = Staged(sample, "labelled")
        sample = staged.read()
        lexicon = learn_lexicon(sample)
        rows = Staged(with_features(sample, lexicon, ["id", "label"]), "features")
        ready = _assembled(rows.read())
        part = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(3))
        trees = curve = None
        fitting = ready.where(part != 0)
        if fitting.select("label").distinct().limit(2).count() == 2:
            trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.2, seed=SEED, subsamplingRate=1.0).fit(fitting.coalesce(4))
            margins = trees.transform(ready.where(part == 0)).select(vector_to_array("probability")[1].alias("margin"), "label")
            if margins.limit(1).count():
                curve = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margins)
        for old in (chosen, staged, rows):
            old.remove()
        return cls(lexicon, trees, curve)

    def score(self, docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """The columns ``keep`` and score, from 0 to 1."""
        measured = _assembled(with_features(docs, self.lexicon, keep, text))
        if self.trees is None:
            return measured.select(*keep, F.lit(0.0).alias("score"))
        margin = vector_to_array("probability")[1]
        out = self.trees.transform(measured).select(*keep, margin.alias("margin"))
        if self.curve is not None:
            # the curve is flat where few rows fell; a sliver of the raw score keeps the order inside a step
            out = self.curve.transform(out).withColumn("score", 0.999 * F.col("prediction") + 0.001 * F.col("margin"))
        else:
            out = out.withColumn("score", F.col("margin"))
        return out.select(*keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def _assembled(rows: DataFrame) -> DataFrame:
    columns = [F.col("values")[i].alias(f"f_{name}") for i, name in enumerate(FEATURES)]
    wide = rows.select(*[c for c in rows.columns if c != "values"], *columns)
    return VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="features").transform(wide)


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Defined cases: null and empty texts have features of zero and get the score of those; a null id
    is carried along and counts as not held out, though no label is learned from it; repeated rows
    get equal scores; without labels of both kinds every score is 0; an empty table gives an empty
    table.  Long texts are read whole.
    """
    model = Classifier.fit(docs, labels, id_column, text)
    scored = model.score(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")), ["id"])
    held = F.coalesce(held_out("id"), F.lit(False))
    return scored.select(F.col("id").alias(id_column), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; its columns are unchanged."""
    model = Classifier.fit(docs, labels, id_column, text)
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return model.score(held, ["row"]).where(F.col("score") < threshold).select("row.*")
