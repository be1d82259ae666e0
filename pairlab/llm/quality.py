"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Fixed base rules reject first.  Then each rule score, an integer level from 0 to ``LEVELS``, has a
cutoff for each stratum (language), chosen on labelled documents: the lowest cutoff whose false
rejections among documents labelled good are certified to stay under ``RISK`` / number of rules.
Certified means that the exact binomial probability of seeing so few false rejections, if the
true rate were at that limit, is at most ``ERROR`` divided by the number of (stratum, rule) pairs
(Bonferroni).  Cutoffs of one rule are tested from the loosest to the strictest until one fails,
which needs no further correction.  So with probability 1 - ``ERROR`` at least, no stratum loses
more than ``RISK`` of its good documents to these rules.  Strata with too few labels get no cutoff.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.native import SPACES, covered_length, let, starts, words
from pairlab.llm.tables import Staged

WINDOW = 5
LEVELS = 40
RISK, ERROR = 0.05, 0.05
SYMBOLS = "[#*$%&|<>]"

#: Rule scores as SQL over the counts; integer division, so that every engine gets the same level.
RULES = {
    "symbols": f"least({LEVELS}, (10 * n_symbols) div greatest(n_words, 1))",
    "lines": f"({LEVELS} * n_dup_lines) div greatest(n_lines, 1)",
    "repeats": f"({LEVELS} * n_repeat_words) div greatest(n_words, 1)",
    "long_words": f"least({LEVELS}, (4 * word_chars) div greatest(n_words, 1))",
    "short_words": f"{LEVELS} - least({LEVELS}, (4 * word_chars) div greatest(n_words, 1))",
}


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows found twice or more in the array ``w``, the first find included."""

    def spans(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("start"))))

        def twice(s: Column) -> Column:
            same = F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
            return F.transform(F.array_sort(F.transform(same, lambda e: e["start"])), lambda at: F.struct(at.alias("start"), F.lit(window).alias("len")))

        return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.array().cast("array<struct<start:int,len:int>>")).otherwise(let(ranked, twice))

    return covered_length(let(F.transform(starts(w, window), lambda at: F.xxhash64(F.slice(w, at + 1, window))), spans))


def counts(text: str | Column) -> Column:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of a whole text; null is empty."""
    value = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(words(value, SPACES), lambda w: let(lines, lambda ls: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(value, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
    )))


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """log P(Binomial(n, p) <= k), summed term by term on the log scale; 0 where k is not below the mean."""
    odds = math.log(p / (1 - p))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + odds
        top, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(low - top))).alias("total"))

    zero = n * math.log(1 - p)
    tail = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(zero.alias("term"), zero.alias("total")), step, lambda acc: acc["total"])
    return F.when(k < n * p, tail).otherwise(F.lit(0.0))


def cutoffs(good: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, rule, cutoff) from the levels of documents labelled good; no row where nothing is certified.

    ``good`` has stratum and a column of levels for each rule.  Its rows are folded to at most one
    per stratum, rule and level before anything else.
    """
    limit = risk / len(RULES)
    long = good.unpivot("stratum", list(RULES), "rule", "level").groupBy("stratum", "rule", "level").agg(F.count(F.lit(1)).alias("n"))
    pairs = long.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("level", "n")).alias("levels"))
    trials = pairs.select("stratum", "rule", "n", "levels", F.explode(F.sequence(F.lit(1), F.lit(LEVELS + 1))).alias("cutoff"))
    false = F.aggregate(F.filter("levels", lambda x: x["level"] >= F.col("cutoff")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    tested = trials.select("stratum", "rule", "cutoff", log_binomial_tail(F.col("n"), false, limit).alias("log_p"))
    number = pairs.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    passed = tested.where(F.col("log_p") <= F.log(F.lit(error) / number))
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff")).where(F.col("cutoff") <= LEVELS)


def judge_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, the counts, base_failed, kept, and rejected_by (names of the rules over their cutoff).

    ``labels`` has the id and quality (1 good).  Of several labels of one id the lowest counts.

    Defined cases: a null or empty text has no words and fails the base rules; a null stratum is the
    stratum ''; a null id has no label; repeated rows are judged alike, and counted each for the
    cutoffs; without labels there is no cutoff and the base rules alone decide; an empty table gives
    an empty table.
    """
    counted = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), counts(text).alias("c"))
    levels = [F.expr(sql).cast("int").alias(name) for name, sql in RULES.items()]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    staged = Staged(counted.select("id", "stratum", "c.*").select("*", base.alias("base_failed"), *levels), "quality")
    good = labels.select(F.col(id_column).alias("id"), "quality").groupBy("id").agg(F.min("quality").alias("quality")).where("quality = 1")
    chosen = cutoffs(staged.read().where("not base_failed").join(good, "id", "left_semi"))
    wide = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    wide = Staged(wide, "cutoffs").read()
    over = F.filter(F.array(*[F.when(F.col(r) >= F.col(f"cut_{r}"), F.lit(r)) for r in RULES]), lambda r: r.isNotNull())
    out = staged.read().join(wide, "stratum", "left").withColumn("rejected_by", over)
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(F.col("id").alias(id_column), *names, kept.alias("kept"), "rejected_by")
