"""The study's workflow on its own tables, from raw ratings to pair differences.

Each step takes and returns DataFrames, so steps chain with ``DataFrame.transform``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.functions.exprs import choose, model_name, number
from pairlab.operators.joins import attach, drop_matching, keep_matching, match_text
from pairlab.operators.numbering import number_rows
from pairlab.operators.ratings import failed_raters, flag_correct, standardise
from pairlab.operators.reshape import only_value, relocate, to_long, to_wide
from pairlab.operators.scoring import BatchScorer, pair_scores
from pairlab.operators.summaries import pair_means
from pairlab.sources.tables import read_csv, write_csv

CONSTRUCTS = ("DOsentence", "PDsentence")
# Columns of the study's rating table.
RATING_COLUMNS = (
    "partid", "item", "sentence", "construct", "classification", "IO", "counter", "group", "Value", "zscores"
)
PAIR_KEY = ("item", "recipient_id")


def standardised_choices(raw: DataFrame) -> DataFrame:
    """Rating rows of the raw form export, numeric and standardised per rater.

    Attention items stay in: they count towards a rater's mean and sd.
    """
    rows = raw.where((F.col("PennElementName") == "test") & (F.col("Parameter") == "Choice"))
    return standardise(rows.withColumn("Value", number("Value")), ["partid"], "Value")


def raters_to_drop(choices: DataFrame, fillers: DataFrame, min_high: int = 5, min_low: int = 7) -> DataFrame:
    """Raters who miss too many of the listed attention items."""
    listed = fillers.select(F.col("item").cast("string").alias("item"))
    answered = keep_matching(choices.withColumn("item", F.col("item").cast("string")), listed, ["item"])
    return failed_raters(flag_correct(answered), min_high=min_high, min_low=min_low)


def experiment_rows(choices: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Trials only, without the raters in ``failed``."""
    trials = choices.where(F.col("Label") == "experimental_trial").select(*RATING_COLUMNS)
    return trials if failed is None else drop_matching(trials, failed, ["partid"])


def pairs_from_sentences(stimuli: DataFrame) -> DataFrame:
    """One row per pair from one row per sentence; two sentences for one cell fail the job."""
    keys = [c for c in stimuli.columns if c not in ("group", "sent_construct", "sentence")]
    return to_wide(stimuli, keys, "sent_construct", CONSTRUCTS, {"sentence": only_value}, "{level}")


def number_pairs(pairs: DataFrame) -> DataFrame:
    """Pair ids 1..n in the order of the natural key, as first column."""
    return relocate(number_rows(pairs, PAIR_KEY, "sent_pair_id"), "sent_pair_id")


def with_pair_ids(ratings: DataFrame, pairs: DataFrame, on_duplicate: str = "keep") -> DataFrame:
    """Find each rated sentence's pair by its text; sentences of no pair are left out."""
    sentences = to_long(pairs, ["sent_pair_id", "frequency_rank"], CONSTRUCTS, "sent_const", "sentence")
    listed = sentences.select("sentence", "sent_pair_id", "frequency_rank")
    return relocate(match_text(ratings, listed, on_duplicate=on_duplicate), "sent_pair_id")


def with_verbs(ratings: DataFrame, verbs: DataFrame) -> DataFrame:
    """Add the verb of each item; ``item`` becomes ``verb_id``."""
    rows = ratings.withColumn("item", F.col("item").cast("int"))
    named = attach(rows, verbs.select("verb_id", "verb"), {"item": "verb_id"})
    return relocate(named.withColumnRenamed("item", "verb_id"), "verb", after="verb_id")


def score_pairs(pairs: DataFrame, make_scorer: Callable[[], BatchScorer]) -> DataFrame:
    """Add DO_score, PD_score and their difference, scoring both sentences in one pass."""
    scored = pair_scores(pairs, pairs.columns, CONSTRUCTS, make_scorer)
    return scored.withColumnsRenamed({"DOsentence_score": "DO_score", "PDsentence_score": "PD_score"})


def score_pair_files(
    spark: SparkSession, source: str, schema: str, scorers: Mapping[str, Callable[[], BatchScorer]], target: str,
    checkpoint: str = "last", multi_line: bool = False,
) -> tuple[str, list[str]]:
    """Score a file of pairs with each model and write one file per model; (folder, model codes nobody knows).

    Files are at ``target``/model=<code>, without the sentences.
    """
    codes = spark.createDataFrame([(c,) for c in scorers], "code string")
    named = {r["code"]: r["name"] for r in codes.select("code", model_name("code", checkpoint).alias("name")).collect()}  # one row per model
    unknown = sorted(c for c, name in named.items() if name is None)
    pairs = read_csv(spark, source, schema, multi_line)
    for code, make_scorer in scorers.items():
        if code not in unknown:
            write_csv(score_pairs(pairs, make_scorer).drop(*CONSTRUCTS), f"{target}/model={code}")
    return target, unknown


def merge_replicas(scores: DataFrame, replicas: Sequence[str], name: str) -> DataFrame:
    """Long score table with the listed models replaced by their average, called ``name``.

    ``scores`` has sent_pair_id, model, DO_score, PD_score and diff.  One aggregation does
    it: replicas share a group, every other model is a group of one row per pair.
    """
    model = F.when(F.col("model").isin(*replicas), name).otherwise(F.col("model"))
    return scores.groupBy("sent_pair_id", model.alias("model")).agg(
        *[F.avg(c).alias(c) for c in ("DO_score", "PD_score", "diff")]
    )


def with_scores(ratings: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per rating and model: the score of the rated sentence and the pair's difference.

    Ratings of a pair nobody scored keep one row with missing scores.
    """
    joined = attach(ratings, scores, ["sent_pair_id"])
    chosen = choose("construct", {"PDsentence": "PD_score", "DOsentence": "DO_score"})
    return joined.withColumn("score", chosen).drop("DO_score", "PD_score")


def human_differences(ratings: DataFrame, places: int | None = None) -> DataFrame:
    """Per pair: mean standardised and raw rating of both forms, and PD minus DO.

    Ratings of at most ``places`` decimal places are summed exactly.
    """
    keys = ["sent_pair_id", "verb_id", "verb", "classification", "IO", "frequency_rank"]
    return pair_means(ratings, keys, CONSTRUCTS, raw="Value", raw_places=places)


def differences_by_model(ratings: DataFrame, scores: DataFrame) -> DataFrame:
    """Human and model difference side by side, one row per pair and model.

    Ratings are folded to pairs before the scores are joined.
    """
    return attach(human_differences(ratings), scores.select("sent_pair_id", "model", "diff"), ["sent_pair_id"])
