"""The study's tables, built from the TPC-H-like test tables.

Each view exists twice: as a DataFrame here and as SQL text for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALTERNATING_TYPES = ("ECONOMY", "STANDARD", "PROMO")
CLASSES = ("alternating", "non-alternating")
CONSTRUCTS = ("DOsentence", "PDsentence")
LENGTHS = ("longIndefinite", "shortIndefinite")
MODELS = ("A", "N", "R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per judgement: raters crossed with pairs, pairs nested in verbs."""
    lineitem, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    odd = F.col("l_linenumber") % 2
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("partid"),
        F.col("l_partkey").alias("verb_id"),
        (F.col("l_partkey") * 2 + odd).alias("sent_pair_id"),
        F.when(F.col("l_linestatus") == "F", CONSTRUCTS[0]).otherwise(CONSTRUCTS[1]).alias("construct"),
        F.when(F.col("p_type").isin(*ALTERNATING_TYPES), CLASSES[0]).otherwise(CLASSES[1]).alias("classification"),
        F.when(odd == 1, LENGTHS[0]).otherwise(LENGTHS[1]).alias("io"),
        F.col("p_size").alias("frequency_rank"),
        F.col("l_quantity").alias("value"),
        F.col("l_returnflag").alias("model"),
        F.col("l_extendedprice").alias("price"),
    )


PAIR_COLUMNS = ("sent_pair_id", "verb_id", "classification", "io", "frequency_rank")


def _with_pair_columns(spark: SparkSession, sf_dir: str, folded: DataFrame) -> DataFrame:
    """Pair attributes for lineitem already folded to (l_partkey, odd, ...) rows."""
    part = table(spark, sf_dir, "part")
    kept = [c for c in folded.columns if c not in ("l_partkey", "odd")]
    return folded.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_partkey") * 2 + F.col("odd")).alias("sent_pair_id"),
        F.col("l_partkey").alias("verb_id"),
        F.when(F.col("p_type").isin(*ALTERNATING_TYPES), CLASSES[0]).otherwise(CLASSES[1]).alias("classification"),
        F.when(F.col("odd") == 1, LENGTHS[0]).otherwise(LENGTHS[1]).alias("io"),
        F.col("p_size").alias("frequency_rank"),
        *kept,
    )


def _pair_key() -> list:
    return ["l_partkey", (F.col("l_linenumber") % 2).alias("odd")]


# The three views below fold lineitem before the many-to-one join with part: the fold
# combines on the map side, so a hot part key costs nothing extra and the join is small.


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model, pair and construct."""
    construct = F.when(F.col("l_linestatus") == "F", CONSTRUCTS[0]).otherwise(CONSTRUCTS[1])
    folded = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("model"), *_pair_key(), construct.alias("construct"))
        .agg(F.avg("l_extendedprice").alias("score"))
    )
    return _with_pair_columns(spark, sf_dir, folded)


def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model and pair with both scores."""
    is_do = F.col("l_linestatus") == "F"
    price = F.col("l_extendedprice")
    folded = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("model"), *_pair_key())
        .agg(F.avg(F.when(is_do, price)).alias("DO_score"), F.avg(F.when(~is_do, price)).alias("PD_score"))
    )
    return _with_pair_columns(spark, sf_dir, folded)


def model_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair with PD minus DO of every model, folded from the rows in one shuffle."""
    is_do, price = F.col("l_linestatus") == "F", F.col("l_extendedprice")
    cells = []
    for m in MODELS:
        own = F.col("l_returnflag") == m
        cells.append((F.avg(F.when(own & ~is_do, price)) - F.avg(F.when(own & is_do, price))).alias(f"diff_{m}"))
    return _with_pair_columns(spark, sf_dir, table(spark, sf_dir, "lineitem").groupBy(*_pair_key()).agg(*cells))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sentence pair."""
    folded = table(spark, sf_dir, "lineitem").select(*_pair_key()).distinct()
    return _with_pair_columns(spark, sf_dir, folded)


def verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per verb."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("verb_id"),
        F.col("p_name").alias("verb"),
        F.col("p_size").alias("frequency_rank"),
        "p_brand",
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials and attention items of each rater."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("partid"),
        F.col("event_id").alias("item"),
        "value",
        F.when(F.col("event_type") == "signup", "high")
        .when(F.col("event_type") == "error", "low")
        .otherwise("trial")
        .alias("classification"),
    )


RATINGS_SQL = """ratings as (
  select l_suppkey as partid, l_partkey as verb_id,
         l_partkey * 2 + l_linenumber % 2 as sent_pair_id,
         case when l_linestatus = 'F' then 'DOsentence' else 'PDsentence' end as construct,
         case when p_type in ('ECONOMY', 'STANDARD', 'PROMO')
              then 'alternating' else 'non-alternating' end as classification,
         case when l_linenumber % 2 = 1
              then 'longIndefinite' else 'shortIndefinite' end as io,
         p_size as frequency_rank, l_quantity as value,
         l_returnflag as model, l_extendedprice as price
  from lineitem join part on p_partkey = l_partkey)"""

SCORES_SQL = (
    RATINGS_SQL
    + """, scores as (
  select model, sent_pair_id, verb_id, classification, io, frequency_rank, construct,
         avg(price) as score
  from ratings group by all)"""
)

PAIRS_SQL = (
    RATINGS_SQL
    + """, pairs as (
  select distinct sent_pair_id, verb_id, classification, io, frequency_rank from ratings)"""
)

VERBS_SQL = """verbs as (
  select p_partkey as verb_id, p_name as verb, p_size as frequency_rank, p_brand from part)"""

CHECKS_SQL = """checks as (
  select user_id as partid, event_id as item, value,
         case event_type when 'signup' then 'high' when 'error' then 'low' else 'trial' end
           as classification
  from events)"""

SCORE_PAIRS_SQL = (
    SCORES_SQL
    + """, score_pairs as (
  select model, sent_pair_id, verb_id, classification, io, frequency_rank,
         max(score) filter (where construct = 'DOsentence') as "DO_score",
         max(score) filter (where construct = 'PDsentence') as "PD_score"
  from scores group by all)"""
)

