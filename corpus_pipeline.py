"""From raw documents to packed training sequences: five stages, each over all that the stage before kept.

Toxic documents go; one document of each group of near-duplicates stays; passages that repeat
across documents are cut out; documents contaminated by the benchmark go; the rest is packed.
``run`` writes each stage to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import decontaminate, near, packing, substring, toxicity
from pairlab.llm.queries import tokenizer_path
from pairlab.llm.tables import Staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of op5 rejects go; it learns from labels of documents that aren't held out.

    Defined cases: null and empty texts are scored like any other; rows with a null id have no label and are judged by
    their text; repeated rows share their fate; without labels, or with labels of one kind only, every document
    stays; an empty table stays empty; columns of any name pass unchanged.
    """
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates stays.

    Defined cases: null, empty and blank texts and rows with a null id stay; repeated rows of an id that
    stays all stay; an empty table stays empty; columns of any name pass unchanged.
    """
    return near.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that occur more than once go from the texts; n_chars follows, if it is there, and every document stays.

    Defined cases: a null text stays null, and so does its n_chars; repeated rows repeat each other's windows, so
    texts of 35 words or more that are there twice lose all words; rows with a null id are cut like others; an
    empty table stays empty; other columns of any name pass unchanged.
    """
    cut = substring.remove_repeated(docs).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages of 5 % of their words or more go.

    Defined cases: texts without words, null ones included, stay; repeated rows share their fate; rows with a null id
    are judged by their text; without benchmark items, or with wordless ones only, every document stays; an
    empty table stays empty; columns of any name pass unchanged.
    """
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it.

    Defined cases: a null or empty text is the end id alone; a null id is carried along; repeated rows are packed once
    each; an empty table gives no piece; other columns are left out.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: A trained classifier and a search for few sequences can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        done = Staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            before.remove()
        docs, before = done.read(), done
    return docs
