"""Reading the driver's tables, and scratch tables of one query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.plans.registry import Plan
from pairlab.sources.staging import new_folder, remove_folder

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan of this subpackage, with the SQL that must give the same rows if there is one."""

    def register(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql.strip()
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Sequence[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name (whatever the case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


class Staged:
    """A table written to the shared folder: read any number of times, survives lost executors."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = new_folder(self.spark, label)
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def remove(self) -> None:
        remove_folder(self.spark, self.path)


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a text column, by one pass over it: planner estimates mean nothing behind joins or in-memory rows."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0
