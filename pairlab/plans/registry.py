"""Names, Spark plans and comparison SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan, with the SQL that must give the same rows when there is one."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql.strip()
        return plan

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Round doubles so that both engines print the same digits."""
    return df.withColumns({c: F.round(c, places) for c in columns})
