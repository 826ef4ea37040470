"""Inputs that the queries share, for Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with their oracle SQL where SQL can express them."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Portfolio items from parts: expressions that both engines read alike.
ITEM = {
    "id": "p_partkey", "name": "p_name", "vendor": "p_brand", "category": "p_type", "size": "p_size",
    "business_value": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 1 + p_size % 10 END",
    "alignment": "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 1 + p_partkey % 10 END",
    "risk": "CASE p_partkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' END",
    "complexity": "CASE p_partkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END",
    "lifecycle": "CASE p_partkey % 9 WHEN 0 THEN 'growth' WHEN 1 THEN 'mature' WHEN 2 THEN 'decline' WHEN 3 THEN 'end_of_life' WHEN 4 THEN 'deprecated' ELSE 'active' END",
    "status": "CASE WHEN p_partkey % 7 = 0 THEN 'outdated' ELSE 'active' END",
    "active_users": "(p_partkey * 37) % 500",
    "phase": "1 + p_partkey % 3",
    "cost": "CAST(CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_retailprice * p_size END AS DOUBLE)",
    "budget": "CAST(p_retailprice * (5 + p_partkey % 60) AS DOUBLE)",
    "roi": "CAST(p_partkey % 3 - 1 AS DOUBLE)",
    "n_dependencies": "p_partkey % 6",
    "owner": "concat('owner', CAST(p_partkey % 97 AS STRING))",
}
TAGS = {"compliance": 11, "security": 4, "duplicate": 23, "tech-debt": 13, "modernization": 8, "differentiator": 10, "commodity": 15}


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in ITEM.items()))
    tags = F.array_compact(F.array(*(F.when(F.col("id") % n == 0, t) for t, n in TAGS.items())))
    return rows.withColumn("tags", tags)


def tag(name: str) -> str:
    """SQL: whether an item of ``ITEMS_SQL`` has a tag."""
    return f"(id % {TAGS[name]} = 0)"


ITEMS_SQL = "items AS (SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {n}" for n, e in ITEM.items()) + " FROM part)"


def r(sql: str, places: int = 6) -> str:
    """SQL of ``half_up``."""
    f = f"{float(10**places)}"
    return f"(floor(({sql}) * {f} + 0.5) / {f})"


def rounded(c, places: int = 6):
    f = float(10**places)
    return F.floor(c * f + 0.5) / f


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Exact money of a line.
REVENUE = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
