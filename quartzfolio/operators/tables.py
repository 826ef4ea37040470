"""Tables between the rounds of an operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold at least one row of so many are heavy; no more than so many can be.
HEAVY = 2000


@lru_cache(maxsize=1)
def local_folder() -> str:
    return tempfile.mkdtemp(prefix="quartzfolio-")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the folder of ``spark.checkpoint.dir`` and read it
    back: lineage ends there, and lost executors lose nothing. Without that setting
    only a local master will do, with a folder of its own."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in that folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = local_folder()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` to be joined by a shuffle unless a broadcast is asked for. Files of few
    distinct values are far smaller than their rows, and Spark, which goes by the
    files, would send such tables through the driver."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to all cores, for work that is dear by row: a file of few
    distinct values is small and comes as one task or two, however many rows it has."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def join_by_weight(rows: DataFrame, of_key: DataFrame, keys: Sequence[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with ``of_key``, which has a row a key and in column ``n`` how
    many of the ``total`` rows have it. Heavy keys, ``HEAVY`` at most, are broadcast,
    so that none of them meets in one task; the others are shuffled. Keys must not be
    null."""
    least = max(1, total // HEAVY)
    heavy, rest = F.broadcast(of_key.where(F.col(n) > least)), of_key.where(F.col(n) <= least)
    light = shuffled(rows.join(heavy.select(*keys), list(keys), "left_anti"))
    return rows.join(heavy, list(keys)).unionByName(light.join(rest, list(keys)))
