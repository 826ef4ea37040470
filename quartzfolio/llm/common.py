"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import TypeVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, DataType, StructType, VariantType

T = TypeVar("T")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)
S29 = np.uint64(29)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def local_folder() -> str:
    return tempfile.mkdtemp(prefix="quartzfolio-")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``, else the context's
    checkpoint directory; where neither is set, a temporary one of this process,
    which only a local master can use.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = local_folder()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut of
    the lineage that outlives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that hold at least one row of so many are heavy; no more than so many can be.
HEAVY = 2000


def join_by_weight(rows: DataFrame, of_key: DataFrame, keys: Sequence[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with ``of_key``, which has one row a key and in column ``n``
    (dropped) how many of the ``total`` rows have it. Heavy keys are broadcast,
    ``HEAVY`` at most, so that none of them meets in one task; the others are
    joined by a shuffle. Keys must not be null."""
    least = max(1, total // HEAVY)
    heavy = F.broadcast(of_key.where(F.col(n) > least).drop(n))
    rest = of_key.where(F.col(n) <= least).drop(n)
    light = rows.join(heavy.select(*keys), list(keys), "left_anti")
    return rows.join(heavy, list(keys)).unionByName(light.join(rest, list(keys)))


def orderable(t: DataType) -> bool:
    """Whether rows can be ordered by a column of this type."""
    if isinstance(t, StructType):
        return all(orderable(f.dataType) for f in t)
    if isinstance(t, ArrayType):
        return orderable(t.elementType)
    return isinstance(t, AtomicType) and not isinstance(t, VariantType)


KEPT_BY_WORKER: dict[str, tuple[str, object]] = {}


def kept_by_worker(kind: str, key: str, make: Callable[[], T]) -> T:
    """What ``make`` returns, made once in a Python worker for all its tasks;
    another key replaces it."""
    if KEPT_BY_WORKER.get(kind, ("", None))[0] != key:
        KEPT_BY_WORKER[kind] = (key, make())
    return KEPT_BY_WORKER[kind][1]


class Remembered(dict):
    """A dictionary that forgets: beyond ``most`` entries it starts anew, and
    what is asked for again is taken over from the one before."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.before = most, {}

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that are in neither; all the others are in this one
        afterwards."""
        if len(self) + len(keys) > self.most:
            self.before = dict(self)
            self.clear()
        new = keys.difference(self)
        again = new.intersection(self.before)
        self.update((k, self.before[k]) for k in again)
        return new - again


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> S33)
    x = x * MIX_1
    x ^= x >> S29
    x *= MIX_2
    x ^= x >> S33
    return x


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same for the same seed."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed)) | np.uint64(1)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), dtype="<u4")


def ngram_features(text: str, bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """Hashed character n-gram counts of a whole text under a root, at unit
    length; ``orders`` are 1, 2, ... in turn."""
    c = code_points(text).astype(np.uint64)
    total = np.zeros(1 << bits, np.float32)
    h = np.zeros(len(c), np.uint64)
    for n in orders:
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * MIX_1
        total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    total = np.sqrt(total)
    return total / max(float(np.linalg.norm(total)), 1e-9)
