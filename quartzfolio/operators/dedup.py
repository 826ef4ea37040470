"""Duplicates: copies, near copies by bands of minimal hashes, merges, upserts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzfolio.functions import strings
from quartzfolio.operators.likeness import meet
from quartzfolio.operators.tables import join_by_weight

SHIFT, HALF, MIX = np.uint64(42), np.uint64(21), np.uint64(0x9E3779B97F4A7C15)


def by_content(df: DataFrame, text: str, key: str) -> DataFrame:
    """Of every row with a text: the first key that has it and the number of its
    copies. Copies are counted before they meet, and a text that very many rows have
    is joined back by broadcast. Null keys are first of no text that has others."""
    rows = df.where(F.col(text).isNotNull()).select(key, F.sha2(text, 256).alias("hash"))
    of = rows.groupBy("hash").agg(F.min(key).alias("class_id"), F.count("*").alias("copies"))
    return join_by_weight(rows, of, ["hash"], "copies", rows.count()).select(key, "class_id", "copies")


def merged(df: DataFrame, cluster: str, fields: Sequence[str], confidence: str, key: str = "id") -> DataFrame:
    """One row for each cluster: of every field the value with the highest
    confidence, the first of equals; nulls never win."""
    best = [F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.struct(F.col(confidence), -F.col(key)))).alias(f) for f in fields]
    return df.groupBy(cluster).agg(F.count("*").alias("n"), F.max(confidence).alias(confidence), *best)


def shingles(text: Column, k: int = 3) -> Column:
    s = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    return F.when(F.length(s) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k))))).otherwise(F.array(s))


def band_keys(text: str, a: np.ndarray, bands: int) -> np.ndarray:
    """Hash of each band of seeded minimal hashes over the letter triples of a text."""
    c = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le"), "<u4").astype(np.uint64)
    c = np.pad(c, (0, max(0, 3 - len(c))))
    h = np.unique(((c[:-2] << SHIFT) + (c[1:-1] << HALF) + c[2:]) * MIX)
    h ^= h >> np.uint64(31)
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        v = h[at : at + 4096, None] * a[None, :]
        np.minimum(least, (v ^ (v >> np.uint64(29))).min(axis=0), out=least)
    rows = least.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * MIX
    for j in range(rows.shape[1]):
        key = (key ^ rows[:, j]) * MIX
        key ^= key >> np.uint64(32)
    return key.astype(np.int64)


def lsh_pairs(rows: DataFrame, threshold: float, bands: int = 20, height: int = 5) -> DataFrame:
    """Pairs of rows (id, text) that share a band of seeded minimal hashes of
    letter triples, verified on their full sets, and the copies of equal texts.
    The least id stands for its text: ``copy`` rows tie every other id of the text
    to it, the rest are pairs of such ids. Null texts are copies of nothing; a row
    whose id is null is a copy with ``other`` null."""
    texts = rows.where("text IS NOT NULL").groupBy("text").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    seeds = (np.random.default_rng(7).integers(1, 2**63, bands * height, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    @F.arrow_udf("array<long>")
    def keys(column: pa.Array) -> pa.Array:
        found = np.array([band_keys(t, seeds, bands) for t in column.to_pylist()], np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, bands), pa.int32()), pa.array(found.ravel(), pa.int64()))

    sets = texts.select("id", shingles(F.col("text")).alias("g"))
    banded = texts.select("id", F.explode(keys("text")).alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("who")).where("n > 1")
    fresh = shared.groupBy("n", "who").agg(F.min("band").alias("band"))  # of bands with the same texts one is enough
    banded = banded.join(fresh.select("band"), "band")
    pairs = meet(banded, "band").select("id", "other").distinct()
    size = F.size("g") / F.size("h")
    both = pairs.join(sets, "id").join(sets.select(F.col("id").alias("other"), F.col("g").alias("h")), "other").where(size.between(threshold, 1 / threshold))
    near = both.select("id", "other", strings.jaccard(F.col("g"), F.col("h")).alias("likeness"), F.lit(False).alias("copy")).where(F.col("likeness") >= threshold)
    members = texts.where("copies > 1").join(rows.select(F.col("id").alias("other"), "text"), "text").where("id < other OR other IS NULL")
    return near.unionByName(members.select("id", "other", F.lit(1.0).alias("likeness"), F.lit(True).alias("copy")))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows by key: the latest new one, else the latest old one."""
    rows = old.withColumn("_fresh", F.lit(0)).unionByName(new.withColumn("_fresh", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_fresh", *order)).alias("_r")).select(*keys, "_r.*")


def first_of_each(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each key in order; rows without a key fall away."""
    w = Window.partitionBy("_key").orderBy(*order)
    return df.withColumn("_key", key).where("_key IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")
