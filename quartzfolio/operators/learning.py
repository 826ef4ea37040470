"""Rules from corrections, patterns on scores, and keyed state over time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority_rules(corrections: DataFrame, a: str, b: str, least: int = 3) -> DataFrame:
    """The most frequent target of each value that was changed ``least`` times
    into it, the later name of equals; confidence grows with the count."""
    n = corrections.groupBy(a, b).agg(F.count("*").alias("n"))
    best = n.groupBy(a).agg(F.max_by(b, F.struct("n", b)).alias(b), F.max("n").alias("n")).where(F.col("n") >= least)
    return best.withColumn("confidence", F.least(F.lit(0.95), 0.5 + 0.05 * F.col("n")))


def common_features(rows: DataFrame, key: str, features: Sequence[str], share: float) -> DataFrame:
    """(key, feature, val, share) of feature values that at least ``share`` of a
    key's rows have."""
    long = rows.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("val")) for f in features))).alias("x")).select(key, "x.*")
    n = long.groupBy(key, "feature", "val").agg(F.count("*").alias("n"))
    total = rows.groupBy(key).agg(F.count("*").alias("total"))
    return n.join(total, key).select(key, "feature", "val", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= share)


def adjusted(score: Column, patterns: Sequence[tuple[str, str, str, float, float]]) -> Column:
    """``score`` after patterns (feature, value, action, amount, confidence), by
    falling confidence; held between 0 and 100."""
    for feature, value, action, amount, _ in sorted(patterns, key=lambda p: -p[4]):
        new = {"multiply": score * amount, "add": score + amount, "override": F.lit(amount)}[action]
        score = F.when(F.col(feature).eqNullSafe(F.lit(value)), new).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def by_key(rows: DataFrame) -> DataFrame:
    """Rows of a key together and in order, streamed through a task: none is
    held whole in memory."""
    return rows.select("key", "ts", "event_id").repartition("key").sortWithinPartitions("key", "ts", "event_id")


def cooldown(rows: DataFrame, pause: str) -> DataFrame:
    """Rows (key, ts, event_id) that raise an alert: none within ``pause`` of the
    key's last alert. Null keys are one key; rows without a time raise none."""
    wait = pd.Timedelta(pause)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = object(), None
        for b in batches:
            keep = []
            for k, ts in zip(b.column("key").to_pylist(), b.column("ts").to_pylist(), strict=True):
                if k != key:
                    key, last = k, None
                alert = ts is not None and (last is None or ts - last >= wait)
                keep.append(alert)
                last = ts if alert else last
            yield b.filter(pa.array(keep, pa.bool_()))

    return by_key(rows).mapInArrow(run, rows.select("key", "ts", "event_id").schema)
