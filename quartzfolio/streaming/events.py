"""Watermarked windows, sessions, cooldown with keyed state, file ingestion.

The same functions take batch and stream; sinks are the caller's, but for
``ingest``, which reads new files of a folder into Parquet by micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def rate_windows(events: DataFrame, window: str = "1 hour", late: str = "2 hours", most: int = 4) -> DataFrame:
    """Events of each kind and window, and how many a limit would refuse; rows
    later than ``late`` are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", F.greatest(F.lit(0).cast("long"), F.col("n") - most).alias("refused"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("session_start"), "n")


def alerts(events: DataFrame, pause: str = "1 hour") -> DataFrame:
    """(user_id, event_id, ts) of events that raise an alert: none within
    ``pause`` of the user's last one. A user's last alert is the whole state.
    Events of one user that come together are taken by time."""
    wait = pd.Timedelta(pause)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        keep = []
        for ts in rows["ts"]:
            alert = last is None or ts - last >= wait
            keep.append(alert)
            last = ts if alert else last
        state.update((last.value // 1000 if last.unit == "ns" else int(last.as_unit("us").value),))
        yield rows[keep][["user_id", "event_id", "ts"]]

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, to_items: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Items of new files, appended as Parquet once the source has no more. A
    batch that is run again replaces what it has written before."""

    def save(batch: DataFrame, number: int) -> None:
        to_items(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
