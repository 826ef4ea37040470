"""Latest rows, review tiers and priorities, stratified samples, ordered folds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key. Rows meet in a partial aggregation first, so a
    key with very many rows costs no more than others."""
    order = F.struct(*by)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*").select(df.columns)


def review_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "auto_accept").when(confidence >= 0.7, "quick_review").when(confidence >= 0.5, "manual_review").otherwise("deep_review")


def review_priority(confidence: Column, value: Column, alignment: Column) -> Column:
    """5, more for low confidence, high value and alignment; 1 to 10."""
    add = lambda *cases: F.coalesce(F.when(cases[0][0], cases[0][1]) if len(cases) == 1 else F.when(cases[0][0], cases[0][1]).when(cases[1][0], cases[1][1]), F.lit(0))
    total = 5 + add((confidence < 0.5, 3), (confidence < 0.7, 1)) + add((value >= 8, 2), (value >= 6, 1)) + add((alignment >= 8, 1))
    return F.greatest(F.lit(1), F.least(F.lit(10), total))


def top_per_group(df: DataFrame, group: list[str], order: list, n: int, place: str = "place", salt: str = "id", buckets: int = 32) -> DataFrame:
    """The first ``n`` rows of each group. Each of ``buckets`` parts of a group
    finds its own first ``n`` before the group meets."""
    some = df.withColumn("_b", F.pmod(F.xxhash64(salt), F.lit(buckets)))
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order))).where(F.col("_n") <= n)
    return some.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col(place) <= n).drop("_b", "_n")


def stratified(df: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """A fixed number of rows of each stratum: the least confident of each
    category first, then the least confident. ``df`` has id, stratum, category and
    confidence. Beyond the quota no row of a category can be taken, so each
    category sends no more."""
    most = max(quotas.values())
    best = top_per_group(df, ["stratum", "category"], ["confidence", "id"], most, "_c")
    heads = F.when(F.col("_c") == 1, 0).otherwise(1)
    limit = F.lit(0)
    for name, n in quotas.items():
        limit = F.when(F.col("stratum") == name, n).otherwise(limit)
    taken = best.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy(heads, "confidence", "id")).cast("long"))
    return taken.where(F.col("place") <= limit).drop("_c")


def fold(df: DataFrame, keys: list[str], order: list[str], value: str, start: float | None, step: Callable[[float | None, float], float]) -> DataFrame:
    """Left fold of the values of each key in order, ``step(state, value)``, for any
    step; ``fold_maps`` needs no task a key. Rows of a key stream through a task in
    order; it holds one state, not the rows. Rows whose key is null are a key of
    their own; null values are skipped."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, *(o for o in order if o not in keys), value).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, start, []
        for b in batches:
            for *now, v in zip(*(b.column(c).to_pylist() for c in (*keys, value)), strict=True):
                if now != key:
                    if key is not None:
                        done.append((*key, state))
                    key, state = now, start
                state = step(state, v)
            if done:
                yield named(b.schema, keys, done)
            done = []
        if key is not None:
            yield named(b.schema, keys, [(*key, state)])

    return rows.mapInArrow(run, StructType([*(df.schema[k] for k in keys), StructField("state", DoubleType())]))


def named(schema: pa.Schema, keys: list[str], rows: list[tuple]) -> pa.RecordBatch:
    fields = [*(schema.field(k) for k in keys), pa.field("state", pa.float64())]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


#: A clamped line: state -> min(high, max(low, a * state + b)), with a not below 0.
Line = tuple[float, float, float, float]
SAME: Line = (1.0, 0.0, -math.inf, math.inf)


def after(f: Line, g: Line) -> Line:
    """The clamped line that does ``f``, then ``g``: such lines compose to such."""
    a, b, low, high = g
    ends = (min(high, max(low, a * x + b)) if math.isfinite(x) or a else b for x in f[2:])
    new_low, new_high = ends
    return (f[0] * a, f[1] * a + b, new_low, new_high)


def fold_maps(df: DataFrame, keys: list[str], order: list[str], line: tuple[Column, Column, Column, Column], start: float | None) -> DataFrame:
    """The state of each key after all its rows in order, where a row is a clamped
    line (a, b, low, high) of the state before it; without ``start`` the first row's
    ``b / (1 - a)``, the value that it leaves as it is, begins.

    As lines compose, a key needs no task of its own: rows are dealt by ranges of
    key and order, a task composes the rows of a key that it has to one line, and
    only those few lines of a key meet, in order. Rows whose key is null are a key
    of their own; rows with a null in their line are skipped."""
    names = ["_a", "_b", "_low", "_high"]
    rows = df.select(*keys, *(o for o in order if o not in keys), *(c.cast("double").alias(n) for c, n in zip(line, names, strict=True))).dropna(subset=names)
    cut = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id())
    kept = StructType([*(df.schema[k] for k in keys), *(StructField(n, DoubleType()) for n in names), StructField("_first", DoubleType()), StructField("_part", IntegerType())])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, so_far, first, part = None, SAME, 0.0, 0
        fields = None

        def made(lines: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*lines, strict=True), fields, strict=True)], schema=fields)

        for b in batches:
            fields = pa.schema([*(b.schema.field(k) for k in keys), *(pa.field(n, pa.float64()) for n in (*names, "_first")), pa.field("_part", pa.int32())])
            done, columns = [], [b.column(c).to_pylist() for c in (*keys, *names)]
            for row in zip(*columns, strict=True):
                now, own = row[: len(keys)], row[len(keys) :]
                if now != key:
                    if key is not None:
                        done.append((*key, *so_far, first, part))
                    key, so_far, first = now, SAME, own[1] / (1 - own[0]) if own[0] != 1 else own[1]
                so_far = after(so_far, own)
            part = b.column("_part")[0].as_py() if b.num_rows else part
            if done:
                yield made([(*d[:-1], part) for d in done])
        if key is not None:
            yield made([(*key, *so_far, first, part)])

    lines = cut.mapInArrow(compose, kept).repartition(*keys).sortWithinPartitions(*keys, "_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, schema = None, 0.0, None
        for b in batches:
            schema, done = b.schema, []
            for row in zip(*(b.column(c).to_pylist() for c in (*keys, *names, "_first")), strict=True):
                now, (a, add, low, high, first) = row[: len(keys)], row[len(keys) :]
                if now != key:
                    if key is not None:
                        done.append((*key, state))
                    key, state = now, first if start is None else start
                state = min(high, max(low, a * state + add))
            if done:
                yield named(schema, keys, done)
        if key is not None:
            yield named(schema, keys, [(*key, state)])

    return lines.mapInArrow(run, StructType([*(df.schema[k] for k in keys), StructField("state", DoubleType())]))


def adaptive_threshold(scores: DataFrame, key: str, score: str) -> DataFrame:
    """For each key the score above the widest gap of its sorted scores, held
    between 0.5 and 0.9; 0.7 for fewer than three."""
    w = Window.partitionBy(key).orderBy(F.desc(score))
    gaps = scores.withColumn("_gap", F.col(score) - F.lead(score).over(w))
    best = gaps.groupBy(key).agg(F.count("*").alias("n"), F.max_by(score, F.struct("_gap", score)).alias("_at"))
    cut = F.least(F.lit(0.9), F.greatest(F.lit(0.5), F.col("_at")))
    return best.select(key, F.when(F.col("n") < 3, 0.7).otherwise(cut).alias("threshold"))


def running_sum(df: DataFrame, group: list[str], coarse: Column, order: list, value: str, out: str) -> DataFrame:
    """Sum of ``value`` up to each row of its group in order. ``coarse`` is a step
    of the order that grows with it: steps are summed first, and a window runs over
    the few steps of a group and over the rows of each step, never a whole group."""
    rows = df.withColumn("_step", coarse)
    steps = rows.groupBy(*group, "_step").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(*group, "_step", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_step").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(steps, [*group, "_step"]).withColumn(out, F.col("_before") + F.sum(value).over(within)).drop("_step", "_before")
