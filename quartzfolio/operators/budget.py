"""Budgets: local assessment, waterfalls, plans, greedy and exact selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzfolio.functions.numbers import half_up
from quartzfolio.operators.scoring import level
from quartzfolio.operators.windows import running_sum, top_per_group

#: Weights of the local assessment and its bands.
WEIGHTS = {"fit": 8, "value": 9, "safety": 5, "ease": 7, "timing": 6}
BANDS = ((80, "accelerate"), (60, "keep"), (40, "optimize"), (25, "pause"), (0, "stop"))
SCENARIOS = {"conservative": 0.75, "balanced": 0.9, "aggressive": 0.98}
QUARTERS = (0.25, 0.2, 0.2, 0.15, 0.1, 0.1)


def local_assessment(items: DataFrame) -> DataFrame:
    """Five weighted scores of each item and what they recommend."""
    parts = items.select("id", "vendor", "budget", (F.coalesce("business_value", F.lit(5)) * 10).alias("value"), (F.coalesce("alignment", F.lit(5)) * 10).alias("fit"),
        level("risk", {"low": 90.0, "medium": 60.0, "high": 30.0, "critical": 10.0}, 50.0).alias("safety"), level("complexity", {"low": 90.0, "medium": 60.0, "high": 30.0}, 50.0).alias("ease"),
        level("lifecycle", {"growth": 90.0, "mature": 70.0, "active": 60.0, "decline": 30.0}, 10.0).alias("timing"))
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    out = parts.withColumn("overall", half_up(total / float(sum(WEIGHTS.values())), 1))
    said = F.when(F.col("overall") >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        said = said.when(F.col("overall") >= least, name)
    return out.withColumn("recommendation", said.otherwise(BANDS[-1][1]))


def waterfall(assessed: DataFrame, of_total: float = 0.4) -> DataFrame:
    """Each vendor's budget goes to its items in the order of their scores until
    it is used up, for three shares of it. As an item takes all that is left, the
    running sum of what was wanted before says what it gets."""
    wish = F.when(F.col("overall") >= 80, 1.0).when(F.col("overall") >= 60, 0.9).when(F.col("overall") >= 40, 0.7).otherwise(0.4)
    total = assessed.groupBy("vendor").agg(F.floor(F.sum(F.col("budget").cast("decimal(18,2)")) * F.lit(of_total).cast("decimal(2,1)")).cast("long").alias("total"))
    shares = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("share")) for k, v in SCENARIOS.items())))
    rows = assessed.join(total, "vendor").withColumn("s", shares).select("s.*", "vendor", "id", "overall", F.floor(F.col("budget") * wish).cast("long").alias("want"), "total")
    rows = running_sum(rows, ["scenario", "vendor"], F.floor(-F.col("overall")), [F.desc("overall"), "id"], "want", "used")
    left = F.floor(F.col("total") * F.col("share")).cast("long") - (F.col("used") - F.col("want"))
    return rows.select("scenario", "vendor", "id", "want", F.greatest(F.lit(0), F.least("want", left)).cast("long").alias("given"))


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of each segment's orders over six quarters, with running sums."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    by_customer = read("orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))
    total = by_customer.join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.floor(F.sum("spent")).cast("long").alias("total"))
    planned = total.select("segment", "total", F.posexplode(F.array(*map(F.lit, QUARTERS))).alias("i", "share")).withColumn("planned", F.floor(F.col("total") * F.col("share") + 0.5).cast("long"))
    return planned.select("segment", (F.col("i") + 1).alias("quarter"), "planned", F.sum("planned").over(Window.partitionBy("segment").orderBy("i")).alias("cumulative"))


def greedy(items: DataFrame, group: str, budget: float) -> DataFrame:
    """Items of each group in the order of score for cost; one that doesn't fit
    into what is left is skipped. Rows stream through in order, whatever the size
    of a group; a task holds one number. Items without a group are one group; those
    without a cost are not taken."""
    rows = items.withColumn("ratio", F.col("score") / F.col("cost")).repartition(group).sortWithinPartitions(group, F.desc("ratio"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, left = object(), 0.0
        for b in batches:
            taken = []
            for g, cost in zip(b.column(group).to_pylist(), b.column("cost").to_pylist(), strict=True):
                if g != current:
                    current, left = g, budget
                fits = cost is not None and cost <= left
                taken.append(fits)
                left -= cost if fits else 0.0
            yield b.filter(pa.array(taken, pa.bool_())).select([group, "id", "score", "cost"])

    return rows.mapInArrow(run, items.select(group, "id", "score", "cost").schema)


def knapsack(items: DataFrame, group: str, budget: float, unit: float = 1000.0) -> DataFrame:
    """The set of items of each group with the highest summed score whose costs,
    rounded up to units, keep within the budget. Items that don't fit alone are
    left out before the shuffle, items of no cost are taken without it. Of the
    items of as many units only as many as fit together can be in a best set, so
    the others, with lesser scores, fall away; a group's table stays small."""
    capacity = int(budget // unit)
    out = items.select(group, "id", "score", "cost")
    fit = items.withColumn("units", F.ceil(F.col("cost") / unit).cast("int")).where(F.col("units") <= capacity)
    free = fit.where((F.col("units") == 0) & (F.rint(F.col("score") * 100) > 0)).select(out.columns)
    best_of_size = top_per_group(fit.where("units > 0"), [group, "units"], [F.desc(F.rint(F.col("score") * 100)), "id"], capacity)
    fit = best_of_size.where(F.col("place") * F.col("units") <= capacity)

    def best(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id").reset_index(drop=True)
        value = np.zeros(capacity + 1)
        took = np.zeros((len(f), capacity + 1), bool)
        for i, (units, score) in enumerate(zip(f["units"], np.round(f["score"] * 100), strict=True)):
            other = np.full(capacity + 1, -1.0)
            other[units:] = value[: capacity + 1 - units] + score
            took[i] = other > value
            value = np.maximum(value, other)
        left, chosen = capacity, []
        for i in range(len(f) - 1, -1, -1):
            if took[i, left]:
                chosen.append(i)
                left -= int(f["units"][i])
        return f.loc[sorted(chosen), [group, "id", "score", "cost"]]

    return fit.groupBy(group).applyInPandas(best, out.schema).unionByName(free)
