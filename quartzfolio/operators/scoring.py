"""Scores of portfolio items: WSJF, ICE, retention, MoSCoW, composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfolio.functions.numbers import half_up, or_default, scale10


def level(name: str, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(F.col(name) == k, v).otherwise(out)
    return out


def tagged(*tags: str) -> Column:
    return F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False))


def at_least(name: str, value: float) -> Column:
    return F.coalesce(F.col(name) >= value, F.lit(False))


def wsjf() -> Column:
    """(value + time criticality + risk reduction) / job size, to two places."""
    value = F.least(F.lit(10.0), scale10(F.col("business_value")) + F.when(at_least("alignment", 8), 1.0).otherwise(0.0))
    criticality = level("triage", {"MUST": 9.0, "SHOULD": 7.0, "COULD": 4.0, "WONT": 2.0}, 5.0)
    criticality = F.least(F.lit(10.0), criticality + F.when(F.coalesce(F.col("phase") == 1, F.lit(False)), 2.0).otherwise(0.0))
    reduction = level("risk", {"critical": 2.0, "high": 5.0, "medium": 7.0, "low": 9.0}, 7.0)
    both = at_least("cost", 1e-12) & at_least("budget", 1e-12)
    job = F.when(both, F.greatest(F.lit(1.0), F.least(F.lit(10.0), half_up(F.col("cost") / F.col("budget") * 5 + 3)))).otherwise(level("complexity", {"low": 3.0, "medium": 5.0, "high": 8.0}, 5.0))
    return half_up((value + criticality + reduction) / F.greatest(F.lit(1.0), job), 2)


def ice() -> Column:
    """Impact x confidence x ease."""
    impact = scale10(F.col("business_value"))
    impact = F.when(F.col("alignment").isNotNull(), half_up((impact + scale10(F.col("alignment"))) / 2)).otherwise(impact)
    sure = F.least(F.lit(10.0), level("risk", {"critical": 4.0, "high": 5.0, "low": 9.0}, 7.0) + F.when(F.col("triage_confidence") >= 0.8, 1.0).otherwise(0.0))
    ease = level("complexity", {"low": 9.0, "medium": 5.0, "high": 2.0}, 5.0)
    ease = F.when(at_least("n_dependencies", 4), F.greatest(F.lit(1.0), ease - 2)).otherwise(ease)
    return impact * sure * ease


def retention() -> Column:
    """Weighted mean of seven factors, to three places."""
    bonus = lambda when, by: F.when(when, by).otherwise(0.0)
    tenth = lambda c: F.when(or_default(F.col(c), 0.0) == 0, 0.5).otherwise(F.least(F.lit(1.0), F.col(c) / 10))
    ending = F.coalesce(F.col("lifecycle") == "end_of_life", F.lit(False))
    market = F.least(F.lit(1.0), level("lifecycle", {"growth": 0.9, "mature": 0.6, "decline": 0.2, "end_of_life": 0.2}, 0.5) + bonus(at_least("alignment", 8), 0.2))
    change = F.when(ending, 0.1).when(tagged("modernization", "upgrade"), 0.8).otherwise(0.5)
    money = F.least(F.lit(1.0), tenth("business_value") + bonus(at_least("roi", 1e-12), 0.2))
    resources = level("complexity", {"low": 0.8, "high": 0.2}, 0.5)
    over = F.coalesce((F.col("cost") > F.col("budget")) & (F.col("budget") > 0), F.lit(False))
    resources = F.when(over, F.greatest(F.lit(0.0), resources - 0.3)).otherwise(resources)
    danger = level("risk", {"low": 0.9, "medium": 0.5, "high": 0.3, "critical": 0.1}, 0.5)
    position = F.when(tagged("commodity"), 0.3).when(tagged("differentiator", "unique"), 0.9).otherwise(0.5)
    total = market * 0.2 + change * 0.1 + money * 0.2 + tenth("alignment") * 0.2 + resources * 0.1 + danger * 0.1 + position * 0.1
    return half_up(total, 3)


def moscow() -> Column:
    t, w = F.col("triage"), F.col("wsjf")
    return F.when(t == "WONT", "wont_have").when((t == "MUST") | (w > 3), "must_have").when((t == "SHOULD") | (w >= 2), "should_have").when((t == "COULD") | (w >= 1), "could_have").otherwise("wont_have")


def composite() -> Column:
    part = F.least(F.lit(100.0), F.col("wsjf") / 5 * 100) * 0.4 + F.least(F.lit(100.0), F.col("ice") / 10) * 0.3 + F.col("retention") * 100 * 0.3
    return half_up(part, 1)


def recommendation() -> Column:
    s, r, m = F.col("score"), F.col("retention"), F.col("moscow")
    return (
        F.when((m == "wont_have") & (r < 0.4), "eliminate").when((s >= 70) | (m == "must_have"), "invest")
        .when((s >= 50) & (r >= 0.5), "maintain").when((s >= 40) | (r >= 0.4), "optimize").otherwise("eliminate")
    )


def confidence() -> Column:
    """0.6 and what the item brings along."""
    out = F.lit(0.6)
    for when, by in ((F.col("business_value").isNotNull(), 0.1), (F.col("alignment").isNotNull(), 0.1), (F.col("risk").isNotNull(), 0.05), (F.col("triage_confidence") > 0.7, 0.1)):
        out = out + F.when(when, by).otherwise(0.0)
    return F.least(F.lit(1.0), out)


def score(triaged: DataFrame) -> DataFrame:
    """All scores of triaged items; one projection, no shuffle."""
    return (
        triaged.withColumns({"wsjf": wsjf(), "ice": ice(), "retention": retention()})
        .withColumn("moscow", moscow()).withColumn("score", composite())
        .withColumns({"recommendation": recommendation(), "score_confidence": half_up(confidence(), 2)})
    )


def matrix(scored: DataFrame) -> DataFrame:
    """Quadrant by value (the score) and effort, cut at 60 and 50."""
    ease = level("complexity", {"low": 9.0, "medium": 5.0, "high": 2.0}, 5.0)
    effort = 100 - 10 * ease
    high, hard = F.col("score") >= 60, effort >= 50
    return scored.withColumns({"effort": effort, "quadrant": F.when(high & ~hard, "quick_wins").when(high, "major_projects").when(~hard, "fill_ins").otherwise("thankless")})


def settled(df: DataFrame) -> DataFrame:
    """The same rows, but filters on them stay above: pushed below, conditions on
    scores would repeat the whole expressions of the scores many times over."""
    return df.select(F.inline(F.array(F.struct("*"))))
