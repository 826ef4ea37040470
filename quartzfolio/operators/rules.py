"""Conditions on items as data, compiled to columns, and first-match rule lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object

    def column(self) -> Column:
        """True or false, never null: a missing value only fits ``ne``."""
        x = F.col(self.field)
        if self.op == "ne":
            return ~F.coalesce(x == F.lit(self.value), F.lit(False))
        if self.op == "eq":
            out = x == F.lit(self.value)
        elif self.op in COMPARE:
            out = getattr(x.cast("double"), COMPARE[self.op])(float(self.value))
        elif self.op == "contains":
            out = F.lower(x).contains(str(self.value).lower())
        elif self.op == "startsWith":
            out = F.lower(x).startswith(str(self.value).lower())
        elif self.op == "includes":
            out = F.exists(x, lambda t: F.lower(t).contains(str(self.value).lower()))
        else:
            raise ValueError(f"unknown operator {self.op!r}")
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Rule:
    name: str
    conditions: tuple[Condition, ...]
    category: str
    confidence: float

    def column(self) -> Column:
        return reduce(and_, (c.column() for c in self.conditions), F.lit(True))


def rule(name: str, category: str, confidence: float, *conditions: tuple[str, str, object]) -> Rule:
    return Rule(name, tuple(Condition(*c) for c in conditions), category, confidence)


#: The triage rules in their order.
TRIAGE_RULES = (
    rule("compliance_requirement", "MUST", 0.95, ("tags", "includes", "compliance")),
    rule("security_critical", "MUST", 0.90, ("tags", "includes", "security"), ("risk", "eq", "critical")),
    rule("critical_infrastructure", "MUST", 0.90, ("category", "contains", "infrastructure"), ("risk", "eq", "critical")),
    rule("strategic_high_value", "MUST", 0.85, ("alignment", "gte", 8), ("business_value", "gte", 8)),
    rule("end_of_life", "WONT", 0.85, ("lifecycle", "eq", "end_of_life")),
    rule("deprecated", "WONT", 0.80, ("lifecycle", "eq", "deprecated")),
    rule("no_active_users", "WONT", 0.75, ("active_users", "eq", 0)),
    rule("duplicate_flagged", "WONT", 0.80, ("tags", "includes", "duplicate")),
    rule("outdated", "WONT", 0.70, ("status", "eq", "outdated")),
    rule("high_strategic_alignment", "SHOULD", 0.75, ("alignment", "gte", 7)),
    rule("high_business_value", "SHOULD", 0.75, ("business_value", "gte", 7)),
    rule("customer_facing_active", "SHOULD", 0.70, ("category", "contains", "customer"), ("active_users", "gte", 100)),
    rule("medium_value", "COULD", 0.60, ("business_value", "gte", 4), ("business_value", "lt", 7)),
    rule("technical_debt_reduction", "COULD", 0.60, ("tags", "includes", "tech-debt")),
)
TRIAGE_THRESHOLD = 0.7


def first_match(rules: Sequence[Rule]) -> Column:
    """Struct of the first rule that fits; null if none does."""
    out = None
    for r in rules:
        said = F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.confidence).alias("confidence"))
        out = F.when(r.column(), said) if out is None else out.when(r.column(), said)
    return out if out is not None else F.lit(None)


def triage(items, rules: Sequence[Rule] = TRIAGE_RULES, threshold: float = TRIAGE_THRESHOLD):
    """``items`` with rule, triage and triage_confidence; a first match below the
    threshold leaves an item UNKNOWN at 0.3."""
    sure = F.col("_m.confidence") >= threshold
    return items.withColumn("_m", first_match(rules)).withColumns({
        "triage_rule": F.when(sure, F.col("_m.rule")), "triage": F.when(sure, F.col("_m.category")).otherwise("UNKNOWN"),
        "triage_confidence": F.when(sure, F.col("_m.confidence")).otherwise(0.3),
    }).drop("_m")
