"""Validation issues, noise, encoding, gates, completeness.

An issue is a struct of field, message and severity; a row has an array of them,
so that nothing is joined or shuffled until they are counted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an issue costs a row.
PENALTY = {"critical": 25, "warning": 10, "info": 2}
#: What is no name of an item: headings, links, addresses, page numbers.
NOISE = (
    r"(?i)^(table of contents|contents|index|about us|contact us|terms and conditions|privacy policy)\b", r"(?i)^(page|pagina|pag\.)\s*[0-9]+", r"(?i)^https?://", r"^[^@ ]+@[^@ ]+\.[a-z]{2,}$",
    r"^[0-9 .,/-]+$", r"(?i)^(copyright|all rights reserved)", r"^[^A-Za-z0-9]+$", r"(?i)^(figure|table|chapter|section)\s*[0-9]+", r"(?i)\b(click here|read more)\b",
)
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}


def issue(when: Column, field: str, message: str, severity: str) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"), F.lit(severity).alias("severity")))


def issues(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def score(of: Column, penalty: Mapping[str, int] = PENALTY) -> Column:
    """100 less what the issues cost, 0 at least."""
    cost = F.create_map(*(F.lit(x) for kv in penalty.items() for x in kv))
    return F.greatest(F.lit(0), 100 - F.aggregate(of, F.lit(0), lambda s, i: s + F.coalesce(F.element_at(cost, i["severity"]), F.lit(0))))


def is_noise(name: Column) -> Column:
    """Too short or long to be a name, or like one of ``NOISE``. Null is noise."""
    n = F.length(name)
    shape = (n < 3) | (n > 300) | (F.size(F.split(F.trim(name), " +")) > 25) | ((n > 100) & (F.lower(name) == name))
    for p in NOISE:
        shape = shape | name.rlike(p)
    return F.coalesce(shape, F.lit(True))


def cleaned(text: Column) -> Column:
    """Without replacement and control characters; HTML entities decoded."""
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.replace(text, F.lit("�"), F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def filled(*columns: str) -> Column:
    """How many of the columns have a value."""
    out = F.lit(0)
    for c in columns:
        out = out + F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0)
    return out


def gate(value: Column, sign: str, at: float) -> Column:
    """Whether a value passes; a missing one doesn't."""
    tests = {">=": value >= at, "<=": value <= at, ">": value > at, "<": value < at, "==": F.abs(value - at) <= 0.01}
    return F.coalesce(tests[sign], F.lit(False))
