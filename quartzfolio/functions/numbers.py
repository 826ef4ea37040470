"""Number functions: half-up rounding, scales, currency and budget texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """floor(x * 10^places + 0.5) / 10^places: halves go up, negative ones too."""
    f = float(10**places)
    return F.floor(x * f + 0.5) / f


def scale10(x: Column, default: float = 5.0) -> Column:
    """To 1..10: null is the default, others are cut and rounded half up."""
    return F.when(x.isNull(), default).when(x <= 0, 1.0).when(x >= 10, 10.0).otherwise(half_up(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def or_default(x: Column, default: Column | float) -> Column:
    """``default`` for null and zero alike."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(x.isNull() | (x == 0), d).otherwise(x)


def guarded_ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def currency(text: Column) -> Column:
    """A number from a price text. ``1.234,56`` is read the Italian way and
    ``1,234.56`` the English way; k and m multiply; what has no number is 0."""
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[€$£\s]|eur|usd|gbp", "")
    times = F.when(s.rlike("k$"), 1e3).when(s.rlike("m$"), 1e6).otherwise(1.0)
    s = F.regexp_replace(s, "[km]$", "")
    digits = (
        F.when(s.rlike(r",\d{1,2}$"), F.replace(F.regexp_replace(s, r"\.", ""), F.lit(","), F.lit(".")))
        .when(s.rlike(r"\.\d{1,2}$"), F.regexp_replace(s, ",", ""))
        .otherwise(F.regexp_replace(s, "[^0-9-]", ""))
    )
    return F.coalesce(F.regexp_extract(digits, r"^(-?\d*\.?\d+)", 1).try_cast("double"), F.lit(0.0)) * times


def ordinal(x: Column, levels: dict[str, float], default: float) -> Column:
    """Number of a level by name, any case."""
    out = F.lit(default)
    for name, value in levels.items():
        out = F.when(F.lower(x) == name, float(value)).otherwise(out)
    return out
