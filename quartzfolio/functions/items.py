"""Functions that read the fields of items: status, priority, type, budget and
cell texts, names, dates and small scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quartzfolio.functions.numbers import half_up

#: What status words stand for; the first that a text holds counts.
STATUS_OF = {
    "attivo": "active", "in corso": "active", "running": "active", "live": "active", "operativo": "active", "in pausa": "paused", "sospeso": "paused", "on hold": "paused", "completato": "completed", "done": "completed",
    "chiuso": "completed", "finito": "completed", "cancellato": "cancelled", "annullato": "cancelled", "dropped": "cancelled", "proposto": "proposed", "pianificato": "proposed", "planned": "proposed", "idea": "proposed",
    "backlog": "proposed", "active": "active", "paused": "paused", "completed": "completed", "cancelled": "cancelled", "proposed": "proposed",
}
PRIORITY_OF = {"critica": "critical", "critical": "critical", "urgente": "critical", "urgent": "critical", "alta": "high", "high": "high", "media": "medium", "medium": "medium", "bassa": "low", "low": "low"}
TYPE_WORDS = {
    "initiative": ("progetto", "project", "iniziativa", "initiative", "migrazione", "implementazione"), "product": ("prodotto", "product", "piattaforma", "platform", "applicazione", "sistema"),
    "service": ("servizio", "service", "supporto", "hosting", "managed"),
}
DEPENDENCY_WORDS = {
    "requires": ("requires", "depends on", "needs", "prerequisite", "must have", "built on"), "integrates_with": ("integrates with", "connects to", "syncs with", "works with", "compatible with", "interface to"),
    "replaces": ("replaces", "supersedes", "migrating from", "replacing", "successor to", "instead of"), "extends": ("extends", "plugin for", "add-on for", "module for", "extension of", "enhances"),
    "conflicts_with": ("conflicts with", "incompatible with", "not compatible", "cannot use with"),
}
#: Titles of sections, in order.
SECTION_OF = {
    "toc": r"(?i)^(table\s+of\s+contents|indice|sommario|index)", "executive_summary": r"(?i)^(executive\s+summary|sommario\s+esecutivo|sintesi|riassunto|abstract|panoramica|overview|introduzione|introduction|conclusione|conclusion|summary)",
    "appendix": r"(?i)^(appendix|appendice|allegat[io]|annex)", "references": r"(?i)^(references|bibliografia|riferimenti|bibliography)", "glossary": r"(?i)^(glossary|glossario|definizioni|terminology)",
}
MATURITY = ("initial", "developing", "defined", "managed", "optimized")


def first_held(text: Column, of: Mapping[str, str], default: Column) -> Column:
    """The meaning of a text, else of the first word that it holds."""
    held = reduce(lambda out, kv: F.when(F.contains(text, F.lit(kv[0])), kv[1]).otherwise(out), reversed(of.items()), default)
    exact = F.try_element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), text)
    return F.coalesce(exact, held)


def item_status(x: Column) -> Column:
    """``proposed`` for what isn't known and for null."""
    return F.when(F.coalesce(x, F.lit("")) == "", "proposed").otherwise(first_held(F.lower(F.trim(x)), STATUS_OF, F.lit("proposed")))


def item_priority(x: Column) -> Column:
    """``medium`` for what isn't known; null stays null."""
    return F.when(F.coalesce(x, F.lit("")) != "", first_held(F.lower(F.trim(x)), PRIORITY_OF, F.lit("medium")))


def first_kind(text: Column, of: Mapping[str, Sequence[str]]) -> Column:
    """The first kind with a word that the text holds."""
    t = F.lower(text)
    return reduce(lambda out, kv: F.when(reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in kv[1])), kv[0]).otherwise(out), reversed(of.items()), F.lit(None).cast("string"))


def section_type(title: Column) -> Column:
    return reduce(lambda out, kv: F.when(title.rlike(kv[1]), kv[0]).otherwise(out), reversed(SECTION_OF.items()), F.lit("body"))


def relevance(x: Column) -> Column:
    return F.when(x >= 0.9, "Excellent").when(x >= 0.8, "Very Good").when(x >= 0.7, "Good").when(x >= 0.6, "Moderate").otherwise("Fair")


def budget_number(x: Column) -> Column:
    """A number from a cell: signs and thousands off, k and m multiply; null for none."""
    s = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[€$£]", ""), r"[.,](?=\d{3})", ""), ",", ".")))
    n = F.regexp_extract(s, r"^(-?\d*\.?\d+)", 1).try_cast("double")
    return n * F.when(F.contains(s, F.lit("k")), 1e3).when(F.contains(s, F.lit("m")), 1e6).otherwise(1.0)


#: Budgets in a text, in order.
BUDGETS = (r"(?i)€\s*([\d.,]+)\s*(?:k|mln|m)?", r"(?i)budget[:\s]*([\d.,]+)\s*(?:k|mln|m|€)?", r"(?i)([\d.,]+)\s*(?:euro|€)", r"([\d.,]+)\s*(?:k|K)\s*€?", r"([\d.,]+)\s*(?:mln|m|M)\s*€?")


def budget_in_text(x: Column) -> Column:
    """The budget that a text names, by the first pattern that fits."""
    out = []
    for p in BUDGETS:
        whole, digits = F.lower(F.regexp_extract(x, p, 0)), F.regexp_extract(x, p, 1)
        n = F.regexp_extract(F.regexp_replace(F.regexp_replace(digits, r"[.,](?=\d{3})", ""), ",", "."), r"^(\d*\.?\d+)", 1).try_cast("double")
        tail = F.regexp_replace(whole, "budget|euro", "")
        out.append(n * F.when(F.contains(tail, F.lit("k")), 1e3).when(F.contains(tail, F.lit("m")), 1e6).otherwise(1.0))
    return F.coalesce(*out)


def cell_number(x: Column) -> Column:
    """A typed cell: empty, a dash or n/a is null; Italian or English decimals."""
    t = F.regexp_replace(F.trim(x), "[$€£¥₹]", "")
    s = F.when(t.rlike(r"\d,\d{2}$"), F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")).when(t.rlike(r"\d\.\d{2}$"), F.regexp_replace(t, ",", "")).otherwise(t)
    return F.when(F.trim(x).rlike("(?i)^(-|n/?a)?$"), None).otherwise(F.regexp_extract(F.trim(s), r"^(-?\d*\.?\d+)", 1).try_cast("double"))


def cell_boolean(x: Column) -> Column:
    t = F.lower(F.trim(x))
    return F.when(t.isin("yes", "true", "si", "sì", "✓", "✔"), True).when(t.isin("no", "false", "✗", "✘"), False)


def roi_score(benefit: Column, cost: Column) -> Column:
    """Return on cost in 0 to 100, piecewise; missing values have defaults."""
    b, c = (F.when(x.isNull() | (x == 0), F.lit(d)).otherwise(x) for x, d in ((benefit, 50_000.0), (cost, 30_000.0)))
    roi = (b - c) / c * 100
    return F.when(roi > 200, 100.0).when(roi > 100, 80 + (roi - 100) / 5).when(roi > 50, 60 + (roi - 50)).when(roi > 0, 30 + roi).otherwise(F.greatest(F.lit(0.0), 30 + roi / 2))


def clamp_score(x: Column) -> Column:
    """0 to 100, rounded half up; 50 for what is no number."""
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(x.isNull() | F.isnan(x), 50.0).otherwise(x))))


def filename_pattern(x: Column) -> Column:
    """A file name as a pattern: its first date, version and number are general."""
    s = F.regexp_replace(x, r"\.[^.]+$", "")
    dated = s.rlike(r"\d{4}[-/]\d{2}[-/]\d{2}")
    s = F.regexp_replace(s, r"(?s)^(.*?)\d{4}[-/]\d{2}[-/]\d{2}", r"$1<date>")
    s = F.regexp_replace(s, r"(?s)^(.*?)v?\d+(\.\d+)*", r"$1<version>")
    return F.when(dated | s.isNotNull(), s)


def quarter_label(day: Column, ahead: Column) -> Column:
    later = F.add_months(F.trunc(day, "quarter"), ahead * 3)
    return F.concat(F.lit("Q"), F.quarter(later).cast("string"), F.lit(" "), F.year(later).cast("string"))


def common_prefix(a: Column, b: Column) -> Column:
    """Of two strings; of a set it is that of its least and greatest."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.left(a, i) == F.left(b, i))
    return F.left(a, F.array_max(same))
