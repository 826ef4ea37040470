"""Validation rules, corrections and verdicts of raw items.

An issue is a struct (field, kind, severity), a correction a struct (field, old,
new, confidence); a row has an array of each, so that nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quartzfolio.functions.numbers import currency

#: Allowed words of a field, and what Italian words and digits stand for.
STATUSES = ("active", "inactive", "draft", "pending", "approved", "rejected", "in_progress", "completed", "cancelled", "on_hold", "attivo", "inattivo", "bozza", "in attesa", "approvato", "rifiutato", "in corso", "completato", "annullato", "sospeso")
PRIORITIES = ("low", "medium", "high", "critical", "urgent", "bassa", "media", "alta", "critica", "urgente", "1", "2", "3", "4", "5")
TYPES = ("product", "service")
ALLOWED = {"status": STATUSES, "priority": PRIORITIES, "type": TYPES}
MEANING = {
    "attivo": "active", "inattivo": "inactive", "bozza": "draft", "in attesa": "pending", "approvato": "approved", "rifiutato": "rejected", "in corso": "in_progress", "completato": "completed",
    "annullato": "cancelled", "sospeso": "on_hold", "bassa": "low", "media": "medium", "alta": "high", "critica": "critical", "urgente": "urgent", "1": "low", "2": "medium", "3": "high", "4": "critical",
    "5": "critical", "prodotto": "product", "servizio": "service",
}
#: What is no name.
NO_NAME = (r"(?i)^test$", r"(?i)^xxx", r"(?i)^null$", r"(?i)^undefined$", r"(?i)^n/a$", r"^\s*$", r"^-+$", r"^\.+$")
#: Field, required, least and most signs.
LENGTHS = (("name", True, 2, 300), ("description", False, 0, 5000), ("category", False, 2, 100), ("sku", False, 1, 100), ("owner", False, 2, 200), ("vendor", False, 2, 200), ("type", True, 0, 10**9))
MOST = {"price": 1e8, "budget": 1e9, "quantity": 1e9}
SKU = r"^[A-Za-z0-9\-_./]+$"
#: The taxonomy of categories, and words of other fields.
CATEGORIES = ("infrastructure", "security", "data_analytics", "applications", "integration", "collaboration", "cloud_platform", "development", "networking", "database", "storage", "compute", "identity", "monitoring", "backup", "erp", "crm", "hr", "finance", "marketing", "sales", "operations", "it_service", "professional_service", "managed_service", "consulting", "support", "saas", "paas", "iaas", "hardware", "software", "other")
KNOWN_STATUSES = ("active", "inactive", "deprecated", "planned", "pilot", "production", "development", "testing", "retired", "pending", "approved", "rejected")
KNOWN_PRIORITIES = ("critical", "high", "medium", "low", "none")
VENDORS = {
    "ms": "Microsoft", "msft": "Microsoft", "microsoft corp": "Microsoft", "microsoft corporation": "Microsoft", "aws": "Amazon Web Services", "amazon": "Amazon Web Services", "gcp": "Google Cloud Platform",
    "google": "Google", "google cloud": "Google Cloud Platform", "ibm corp": "IBM", "ibm corporation": "IBM", "salesforce.com": "Salesforce", "sfdc": "Salesforce", "sap ag": "SAP", "sap se": "SAP",
    "oracle corp": "Oracle", "oracle corporation": "Oracle", "vmware inc": "VMware", "servicenow inc": "ServiceNow", "atlassian corp": "Atlassian", "cisco systems": "Cisco", "adobe inc": "Adobe", "adobe systems": "Adobe",
}
SHORT_VENDORS = ("3M", "HP", "GE", "AT", "BT")
SUSPICIOUS = {"test data": (r"(?i)^test|^demo|^sample|^example|^dummy|^fake|^temp|lorem ipsum", "warning"), "placeholder": (r"(?i)^xxx|^placeholder|^tbd|^n/a|^\?+$|^-+$", "warning")}
#: What an issue costs its field, and its item.
FIELD_COST = {"critical": 40, "warning": 20, "info": 5}
ITEM_COST = {"critical": 25, "warning": 10, "info": 2}


def names(of: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in of.items() for x in kv))


def issue(when: Column, field: str, kind: str, severity: str) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))


def kept(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def normalized(value: Column, allowed: Sequence[str]) -> Column:
    """The allowed word that a value stands for: by meaning, else itself, else the
    first that holds it or that it holds; null for none."""
    v, words = F.lower(F.trim(value)), F.array(*map(F.lit, allowed))
    said = F.try_element_at(names({k: m for k, m in MEANING.items() if m in allowed}), v)
    near = F.get(F.filter(words, lambda a: F.contains(a, v) | F.contains(v, a)), 0)
    return F.when(v == "", None).otherwise(F.coalesce(said, F.when(v.isin(*allowed), v), near))


def empty(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def rule_issues() -> Column:
    """The thirteen rules. A field that is empty and not required has no issue."""
    found = []
    for field, required, least, most in LENGTHS:
        c = F.col(field)
        if required:
            found.append(issue(empty(field), field, "required", "error"))
        if least > 0:
            found.append(issue(~empty(field) & (F.length(c) < least), field, "short", "warning"))
        found.append(issue(F.length(c) > most, field, "cut", "warning"))
    for field, most in MOST.items():
        v = currency(F.col(field))
        found += [issue(~empty(field) & (v < 0), field, "low", "warning"), issue(~empty(field) & (v > most), field, "high", "warning")]
    found.append(issue(~empty("sku") & ~F.col("sku").rlike(SKU), "sku", "pattern", "warning"))
    bad = F.lit(False)
    for p in NO_NAME:
        bad = bad | F.col("name").rlike(p)
    found.append(issue(~empty("name") & bad, "name", "invalid", "error"))
    found += [issue(~empty(f) & normalized(F.col(f), allowed).isNull(), f, "unknown", "warning") for f, allowed in ALLOWED.items()]
    return kept(*found)


def fixes() -> Column:
    """Values that the rules change: (field, value)."""
    fix = lambda field, new: F.when(~empty(field) & new.isNotNull() & (new != F.lower(F.col(field))), F.struct(F.lit(field).alias("field"), new.alias("value")))
    enums = [fix(f, normalized(F.col(f), allowed)) for f, allowed in ALLOWED.items()]
    return kept(*enums, *(fix(f, F.substring(f, 1, most)) for f, _, _, most in LENGTHS if most < 10**9 and f != "name"))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often it is used there."""
    return F.get(F.transform(F.array(value), then), 0)


def nearest_category(category: Column) -> tuple[Column, Column]:
    """Name and likeness (length against length) of the nearest category that
    holds this one or is held by it; the first of equals."""
    known = F.array(*(F.struct(F.lit(-i).alias("o"), F.lit(a).alias("a")) for i, a in enumerate(CATEGORIES)))

    def nearest(c: Column) -> Column:
        size = lambda a: F.least(F.length(a), F.length(c)) / F.greatest(F.length(a), F.length(c))
        option = lambda k: F.struct(F.when(F.contains(k["a"], c) | F.contains(c, k["a"]), size(k["a"])).otherwise(0.0).alias("s"), k["o"].alias("o"), k["a"].alias("a"))
        return F.array_max(F.transform(known, option))  # a category itself has 1

    best = once(F.trim(F.regexp_replace(F.lower(category), r"[\s-]", "_")), nearest)
    return best["a"], best["s"]


def guardian_issues() -> Column:
    """Completeness, formats, ranges, consistency, suspicious values, dictionaries."""
    c = F.col
    found = [issue(empty(f), f, "missing", "critical") for f in ("name", "type")]
    found += [issue(~empty(f) & F.try_to_date(f, "yyyy-MM-dd").isNull(), f, "format", "warning") for f in ("start_date", "end_date")]
    number = F.regexp_replace("budget", r"[€$£,\s]", "")
    found.append(issue(~empty("budget") & ~number.rlike(r"^-?[0-9.]*[0-9]"), "budget", "format", "warning"))
    kind = F.lower(F.trim("type"))
    guess = kind.rlike("product|software|hardware|service|consulting|managed")
    found.append(issue(~empty("type") & ~kind.isin(*TYPES) & ~guess, "type", "format", "warning"))
    value = currency(c("budget"))
    found += [issue(value < 0, "budget", "range", "critical"), issue(value > 1e9, "budget", "range", "warning"), issue(c("users") < 0, "users", "range", "critical"), issue(c("users") > 1e7, "users", "range", "warning")]
    start, end = (F.try_to_date(f, "yyyy-MM-dd") for f in ("start_date", "end_date"))
    found += [issue(end < start, "end_date", "inconsistent", "warning"), issue((c("lifecycle") == "end_of_life") & (c("status") == "active"), "status", "inconsistent", "warning"), issue((c("priority") == "critical") & (value < 1000), "budget", "inconsistent", "info")]
    for f in ("name", "description", "vendor"):
        found += [issue(c(f).rlike(p), f, k, s) for k, (p, s) in SUSPICIOUS.items()]
        found.append(issue(c(f).rlike(r"(.)\1{4,}"), f, "repetition", "info"))
    found.append(issue((F.length("vendor") <= 2) & ~F.upper("vendor").isin(*SHORT_VENDORS), "vendor", "short", "info"))
    _, near = nearest_category(c("category"))
    found.append(issue(~empty("category") & (near <= 0.5), "category", "unknown", "info"))
    found += [issue(~empty(f) & ~F.lower(F.trim(f)).isin(*known), f, "unknown", "info") for f, known in (("status", KNOWN_STATUSES), ("priority", KNOWN_PRIORITIES))]
    return kept(*found)


def guardian_corrections() -> Column:
    """(field, old, new, confidence); those of 0.85 or more are applied."""
    c = F.col
    fix = lambda when, field, new, sure: F.when(when, F.struct(F.lit(field).alias("field"), c(field).alias("old"), new.alias("new"), sure.alias("confidence")))
    number = F.regexp_extract(F.regexp_replace("budget", r"[€$£,\s]", ""), r"^(-?[0-9]+(?:\.[0-9]+)?)", 1)
    kind = F.lower(F.trim("type"))
    guess = F.when(kind.rlike("product|software|hardware"), "product").when(kind.rlike("service|consulting|managed"), "service")
    name, near = nearest_category(c("category"))
    vendor = F.try_element_at(names(VENDORS), F.lower(F.trim("vendor")))
    return kept(
        fix(~empty("budget") & (number != ""), "budget", number, F.lit(0.95)), fix(~empty("type") & ~kind.isin(*TYPES) & guess.isNotNull(), "type", guess, F.lit(0.8)), fix(vendor.isNotNull(), "vendor", vendor, F.lit(0.95)),
        fix(c("vendor") != F.trim("vendor"), "vendor", F.trim("vendor"), F.lit(1.0)), once(F.struct(name.alias("name"), near.alias("near")), lambda n: fix(~empty("category") & (n["near"] > 0.5) & (n["near"] < 1), "category", n["name"], n["near"])),
    )


def score(issues: Column, cost: Mapping[str, int], field: str | None = None) -> Column:
    """100 less what the issues (of a field) cost, 0 at least."""
    costs = names({k: str(v) for k, v in cost.items()})
    mine = issues if field is None else F.filter(issues, lambda i: i["field"] == field)
    return F.greatest(F.lit(0), 100 - F.aggregate(mine, F.lit(0), lambda s, i: s + F.coalesce(F.try_element_at(costs, i["severity"]).cast("int"), F.lit(0))))
