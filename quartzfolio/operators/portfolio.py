"""Health and risk of portfolios, one row a tenant.

Items have tenant, id, name, description, category, vendor, type, status,
priority, risk_level, lifecycle_stage, alignment, importance, budget,
user_count, deployment, version, license_type, updated, support_end,
integrations, rto and data_class. Everything is counted by tenant, by tenant and
vendor, and by tenant and category, with partial sums before each shuffle; what
is counted by smaller keys is joined back as one row a tenant.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfolio.functions.numbers import half_up
from quartzfolio.operators import containment
from quartzfolio.operators.tables import shuffled

#: Domains that a portfolio should cover, and those of category names.
DOMAINS = ("Infrastructure", "Security", "Data & Analytics", "Applications", "Integration", "Collaboration", "Cloud Platform", "Development", "Networking")
DOMAIN_OF = {
    "cloud_platform": "Cloud Platform", "cloud": "Cloud Platform", "security": "Security", "cybersecurity": "Security", "data_analytics": "Data & Analytics", "data": "Data & Analytics",
    "analytics": "Data & Analytics", "bi": "Data & Analytics", "infrastructure": "Infrastructure", "compute": "Infrastructure", "storage": "Infrastructure", "applications": "Applications",
    "erp": "Applications", "crm": "Applications", "integration": "Integration", "api": "Integration", "middleware": "Integration", "collaboration": "Collaboration",
    "communication": "Collaboration", "development": "Development", "devops": "Development", "networking": "Networking", "network": "Networking",
}
HEALTH_WEIGHTS = {"coverage": 0.20, "balance": 0.15, "risk": 0.30, "alignment": 0.25, "efficiency": 0.10}
RISK_WEIGHTS = {"vendor": 0.10, "end_of_life": 0.15, "security": 0.20, "debt": 0.10, "compliance": 0.15, "integration": 0.10, "license": 0.10, "continuity": 0.10}

#: Products and the day that their support ended.
ENDED = {
    "windows server 2012": "2023-10-10", "windows server 2016": "2027-01-12", "oracle 11g": "2020-12-31", "oracle 12c": "2022-03-01", "sql server 2014": "2024-07-09", "java 8": "2030-12-31",
    "java 11": "2026-09-30", "python 2": "2020-01-01", "python 3.7": "2023-06-27", "php 7.4": "2022-11-28", "php 8.0": "2023-11-26", "dotnet framework 4.5": "2022-04-26",
    "centos 7": "2024-06-30", "centos 8": "2021-12-31", "ubuntu 18.04": "2028-04-01", "rhel 7": "2024-06-30",
}
SECURITY_CATEGORIES = ("security", "cybersecurity", "identity", "access management", "encryption")
SECURITY_NEEDS = {
    "identity": ("identity", "iam", "sso", "oauth", "saml", "authentication"), "endpoint": ("endpoint", "edr", "antivirus", "anti-malware"),
    "network": ("firewall", "waf", "ids", "ips", "network security"), "data": ("dlp", "encryption", "data protection", "backup"), "watch": ("siem", "monitoring", "logging", "threat detection"),
}
#: Words that make a framework apply, and whether it asks for encryption and audits.
FRAMEWORKS = {
    "GDPR": (("personal", "pii", "customer", "user", "employee"), True, True), "HIPAA": (("health", "medical", "patient", "phi", "healthcare"), True, True),
    "SOC2": (("customer", "financial", "business"), False, False), "PCI-DSS": (("payment", "card", "credit", "transaction", "cardholder"), True, False),
    "SOX": (("financial", "accounting", "audit", "reporting"), False, True),
}
AUDITED_VENDORS = ("oracle", "sap", "ibm", "microsoft enterprise", "adobe enterprise", "vmware", "citrix", "red hat", "autodesk")


def low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def holds(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def some(c: Column) -> Column:
    return F.bool_or(sure(c))


def less(when: Column, by: int) -> Column:
    return F.when(when, -by).otherwise(0)


def clamp100(c: Column) -> Column:
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c.cast("double"))))


def status(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "warning").otherwise("critical")


def level(score: Column) -> Column:
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").otherwise("low")


def domain(category: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in DOMAIN_OF.items() for x in kv))
    return F.coalesce(F.try_element_at(names, F.regexp_replace(F.lower(F.coalesce(category, F.lit(""))), "[^a-z]", "_")), F.lit("Applications"))


def critical_item() -> Column:
    return sure(F.col("priority") == "critical") | sure(F.col("importance") == "core")


def health(items: DataFrame) -> DataFrame:
    """coverage, balance, risk, alignment and efficiency of each tenant, 0 to
    100, their weighed mean and its status."""
    items = shuffled(items)
    a, b = F.col("alignment"), F.coalesce("budget", F.lit(0.0))
    core = sure(F.col("importance") == "core") | sure(a >= 7)
    part = lambda c: F.avg(c.cast("int").cast("double"))
    of = items.groupBy("tenant").agg(
        F.count("*").alias("n"), part(F.col("type") == "product").alias("products"), part(core).alias("core"), F.sum(b).alias("budget"), F.sum(F.when(core, b).otherwise(0.0)).alias("core_budget"),
        F.sum(F.when(sure(a >= 7), b).otherwise(0.0)).alias("high_budget"), F.coalesce(F.avg(a.cast("double")), F.lit(5.0)).alias("mean"), part(sure(a >= 7)).alias("high"),
        F.count_if((F.coalesce(a, F.lit(5)) < 4) & F.col("importance").isNull()).alias("orphans"),
        F.count_if(F.col("lifecycle_stage").isin("end_of_life", "deprecated") | (F.col("status") == "deprecated")).alias("ended"), F.count_if(F.col("risk_level").isin("high", "critical")).alias("risky"),
        F.count_if(F.contains(low("category"), F.lit("security"))).alias("secure"), F.count_if(F.col("status").isin("underutilized", "inactive", "paused")).alias("unused"),
    )
    vendors = items.groupBy("tenant", F.coalesce("vendor", F.lit("Unknown")).alias("v")).agg(F.count("*").alias("k")).groupBy("tenant").agg(F.max("k").alias("top"))
    important = critical_item() | sure(a >= 9)
    kinds = items.groupBy("tenant", "category").agg(F.count("*").alias("k"), some(important).alias("important")).groupBy("tenant")
    kinds = kinds.agg(F.count_if(F.col("k") >= 4).alias("crowded"), F.count_if((F.col("k") == 1) & F.col("important")).alias("single"))
    covered = items.groupBy("tenant", domain(F.col("category")).alias("d")).agg(F.count("*").alias("k")).groupBy("tenant")
    covered = covered.agg(F.count("*").alias("domains"), F.count_if(F.col("k") >= 3).alias("strong"), some(F.col("d") == "Security").alias("has_security"), some(F.col("d") == "Infrastructure").alias("has_base"))
    shared = containment.overlaps(items).groupBy("tenant").agg(F.floor(F.sum(F.col("n") * F.col("n_links")) / 2).cast("long").alias("overlaps"))
    t = of.join(vendors, "tenant").join(kinds, "tenant").join(covered, "tenant").join(shared, "tenant", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))
    c = F.col
    share = c("top") / c("n")
    ratio = lambda x: F.when(c("budget") > 0, c(x) / c("budget")).otherwise(0.5)
    parts = {
        "coverage": c("domains") / len(DOMAINS) * 100 + less(~c("has_security"), 15) + less(~c("has_base"), 10) + 2 * c("strong"),
        "balance": 70 + F.when(c("products") < 0.4, -10).when(c("products") > 0.85, -5).otherwise(0) + F.when(c("core") < 0.4, -15).when(c("core") > 0.8, -5).otherwise(0) + less((ratio("core_budget") < 0.5) & (c("budget") > 0), 10),
        "risk": 100 + F.when(share > 0.4, -20).when(share > 0.3, -10).otherwise(0) - 5 * c("ended") - 3 * c("risky") + F.when(c("secure") == 0, -25).when(c("secure") < 3, -10).otherwise(0) - 5 * c("single"),
        "alignment": c("mean") / 10 * 50 + c("high") * 30 + ratio("high_budget") * 20 + less(c("orphans") > c("n") * 0.2, 15),
        "efficiency": 80 - 5 * c("overlaps") - 3 * c("crowded") - 4 * c("unused"),
    }
    t = t.select("tenant", "n", *(clamp100(e).alias(k) for k, e in parts.items()))
    overall = sum((c(k) * w for k, w in HEALTH_WEIGHTS.items()), F.lit(0.0))
    return t.withColumn("health", half_up(overall)).withColumn("status", status(F.col("health")))


def cost_outliers(items: DataFrame, times: float = 3.0) -> DataFrame:
    """Items whose budget is over ``times`` the mean of their tenant's positive ones."""
    mean = items.where("budget > 0").groupBy("tenant").agg(F.avg(F.col("budget").cast("decimal(18,2)")).cast("double").alias("mean"))  # a row a tenant
    return items.where("budget > 0").join(mean, "tenant").where(F.col("budget") > times * F.col("mean")).select("tenant", "id", "budget", "mean")


def months(later: Column, earlier: Column) -> Column:
    """Of thirty days each."""
    return F.datediff(later, earlier) / 30.0


def ended_points(name: Column, as_of: str) -> Column:
    """10 for the first known product that the name holds, if its support has ended."""
    out = F.lit(0)
    for product, day in reversed(ENDED.items()):
        out = F.when(F.contains(name, F.lit(product)), 10 if day < as_of else 0).otherwise(out)
    return out


def risk(items: DataFrame, as_of: str) -> DataFrame:
    """The eight risks of each tenant, 0 to 100, their weighed sum and its level.
    ``as_of`` is the day of the assessment."""
    items = shuffled(items)
    c, day = F.col, F.lit(as_of).cast("date")
    name, text = low("name"), F.concat_ws(" ", low("data_class"), low("description"), low("name"))
    own = F.concat_ws(" ", low("name"), low("description"))
    important, users, budget = critical_item(), c("user_count"), c("budget")
    cloud = c("deployment").isin("cloud", "saas")
    left, age = months(c("support_end"), day), months(day, c("updated"))
    points = lambda e: F.sum(F.coalesce(e, F.lit(0)))
    supported = F.when(left < 0, 12).when(left < 6, 8).when(left < 12, 4).otherwise(0)
    ending = F.when(sure(c("lifecycle_stage") == "end_of_life") | sure(c("status") == "deprecated"), 15).otherwise(F.coalesce(supported, F.lit(0)) + ended_points(name, as_of))
    of = items.groupBy("tenant").agg(
        F.count("*").alias("n"), F.count_if(important).alias("n_critical"), F.countDistinct(F.when(important, F.coalesce(F.lower("vendor"), F.lit("?")))).alias("critical_vendors"),
        points(ending).alias("end_of_life"), F.count_if(holds(low("category"), SECURITY_CATEGORIES)).alias("secure"), *(some(holds(own, ws)).alias(f"has_{k}") for k, ws in SECURITY_NEEDS.items()),
        points(F.when(c("version").rlike("^[01]\\."), 5)).alias("old"), points(F.when(age > 24, 8).when(age > 12, 4)).alias("stale"),
        F.avg((cloud | sure(c("lifecycle_stage").isin("growth", "maturity"))).cast("int").cast("double")).alias("modern"),
        *(some(holds(text, ws)).alias(f"in_{k}") for k, (ws, _, _) in FRAMEWORKS.items()), some(F.contains(name, F.lit("encrypt")) | F.contains(low("description"), F.lit("encryption"))).alias("encrypts"),
        some(holds(name, ("audit", "siem")) | F.contains(low("description"), F.lit("audit log"))).alias("audits"),
        points(F.when(c("integrations") > 5, 8).when(c("integrations") > 3, 3)).alias("links"), F.count_if(c("integrations") > 0).alias("linked"), points(F.when(important & (c("integrations") == 1), 5)).alias("lone_links"),
        some(F.contains(low("category"), F.lit("integration")) | holds(name, ("middleware", "mulesoft", "boomi", "zapier"))).alias("middleware"),
        points(F.when(holds(F.concat_ws(" ", low("vendor"), name), AUDITED_VENDORS), 5)).alias("audited"), points(F.when(holds(low("license_type"), ("enterprise", "unlimited")), 3)).alias("enterprise"),
        points(F.when((users > 100) & (budget > 0) & (budget / users < 10), 8)).alias("thin"), some(F.contains(name, F.lit("license")) | F.contains(low("description"), F.lit("software asset"))).alias("managed"),
        some(F.contains(name, F.lit("backup")) | F.contains(low("category"), F.lit("backup")) | F.contains(low("description"), F.lit("disaster recovery"))).alias("backed"), some(important & c("rto").isNull()).alias("no_rto"),
    )
    vendors = items.groupBy("tenant", F.lower(F.coalesce("vendor", F.lit("Unknown"))).alias("v")).agg(F.count("*").alias("k")).groupBy("tenant").agg(F.max("k").alias("top"))
    local = sure(c("deployment").isin("on_premise", "legacy"))
    by_kind = items.groupBy("tenant", "category").agg(F.count("*").alias("k"), F.countDistinct(F.lower("vendor")).alias("v"), F.count_if(important).alias("crit"), F.count_if(local).alias("local"), some(cloud).alias("cloud"))
    kinds = by_kind.groupBy("tenant").agg(
        F.count_if((c("v") == 1) & (c("k") > 2) & c("category").isNotNull()).alias("one_vendor"), F.count_if(c("crit") == 1).alias("one_critical"),
        F.sum(F.when(c("cloud"), 0).otherwise(c("local"))).alias("grounded"),
    )
    t = of.join(vendors, "tenant").join(kinds, "tenant")
    share = c("top") / c("n")
    asked = lambda i: sum((F.when(c(f"in_{k}"), 1).otherwise(0) for k, f in FRAMEWORKS.items() if f[i]), F.lit(0))
    parts = {
        "vendor": F.when(share > 0.5, 40).when(share > 0.35, 25).otherwise(0) + 10 * c("one_vendor") + F.when((c("critical_vendors") == 1) & (c("n_critical") > 3), 15).otherwise(0), "end_of_life": c("end_of_life"),
        "security": F.when(c("secure") == 0, 35).when(c("secure") < 3, 20).otherwise(0) + sum((F.when(c(f"has_{k}"), 0).otherwise(8) for k in SECURITY_NEEDS), F.lit(0)),
        "debt": c("old") + c("stale") + 3 * c("grounded") + F.when(c("modern") < 0.4, 15).otherwise(0), "compliance": F.when(c("encrypts"), 0).otherwise(12 * asked(1)) + F.when(c("audits"), 0).otherwise(10 * asked(2)),
        "integration": c("links") + F.when(~c("middleware") & (c("linked") > 5), 15).otherwise(0) + c("lone_links"),
        "license": c("audited") + c("enterprise") + c("thin") + F.when(~c("managed") & (c("n") > 20), 10).otherwise(0), "continuity": F.when(c("backed"), 0).otherwise(20) + F.when(c("no_rto"), 10).otherwise(0) + 5 * c("one_critical"),
    }
    t = t.select("tenant", *(clamp100(e).alias(k) for k, e in parts.items()))
    overall = sum((c(k) * w for k, w in RISK_WEIGHTS.items()), F.lit(0.0))
    return t.withColumn("overall", half_up(overall)).withColumn("level", level(F.col("overall")))
