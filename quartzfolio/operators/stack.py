"""Technology stacks: tiers, capabilities, flags, redundancy, gaps, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfolio.functions.numbers import half_up
from quartzfolio.operators.portfolio import holds, low, sure

#: Words that tell the tier of an item; of equals the first tier holds.
TIERS = {
    "presentation": ("web", "mobile", "frontend", "ui", "ux", "portal", "app", "client", "angular", "react", "vue", "wordpress", "sharepoint", "intranet"),
    "business": ("erp", "crm", "hrm", "scm", "plm", "workflow", "bpm", "salesforce", "sap", "oracle ebs", "dynamics", "workday", "servicenow"),
    "integration": ("api", "middleware", "esb", "integration", "etl", "mq", "kafka", "mulesoft", "boomi", "talend", "informatica", "tibco", "webmethods"),
    "data": ("database", "data warehouse", "analytics", "bi", "reporting", "sql", "oracle db", "postgresql", "mysql", "mongodb", "snowflake", "databricks", "tableau", "power bi", "looker", "qlik", "elasticsearch"),
    "infrastructure": ("server", "vm", "container", "kubernetes", "docker", "cloud", "aws", "azure", "gcp", "vmware", "citrix", "storage", "compute", "network", "load balancer", "cdn", "dns"),
    "security": ("security", "firewall", "antivirus", "identity", "iam", "sso", "mfa", "encryption", "vault", "siem", "endpoint", "waf", "dlp", "pam"),
    "devops": ("devops", "ci/cd", "jenkins", "gitlab", "github", "azure devops", "terraform", "ansible", "puppet", "chef", "helm", "argocd"),
    "monitoring": ("monitoring", "observability", "apm", "logging", "alerting", "metrics", "prometheus", "grafana", "datadog", "splunk", "new relic", "dynatrace"),
}
#: Words that tell what an item can do.
CAPABILITIES = {
    "CRM": ("crm", "salesforce", "hubspot", "dynamics crm", "customer relationship"), "ERP": ("erp", "sap", "oracle ebs", "dynamics 365", "netsuite"),
    "Container Platform": ("kubernetes", "k8s", "openshift", "ecs", "aks", "gke"), "Database": ("database", "sql", "postgresql", "mysql", "oracle db", "sql server"),
    "BI & Analytics": ("tableau", "power bi", "looker", "qlik", "analytics"), "Identity & Access": ("okta", "azure ad", "auth0", "ping", "iam", "identity"),
    "SIEM": ("siem", "splunk", "sentinel", "qradar", "sumo logic"), "Backup & DR": ("backup", "veeam", "commvault", "rubrik", "disaster recovery"),
    "API Gateway": ("api gateway", "kong", "apigee", "aws api", "azure api"), "CI/CD": ("jenkins", "gitlab ci", "github actions", "azure pipelines", "ci/cd"),
    "Monitoring": ("prometheus", "grafana", "datadog", "new relic", "monitoring"), "Log Management": ("splunk", "elk", "elasticsearch", "logstash", "logging"),
}
MODERN = ("cloud", "saas", "kubernetes", "container", "serverless", "microservice", "api-first", "graphql", "react", "vue", "angular", "typescript", "go", "rust", "python 3", "node.js", "spring boot", "docker")
CLOUD = ("aws", "azure", "gcp", "cloud", "saas", "paas", "serverless", "kubernetes", "lambda", "functions", "managed", "elastic")
OPEN = ("rest", "graphql", "oauth", "oidc", "saml", "openid", "json", "yaml", "kubernetes", "docker", "terraform", "open source", "linux", "postgresql")
#: Legacy products and what replaces them.
LEGACY = {
    "windows server 2012": "Windows Server 2022", "sql server 2014": "SQL Server 2022 or Azure SQL", "oracle 11g": "Oracle 19c or PostgreSQL", "sharepoint 2013": "SharePoint Online", "exchange 2013": "Exchange Online",
    "centos": "Rocky Linux or RHEL", "java 8": "Java 17+ LTS", "dotnet framework": ".NET 8+", "angular.js": "Angular 17+ or React", "jquery": "Modern framework (React, Vue)", "svn": "Git", "jenkins": "GitHub Actions or GitLab CI",
}
#: What each tier should be able to do.
NEEDED = {"security": ("Identity & Access", "SIEM"), "infrastructure": ("Backup & DR", "Container Platform"), "integration": ("API Gateway",), "monitoring": ("Monitoring", "Log Management"), "devops": ("CI/CD",)}


def able(text: Column) -> Column:
    """What a text says an item can do, by a loop over the words; the text is made once."""
    known = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(c).alias("name")) for c, ws in CAPABILITIES.items() for w in ws))
    held = lambda t: F.transform(F.filter(known, lambda x: F.contains(t, x["word"])), lambda x: x["name"])
    return F.array_distinct(F.get(F.transform(F.array(text), held), 0))


def described(items: DataFrame) -> DataFrame:
    """Items with tier, capabilities, flags and the number of issues; in place."""
    text, tech, plain = (F.lower(F.concat_ws(" ", *cs)) for cs in (("name", "category", "description"), ("name", "description", "deployment"), ("name", "description")))
    count = lambda t, words: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0))
    best = F.array_max(F.array(*(F.struct(count(text, ws).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, ws) in enumerate(TIERS.items()))))
    hosted = sure(F.col("deployment").isin("saas", "cloud"))
    issues = count(F.lower("name"), LEGACY) + sum((sure(x).cast("int") for x in (F.col("lifecycle_stage").isin("end_of_life", "decline"), F.col("status") == "deprecated", F.col("deployment").isin("on_premise", "legacy"))), F.lit(0))
    return items.withColumns({
        "tier": F.when(best["n"] > 0, best["t"]).when(F.contains(low("category"), F.lit("application")), "business").otherwise("infrastructure"),
        "capabilities": able(text), "n_issues": issues,
        "modern": hosted | sure(F.col("lifecycle_stage").isin("growth", "introduction")) | (count(tech, MODERN) >= 2), "cloud_ready": hosted | holds(tech, CLOUD), "open_standards": holds(plain, OPEN),
    })


def layers(described: DataFrame) -> DataFrame:
    lost = 5 * F.count_if(~F.col("modern")) + 3 * F.count_if(~F.col("cloud_ready")) + 2 * F.count_if(~F.col("open_standards")) + 5 * F.sum("n_issues")
    return described.groupBy("tenant", "tier").agg(F.count("*").alias("n"), F.greatest(F.lit(0).cast("long"), 100 - lost).alias("health"))


def redundant(described: DataFrame) -> DataFrame:
    both, n = F.col("modern") & F.col("cloud_ready"), F.col("n")
    each = described.select("tenant", "id", "modern", "cloud_ready", F.explode_outer("capabilities").alias("capability"))  # explode would make the array twice more, to look for empty ones
    g = each.where("capability IS NOT NULL").groupBy("tenant", "capability")
    g = g.agg(F.count("*").alias("n"), F.coalesce(F.max(F.when(both, F.col("id"))), F.min(F.when(F.col("modern"), F.col("id"))), F.min("id")).alias("kept")).where("n > 1")
    return g.withColumn("effort", F.when(n > 3, "high").when(n > 2, "medium").otherwise("low"))


def modernized(items: DataFrame) -> DataFrame:
    found = reduce(lambda out, kv: F.when(F.contains(F.lower("name"), F.lit(kv[0])), F.struct(F.lit(kv[0]).alias("legacy"), F.lit(kv[1]).alias("target"))).otherwise(out), reversed(LEGACY.items()), F.lit(None))
    return items.select("id", found.alias("f")).where("f IS NOT NULL").select("id", "f.*")


def gaps(described: DataFrame) -> DataFrame:
    """Each tenant's set of capabilities against the fixed list: no join."""
    have = described.groupBy("tenant").agg(F.array_distinct(F.flatten(F.collect_set("capabilities"))).alias("have"))  # a fixed number of names
    needed = F.array(*(F.struct(F.lit(t).alias("tier"), F.lit(c).alias("capability")) for t, cs in NEEDED.items() for c in cs))
    return have.select("tenant", F.inline(F.filter(needed, lambda x: ~F.array_contains("have", x["capability"]))))


def scores(described: DataFrame) -> DataFrame:
    share = lambda c: half_up(100 * F.avg(c.cast("int").cast("double")))
    of = described.groupBy("tenant").agg(share(~F.col("modern")).alias("debt"), share(F.col("cloud_ready")).alias("cloud"), F.count("*").alias("n"))
    mean = layers(described).groupBy("tenant").agg(half_up(F.avg(F.col("health").cast("double"))).alias("health"))
    top = described.where("vendor IS NOT NULL").groupBy("tenant", "vendor").agg(F.count("*").alias("k")).groupBy("tenant").agg(F.max("k").alias("top"))
    lock = half_up(100 * F.coalesce("top", F.lit(0)).cast("double") / F.col("n"))
    return of.join(mean, "tenant").join(top, "tenant", "left").select("tenant", "health", "debt", "cloud", lock.alias("lock_in"))
