"""Health, risk and technology of tenants' portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzfolio.operators import containment
from quartzfolio.operators import portfolio as pf
from quartzfolio.operators import stack
from quartzfolio.operators.tables import spread
from quartzfolio.plans.common import Registry, r, rounded, table

R = Registry()
AS_OF = "2026-01-01"


def case(on: str, of: dict, default: str) -> str:
    return f"CASE {on} " + " ".join(f"WHEN {k} THEN {v}" for k, v in of.items()) + f" ELSE {default} END"


NAMES = dict(enumerate((
    "'Backup Vault'", "'Audit Trail Hub'", "'Oracle 11g Suite'", "'Windows Server 2012 Farm'", "'MuleSoft API Gateway'", "'License Manager'", "'Identity SSO Portal'", "'Firewall Edge'",
    "'Python 2 Tools'", "'SAP ERP Core'", "'Salesforce CRM Cloud'", "'Kubernetes Platform'", "'Power BI Reports'", "'Jenkins CI/CD'", "'Datadog Monitoring'",
)))
DESCRIPTIONS = dict(enumerate((
    "'data encryption at rest'", "'keeps an audit log of patient records'", "'customer payment card data'", "'financial reporting and accounting'", "'employee personal data on the web'",
    "'disaster recovery in the cloud with docker and kubernetes'", "'database analytics sql'", "'rest api middleware'", "NULL", "'siem and logging'",
)))
CATEGORIES = dict(enumerate(("'Security'", "'Infrastructure'", "'Data Analytics'", "'Applications'", "'Integration'", "'Collaboration'", "'Cloud'", "'Development'", "'Networking'", "NULL")))
#: Items of tenants with twenty each, from parts: expressions that both engines read alike.
ITEM = {
    "tenant": "CAST(floor(p_partkey / 20) AS BIGINT)", "id": "p_partkey", "name": case("p_partkey % 43", NAMES, "p_name"), "description": case("p_partkey % 37", DESCRIPTIONS, "'plain ' || p_name"),
    "category": case("p_partkey % 11", CATEGORIES, "p_type"), "vendor": "CASE WHEN floor(p_partkey / 20) % 3 = 0 AND p_partkey % 2 = 0 THEN 'Microsoft' WHEN p_partkey % 17 = 0 THEN 'Oracle' WHEN p_partkey % 17 = 1 THEN 'IBM' WHEN p_partkey % 17 = 2 THEN 'SAP SE' WHEN p_partkey % 17 = 3 THEN NULL ELSE p_brand END",
    "type": "CASE WHEN p_partkey % 3 = 0 THEN 'service' ELSE 'product' END", "budget": "CAST(CASE WHEN p_partkey % 9 = 0 THEN 0 WHEN p_partkey % 41 = 0 THEN 900000 ELSE 500 + p_partkey * 7919 % 60000 END AS DOUBLE)",
    "user_count": "p_partkey * 37 % 5000", "lifecycle_stage": case("p_partkey % 53", {0: "'end_of_life'", 1: "'deprecated'", 2: "'decline'", 3: "'growth'", 4: "'introduction'", 5: "'maturity'"}, "'mature'"),
    "status": case("p_partkey % 61", {0: "'deprecated'", 1: "'inactive'", 2: "'paused'", 3: "'underutilized'"}, "'active'"), "priority": case("p_partkey % 12", {0: "'critical'", 1: "'high'", 2: "'medium'"}, "'low'"),
    "risk_level": case("p_partkey % 34", {0: "'critical'", 1: "'high'", 2: "'medium'"}, "'low'"), "alignment": "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 1 + (p_partkey * 31 + floor(p_partkey / 20) % 5) % 10 END",
    "importance": case("p_partkey % 15", {0: "'core'", 1: "'support'"}, "NULL"), "deployment": case("p_partkey % 7", {0: "'on_premise'", 1: "'saas'", 2: "'cloud'", 3: "'legacy'"}, "'hybrid'"),
    "version": "CAST(p_partkey % 6 AS STRING) || '.' || CAST(p_partkey % 4 AS STRING)", "license_type": case("p_partkey % 25", {0: "'Enterprise'", 1: "'unlimited'"}, "'named'"),
    "updated": f"DATE '{AS_OF}' - CAST(p_partkey * 13 % 420 AS INT)", "support_end": f"CASE WHEN p_partkey % 5 > 0 THEN DATE '{AS_OF}' + CAST(p_partkey * 29 % 1500 - 100 AS INT) END",
    "integrations": "p_partkey % 7", "rto": "CASE WHEN p_partkey % 4 = 0 THEN 4 END", "data_class": case("p_partkey % 71", {0: "'PII'", 1: "'PHI'", 2: "'cardholder'"}, "NULL"),
}
ITEMS_SQL = "items AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in ITEM.items()) + " FROM part)"


def items(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return (spread(rows) if dealt else rows).selectExpr(*(f"{e} AS {n}" for n, e in ITEM.items()))


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def clamp(e: str) -> str:
    return f"floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, ({e})::DOUBLE)) + 0.5)"


LOW = {c: f"lower(coalesce({c}, ''))" for c in ("name", "description", "category", "vendor", "license_type", "data_class")}
CRITICAL = "(coalesce(priority = 'critical', false) OR coalesce(importance = 'core', false))"
DOMAIN_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in pf.DOMAIN_OF.items())
#: Names of a tenant, each with each other one.
HOLDS_SQL = "(contains({0}, {1}) OR len(list_filter(string_split({1}, ' '), lambda w: length(w) > 3 AND contains({0}, w))) > 0)"
OVERLAP_SQL = f"""names AS (SELECT tenant, lower(coalesce(name, '')) AS name, count(*) AS n FROM items GROUP BY 1, 2),
overlap AS (SELECT a.tenant, a.name, a.n, CAST(a.n - 1 + coalesce(sum(b.n), 0) AS BIGINT) AS n_links FROM names a LEFT JOIN names b ON a.tenant IS NOT DISTINCT FROM b.tenant AND a.name <> b.name AND ({HOLDS_SQL.format('a.name', 'b.name')} OR {HOLDS_SQL.format('b.name', 'a.name')}) GROUP BY a.tenant, a.name, a.n)"""
HEALTH_SQL = f"""{ITEMS_SQL}, dom(k, d) AS (VALUES {DOMAIN_ROWS}),
i AS (SELECT *, coalesce(importance = 'core', false) OR coalesce(alignment >= 7, false) AS is_core, {CRITICAL} OR coalesce(alignment >= 9, false) AS important FROM items),
o AS (SELECT tenant, count(*) AS n, avg((type = 'product')::INT::DOUBLE) AS products, avg(is_core::INT::DOUBLE) AS core, sum(coalesce(budget, 0)) AS budget, coalesce(sum(budget) FILTER (is_core), 0) AS core_budget, coalesce(sum(budget) FILTER (alignment >= 7), 0) AS high_budget,
  coalesce(avg(alignment::DOUBLE), 5) AS mean, avg(coalesce(alignment >= 7, false)::INT::DOUBLE) AS high, count(*) FILTER (coalesce(alignment, 5) < 4 AND importance IS NULL) AS orphans,
  count(*) FILTER (lifecycle_stage IN ('end_of_life', 'deprecated') OR status = 'deprecated') AS ended, count(*) FILTER (risk_level IN ('high', 'critical')) AS risky, count(*) FILTER (contains(lower(category), 'security')) AS secure,
  count(*) FILTER (status IN ('underutilized', 'inactive', 'paused')) AS unused FROM i GROUP BY tenant),
v AS (SELECT tenant, max(k) AS top FROM (SELECT tenant, coalesce(vendor, 'Unknown') AS v, count(*) AS k FROM i GROUP BY ALL) GROUP BY tenant),
k AS (SELECT tenant, count(*) FILTER (k >= 4) AS crowded, count(*) FILTER (k = 1 AND important) AS single FROM (SELECT tenant, category, count(*) AS k, bool_or(important) AS important FROM i GROUP BY ALL) GROUP BY tenant),
g AS (SELECT tenant, count(*) AS domains, count(*) FILTER (k >= 3) AS strong, bool_or(d = 'Security') AS has_security, bool_or(d = 'Infrastructure') AS has_base FROM (SELECT tenant, coalesce(dom.d, 'Applications') AS d, count(*) AS k FROM i LEFT JOIN dom ON dom.k = regexp_replace(lower(coalesce(category, '')), '[^a-z]', '_', 'g') GROUP BY ALL) GROUP BY tenant),
{OVERLAP_SQL}, w AS (SELECT tenant, CAST(sum(n * n_links) // 2 AS BIGINT) AS shared_pairs FROM overlap GROUP BY tenant),
t AS (SELECT * FROM o JOIN v USING (tenant) JOIN k USING (tenant) JOIN g USING (tenant) LEFT JOIN w USING (tenant)),
h AS (SELECT tenant, n,
  {clamp("domains::DOUBLE / 9 * 100 - CASE WHEN has_security THEN 0 ELSE 15 END - CASE WHEN has_base THEN 0 ELSE 10 END + 2 * strong")} AS coverage,
  {clamp("70 - CASE WHEN products < 0.4 THEN 10 WHEN products > 0.85 THEN 5 ELSE 0 END - CASE WHEN core < 0.4 THEN 15 WHEN core > 0.8 THEN 5 ELSE 0 END - CASE WHEN budget > 0 AND core_budget / budget < 0.5 THEN 10 ELSE 0 END")} AS balance,
  {clamp("100 - CASE WHEN top::DOUBLE / n > 0.4 THEN 20 WHEN top::DOUBLE / n > 0.3 THEN 10 ELSE 0 END - 5 * ended - 3 * risky - CASE WHEN secure = 0 THEN 25 WHEN secure < 3 THEN 10 ELSE 0 END - 5 * single")} AS risk,
  {clamp("mean / 10 * 50 + high * 30 + CASE WHEN budget > 0 THEN high_budget / budget ELSE 0.5 END * 20 - CASE WHEN orphans > n * 0.2 THEN 15 ELSE 0 END")} AS alignment,
  {clamp("80 - 5 * coalesce(shared_pairs, 0) - 3 * crowded - 4 * unused")} AS efficiency FROM t),
health AS (SELECT *, floor({" + ".join(f"{w}::DOUBLE * {k}" for k, w in pf.HEALTH_WEIGHTS.items())} + 0.5) AS health FROM h)"""
STATUS_SQL = "CASE WHEN {0} >= 80 THEN 'excellent' WHEN {0} >= 60 THEN 'good' WHEN {0} >= 40 THEN 'warning' ELSE 'critical' END"


def dimension(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pf.health(items(spark, sf_dir)).select("tenant", F.col(name).alias("score"), pf.status(F.col(name)).alias("status"))

    return query


for _name in pf.HEALTH_WEIGHTS:
    R.add(f"health_{_name}", f"WITH {HEALTH_SQL} SELECT tenant, {_name} AS score, {STATUS_SQL.format(_name)} AS status FROM health")(dimension(_name))


@R.add("name_overlaps", f"WITH {ITEMS_SQL}, {OVERLAP_SQL} SELECT * FROM overlap")
def name_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each tenant with the number of other items that theirs overlap."""
    return containment.overlaps(items(spark, sf_dir))


@R.add("cost_outliers", f"WITH {ITEMS_SQL}, m AS (SELECT tenant, avg(CAST(budget AS DECIMAL(18,2)))::DOUBLE AS mean FROM items WHERE budget > 0 GROUP BY tenant) SELECT tenant, id, budget, {r('mean', 2)} AS mean FROM items JOIN m USING (tenant) WHERE budget > 3 * mean")
def cost_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that cost over three times the mean of their tenant."""
    return pf.cost_outliers(items(spark, sf_dir)).withColumn("mean", rounded(F.col("mean"), 2))


@R.add("portfolio_health", f"WITH {HEALTH_SQL} SELECT *, {STATUS_SQL.format('health')} AS status FROM health")
def portfolio_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five scores of each tenant's portfolio, and their weighed mean."""
    return pf.health(items(spark, sf_dir))


NEED_SQL = ", ".join(f"bool_or({any_of('own', ws)}) AS has_{k}" for k, ws in pf.SECURITY_NEEDS.items())
FRAME_SQL = ", ".join(f"bool_or({any_of('txt', ws)}) AS \"in_{k}\"" for k, (ws, _, _) in pf.FRAMEWORKS.items())
ENDED_SQL = "CASE " + " ".join(f"WHEN contains(nm, '{p}') THEN {10 if d < AS_OF else 0}" for p, d in pf.ENDED.items()) + " ELSE 0 END"
ASKED = {i: " + ".join(f'"in_{k}"::INT' for k, f in pf.FRAMEWORKS.items() if f[i]) for i in (1, 2)}
RISK_SQL = f"""{ITEMS_SQL}, i AS (SELECT *, {LOW['name']} AS nm, {LOW['name']} || ' ' || {LOW['description']} AS own, {LOW['data_class']} || ' ' || {LOW['description']} || ' ' || {LOW['name']} AS txt, {CRITICAL} AS important,
  (support_end - DATE '{AS_OF}') / 30.0::DOUBLE AS left_, (DATE '{AS_OF}' - updated) / 30.0::DOUBLE AS age FROM items),
o AS (SELECT tenant, count(*) AS n, count(*) FILTER (important) AS n_critical, count(DISTINCT coalesce(lower(vendor), '?')) FILTER (important) AS critical_vendors,
  sum(CASE WHEN lifecycle_stage = 'end_of_life' OR status = 'deprecated' THEN 15 ELSE CASE WHEN left_ < 0 THEN 12 WHEN left_ < 6 THEN 8 WHEN left_ < 12 THEN 4 ELSE 0 END + {ENDED_SQL} END) AS end_of_life,
  count(*) FILTER ({any_of('lower(category)', pf.SECURITY_CATEGORIES)}) AS secure, {NEED_SQL}, sum(CASE WHEN regexp_matches(version, '^[01]\\.') THEN 5 ELSE 0 END) AS old, sum(CASE WHEN age > 24 THEN 8 WHEN age > 12 THEN 4 ELSE 0 END) AS stale,
  avg((deployment IN ('cloud', 'saas') OR lifecycle_stage IN ('growth', 'maturity'))::INT::DOUBLE) AS modern, {FRAME_SQL}, bool_or(contains(nm, 'encrypt') OR contains({LOW['description']}, 'encryption')) AS encrypts,
  bool_or(contains(nm, 'audit') OR contains(nm, 'siem') OR contains({LOW['description']}, 'audit log')) AS audits, sum(CASE WHEN integrations > 5 THEN 8 WHEN integrations > 3 THEN 3 ELSE 0 END) AS links, count(*) FILTER (integrations > 0) AS linked,
  sum(CASE WHEN important AND integrations = 1 THEN 5 ELSE 0 END) AS lone_links, bool_or(contains({LOW['category']}, 'integration') OR {any_of('nm', ('middleware', 'mulesoft', 'boomi', 'zapier'))}) AS middleware,
  sum(CASE WHEN {any_of(LOW['vendor'] + " || ' ' || nm", pf.AUDITED_VENDORS)} THEN 5 ELSE 0 END) AS audited, sum(CASE WHEN {any_of(LOW['license_type'], ('enterprise', 'unlimited'))} THEN 3 ELSE 0 END) AS enterprise,
  sum(CASE WHEN user_count > 100 AND budget > 0 AND budget / user_count < 10 THEN 8 ELSE 0 END) AS thin, bool_or(contains(nm, 'license') OR contains({LOW['description']}, 'software asset')) AS managed,
  bool_or(contains(nm, 'backup') OR contains({LOW['category']}, 'backup') OR contains({LOW['description']}, 'disaster recovery')) AS backed, bool_or(important AND rto IS NULL) AS no_rto FROM i GROUP BY tenant),
v AS (SELECT tenant, max(k) AS top FROM (SELECT tenant, lower(coalesce(vendor, 'Unknown')) AS v, count(*) AS k FROM i GROUP BY ALL) GROUP BY tenant),
k AS (SELECT tenant, count(*) FILTER (v = 1 AND k > 2 AND category IS NOT NULL) AS one_vendor, count(*) FILTER (crit = 1) AS one_critical, sum(CASE WHEN cloud THEN 0 ELSE local END) AS grounded FROM
  (SELECT tenant, category, count(*) AS k, count(DISTINCT lower(vendor)) AS v, count(*) FILTER (important) AS crit, count(*) FILTER (deployment IN ('on_premise', 'legacy')) AS local, bool_or(deployment IN ('cloud', 'saas')) AS cloud FROM i GROUP BY ALL) GROUP BY tenant),
t AS (SELECT * FROM o JOIN v USING (tenant) JOIN k USING (tenant)),
x AS (SELECT tenant,
  {clamp("CASE WHEN top::DOUBLE / n > 0.5 THEN 40 WHEN top::DOUBLE / n > 0.35 THEN 25 ELSE 0 END + 10 * one_vendor + CASE WHEN critical_vendors = 1 AND n_critical > 3 THEN 15 ELSE 0 END")} AS vendor, {clamp("end_of_life")} AS end_of_life,
  {clamp("CASE WHEN secure = 0 THEN 35 WHEN secure < 3 THEN 20 ELSE 0 END + " + " + ".join(f"CASE WHEN has_{k} THEN 0 ELSE 8 END" for k in pf.SECURITY_NEEDS))} AS security,
  {clamp("old + stale + 3 * grounded + CASE WHEN modern < 0.4 THEN 15 ELSE 0 END")} AS debt, {clamp(f"CASE WHEN encrypts THEN 0 ELSE 12 * ({ASKED[1]}) END + CASE WHEN audits THEN 0 ELSE 10 * ({ASKED[2]}) END")} AS compliance,
  {clamp("links + CASE WHEN NOT middleware AND linked > 5 THEN 15 ELSE 0 END + lone_links")} AS integration, {clamp("audited + enterprise + thin + CASE WHEN NOT managed AND n > 20 THEN 10 ELSE 0 END")} AS license,
  {clamp("CASE WHEN backed THEN 0 ELSE 20 END + CASE WHEN no_rto THEN 10 ELSE 0 END + 5 * one_critical")} AS continuity FROM t),
risks AS (SELECT *, floor({" + ".join(f"{w}::DOUBLE * {k}" for k, w in pf.RISK_WEIGHTS.items())} + 0.5) AS overall FROM x)"""
LEVEL_SQL = "CASE WHEN {0} >= 75 THEN 'critical' WHEN {0} >= 50 THEN 'high' WHEN {0} >= 25 THEN 'medium' ELSE 'low' END"


def one_risk(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pf.risk(items(spark, sf_dir), AS_OF).select("tenant", F.col(name).alias("score"), pf.level(F.col(name)).alias("level"))

    return query


for _name in pf.RISK_WEIGHTS:
    R.add(f"risk_{_name}", f"WITH {RISK_SQL} SELECT tenant, {_name} AS score, {LEVEL_SQL.format(_name)} AS level FROM risks")(one_risk(_name))


@R.add("risk_overall", f"WITH {RISK_SQL} SELECT *, {LEVEL_SQL.format('overall')} AS level FROM risks")
def risk_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight risks of each tenant's portfolio, and their weighed sum."""
    return pf.risk(items(spark, sf_dir), AS_OF)


@R.add("top_risks", f"WITH {RISK_SQL}, d(no, name) AS (VALUES {', '.join(f'({i}, {chr(39)}{k}{chr(39)})' for i, k in enumerate(pf.RISK_WEIGHTS))}), u AS (UNPIVOT (SELECT * EXCLUDE (overall) FROM risks) ON COLUMNS(* EXCLUDE (tenant)) INTO NAME name VALUE score) SELECT tenant, name AS risk, score, row_number() OVER (PARTITION BY tenant ORDER BY no) AS place FROM u JOIN d USING (name) WHERE score >= 50 QUALIFY place <= 10")
def top_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High and critical risks of each tenant in the order of dimensions; in place."""
    risks = F.filter(F.array(*(F.struct(F.lit(k).alias("risk"), F.col(k).alias("score")) for k in pf.RISK_WEIGHTS)), lambda x: x["score"] >= 50)
    rows = pf.risk(items(spark, sf_dir), AS_OF).select("tenant", F.posexplode(F.slice(risks, 1, 10)).alias("i", "x"))
    return rows.select("tenant", "x.*", (F.col("i") + 1).cast("long").alias("place"))


TIER_ROWS = ", ".join(f"({i}, '{t}', '{w}')" for i, (t, ws) in enumerate(stack.TIERS.items()) for w in ws)
CAP_ROWS = ", ".join(f"('{c}', '{w}')" for c, ws in stack.CAPABILITIES.items() for w in ws)
STACK_SQL = f"""{ITEMS_SQL}, tiers(no, tier, word) AS (VALUES {TIER_ROWS}), caps(capability, word) AS (VALUES {CAP_ROWS}),
b AS (SELECT *, lower(concat_ws(' ', name, category, description)) AS txt, lower(concat_ws(' ', name, description, deployment)) AS tech, lower(concat_ws(' ', name, description)) AS plain FROM items),
h AS (SELECT id, no, tier, count(*) AS hits FROM b JOIN tiers ON contains(txt, word) GROUP BY id, no, tier QUALIFY row_number() OVER (PARTITION BY id ORDER BY hits DESC, no) = 1),
s AS (SELECT b.*, coalesce(tier, CASE WHEN contains(lower(coalesce(category, '')), 'application') THEN 'business' ELSE 'infrastructure' END) AS tier,
  deployment IN ('saas', 'cloud') OR coalesce(lifecycle_stage IN ('growth', 'introduction'), false) OR ({' + '.join(f"contains(tech, '{w}')::INT" for w in stack.MODERN)}) >= 2 AS modern,
  deployment IN ('saas', 'cloud') OR {any_of('tech', stack.CLOUD)} AS cloud_ready, {any_of('plain', stack.OPEN)} AS open_standards,
  {' + '.join(f"contains(lower(name), '{w}')::INT" for w in stack.LEGACY)} + (lifecycle_stage IN ('end_of_life', 'decline'))::INT + (status = 'deprecated')::INT + (deployment IN ('on_premise', 'legacy'))::INT AS n_issues FROM b LEFT JOIN h USING (id)),
layers AS (SELECT tenant, tier, count(*) AS n, CAST(greatest(0, greatest(0, 100 - 5 * count(*) FILTER (NOT modern) - 3 * count(*) FILTER (NOT cloud_ready) - 2 * count(*) FILTER (NOT open_standards) - 5 * sum(n_issues))) AS BIGINT) AS health FROM s GROUP BY ALL),
c AS (SELECT DISTINCT s.tenant, s.id, capability, modern, cloud_ready FROM s JOIN caps ON contains(txt, word))"""


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.described(items(spark, sf_dir, dealt=True))


@R.add("tier_classify", f"WITH {STACK_SQL} SELECT id, tier FROM s")
def tier_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacked(spark, sf_dir).select("id", "tier")


@R.add("technology_flags", f"WITH {STACK_SQL} SELECT id, modern, cloud_ready, open_standards, CAST(n_issues AS INTEGER) AS n_issues FROM s")
def technology_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacked(spark, sf_dir).select("id", "modern", "cloud_ready", "open_standards", "n_issues")


@R.add("capabilities", f"WITH {STACK_SQL} SELECT id, capability FROM c")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacked(spark, sf_dir).select("id", F.explode_outer("capabilities").alias("capability")).where("capability IS NOT NULL")


@R.add("tier_health", f"WITH {STACK_SQL} SELECT tenant, tier, n, health FROM layers")
def tier_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.layers(stacked(spark, sf_dir))


@R.add("redundant_capabilities", f"WITH {STACK_SQL} SELECT tenant, capability, count(*) AS n, CASE WHEN count(*) > 3 THEN 'high' WHEN count(*) > 2 THEN 'medium' ELSE 'low' END AS effort, coalesce(max(id) FILTER (modern AND cloud_ready), min(id) FILTER (modern), min(id)) AS kept FROM c GROUP BY ALL HAVING count(*) > 1")
def redundant_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a tenant that do the same, and the one to keep."""
    return stack.redundant(stacked(spark, sf_dir))


@R.add("modernization", f"WITH {STACK_SQL}, l(no, word, target) AS (VALUES {', '.join(f'({i}, {chr(39)}{w}{chr(39)}, {chr(39)}{t}{chr(39)})' for i, (w, t) in enumerate(stack.LEGACY.items()))}) SELECT id, word AS legacy, target FROM s JOIN l ON contains(lower(name), word) QUALIFY row_number() OVER (PARTITION BY id ORDER BY no) = 1")
def modernization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of legacy products, with what could replace them."""
    return stack.modernized(items(spark, sf_dir))


@R.add("technology_gaps", f"WITH {STACK_SQL}, need(tier, capability) AS (VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {chr(39)}{c}{chr(39)})' for t, cs in stack.NEEDED.items() for c in cs)}), tn AS (SELECT DISTINCT tenant FROM items) SELECT tenant, need.tier, need.capability FROM tn CROSS JOIN need WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.tenant = tn.tenant AND c.capability = need.capability)")
def technology_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities that a tier needs and no item of the tenant has."""
    return stack.gaps(stacked(spark, sf_dir))


@R.add("stack_scores", f"""WITH {STACK_SQL}, m AS (SELECT tenant, avg(health::DOUBLE) AS health FROM layers GROUP BY tenant), v AS (SELECT tenant, max(k) AS top FROM (SELECT tenant, vendor, count(*) AS k FROM s WHERE vendor IS NOT NULL GROUP BY ALL) GROUP BY tenant)
SELECT tenant, floor(any_value(m.health) + 0.5) AS health, floor(100 * avg((NOT modern)::INT::DOUBLE) + 0.5) AS debt, floor(100 * avg(cloud_ready::INT::DOUBLE) + 0.5) AS cloud, floor(100 * coalesce(any_value(top), 0)::DOUBLE / count(*) + 0.5) AS lock_in FROM s JOIN m USING (tenant) LEFT JOIN v USING (tenant) GROUP BY tenant""")
def stack_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean health of the tiers, and shares of old, cloud-ready and one vendor's items."""
    return stack.scores(stacked(spark, sf_dir))


@R.add("vendor_pricing", f"""WITH {ITEMS_SQL} SELECT tenant, vendor, {r('sum(budget)', 2)} AS spend, CASE WHEN sum(budget) > 500000 THEN 'strong' WHEN sum(budget) > 50000 THEN 'moderate' ELSE 'weak' END AS leverage,
CASE WHEN bool_or(support_end >= DATE '{AS_OF}' AND support_end - DATE '{AS_OF}' <= 180) THEN 70 ELSE 30 END AS renewal_risk, CASE WHEN sum(budget) / count(*) > 20000 THEN 70 ELSE 50 END AS pressure FROM items WHERE vendor IS NOT NULL GROUP BY ALL""")
def vendor_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leverage by spend, renewals within six months of thirty days, and pressure."""
    soon = F.bool_or(F.coalesce(F.datediff("support_end", F.lit(AS_OF).cast("date")).between(0, 180), F.lit(False)))
    g = items(spark, sf_dir).where("vendor IS NOT NULL").groupBy("tenant", "vendor").agg(F.sum("budget").alias("s"), F.count("*").alias("n"), soon.alias("soon"))
    s = F.col("s")
    return g.select("tenant", "vendor", rounded(s, 2).alias("spend"), F.when(s > 500_000, "strong").when(s > 50_000, "moderate").otherwise("weak").alias("leverage"), F.when(F.col("soon"), 70).otherwise(30).alias("renewal_risk"), F.when(s / F.col("n") > 20_000, 70).otherwise(50).alias("pressure"))


@R.add("recommendation_order", f"""WITH {HEALTH_SQL}, u AS (UNPIVOT (SELECT * EXCLUDE (n, health) FROM health) ON coverage, balance, risk, alignment, efficiency INTO NAME dimension VALUE score),
p AS (SELECT *, CASE WHEN score < 40 THEN 'high' WHEN score < 60 THEN 'medium' ELSE 'low' END AS priority, CASE dimension WHEN 'risk' THEN 'high' WHEN 'efficiency' THEN 'low' ELSE 'medium' END AS effort FROM u WHERE score < 80)
SELECT tenant, dimension, priority, effort, row_number() OVER (PARTITION BY tenant ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE effort WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, dimension) AS place FROM p""")
def recommendation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to work on, by priority and then by effort; five rows a tenant at most."""
    u = pf.health(items(spark, sf_dir)).unpivot(["tenant"], list(pf.HEALTH_WEIGHTS), "dimension", "score").where("score < 80")
    rank = lambda c, first: F.when(F.col(c) == first, 0).when(F.col(c) == "medium", 1).otherwise(2)
    p = u.withColumns({"priority": F.when(F.col("score") < 40, "high").when(F.col("score") < 60, "medium").otherwise("low"), "effort": F.when(F.col("dimension") == "risk", "high").when(F.col("dimension") == "efficiency", "low").otherwise("medium")})
    place = F.row_number().over(Window.partitionBy("tenant").orderBy(rank("priority", "high"), rank("effort", "low"), "dimension")).cast("long")
    return p.select("tenant", "dimension", "priority", "effort", place.alias("place"))
