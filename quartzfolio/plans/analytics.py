"""Vendors, health, risk, relations between items, and learning from corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzfolio.operators import graph, learning
from quartzfolio.plans.common import ITEMS_SQL, REVENUE, Registry, items, r, rounded, table

R = Registry()

SPEND_SQL = f"v AS (SELECT l_suppkey AS supplier, CAST(sum({REVENUE}) AS DOUBLE) AS spend, count(*) AS n FROM lineitem GROUP BY 1)"


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.sum(F.expr(REVENUE)).cast("double").alias("spend"), F.count("*").alias("n"))


@R.add("vendor_spend_share", f"WITH {SPEND_SQL} SELECT supplier, {r('spend', 2)} AS spend, {r('spend / (SELECT sum(spend) FROM v)')} AS share FROM v ORDER BY floor(spend * 100 + 0.5) DESC, supplier LIMIT 10")
def vendor_spend_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vendors most is spent on; the total is one row."""
    v = spend(spark, sf_dir)
    top = v.select("supplier", rounded(F.col("spend"), 2).alias("s"), "spend").orderBy(F.desc("s"), "supplier").limit(10)
    total = v.agg(F.sum("spend").alias("total"))
    return top.crossJoin(F.broadcast(total)).select("supplier", F.col("s").alias("spend"), rounded(F.col("spend") / F.col("total")).alias("share"))


@R.add("vendor_concentration", f"""WITH {ITEMS_SQL}, c AS (SELECT category, vendor, count(*) AS n FROM items GROUP BY ALL), g AS (SELECT category, sum(n) AS n, max(n) AS most, count(*) AS vendors FROM c GROUP BY category)
SELECT category, CAST(n AS BIGINT) AS n, vendors, {r('most::DOUBLE / n')} AS top_share, CASE WHEN most::DOUBLE / n > 0.5 THEN 40 WHEN most::DOUBLE / n > 0.35 THEN 25 ELSE 0 END + CASE WHEN vendors = 1 AND n > 2 THEN 10 ELSE 0 END AS risk FROM g""")
def vendor_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = items(spark, sf_dir).groupBy("category", "vendor").agg(F.count("*").alias("n"))
    g = c.groupBy("category").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("vendors"))
    share = F.col("most") / F.col("n")
    risk = F.when(share > 0.5, 40).when(share > 0.35, 25).otherwise(0) + F.when((F.col("vendors") == 1) & (F.col("n") > 2), 10).otherwise(0)
    return g.select("category", "n", "vendors", rounded(share).alias("top_share"), risk.alias("risk"))


@R.add("vendor_consolidation", f"""WITH {ITEMS_SQL}, t AS (SELECT vendor, count(*) AS total FROM items GROUP BY 1), c AS (SELECT category, vendor, count(*) AS n FROM items GROUP BY ALL)
SELECT category, count(*) AS vendors, CAST(sum(n) AS BIGINT) AS n, arg_max(vendor, (total, vendor)) AS target FROM c JOIN t USING (vendor) GROUP BY category HAVING count(*) > 1""")
def vendor_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of several vendors, and the vendor that has most items overall."""
    i = items(spark, sf_dir)
    t = i.groupBy("vendor").agg(F.count("*").alias("total"))
    c = i.groupBy("category", "vendor").agg(F.count("*").alias("n")).join(t, "vendor")
    return c.groupBy("category").agg(F.count("*").alias("vendors"), F.sum("n").alias("n"), F.max_by("vendor", F.struct("total", "vendor")).alias("target")).where("vendors > 1")


@R.add("vendor_profile", f"""WITH {ITEMS_SQL} SELECT vendor, count(*) AS n, {r('sum(CAST(budget AS DECIMAL(18,2)))::DOUBLE', 2)} AS spend, CASE WHEN sum(budget) > 500000 THEN 'enterprise' ELSE 'smb' END AS size,
{r("0.2::DOUBLE * (100 - avg(coalesce(business_value, 5)) * 10) + 0.2::DOUBLE * (100 - avg(coalesce(alignment, 5)) * 10) + 0.15::DOUBLE * 100 * avg((risk = 'critical')::INT::DOUBLE) + 0.2::DOUBLE * 100 * avg((complexity = 'high')::INT::DOUBLE) + 0.25::DOUBLE * 100 * avg((lifecycle IN ('end_of_life', 'deprecated'))::INT::DOUBLE)")} AS risk FROM items GROUP BY vendor""")
def vendor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, spend and weighed risk of each vendor."""
    yes = lambda c: F.avg(c.cast("int").cast("double"))
    risk = 0.2 * (100 - F.avg(F.coalesce("business_value", F.lit(5))) * 10) + 0.2 * (100 - F.avg(F.coalesce("alignment", F.lit(5))) * 10) + F.lit(0.15) * 100 * yes(F.col("risk") == "critical") + F.lit(0.2) * 100 * yes(F.col("complexity") == "high") + F.lit(0.25) * 100 * yes(F.col("lifecycle").isin("end_of_life", "deprecated"))
    return items(spark, sf_dir).groupBy("vendor").agg(F.count("*").alias("n"), rounded(F.sum(F.col("budget").cast("decimal(18,2)")).cast("double"), 2).alias("spend"), F.when(F.sum("budget") > 500_000, "enterprise").otherwise("smb").alias("size"), rounded(risk).alias("risk"))


THEMES = {"metal": ("steel", "copper", "tin"), "fine": ("brass", "nickel"), "bulk": ("economy", "large")}
THEME_SQL = " UNION ALL ".join(f"SELECT id, '{t}' AS theme, budget, alignment FROM items WHERE " + " OR ".join(f"contains(lower(category), '{w}')" for w in ws) for t, ws in THEMES.items())


@R.add("strategic_clusters", f"WITH {ITEMS_SQL}, t AS ({THEME_SQL}) SELECT theme, count(*) AS n, {r('sum(CAST(budget AS DECIMAL(18,2)))::DOUBLE', 2)} AS budget, {r('avg(alignment)')} AS alignment FROM t GROUP BY theme")
def strategic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes by keywords; an item can be of several."""
    text = F.lower("category")
    themes = F.array_compact(F.array(*(F.when(F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(text, w)), t) for t, ws in THEMES.items())))
    return items(spark, sf_dir).select(F.explode(themes).alias("theme"), "budget", "alignment").groupBy("theme").agg(F.count("*").alias("n"), rounded(F.sum(F.col("budget").cast("decimal(18,2)")).cast("double"), 2).alias("budget"), rounded(F.avg("alignment")).alias("alignment"))


@R.add("budget_distribution", f"""WITH {ITEMS_SQL}, b AS (SELECT category, sum(CAST(CASE WHEN budget = 0 THEN 30000 ELSE budget END AS DECIMAL(18,2)))::DOUBLE AS budget FROM items GROUP BY 1) SELECT category, {r('budget', 2)} AS budget, {r('budget / (SELECT sum(budget) FROM b)')} AS share, budget / (SELECT sum(budget) FROM b) <= 0.4 AS optimal FROM b""")
def budget_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = items(spark, sf_dir).groupBy("category").agg(F.sum(F.when(F.col("budget") == 0, 30_000).otherwise(F.col("budget")).cast("decimal(18,2)")).cast("double").alias("b"))
    total = b.agg(F.sum("b").alias("total"))  # one row
    share = F.col("b") / F.col("total")
    return b.crossJoin(F.broadcast(total)).select("category", rounded(F.col("b"), 2).alias("budget"), rounded(share).alias("share"), (share <= 0.4).alias("optimal"))


EDGES_SQL = f"""{ITEMS_SQL}, byvendor AS (SELECT a.id AS src, b.id AS dst, 'vendor' AS kind, 2 AS rank FROM items a JOIN items b ON a.vendor = b.vendor AND a.category = b.category AND a.id < b.id),
bycategory AS (SELECT a.id AS src, b.id AS dst, 'category' AS kind, 1 AS rank FROM items a JOIN items b ON a.category = b.category AND a.owner = b.owner AND a.id < b.id),
e AS (SELECT src, dst, kind FROM (SELECT * FROM byvendor UNION ALL SELECT * FROM bycategory) QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY rank) = 1)"""


#: What makes a relation, the first that does.
DETECTORS = (("category", ("category", "owner")), ("vendor", ("category", "vendor")))


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", "vendor", "category", "owner")


@R.add("dependency_edges", f"WITH {EDGES_SQL} SELECT * FROM e")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of items; the first detector of a pair wins."""
    return graph.agreeing_pairs(related(spark, sf_dir), DETECTORS)


@R.add("dependency_stats", f"WITH {EDGES_SQL}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT items.id, coalesce(degree, 0) AS degree FROM items LEFT JOIN d USING (id)")
def dependency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree of every item; isolated ones have none."""
    return graph.agreement_degrees(related(spark, sf_dir), DETECTORS)


CYCLE_EDGES_SQL = "e AS (SELECT n_nationkey::BIGINT AS src, (n_nationkey * 7 + 3)::BIGINT % 25 AS dst FROM nation UNION SELECT n_nationkey::BIGINT, n_nationkey::BIGINT // 2 FROM nation WHERE n_nationkey > 0)"


@R.add("cycles", f"""WITH RECURSIVE {CYCLE_EDGES_SQL}, p(start, last, path) AS (SELECT src, dst, [src, dst] FROM e WHERE src <= dst UNION ALL SELECT start, dst, list_append(path, dst) FROM p JOIN e ON e.src = p.last WHERE p.last <> p.start AND dst >= start AND (dst = start OR NOT list_contains(path, dst)) AND len(path) <= 4)
SELECT start, array_to_string(path, '>') AS cycle FROM p WHERE start = last""")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of at most four edges, each from its least node."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    e = n.select(F.col("k").alias("src"), ((F.col("k") * 7 + 3) % 25).alias("dst")).union(n.where("k > 0").select("k", F.floor(F.col("k") / 2).cast("long"))).distinct()
    return graph.cycles(e, 4)


#: What was ordered next, in amounts over 47: parts that lead to parts.
LEADS_SQL = "l AS (SELECT l_partkey AS src, lead(l_partkey) OVER w AS dst, lead(l_quantity) OVER w AS q FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)), e AS (SELECT DISTINCT src, dst FROM l WHERE q > 47 AND src IS NOT NULL AND dst IS NOT NULL)"
#: Steps up to which the SQL follows ways; enough for the tables that it is held against.
WAYS = 150


def part_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")  # the lines of an order
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.lead("l_quantity").over(w).alias("q"))
    return lines.where("q > 47").select("src", "dst")


@R.add("dependency_cycles", f"""WITH RECURSIVE {LEADS_SQL}, a(k, x) AS (SELECT 0, src FROM e UNION SELECT k + 1, src FROM a JOIN e ON dst = x WHERE k < {WAYS}), b(k, x) AS (SELECT 0, dst FROM e UNION SELECT k + 1, dst FROM b JOIN e ON src = x WHERE k < {WAYS}),
core AS (SELECT x FROM a WHERE k = {WAYS} INTERSECT SELECT x FROM b WHERE k = {WAYS}), f AS (SELECT src, min(dst) AS dst FROM e WHERE src IN (FROM core) AND dst IN (FROM core) GROUP BY src),
r(k, x) AS (SELECT 0, src FROM f UNION SELECT k + 1, dst FROM r JOIN f ON src = x WHERE k < {WAYS}), c AS (SELECT x FROM r WHERE k = {WAYS}), p(start, place, node) AS (SELECT x, 0, x FROM c UNION ALL SELECT start, place + 1, dst FROM p JOIN f ON src = node WHERE dst <> start AND place < {WAYS})
SELECT start, count(*) OVER (PARTITION BY start) AS length, place::BIGINT AS place, node FROM p QUALIFY min(node) OVER (PARTITION BY start) = start""")
def dependency_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of parts that lead to each other in orders: each part that can reach a
    cycle goes to the least part that can too; a row for each part of a cycle."""
    return graph.found_cycles(part_leads(spark, sf_dir))


@R.add("doc_series", "WITH d AS (SELECT p_partkey AS id, p_name || ' v' || (p_partkey % 4 + 1) || '.pdf' AS file FROM part), s AS (SELECT id, regexp_replace(file, '[ _-]*v[0-9]+\\.[a-z]+$', '') AS stem, CAST(regexp_extract(file, 'v([0-9]+)\\.[a-z]+$', 1) AS INTEGER) AS version FROM d) SELECT stem, count(*) AS n, arg_max(id, (version, id)) AS latest, max(version) AS version FROM s GROUP BY stem HAVING count(*) > 1")
def doc_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of one document by the stem of their file names; whole groups."""
    file = F.concat("p_name", F.lit(" v"), (F.col("p_partkey") % 4 + 1).cast("string"), F.lit(".pdf"))
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace(file, "[ _-]*v[0-9]+\\.[a-z]+$", "").alias("stem"), F.regexp_extract(file, "v([0-9]+)\\.[a-z]+$", 1).cast("int").alias("version"))
    return d.groupBy("stem").agg(F.count("*").alias("n"), F.max_by("id", F.struct("version", "id")).alias("latest"), F.max("version").alias("version")).where("n > 1")


@R.add("text_mentions", "SELECT doc_id, item_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)")
def text_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage: texts meet on the passages' rarest word,
    and only those pairs are compared."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return graph.mentions(docs, table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")))


TRANSITIONS_SQL = "t AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), x AS (SELECT a, b, count(*) AS n FROM t WHERE b IS NOT NULL AND a <> b GROUP BY ALL)"


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).where("b IS NOT NULL AND a <> b")


@R.add("rule_mining", f"WITH {TRANSITIONS_SQL} SELECT a, arg_max(b, (n, b)) AS b, CAST(max(n) AS BIGINT) AS n, least(0.95::DOUBLE, {r('0.5::DOUBLE + 0.05::DOUBLE * max(n)')}) AS confidence FROM x GROUP BY a HAVING max(n) >= 3")
def rule_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From what users change a value into: the most frequent target of each."""
    return learning.majority_rules(transitions(spark, sf_dir), "a", "b").withColumn("confidence", rounded(F.col("confidence")))


@R.add("category_transitions", f"WITH {TRANSITIONS_SQL} SELECT a, b, n, {r('n::DOUBLE / sum(n) OVER (PARTITION BY a)')} AS share FROM x WHERE n >= 5")
def category_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = transitions(spark, sf_dir).groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 5")
    return x.withColumn("share", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("a"))))


@R.add("feature_mining", f"""WITH {ITEMS_SQL}, f AS (SELECT vendor, unnest([('risk', coalesce(risk, '-')), ('complexity', coalesce(complexity, '-')), ('status', status), ('lifecycle', lifecycle)]) AS x FROM items), c AS (SELECT vendor, x[1] AS feature, x[2] AS val, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT vendor, count(*) AS total FROM items GROUP BY 1)
SELECT vendor, feature, val, {r('n::DOUBLE / total')} AS share FROM c JOIN t USING (vendor) WHERE n::DOUBLE / total >= 0.5""")
def feature_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that at least half of a vendor's items share."""
    i = items(spark, sf_dir).select("vendor", *(F.coalesce(c, F.lit("-")).alias(c) for c in ("risk", "complexity", "status", "lifecycle")))
    return learning.common_features(i, "vendor", ["risk", "complexity", "status", "lifecycle"], 0.5).withColumn("share", rounded(F.col("share")))


@R.add("pattern_apply", f"""WITH {ITEMS_SQL} SELECT id, greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN status = 'outdated' THEN 20.0::DOUBLE ELSE (CASE WHEN risk = 'critical' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * coalesce(business_value, 5) * 10) + CASE WHEN lifecycle = 'growth' THEN 15 ELSE 0 END END)) AS score FROM items""")
def pattern_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned patterns change a score, the most trusted first; 0 to 100."""
    patterns = [("risk", "critical", "multiply", 1.2, 0.9), ("lifecycle", "growth", "add", 15.0, 0.8), ("status", "outdated", "override", 20.0, 0.7)]
    start = (F.coalesce("business_value", F.lit(5)) * 10).cast("double")
    return items(spark, sf_dir).select("id", learning.adjusted(start, patterns).alias("score"))


@R.add("pattern_confidence", f"SELECT event_type, tenant, {r('(good::DOUBLE / n) * (1 - exp(-n / 10.0::DOUBLE))')} AS confidence FROM (SELECT event_type, user_id % 10 AS tenant, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS good FROM events GROUP BY ALL)")
def pattern_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 10).alias("tenant")).agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 3 == 0).alias("good"))
    return g.select("event_type", "tenant", rounded(F.col("good") / F.col("n") * (1 - F.exp(-F.col("n") / 10.0))).alias("confidence"))


@R.add("cooldown_alerts")
def cooldown_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each user that raise an alert: an hour after one there is none."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("key"), "ts", "event_id")
    return learning.cooldown(e, "1 hour")
