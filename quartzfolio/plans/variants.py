"""Other ways to score, select and compare: catalog and strategy scores, scenarios, KPIs, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfolio.functions.numbers import half_up
from quartzfolio.operators.scoring import settled
from quartzfolio.plans.common import ITEMS_SQL, Registry, items, r, rounded, tag
from quartzfolio.plans.prioritize import LOCAL_SQL, SCORED_SQL, local, scored

R = Registry()

# ---- scores from assessments: one way for catalogs, another for strategies

ASSESSED_SQL = f"""{LOCAL_SQL}, a AS (SELECT w.*, CASE WHEN overall >= 80 THEN 'accelerate' WHEN overall >= 60 THEN 'keep' WHEN overall >= 40 THEN 'optimize' WHEN overall >= 25 THEN 'pause' ELSE 'stop' END AS said, category, phase, risk, CASE id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS sure FROM w JOIN items USING (id))"""


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("id") % 3 + 1).cast("int"))
    more = items(spark, sf_dir).select("id", "category", "phase", "risk", level.alias("sure"))
    return local(spark, sf_dir).withColumnRenamed("recommendation", "said").join(more, "id")


def capped(e: Column) -> Column:
    return F.least(F.lit(10.0), half_up(e))


def urgency(other: float = 5.0) -> Column:
    return F.when(F.col("said") == "accelerate", 9.0).when(F.col("said") == "keep", 6.0).when(F.col("said") == "pause", 3.0).when(F.col("said") == "stop", 1.0).otherwise(other)


CAP = "least(10.0::DOUBLE, floor(({0})::DOUBLE + 0.5))"
URGENCY_SQL = "CASE said WHEN 'accelerate' THEN 9 WHEN 'keep' THEN 6 WHEN 'pause' THEN 3 WHEN 'stop' THEN 1 ELSE 5 END"
JOB_SQL = "greatest(1.0::DOUBLE, 11 - floor(ease / 10.0::DOUBLE + 0.5))"
CATALOG_SQL = f"""{ASSESSED_SQL}, k1 AS (SELECT *, {r(f"({CAP.format('(fit * 0.5::DOUBLE + value * 0.5::DOUBLE) / 10')} + {URGENCY_SQL} + {CAP.format('safety / 10.0::DOUBLE')}) / {JOB_SQL}", 2)} AS wsjf,
  {CAP.format('(value + fit) / 20.0::DOUBLE')} * CASE sure WHEN 'high' THEN 9 WHEN 'medium' THEN 6 ELSE 3 END * {CAP.format('(ease + timing) / 20.0::DOUBLE')} AS ice, {CAP.format('(ease + timing) / 20.0::DOUBLE')} AS ease10,
  {r("timing / 100.0::DOUBLE * 0.2::DOUBLE + value / 100.0::DOUBLE * 0.2::DOUBLE + fit / 100.0::DOUBLE * 0.2::DOUBLE - (100 - ease) / 100.0::DOUBLE * 0.15::DOUBLE + safety / 100.0::DOUBLE * 0.15::DOUBLE + overall / 100.0::DOUBLE * 0.1::DOUBLE", 2)} AS retention,
  CASE WHEN regexp_matches(lower(category), 'security|compliance|core') THEN 'must_be' WHEN regexp_matches(lower(category), 'innovation|ai|digital') THEN 'attractive' WHEN overall >= 70 THEN 'one_dimensional' WHEN overall < 40 THEN 'indifferent' ELSE 'one_dimensional' END AS kano FROM a),
k2 AS (SELECT *, {r("least(100.0::DOUBLE, wsjf / 5 * 100) * 0.3::DOUBLE + least(100.0::DOUBLE, ice / 10) * 0.25::DOUBLE + retention * 100 * 0.25::DOUBLE + overall * 0.2::DOUBLE", 1)} AS composite,
  CASE WHEN said = 'stop' THEN 'wont' WHEN kano = 'must_be' OR said = 'accelerate' OR wsjf >= 4 THEN 'must' WHEN said = 'keep' OR wsjf >= 2.5 THEN 'should' WHEN wsjf >= 1.5 THEN 'could' ELSE 'wont' END AS moscow FROM k1),
k3 AS (SELECT *, CASE WHEN composite >= 60 AND 100 - ease10 * 10 < 50 THEN 'quick_win' WHEN composite >= 60 THEN 'strategic' WHEN 100 - ease10 * 10 < 50 THEN 'fill_in' ELSE 'rationalize' END AS quadrant FROM k2),
catalog AS (SELECT *, CASE WHEN moscow = 'must' AND quadrant = 'quick_win' THEN 'critical' WHEN moscow = 'must' OR quadrant = 'quick_win' THEN 'high' WHEN moscow = 'should' OR quadrant = 'strategic' THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN sure = 'low' AND safety < 40 THEN 'critical' WHEN sure = 'low' OR safety < 50 THEN 'high' WHEN safety < 70 THEN 'medium' ELSE 'low' END AS risk_level FROM k3)"""


def catalog_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    job = F.greatest(F.lit(1.0), 11 - half_up(c("ease") / 10.0))
    ease = capped((c("ease") + c("timing")) / 20.0)
    sure = F.when(c("sure") == "high", 9.0).when(c("sure") == "medium", 6.0).otherwise(3.0)
    part = lambda n, w: c(n) / 100.0 * w
    kind = F.lower("category")
    k = assessed(spark, sf_dir).withColumns({
        "wsjf": half_up((capped((c("fit") * 0.5 + c("value") * 0.5) / 10) + urgency() + capped(c("safety") / 10.0)) / job, 2), "ice": capped((c("value") + c("fit")) / 20.0) * sure * ease, "ease10": ease,
        "retention": half_up(part("timing", 0.2) + part("value", 0.2) + part("fit", 0.2) - (100 - c("ease")) / 100.0 * 0.15 + part("safety", 0.15) + part("overall", 0.1), 2),
        "kano": F.when(kind.rlike("security|compliance|core"), "must_be").when(kind.rlike("innovation|ai|digital"), "attractive").when(c("overall") >= 70, "one_dimensional").when(c("overall") < 40, "indifferent").otherwise("one_dimensional"),
    })
    w, s = c("wsjf"), c("said")
    k = k.withColumns({
        "composite": half_up(F.least(F.lit(100.0), w / 5 * 100) * 0.3 + F.least(F.lit(100.0), c("ice") / 10) * 0.25 + c("retention") * 100 * 0.25 + c("overall") * 0.2, 1),
        "moscow": F.when(s == "stop", "wont").when((c("kano") == "must_be") | (s == "accelerate") | (w >= 4), "must").when((s == "keep") | (w >= 2.5), "should").when(w >= 1.5, "could").otherwise("wont"),
    })
    high, easy = c("composite") >= 60, 100 - c("ease10") * 10 < 50
    k = k.withColumn("quadrant", F.when(high & easy, "quick_win").when(high, "strategic").when(easy, "fill_in").otherwise("rationalize"))
    m, q = c("moscow"), c("quadrant")
    return k.withColumns({
        "priority": F.when((m == "must") & (q == "quick_win"), "critical").when((m == "must") | (q == "quick_win"), "high").when((m == "should") | (q == "strategic"), "medium").otherwise("low"),
        "risk_level": F.when((c("sure") == "low") & (c("safety") < 40), "critical").when((c("sure") == "low") | (c("safety") < 50), "high").when(c("safety") < 70, "medium").otherwise("low"),
    })


CATALOG_COLUMNS = ("id", "wsjf", "ice", "retention", "kano", "composite", "moscow", "quadrant", "priority", "risk_level")


@R.add("catalog_scores", f"WITH {CATALOG_SQL} SELECT {', '.join(CATALOG_COLUMNS)} FROM catalog")
def catalog_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_scored(spark, sf_dir).select(*CATALOG_COLUMNS)


@R.add("catalog_summary", f"WITH {CATALOG_SQL}, g AS (SELECT *, quadrant AS q FROM catalog) SELECT quadrant, moscow, count(*) AS n, {r('sum(CAST(budget AS DECIMAL(18,2)))::DOUBLE', 2)} AS investment, {r('sum(CASE WHEN q = ' + chr(39) + 'rationalize' + chr(39) + ' THEN CAST(budget AS DECIMAL(18,2)) ELSE 0 END)::DOUBLE * 0.3::DOUBLE', 2)} AS savings FROM g GROUP BY GROUPING SETS ((quadrant), (moscow), ())")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, investments and 30 % savings of what is to be rationalised."""
    b = F.col("budget").cast("decimal(18,2)")
    k = catalog_scored(spark, sf_dir).withColumn("q", F.col("quadrant"))  # a copy: the grouped one is null in other sets
    spare = F.sum(F.when(F.col("q") == "rationalize", b).otherwise(0)).cast("double") * 0.3
    g = k.groupingSets([["quadrant"], ["moscow"], []], "quadrant", "moscow")
    return g.agg(F.count("*").alias("n"), rounded(F.sum(b).cast("double"), 2).alias("investment"), rounded(spare, 2).alias("savings"))


STRATEGY_SQL = f"""{ASSESSED_SQL}, s1 AS (SELECT *, {CAP.format('(fit * 0.4::DOUBLE + value * 0.4::DOUBLE + (20 + id % 60) / 10.0::DOUBLE) / 2')} AS bv, CASE WHEN phase = 1 THEN least(10, {URGENCY_SQL} + 2) ELSE {URGENCY_SQL} END AS tc FROM a),
s2 AS (SELECT *, {r(f"(bv + tc + {CAP.format('safety / 10.0::DOUBLE')}) / {JOB_SQL}", 2)} AS wsjf, {CAP.format('(value + fit) / 20.0::DOUBLE')} * {CAP.format("(100 - CASE risk WHEN 'high' THEN 30 WHEN 'medium' THEN 15 ELSE 0 END) / 10.0::DOUBLE")} * {CAP.format('(ease + timing) / 20.0::DOUBLE')} AS ice FROM s1),
strategy AS (SELECT *, CASE WHEN said = 'stop' THEN 'wont_have' WHEN said = 'accelerate' OR wsjf > 3 THEN 'must_have' WHEN said = 'keep' OR wsjf >= 2 THEN 'should_have' WHEN said = 'pause' OR wsjf >= 1 THEN 'could_have' ELSE 'wont_have' END AS moscow,
  {r("least(100.0::DOUBLE, wsjf / 5 * 100) * 0.4::DOUBLE + least(100.0::DOUBLE, ice / 10) * 0.3::DOUBLE + overall * 0.3::DOUBLE", 1)} AS composite FROM s2)"""


def strategy_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    tc = F.when(c("phase") == 1, F.least(F.lit(10.0), urgency() + 2)).otherwise(urgency())
    job = F.greatest(F.lit(1.0), 11 - half_up(c("ease") / 10.0))
    sure = capped((100 - F.when(c("risk") == "high", 30).when(c("risk") == "medium", 15).otherwise(0)) / 10.0)
    k = assessed(spark, sf_dir).withColumn("bv", capped((c("fit") * 0.4 + c("value") * 0.4 + (20 + c("id") % 60) / 10.0) / 2)).withColumn("wsjf", half_up((c("bv") + tc + capped(c("safety") / 10.0)) / job, 2))
    k = k.withColumn("ice", capped((c("value") + c("fit")) / 20.0) * sure * capped((c("ease") + c("timing")) / 20.0))
    w, s = c("wsjf"), c("said")
    moscow = F.when(s == "stop", "wont_have").when((s == "accelerate") | (w > 3), "must_have").when((s == "keep") | (w >= 2), "should_have").when((s == "pause") | (w >= 1), "could_have").otherwise("wont_have")
    return k.withColumns({"moscow": moscow, "composite": half_up(F.least(F.lit(100.0), w / 5 * 100) * 0.4 + F.least(F.lit(100.0), c("ice") / 10) * 0.3 + c("overall") * 0.3, 1)})


@R.add("strategy_scores", f"WITH {STRATEGY_SQL} SELECT id, bv, wsjf, ice, moscow, composite FROM strategy")
def strategy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategy_scored(spark, sf_dir).select("id", "bv", "wsjf", "ice", "moscow", "composite")


@R.add("strategic_kpis", f"""WITH {STRATEGY_SQL}, g AS (SELECT vendor, count(*) AS n, avg(composite) AS mean, count(*) FILTER (moscow = 'must_have') AS musts, count(*) FILTER (said = 'stop') AS stops, count(*) FILTER (said = 'pause') AS paused, avg(bv * 10) AS business, avg(CASE WHEN id % 2 = 0 THEN 80 ELSE 60 END::DOUBLE) AS resource, sum(CAST(budget AS DECIMAL(18,2)))::DOUBLE AS invested FROM strategy GROUP BY vendor)
SELECT vendor, n, {r('mean', 3)} AS mean_score, CASE WHEN stops > musts THEN 'declining' WHEN musts > 2 * stops THEN 'improving' ELSE 'stable' END AS trend, {r('business', 3)} AS business, {r('mean * 0.9::DOUBLE', 3)} AS technology, {r('resource', 3)} AS resource, 100 - 10 * paused AS readiness, {r('invested', 2)} AS invested, {r('invested * 1.5::DOUBLE', 2)} AS expected FROM g""")
def strategic_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    g = strategy_scored(spark, sf_dir).groupBy("vendor").agg(
        F.count("*").alias("n"), F.avg("composite").alias("mean"), F.count_if(c("moscow") == "must_have").alias("musts"), F.count_if(c("said") == "stop").alias("stops"), F.count_if(c("said") == "pause").alias("paused"),
        F.avg(c("bv") * 10).alias("b"), F.avg(F.when(c("id") % 2 == 0, 80.0).otherwise(60.0)).alias("res"), F.sum(c("budget").cast("decimal(18,2)")).cast("double").alias("inv"),
    )
    trend = F.when(c("stops") > c("musts"), "declining").when(c("musts") > 2 * c("stops"), "improving").otherwise("stable")
    return g.select("vendor", "n", rounded(c("mean"), 3).alias("mean_score"), trend.alias("trend"), rounded(c("b"), 3).alias("business"), rounded(c("mean") * 0.9, 3).alias("technology"), rounded(c("res"), 3).alias("resource"), (100 - 10 * c("paused")).alias("readiness"), rounded(c("inv"), 2).alias("invested"), rounded(c("inv") * 1.5, 2).alias("expected"))


# ---- selections compared

COST_SQL = "CASE WHEN cost = 0 THEN 50000 ELSE cost END"


@R.add("portfolio_optimization", f"""WITH {SCORED_SQL}, c AS (SELECT *, {COST_SQL} AS price FROM scored), s AS (SELECT *, sum(CAST(price AS DECIMAL(18,2))) OVER (PARTITION BY vendor ORDER BY score DESC, id) <= 300000 OR moscow = 'must_have' AS chosen FROM c)
SELECT vendor, count(*) FILTER (chosen) AS selected, count(*) FILTER (NOT chosen AND (recommendation = 'eliminate' OR moscow = 'wont_have')) AS to_eliminate, count(*) FILTER (NOT chosen AND NOT (recommendation = 'eliminate' OR moscow = 'wont_have')) AS deferred,
{r('sum(score) FILTER (chosen)', 1)} AS total_value, {r('sum(CAST(price AS DECIMAL(18,2))) FILTER (chosen)::DOUBLE', 2)} AS total_cost, {r('1 - (avg(score_confidence) FILTER (chosen) * 0.5::DOUBLE + avg(retention) FILTER (chosen) * 0.5::DOUBLE)', 2)} AS risk, sum(CAST(price AS DECIMAL(18,2))) FILTER (chosen) <= 300000 AS within_budget FROM s GROUP BY vendor""")
def portfolio_optimization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is selected by score within a budget, with all must-haves; the rest
    is deferred or to be eliminated. Sets are taken after the must-haves came in.
    The running cost comes from sums over score classes first, so that no task
    sorts a whole vendor."""
    from quartzfolio.operators.windows import running_sum

    c = F.col
    rows = scored(spark, sf_dir).withColumn("price", F.when(c("cost") == 0, 50_000.0).otherwise(c("cost")).cast("decimal(18,2)"))
    s = running_sum(rows, ["vendor"], F.floor(-c("score")), [F.desc("score"), "id"], "price", "used").withColumn("chosen", (c("used") <= 300_000) | (c("moscow") == "must_have"))
    gone = (c("recommendation") == "eliminate") | (c("moscow") == "wont_have")
    if_chosen = lambda x: F.when(c("chosen"), c(x))
    total = F.sum(if_chosen("price"))
    return s.groupBy("vendor").agg(
        F.count_if("chosen").alias("selected"), F.count_if(~c("chosen") & gone).alias("to_eliminate"), F.count_if(~c("chosen") & ~gone).alias("deferred"), rounded(F.sum(if_chosen("score")), 1).alias("total_value"),
        rounded(total.cast("double"), 2).alias("total_cost"), rounded(1 - (F.avg(if_chosen("score_confidence")) * 0.5 + F.avg(if_chosen("retention")) * 0.5), 2).alias("risk"), (total <= 300_000).alias("within_budget"),
    )


SCENARIOS = {"conservative": ("moscow IN ('must_have', 'should_have')", 0.3), "balanced": ("score >= 60 OR moscow = 'must_have'", 0.5), "aggressive": ("recommendation <> 'eliminate'", 0.8)}


@R.add("scenarios", f"WITH {SCORED_SQL}, c AS (SELECT *, {COST_SQL} AS price FROM scored) " + " UNION ALL ".join(f"SELECT '{k}' AS scenario, vendor, count(*) AS n, {r('sum(score)', 1)} AS total_value, {r('sum(CAST(price AS DECIMAL(18,2)))::DOUBLE', 2)} AS total_cost, {risk}::DOUBLE AS risk FROM c WHERE {w} GROUP BY vendor" for k, (w, risk) in SCENARIOS.items()))
def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and cost of three selections of each vendor's items, in one pass."""
    rows = scored(spark, sf_dir).withColumn("price", F.when(F.col("cost") == 0, 50_000.0).otherwise(F.col("cost")).cast("decimal(18,2)"))
    of = F.array_compact(F.array(*(F.when(F.expr(w), F.struct(F.lit(k).alias("scenario"), F.lit(risk).alias("risk"))) for k, (w, risk) in SCENARIOS.items())))
    g = rows.select("vendor", "score", "price", F.inline(of)).groupBy("scenario", "vendor", "risk")
    return g.agg(F.count("*").alias("n"), rounded(F.sum("score"), 1).alias("total_value"), rounded(F.sum("price").cast("double"), 2).alias("total_cost")).select("scenario", "vendor", "n", "total_value", "total_cost", "risk")


@R.add("compare_selections", f"WITH {SCORED_SQL}, a AS (SELECT category, count(*) AS n, sum(score) AS v FROM scored WHERE recommendation = 'invest' GROUP BY 1), b AS (SELECT category, count(*) AS n, sum(score) AS v FROM scored WHERE score >= 50 GROUP BY 1) SELECT category, coalesce(b.n, 0) - coalesce(a.n, 0) AS more_items, {r('coalesce(b.v, 0) - coalesce(a.v, 0)', 1)} AS more_value FROM a FULL JOIN b USING (category)")
def compare_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two selections by category; both are sums of one pass."""
    a, b = F.col("recommendation") == "invest", F.col("score") >= 50
    n = lambda x: F.count_if(x)
    v = lambda x: F.sum(F.when(x, F.col("score")).otherwise(0.0))
    g = settled(scored(spark, sf_dir)).where(a | b).groupBy("category")
    return g.agg((n(b) - n(a)).alias("more_items"), rounded(v(b) - v(a), 1).alias("more_value"))


@R.add("requested_budget", f"WITH {ITEMS_SQL} SELECT owner, CASE WHEN sum(budget) = 0 THEN 360000 ELSE greatest(sum(CAST(budget AS DECIMAL(18,2))), sum(CASE WHEN phase = 1 THEN CAST(cost AS DECIMAL(18,2)) ELSE 0 END))::DOUBLE END AS total FROM items GROUP BY owner")
def requested_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of an owner, at least the cost of the first phase."""
    b, k = F.col("budget").cast("decimal(18,2)"), F.when(F.col("phase") == 1, F.col("cost").cast("decimal(18,2)")).otherwise(0)
    return items(spark, sf_dir).groupBy("owner").agg(F.when(F.sum("budget") == 0, 360_000.0).otherwise(F.greatest(F.sum(b), F.sum(k)).cast("double")).alias("total"))


@R.add("budget_shares", f"WITH {SCORED_SQL}, s AS (SELECT phase, CASE WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS band, CAST(budget AS DECIMAL(18,2)) AS b FROM scored), g AS (SELECT phase, band, sum(b)::DOUBLE AS budget FROM s GROUP BY ALL), t AS (SELECT sum(budget) AS total FROM g) SELECT phase, band, {r('budget', 2)} AS budget, {r('budget / total * 100', 1)} AS percent FROM g, t")
def budget_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget by phase and band of priority, with its share of all."""
    s = F.col("score")
    g = scored(spark, sf_dir).groupBy("phase", F.when(s >= 70, "high").when(s >= 50, "medium").otherwise("low").alias("band")).agg(F.sum(F.col("budget").cast("decimal(18,2)")).cast("double").alias("b"))
    total = g.agg(F.sum("b").alias("total"))  # one row
    return g.crossJoin(F.broadcast(total)).select("phase", "band", rounded(F.col("b"), 2).alias("budget"), rounded(F.col("b") / F.col("total") * 100, 1).alias("percent"))


# ---- explained scores: 50 and what each factor adds, held between 0 and 100

#: Breakdown, condition that both engines read alike, impact, weight.
FACTORS = (
    ("strategic_fit", "alignment >= 8", 40, 1.0), ("strategic_fit", "alignment < 4", -30, 1.0), ("strategic_fit", "lifecycle = 'growth'", 20, 0.5), ("value", "business_value >= 8", 40, 1.0), ("value", "business_value < 4", -30, 1.0),
    ("value", "roi > 0", 20, 0.6), ("risk", "risk = 'critical'", -40, 1.0), ("risk", "risk = 'high'", -25, 1.0), ("risk", "risk = 'low'", 30, 0.8), ("efficiency", "complexity = 'low'", 30, 1.0), ("efficiency", "complexity = 'high'", -30, 1.0),
    ("efficiency", "cost > budget", -20, 0.7), ("timing", "phase = 1", 30, 1.0), ("timing", "n_dependencies > 3", -20, 0.8), ("timing", "lifecycle = 'end_of_life'", -35, 1.0),
)
BREAKDOWNS = tuple(dict.fromkeys(f[0] for f in FACTORS))


def breakdown_sql(k: str) -> str:
    total = " + ".join(f"CASE WHEN {w} THEN {i * x}::DOUBLE ELSE 0.0::DOUBLE END" for b, w, i, x in FACTORS if b == k)
    return f"floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 50 + {total})) + 0.5) AS {k}"


@R.add("score_breakdowns", f"WITH {ITEMS_SQL} SELECT id, {', '.join(map(breakdown_sql, BREAKDOWNS))} FROM items")
def score_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five explained scores: factors are structs, summed in place."""
    out = []
    for k in BREAKDOWNS:
        factors = F.array_compact(F.array(*(F.when(F.expr(w), F.struct(F.lit(w).alias("why"), F.lit(float(i * x)).alias("by"))) for b, w, i, x in FACTORS if b == k)))
        total = F.aggregate(factors, F.lit(50.0), lambda s, f: s + f["by"])
        out.append(half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))).alias(k))
    return items(spark, sf_dir).select("id", *out)


# ---- confidence of items in detail

REQUIRED, IMPORTANT, OPTIONAL = ("name", "business_value", "alignment", "risk"), ("complexity", "owner", "category"), ("cost", "budget", "roi", "lifecycle")
MULTIPLIERS = {"manual": 0.9, "api": 1.0, "extracted": 0.7, "imported": 0.8}
FULL = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END" for cs, w in ((REQUIRED, 3), (IMPORTANT, 2), (OPTIONAL, 1)) for c in cs)
MOST = 3 * len(REQUIRED) + 2 * len(IMPORTANT) + len(OPTIONAL)
#: Applicable and passed checks of two fields each.
CROSS = (("cost IS NOT NULL AND budget IS NOT NULL", "cost <= budget * 2"), ("roi IS NOT NULL AND cost IS NOT NULL", "roi >= -100 AND roi <= 1000"), ("business_value IS NOT NULL AND risk IS NOT NULL", "NOT (risk IN ('critical', 'high')) OR business_value >= 6"), ("alignment IS NOT NULL AND lifecycle IS NOT NULL", "NOT (lifecycle IN ('decline', 'end_of_life')) OR alignment <= 5"))
SOURCE_SQL = "CASE id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'api' WHEN 2 THEN 'extracted' ELSE 'imported' END"
CROSS_SQL = (" + ".join(f"CASE WHEN {a} THEN 1 ELSE 0 END" for a, _ in CROSS), " + ".join(f"CASE WHEN {a} AND ({p}) THEN 1 ELSE 0 END" for a, p in CROSS))
RELIABLE_SQL = f"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN id % 120 < 7 THEN least(1.0::DOUBLE, 0.8::DOUBLE + 0.1::DOUBLE) WHEN id % 120 > 90 THEN 0.8::DOUBLE - 0.1::DOUBLE ELSE 0.8::DOUBLE END + (id % 10) / 10.0::DOUBLE) / 2 * CASE {SOURCE_SQL} {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in MULTIPLIERS.items())} END))"""


@R.add("detailed_confidence", f"""WITH {ITEMS_SQL}, d AS (SELECT id, ({FULL}) / {MOST}.0::DOUBLE AS complete, {RELIABLE_SQL} AS reliable, CASE WHEN {CROSS_SQL[0]} = 0 THEN 0.5::DOUBLE ELSE ({CROSS_SQL[1]})::DOUBLE / ({CROSS_SQL[0]}) END AS crossed FROM items)
SELECT id, {r('complete', 2)} AS completeness, {r('reliable', 2)} AS reliability, {r('crossed', 2)} AS cross_checks, {r('complete * 0.3::DOUBLE + reliable * 0.25::DOUBLE + 0.5::DOUBLE * 0.25::DOUBLE + crossed * 0.2::DOUBLE', 2)} AS confidence FROM d""")
def detailed_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, reliability of the source and checks of fields against each other."""
    c = F.col
    full = reduce(lambda a, b: a + b, (F.when(c(x).isNotNull(), w).otherwise(0) for cs, w in ((REQUIRED, 3), (IMPORTANT, 2), (OPTIONAL, 1)) for x in cs)) / float(MOST)
    applicable = sum((F.when(F.expr(a), 1).otherwise(0) for a, _ in CROSS), F.lit(0))
    passed = sum((F.when(F.expr(f"{a} AND ({p})"), 1).otherwise(0) for a, p in CROSS), F.lit(0))
    age, source = c("id") % 120, F.element_at(F.array(*map(F.lit, MULTIPLIERS)), (c("id") % 4 + 1).cast("int"))
    base = F.when(age < 7, F.least(F.lit(1.0), F.lit(0.8) + 0.1)).when(age > 90, F.lit(0.8) - 0.1).otherwise(0.8)
    times = F.element_at(F.create_map(*(F.lit(x) for kv in MULTIPLIERS.items() for x in kv)), source)
    reliable = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (base + (c("id") % 10) / 10.0) / 2 * times))
    d = items(spark, sf_dir).select("id", full.alias("f"), reliable.alias("s"), F.when(applicable == 0, 0.5).otherwise(passed / applicable).alias("x"))
    total = c("f") * 0.3 + c("s") * 0.25 + F.lit(0.5) * 0.25 + c("x") * 0.2
    return d.select("id", rounded(c("f"), 2).alias("completeness"), rounded(c("s"), 2).alias("reliability"), rounded(c("x"), 2).alias("cross_checks"), rounded(total, 2).alias("confidence"))


@R.add("enrichment_eligible", f"WITH {ITEMS_SQL} SELECT id FROM items WHERE {tag('modernization')} AND (budget IS NULL OR budget = 0 OR budget >= 10000)")
def enrichment_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without a budget or with a large one."""
    b = F.col("budget")
    return items(spark, sf_dir).where(F.array_contains("tags", "modernization") & (b.isNull() | (b == 0) | (b >= 10_000))).select("id")


@R.add("bulk_confirm", f"WITH {SCORED_SQL} SELECT id, CASE WHEN score_confidence >= 0.8 THEN 'confirmed' ELSE 'remaining' END AS state FROM scored")
def bulk_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", F.when(F.col("score_confidence") >= 0.8, "confirmed").otherwise("remaining").alias("state"))
