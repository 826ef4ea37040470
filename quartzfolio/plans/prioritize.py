"""Triage, scores, matrix, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzfolio.operators import budget, rules, scoring
from quartzfolio.operators.windows import running_sum
from quartzfolio.plans.common import ITEMS_SQL, Registry, items, r, rounded, tag

R = Registry()

TRIAGE_SQL = f"""{ITEMS_SQL},
matched AS (SELECT *, CASE
  WHEN {tag('compliance')} THEN 1 WHEN {tag('security')} AND risk = 'critical' THEN 2 WHEN lower(category) LIKE '%infrastructure%' AND risk = 'critical' THEN 3
  WHEN alignment >= 8 AND business_value >= 8 THEN 4 WHEN lifecycle = 'end_of_life' THEN 5 WHEN lifecycle = 'deprecated' THEN 6 WHEN active_users = 0 THEN 7
  WHEN {tag('duplicate')} THEN 8 WHEN status = 'outdated' THEN 9 WHEN alignment >= 7 THEN 10 WHEN business_value >= 7 THEN 11
  WHEN lower(category) LIKE '%customer%' AND active_users >= 100 THEN 12 WHEN business_value >= 4 AND business_value < 7 THEN 13 WHEN {tag('tech-debt')} THEN 14 END AS no FROM items),
rules(no, rule, category_, confidence) AS (VALUES {", ".join(f"({i}, '{x.name}', '{x.category}', {x.confidence}::DOUBLE)" for i, x in enumerate(rules.TRIAGE_RULES, 1))}),
triaged AS (SELECT matched.*, CASE WHEN confidence >= 0.7 THEN rule END AS triage_rule, CASE WHEN confidence >= 0.7 THEN category_ ELSE 'UNKNOWN' END AS triage,
  CASE WHEN confidence >= 0.7 THEN confidence ELSE 0.3::DOUBLE END AS triage_confidence FROM matched LEFT JOIN rules USING (no))"""

S10 = "(CASE WHEN {0} IS NULL THEN 5.0 WHEN {0} <= 0 THEN 1.0 WHEN {0} >= 10 THEN 10.0 ELSE floor({0} + 0.5) END)::DOUBLE"
TENTH = "(CASE WHEN {0} IS NULL OR {0} = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, {0} / 10.0::DOUBLE) END)"
SCORED_SQL = f"""{TRIAGE_SQL},
s1 AS MATERIALIZED (SELECT *,
  {r(f'''(least(10.0, {S10.format('business_value')} + CASE WHEN alignment >= 8 THEN 1 ELSE 0 END)
    + least(10.0, CASE triage WHEN 'MUST' THEN 9 WHEN 'SHOULD' THEN 7 WHEN 'COULD' THEN 4 WHEN 'WONT' THEN 2 ELSE 5 END + CASE WHEN phase = 1 THEN 2 ELSE 0 END)
    + CASE risk WHEN 'critical' THEN 2 WHEN 'high' THEN 5 WHEN 'medium' THEN 7 WHEN 'low' THEN 9 ELSE 7 END)::DOUBLE
    / greatest(1.0::DOUBLE, CASE WHEN cost > 0 AND budget > 0 THEN greatest(1.0::DOUBLE, least(10.0::DOUBLE, floor(cost / budget * 5 + 3 + 0.5)))
      ELSE CASE complexity WHEN 'low' THEN 3 WHEN 'medium' THEN 5 WHEN 'high' THEN 8 ELSE 5 END END)''', 2)} AS wsjf,
  (CASE WHEN alignment IS NOT NULL THEN floor(({S10.format('business_value')} + {S10.format('alignment')}) / 2 + 0.5) ELSE {S10.format('business_value')} END
    * least(10, CASE risk WHEN 'critical' THEN 4 WHEN 'high' THEN 5 WHEN 'low' THEN 9 ELSE 7 END + CASE WHEN triage_confidence >= 0.8 THEN 1 ELSE 0 END)
    * CASE WHEN n_dependencies > 3 THEN greatest(1, CASE complexity WHEN 'low' THEN 9 WHEN 'high' THEN 2 ELSE 5 END - 2) ELSE CASE complexity WHEN 'low' THEN 9 WHEN 'high' THEN 2 ELSE 5 END END)::DOUBLE AS ice,
  {r(f'''least(1.0::DOUBLE, (CASE lifecycle WHEN 'growth' THEN 0.9 WHEN 'mature' THEN 0.6 WHEN 'decline' THEN 0.2 WHEN 'end_of_life' THEN 0.2 ELSE 0.5 END)::DOUBLE + CASE WHEN alignment >= 8 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) * 0.2::DOUBLE
    + (CASE WHEN lifecycle = 'end_of_life' THEN 0.1 WHEN {tag('modernization')} THEN 0.8 ELSE 0.5 END)::DOUBLE * 0.1::DOUBLE
    + least(1.0::DOUBLE, {TENTH.format('business_value')} + CASE WHEN roi > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) * 0.2::DOUBLE
    + {TENTH.format('alignment')} * 0.2::DOUBLE
    + (CASE WHEN cost > budget AND budget > 0 THEN greatest(0.0::DOUBLE, (CASE complexity WHEN 'low' THEN 0.8 WHEN 'high' THEN 0.2 ELSE 0.5 END)::DOUBLE - 0.3::DOUBLE) ELSE (CASE complexity WHEN 'low' THEN 0.8 WHEN 'high' THEN 0.2 ELSE 0.5 END)::DOUBLE END) * 0.1::DOUBLE
    + (CASE risk WHEN 'low' THEN 0.9 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.3 WHEN 'critical' THEN 0.1 ELSE 0.5 END)::DOUBLE * 0.1::DOUBLE
    + (CASE WHEN {tag('commodity')} THEN 0.3 WHEN {tag('differentiator')} THEN 0.9 ELSE 0.5 END)::DOUBLE * 0.1::DOUBLE''', 3)} AS retention
  FROM triaged),
s2 AS MATERIALIZED (SELECT *, CASE WHEN triage = 'WONT' THEN 'wont_have' WHEN triage = 'MUST' OR wsjf > 3 THEN 'must_have' WHEN triage = 'SHOULD' OR wsjf >= 2 THEN 'should_have' WHEN triage = 'COULD' OR wsjf >= 1 THEN 'could_have' ELSE 'wont_have' END AS moscow,
  {r("least(100.0::DOUBLE, wsjf / 5 * 100) * 0.4::DOUBLE + least(100.0::DOUBLE, ice / 10) * 0.3::DOUBLE + retention * 100 * 0.3::DOUBLE", 1)} AS score FROM s1),
scored AS MATERIALIZED (SELECT *, CASE WHEN moscow = 'wont_have' AND retention < 0.4 THEN 'eliminate' WHEN score >= 70 OR moscow = 'must_have' THEN 'invest' WHEN score >= 50 AND retention >= 0.5 THEN 'maintain' WHEN score >= 40 OR retention >= 0.4 THEN 'optimize' ELSE 'eliminate' END AS recommendation,
  {r("least(1.0::DOUBLE, 0.6::DOUBLE + CASE WHEN business_value IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN alignment IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN risk IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN triage_confidence > 0.7 THEN 0.1::DOUBLE ELSE 0 END)", 2)} AS score_confidence FROM s2)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(rules.triage(items(spark, sf_dir)))


@R.add("triage_rules", f"WITH {TRIAGE_SQL} SELECT id, triage_rule, triage, triage_confidence FROM triaged")
def triage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.triage(items(spark, sf_dir)).select("id", "triage_rule", "triage", "triage_confidence")


@R.add("prioritize_parts", f"WITH {SCORED_SQL} SELECT id, name, triage, wsjf, ice, retention, moscow, score, recommendation, score_confidence FROM scored")
def prioritize_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", "name", "triage", "wsjf", "ice", "retention", "moscow", "score", "recommendation", "score_confidence")


@R.add("triage_breakdown", f"""WITH {TRIAGE_SQL}, kinds(triage) AS (VALUES ('MUST'), ('SHOULD'), ('COULD'), ('WONT'), ('UNKNOWN'))
SELECT kinds.triage, count(id) AS n, {r('avg(triage_confidence)')} AS mean_confidence FROM kinds LEFT JOIN triaged ON triaged.triage = kinds.triage GROUP BY 1""")
def triage_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.range(1).select(F.explode(F.array(*map(F.lit, ("MUST", "SHOULD", "COULD", "WONT", "UNKNOWN")))).alias("triage"))
    n = rules.triage(items(spark, sf_dir)).groupBy("triage").agg(F.count("*").alias("n"), rounded(F.avg("triage_confidence")).alias("mean_confidence"))
    return kinds.join(n, "triage", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@R.add("moscow_distribution", f"""WITH {SCORED_SQL} SELECT moscow, recommendation, count(*) AS n, count(*) FILTER (score >= 80) AS n80, count(*) FILTER (score >= 60 AND score < 80) AS n60,
count(*) FILTER (score >= 40 AND score < 60) AS n40, count(*) FILTER (score < 40) AS n0, {r('avg(score)', 3)} AS mean_score FROM scored GROUP BY ALL""")
def moscow_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    return scored(spark, sf_dir).groupBy("moscow", "recommendation").agg(
        F.count("*").alias("n"), F.count_if(s >= 80).alias("n80"), F.count_if((s >= 60) & (s < 80)).alias("n60"), F.count_if((s >= 40) & (s < 60)).alias("n40"), F.count_if(s < 40).alias("n0"), rounded(F.avg(s), 3).alias("mean_score")
    )


@R.add("decision_matrix", f"""WITH {SCORED_SQL}, m AS (SELECT *, 100 - 10.0::DOUBLE * CASE complexity WHEN 'low' THEN 9 WHEN 'high' THEN 2 ELSE 5 END AS effort FROM scored),
q AS (SELECT *, CASE WHEN score >= 60 AND effort < 50 THEN 'quick_wins' WHEN score >= 60 THEN 'major_projects' WHEN effort < 50 THEN 'fill_ins' ELSE 'thankless' END AS quadrant FROM m)
SELECT quadrant, id, score, effort, row_number() OVER (PARTITION BY quadrant ORDER BY score DESC, effort, id) AS place FROM q QUALIFY place <= 10""")
def decision_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best items of each quadrant. A partial top ten of every bucket of
    ids comes first, so that no task ranks a whole quadrant."""
    order = [F.desc("score"), "effort", "id"]
    m = scoring.matrix(scored(spark, sf_dir)).select("quadrant", "id", "score", "effort", F.pmod(F.xxhash64("id"), F.lit(64)).alias("bucket"))
    some = m.withColumn("n", F.row_number().over(Window.partitionBy("quadrant", "bucket").orderBy(*order))).where("n <= 10")
    best = some.withColumn("place", F.row_number().over(Window.partitionBy("quadrant").orderBy(*order)).cast("long")).where("place <= 10")
    return best.select("quadrant", "id", "score", "effort", "place")


@R.add("composite_topk", f"WITH {SCORED_SQL} SELECT id, score, wsjf FROM scored ORDER BY score DESC, wsjf DESC, id LIMIT 25")
def composite_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", "score", "wsjf").orderBy(F.desc("score"), F.desc("wsjf"), "id").limit(25)


LOCAL_SQL = f"""{ITEMS_SQL}, l AS (SELECT id, vendor, coalesce(business_value, 5) * 10 AS value, coalesce(alignment, 5) * 10 AS fit, CASE risk WHEN 'low' THEN 90 WHEN 'medium' THEN 60 WHEN 'high' THEN 30 WHEN 'critical' THEN 10 ELSE 50 END AS safety,
  CASE complexity WHEN 'low' THEN 90 WHEN 'medium' THEN 60 WHEN 'high' THEN 30 ELSE 50 END AS ease, CASE lifecycle WHEN 'growth' THEN 90 WHEN 'mature' THEN 70 WHEN 'active' THEN 60 WHEN 'decline' THEN 30 ELSE 10 END AS timing, budget FROM items),
w AS (SELECT *, {r('(8 * fit + 9 * value + 5 * safety + 7 * ease + 6 * timing) / 35.0::DOUBLE', 1)} AS overall FROM l)"""


def local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.local_assessment(items(spark, sf_dir))


@R.add("local_assessment", f"""WITH {LOCAL_SQL} SELECT vendor, id, overall, CASE WHEN overall >= 80 THEN 'accelerate' WHEN overall >= 60 THEN 'keep' WHEN overall >= 40 THEN 'optimize' WHEN overall >= 25 THEN 'pause' ELSE 'stop' END AS recommendation,
row_number() OVER (PARTITION BY vendor ORDER BY overall DESC, id) AS ranking FROM w""")
def local_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = local(spark, sf_dir).withColumn("one", F.lit(1).cast("long"))
    ranked = running_sum(rows, ["vendor"], F.floor(-F.col("overall")), [F.desc("overall"), "id"], "one", "ranking")
    return ranked.select("vendor", "id", "overall", "recommendation", "ranking")


@R.add("budget_waterfall", f"""WITH {LOCAL_SQL}, shares(scenario, share) AS (VALUES ('conservative', 0.75::DOUBLE), ('balanced', 0.9::DOUBLE), ('aggressive', 0.98::DOUBLE)),
c AS (SELECT vendor, CAST(floor(sum(CAST(budget AS DECIMAL(18,2))) * 0.4) AS BIGINT) AS total FROM l GROUP BY vendor),
a AS (SELECT scenario, vendor, id, CAST(floor(budget * CASE WHEN overall >= 80 THEN 1.0 WHEN overall >= 60 THEN 0.9 WHEN overall >= 40 THEN 0.7 ELSE 0.4 END::DOUBLE) AS BIGINT) AS want, CAST(floor(total * share) AS BIGINT) AS cap, overall FROM w JOIN c USING (vendor) CROSS JOIN shares),
p AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY scenario, vendor ORDER BY overall DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT scenario, vendor, id, want, CAST(greatest(0, least(want, cap - before)) AS BIGINT) AS given FROM p""")
def budget_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.waterfall(local(spark, sf_dir))


@R.add("quarterly_plan", """WITH o AS (SELECT c_mktsegment AS segment, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
d(i, share) AS (VALUES (0, 0.25::DOUBLE), (1, 0.2::DOUBLE), (2, 0.2::DOUBLE), (3, 0.15::DOUBLE), (4, 0.1::DOUBLE), (5, 0.1::DOUBLE)), q AS (SELECT segment, i, CAST(floor(total * share + 0.5) AS BIGINT) AS planned FROM o CROSS JOIN d)
SELECT segment, i + 1 AS quarter, planned, CAST(sum(planned) OVER (PARTITION BY segment ORDER BY i) AS BIGINT) AS cumulative FROM q""")
def quarterly_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.quarterly(spark, sf_dir)


@R.add("greedy_selection")
def greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each vendor by score for cost, skipping what doesn't fit."""
    s = scored(spark, sf_dir).select("vendor", "id", "score", F.when(F.col("cost") == 0, 50_000.0).otherwise(F.col("cost")).alias("cost"))
    return budget.greedy(s, "vendor", 100_000.0)


@R.add("knapsack_selection")
def knapsack_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best set of items of each vendor within a budget."""
    s = scored(spark, sf_dir).select("vendor", "id", "score", F.when(F.col("cost") == 0, 50_000.0).otherwise(F.col("cost")).alias("cost"))
    return budget.knapsack(s, "vendor", 100_000.0)


@R.add("diversification_index", f"""WITH {SCORED_SQL}, v AS (SELECT vendor, count(*) AS n, count(DISTINCT moscow) AS m, count(DISTINCT recommendation) AS k, max(score) - min(score) AS spread FROM scored GROUP BY vendor)
SELECT vendor, n, CASE WHEN n = 1 THEN 0.5 ELSE {r('0.3::DOUBLE * m / 4 + 0.3::DOUBLE * k / 4 + 0.2::DOUBLE * spread / 100 + 0.2::DOUBLE * least(1.0::DOUBLE, n / 10.0::DOUBLE)')} END AS diversification FROM v""")
def diversification_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scored(spark, sf_dir).groupBy("vendor").agg(F.count("*").alias("n"), F.countDistinct("moscow").alias("m"), F.countDistinct("recommendation").alias("k"), (F.max("score") - F.min("score")).alias("spread"))
    d = F.lit(0.3) * F.col("m") / 4 + F.lit(0.3) * F.col("k") / 4 + F.lit(0.2) * F.col("spread") / 100 + F.lit(0.2) * F.least(F.lit(1.0), F.col("n") / 10.0)
    return v.select("vendor", "n", F.when(F.col("n") == 1, 0.5).otherwise(rounded(d)).alias("diversification"))


@R.add("category_coverage", f"WITH {SCORED_SQL} SELECT category, count(*) AS n, count(*) FILTER (recommendation = 'invest') AS selected, {r('avg(CASE WHEN recommendation = ' + chr(39) + 'invest' + chr(39) + ' THEN 1.0::DOUBLE ELSE 0 END)')} AS coverage FROM scored GROUP BY category")
def category_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.col("recommendation") == "invest"
    return scored(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.count_if(chosen).alias("selected"), rounded(F.avg(F.when(chosen, 1.0).otherwise(0.0))).alias("coverage"))


@R.add("must_have_enforcement", f"""WITH {SCORED_SQL}, chosen AS (SELECT * FROM scored WHERE score >= 60), forced AS (SELECT * FROM scored s WHERE moscow = 'must_have' AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.id = s.id))
SELECT id, 'selected' AS how FROM chosen UNION ALL SELECT id, 'forced' FROM forced""")
def must_have_enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.settled(scored(spark, sf_dir))
    chosen = s.where("score >= 60")
    forced = s.where("moscow = 'must_have'").join(chosen, "id", "left_anti")
    return chosen.select("id", F.lit("selected").alias("how")).unionByName(forced.select("id", F.lit("forced").alias("how")))
