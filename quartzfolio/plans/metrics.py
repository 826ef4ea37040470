"""Metrics, reviews, trends and anomalies over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzfolio.operators import windows
from quartzfolio.plans.common import ITEMS_SQL, REVENUE, Registry, items, r, rounded, table

R = Registry()

METRIC = {
    "id": "event_id", "seen_at": "ts", "document": "user_id", "kind": "event_type", "tenant": "user_id % 10",
    "accuracy": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE 1.0 - (event_id * 7919 % 1000) / 2000.0 END",
    "extracted": "1 + event_id % 10", "approved": "(1 + event_id % 10) / 2 - (1 + event_id % 10) / 2 % 1", "corrected": "event_id % 3",
    "confidence": "(event_id * 104729 % 1000) / 1000.0", "value": "value", "props": "props",
}
METRIC["accuracy"] = "CASE WHEN event_id % 13 = 0 THEN NULL ELSE 1 - CAST(event_id * 7919 % 1000 AS DOUBLE) / CAST(2000 AS DOUBLE) END"
METRIC["approved"] = "CAST(event_id % 5 AS BIGINT)"
METRIC["confidence"] = "CAST(event_id * 104729 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)"
METRICS_SQL = "m AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in METRIC.items()) + " FROM events)"
AS_OF = "2024-01-31"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{e} AS `{n}`" for n, e in METRIC.items()))


def k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("long")


K_SQL = "CAST(json_extract(props, '$.k') AS BIGINT)"


@R.add("enrichment_sector_stats", f"WITH {METRICS_SQL} SELECT tenant, kind, count(*) AS n, {r('avg(confidence)')} AS mean_confidence, max(seen_at) AS latest, count(DISTINCT {K_SQL}) AS n_keys FROM m GROUP BY ALL")
def enrichment_sector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).groupBy("tenant", "kind").agg(F.count("*").alias("n"), rounded(F.avg("confidence")).alias("mean_confidence"), F.max("seen_at").alias("latest"), F.countDistinct(k()).alias("n_keys"))


@R.add("cache_stats", f"WITH {METRICS_SQL} SELECT kind, count(*) AS n, CAST(sum(extracted) AS BIGINT) AS hits, count(*) FILTER (confidence < 0.2) AS expired, {r('avg(extracted)')} AS mean_hits, min(seen_at) AS oldest, max(seen_at) AS newest FROM m GROUP BY kind")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.sum("extracted").alias("hits"), F.count_if(F.col("confidence") < 0.2).alias("expired"), rounded(F.avg("extracted")).alias("mean_hits"), F.min("seen_at").alias("oldest"), F.max("seen_at").alias("newest"))


@R.add("daily_accuracy", f"WITH {METRICS_SQL} SELECT CAST(seen_at AS DATE) AS day, {r('avg(accuracy)')} AS accuracy, CAST(sum(extracted) AS BIGINT) AS extracted, {r('avg(CASE WHEN extracted > 0 THEN (approved + 0.5 * corrected)::DOUBLE / extracted ELSE 0 END)')} AS approval FROM m GROUP BY 1")
def daily_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.when(F.col("extracted") > 0, (F.col("approved") + 0.5 * F.col("corrected")) / F.col("extracted")).otherwise(0.0)
    return metrics(spark, sf_dir).groupBy(F.to_date("seen_at").alias("day")).agg(rounded(F.avg("accuracy")).alias("accuracy"), F.sum("extracted").alias("extracted"), rounded(F.avg(ratio)).alias("approval"))


@R.add("pattern_effectiveness", f"WITH {METRICS_SQL} SELECT document, CAST(sum(approved) AS BIGINT) AS good, CAST(sum(extracted) AS BIGINT) AS used, {r('sum(approved)::DOUBLE / sum(extracted)')} AS effectiveness, date_diff('day', CAST(max(seen_at) AS DATE), DATE '{AS_OF}') AS age FROM m GROUP BY document HAVING sum(extracted) >= 10")
def pattern_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = metrics(spark, sf_dir).groupBy("document").agg(F.sum("approved").alias("good"), F.sum("extracted").alias("used"), F.max("seen_at").alias("last")).where("used >= 10")
    return g.select("document", "good", "used", rounded(F.col("good") / F.col("used")).alias("effectiveness"), F.datediff(F.lit(AS_OF).cast("date"), F.to_date("last")).cast("long").alias("age"))


@R.add("feedback_summary", f"WITH {METRICS_SQL} SELECT kind, tenant, count(*) AS n, count(*) FILTER (corrected = 0) AS accepted, count(*) FILTER (corrected = 1) AS changed, count(*) FILTER (corrected = 2) AS rejected FROM m GROUP BY ALL")
def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda v: F.count_if(F.col("corrected") == v)
    return metrics(spark, sf_dir).groupBy("kind", "tenant").agg(F.count("*").alias("n"), n(0).alias("accepted"), n(1).alias("changed"), n(2).alias("rejected"))


STATS_SQL = f"""WITH {METRICS_SQL}, p AS (SELECT tenant, count(DISTINCT id) AS runs, avg(confidence) AS mean FROM m WHERE kind = 'purchase' GROUP BY tenant), f AS (SELECT tenant, count(DISTINCT id) AS feedbacks FROM m WHERE kind = 'error' GROUP BY tenant), t AS (SELECT tenant, count(DISTINCT id) AS patterns FROM m WHERE kind = 'view' GROUP BY tenant)"""


@R.add("prioritization_stats_fanout", f"{STATS_SQL} SELECT p.tenant, runs, coalesce(feedbacks, 0) AS feedbacks, coalesce(patterns, 0) AS patterns, {r('mean')} AS mean_confidence FROM p LEFT JOIN f USING (tenant) LEFT JOIN t USING (tenant)")
def prioritization_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side is counted before they meet: what the joined rows would say
    through DISTINCT, without multiplying them."""
    m = metrics(spark, sf_dir)
    p = m.where("kind = 'purchase'").groupBy("tenant").agg(F.countDistinct("id").alias("runs"), rounded(F.avg("confidence")).alias("mean_confidence"))
    f = m.where("kind = 'error'").groupBy("tenant").agg(F.countDistinct("id").alias("feedbacks"))
    t = m.where("kind = 'view'").groupBy("tenant").agg(F.countDistinct("id").alias("patterns"))
    return p.join(f, "tenant", "left").join(t, "tenant", "left").na.fill(0, ["feedbacks", "patterns"])


@R.add("metrics_aggregate", f"WITH {METRICS_SQL} SELECT kind, count(*) AS n, count(DISTINCT document) AS documents, {r('avg(accuracy)')} AS mean_accuracy, CAST(sum(extracted) AS BIGINT) AS extracted, {r('sum(approved)::DOUBLE / nullif(sum(extracted), 0)')} AS effectiveness FROM m GROUP BY GROUPING SETS ((kind), ())")
def metrics_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).rollup("kind").agg(F.count("*").alias("n"), F.countDistinct("document").alias("documents"), rounded(F.avg("accuracy")).alias("mean_accuracy"), F.sum("extracted").alias("extracted"), rounded(F.sum("approved") / F.nullif(F.sum("extracted"), F.lit(0))).alias("effectiveness"))


@R.add("metrics_by_field", "SELECT key AS field, count(*) AS n, CAST(min(CAST(v AS BIGINT)) AS BIGINT) AS low, CAST(max(CAST(v AS BIGINT)) AS BIGINT) AS high FROM (SELECT unnest(json_keys(props)) AS key, json_extract(props, '$.k') AS v FROM events) GROUP BY key")
def metrics_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,bigint>")).alias("field", "v"))
    return pairs.groupBy("field").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


@R.add("accuracy_trend_day", f"WITH {METRICS_SQL} SELECT CAST(seen_at AS DATE) AS day, count(accuracy) AS n, {r('avg(accuracy)')} AS accuracy, {r('avg(confidence)')} AS confidence FROM m WHERE seen_at >= DATE '{AS_OF}' - INTERVAL 14 DAY GROUP BY 1")
def accuracy_trend_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = metrics(spark, sf_dir).where(F.col("seen_at") >= F.date_sub(F.lit(AS_OF).cast("date"), 14))
    return recent.groupBy(F.to_date("seen_at").alias("day")).agg(F.count("accuracy").alias("n"), rounded(F.avg("accuracy")).alias("accuracy"), rounded(F.avg("confidence")).alias("confidence"))


@R.add("accuracy_trend_week", f"WITH {METRICS_SQL} SELECT CAST(seen_at AS DATE) - CAST(dayofweek(seen_at) AS INTEGER) AS week, count(accuracy) AS n, {r('avg(accuracy)')} AS accuracy FROM m GROUP BY 1")
def accuracy_trend_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks start on Sunday."""
    week = F.date_sub(F.to_date("seen_at"), F.dayofweek("seen_at") - 1)
    return metrics(spark, sf_dir).groupBy(week.alias("week")).agg(F.count("accuracy").alias("n"), rounded(F.avg("accuracy")).alias("accuracy"))


@R.add("metrics_summary", f"WITH {METRICS_SQL}, s AS (SELECT tenant, avg(accuracy) FILTER (seen_at >= DATE '{AS_OF}' - INTERVAL 7 DAY) AS recent, avg(accuracy) FILTER (seen_at < DATE '{AS_OF}' - INTERVAL 7 DAY) AS older, count(*) AS n FROM m GROUP BY tenant) SELECT tenant, n, {r('recent')} AS recent, {r('older')} AS older, {r('CASE WHEN older > 0 THEN (recent - older) / older ELSE 0 END')} AS improvement FROM s")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.col("seen_at") >= F.date_sub(F.lit(AS_OF).cast("date"), 7)
    s = metrics(spark, sf_dir).groupBy("tenant").agg(F.count("*").alias("n"), F.avg(F.when(new, F.col("accuracy"))).alias("a"), F.avg(F.when(~new, F.col("accuracy"))).alias("b"))
    return s.select("tenant", "n", rounded(F.col("a")).alias("recent"), rounded(F.col("b")).alias("older"), rounded(F.when(F.col("b") > 0, (F.col("a") - F.col("b")) / F.col("b")).otherwise(0.0)).alias("improvement"))


#: Some days are made odd: rows repeated, less accurate, or rejected.
ODD = "dayofmonth(seen_at) + length(kind)"
ODD_SQL = "day(seen_at) + length(kind)"


@R.add("anomaly_detect", f"""WITH {METRICS_SQL}, o AS (SELECT kind, seen_at, CASE WHEN ({ODD_SQL}) % 13 = 0 THEN accuracy * 0.7::DOUBLE ELSE accuracy END AS accuracy, CASE WHEN ({ODD_SQL}) % 11 = 0 THEN 2 ELSE corrected % 2 END AS corrected, CASE WHEN ({ODD_SQL}) % 17 = 0 THEN 9 ELSE 1 END AS times FROM m),
d AS (SELECT kind, CAST(seen_at AS DATE) AS day, CAST(sum(times) AS BIGINT) AS n, avg(accuracy) AS acc, CAST(sum(times) FILTER (corrected = 2) AS BIGINT) AS rejected FROM o GROUP BY ALL),
b AS (SELECT kind, avg(n) AS mean_n, avg(acc) AS mean_acc FROM d GROUP BY kind)
SELECT d.kind, day, 'accuracy_drop' AS anomaly FROM d JOIN b USING (kind) WHERE acc < mean_acc * 0.85 UNION ALL SELECT d.kind, day, 'volume' FROM d JOIN b USING (kind) WHERE n > 3 * mean_n UNION ALL SELECT kind, day, 'rejections' FROM d WHERE n > 10 AND rejected::DOUBLE / n > 0.3""")
def anomaly_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a kind that stand out from its mean day: accuracy lower by more
    than 15 %, more than three times the volume, over 30 % rejected."""
    odd = lambda n: F.expr(f"({ODD}) % {n} = 0")
    o = metrics(spark, sf_dir).select("kind", "seen_at", F.when(odd(13), F.col("accuracy") * 0.7).otherwise(F.col("accuracy")).alias("accuracy"), F.when(odd(11), 2).otherwise(F.col("corrected") % 2).alias("corrected"), F.when(odd(17), 9).otherwise(1).alias("times"))
    d = o.groupBy("kind", F.to_date("seen_at").alias("day")).agg(F.sum("times").alias("n"), F.avg("accuracy").alias("acc"), F.coalesce(F.sum(F.when(F.col("corrected") == 2, F.col("times"))), F.lit(0)).alias("rejected"))
    w = Window.partitionBy("kind")
    d = d.withColumns({"mean_n": F.avg("n").over(w), "mean_acc": F.avg("acc").over(w)})
    found = F.array_compact(F.array(
        F.when(F.col("acc") < F.col("mean_acc") * 0.85, "accuracy_drop"), F.when(F.col("n") > 3 * F.col("mean_n"), "volume"), F.when((F.col("n") > 10) & (F.col("rejected") / F.col("n") > 0.3), "rejections"),
    ))
    return d.select("kind", "day", F.explode(found).alias("anomaly"))


@R.add("review_tier_summary", f"WITH {METRICS_SQL}, t AS (SELECT *, CASE WHEN confidence >= 0.9 THEN 'auto_accept' WHEN confidence >= 0.7 THEN 'quick_review' WHEN confidence >= 0.5 THEN 'manual_review' ELSE 'deep_review' END AS tier FROM m) SELECT tier, kind, count(*) AS n, {r('avg(confidence)')} AS mean_confidence FROM t GROUP BY GROUPING SETS ((tier), (kind), ())")
def review_tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics(spark, sf_dir).withColumn("tier", windows.review_tier(F.col("confidence")))
    return t.groupingSets([["tier"], ["kind"], []], "tier", "kind").agg(F.count("*").alias("n"), rounded(F.avg("confidence")).alias("mean_confidence"))


PRIORITY_SQL = "CAST(greatest(1, least(10, 5 + CASE WHEN confidence < 0.5 THEN 3 WHEN confidence < 0.7 THEN 1 ELSE 0 END + CASE WHEN extracted >= 8 THEN 2 WHEN extracted >= 6 THEN 1 ELSE 0 END + CASE WHEN approved >= 4 THEN 1 ELSE 0 END)) AS INTEGER)"


@R.add("review_queue", f"WITH {METRICS_SQL} SELECT tenant, id, {PRIORITY_SQL} AS priority, row_number() OVER (PARTITION BY tenant ORDER BY {PRIORITY_SQL} DESC, seen_at, id) AS place FROM m WHERE confidence < 0.9 QUALIFY place <= 20")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = metrics(spark, sf_dir).where("confidence < 0.9").withColumn("priority", windows.review_priority(F.col("confidence"), F.col("extracted"), F.col("approved") * 2))
    return windows.top_per_group(waiting, ["tenant"], [F.desc("priority"), "seen_at", "id"], 20).select("tenant", "id", F.col("priority").cast("int").alias("priority"), "place")


@R.add("latest_row", "SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])


@R.add("paging", "SELECT p_partkey, p_name, CAST(ceil(count(*) OVER () / 20.0) AS BIGINT) AS pages FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty; the number of pages comes from a count."""
    parts = table(spark, sf_dir, "part")
    pages = parts.agg(F.ceil(F.count("*") / 20).alias("pages"))
    page = parts.orderBy(F.desc("p_retailprice"), "p_partkey").offset(40).limit(20)
    return page.crossJoin(F.broadcast(pages)).select("p_partkey", "p_name", "pages")  # one row


SAMPLE_SQL = f"""{METRICS_SQL}, s AS (SELECT id, kind AS category, confidence, CASE WHEN confidence < 0.6 THEN 'low' WHEN confidence < 0.8 THEN 'medium' ELSE 'high' END AS stratum FROM m),
c AS (SELECT *, row_number() OVER (PARTITION BY stratum, category ORDER BY confidence, id) AS rn FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY CASE WHEN rn = 1 THEN 0 ELSE 1 END, confidence, id) AS place FROM c)"""


@R.add("stratified_sample", f"WITH {SAMPLE_SQL} SELECT stratum, category, id, confidence, place FROM p WHERE place <= CASE stratum WHEN 'low' THEN 6 WHEN 'medium' THEN 5 ELSE 4 END")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    s = metrics(spark, sf_dir).select("id", F.col("kind").alias("category"), "confidence", F.when(c < 0.6, "low").when(c < 0.8, "medium").otherwise("high").alias("stratum"))
    return windows.stratified(s, {"low": 6, "medium": 5, "high": 4}).select("stratum", "category", "id", "confidence", "place")


@R.add("confidence_ema", f"""WITH RECURSIVE {METRICS_SQL}, o AS (SELECT document, confidence, row_number() OVER (PARTITION BY document ORDER BY seen_at, id) AS n FROM m),
f(document, n, state) AS (SELECT document, 0::BIGINT, 0.5::DOUBLE FROM (SELECT DISTINCT document FROM m) UNION ALL SELECT f.document, f.n + 1, 0.3::DOUBLE * o.confidence + 0.7::DOUBLE * f.state FROM f JOIN o ON o.document = f.document AND o.n = f.n + 1)
SELECT document, {r('arg_max(state, n)')} AS state FROM f GROUP BY document""")
def confidence_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = (F.lit(0.7), 0.3 * F.col("confidence"), F.lit(float("-inf")), F.lit(float("inf")))
    out = windows.fold_maps(metrics(spark, sf_dir), ["document"], ["seen_at", "id"], line, 0.5)
    return out.select("document", rounded(F.col("state")).alias("state"))


@R.add("progressive_confidence", f"""WITH RECURSIVE {METRICS_SQL}, o AS (SELECT document, kind, CASE WHEN corrected = 0 THEN 0.1 ELSE -0.1 END::DOUBLE AS d, row_number() OVER (PARTITION BY document, kind ORDER BY seen_at, id) AS n FROM m),
f(document, kind, n, state) AS (SELECT DISTINCT document, kind, 0::BIGINT, 0.5::DOUBLE FROM m UNION ALL SELECT f.document, f.kind, f.n + 1, least(0.95::DOUBLE, greatest(0.3::DOUBLE, f.state + o.d)) FROM f JOIN o ON o.document = f.document AND o.kind = f.kind AND o.n = f.n + 1)
SELECT document, kind, {r('arg_max(state, n)')} AS state FROM f GROUP BY ALL""")
def progressive_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = (F.lit(1.0), F.when(F.col("corrected") == 0, 0.1).otherwise(-0.1), F.lit(0.3), F.lit(0.95))
    out = windows.fold_maps(metrics(spark, sf_dir), ["document", "kind"], ["seen_at", "id"], line, 0.5)
    return out.select("document", "kind", rounded(F.col("state")).alias("state"))


@R.add("rate_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, greatest(0, count(*) - 4) AS refused FROM events GROUP BY 1, 2")
def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows of an hour: of each kind four events are let through."""
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", F.greatest(F.lit(0).cast("long"), F.col("n") - 4).alias("refused"))


@R.add("session_activity", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, no""")
def session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("session_start"), "n")


@R.add("conversation_window", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, count(*) AS messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (back <= 3) AS context FROM t GROUP BY conv_id")
def conversation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of a conversation, and how many it has."""
    c = table(spark, sf_dir, "conversations").withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    line = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))
    g = c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.array_sort(F.collect_list(F.when(F.col("back") <= 3, line))).alias("l"))
    return g.select("conv_id", "messages", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("context"))


@R.add("error_stats", f"WITH {METRICS_SQL} SELECT tenant, count(*) AS n, {r('count(*) / 720.0::DOUBLE')} AS per_hour, max(seen_at) AS latest FROM m WHERE kind = 'error' GROUP BY tenant")
def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).where("kind = 'error'").groupBy("tenant").agg(F.count("*").alias("n"), rounded(F.count("*") / 720.0).alias("per_hour"), F.max("seen_at").alias("latest"))


@R.add("correction_stats", f"""WITH {METRICS_SQL}, f AS (SELECT id, unnest(list_filter([CASE WHEN id % 2 = 0 THEN 'name' END, CASE WHEN id % 3 = 0 THEN 'vendor' END, CASE WHEN id % 5 = 0 THEN 'category' END], lambda x: x IS NOT NULL)) AS field FROM m) SELECT field, count(*) AS n FROM f GROUP BY field""")
def correction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array_compact(F.array(*(F.when(F.col("id") % n == 0, name) for name, n in (("name", 2), ("vendor", 3), ("category", 5)))))
    return metrics(spark, sf_dir).select(F.explode(fields).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@R.add("confidence_distribution", f"WITH {METRICS_SQL} SELECT tenant, count(*) FILTER (confidence < 0.6) AS low, count(*) FILTER (confidence >= 0.6 AND confidence < 0.8) AS medium, count(*) FILTER (confidence >= 0.8) AS high, {r('sum(confidence * extracted) / sum(extracted)')} AS blended FROM m GROUP BY tenant")
def confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    return metrics(spark, sf_dir).groupBy("tenant").agg(F.count_if(c < 0.6).alias("low"), F.count_if((c >= 0.6) & (c < 0.8)).alias("medium"), F.count_if(c >= 0.8).alias("high"), rounded(F.sum(c * F.col("extracted")) / F.sum("extracted")).alias("blended"))


@R.add("field_accuracy_zip", f"""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax FROM lineitem),
p AS (SELECT 'quantity' AS field, l_quantity AS a, CASE WHEN l_partkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END AS b FROM o UNION ALL SELECT 'discount', l_discount, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount END FROM o UNION ALL SELECT 'tax', l_tax, l_tax FROM o)
SELECT field, count(*) AS total, count(*) FILTER (a IS NOT DISTINCT FROM b) AS unchanged, {r('count(*) FILTER (a IS NOT DISTINCT FROM b)::DOUBLE / count(*)')} AS accuracy FROM p WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY field""")
def field_accuracy_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of unchanged values of each field; a corrected row is beside its
    original, so that nothing is joined."""
    o = table(spark, sf_dir, "lineitem")
    pairs = {"quantity": F.when(F.col("l_partkey") % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")), "discount": F.when(F.col("l_partkey") % 5 != 0, F.col("l_discount")), "tax": F.col("l_tax")}
    long = o.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"l_{n}").alias("a"), c.alias("b")) for n, c in pairs.items()))).alias("x")).select("x.*").where("a IS NOT NULL OR b IS NOT NULL")
    same = F.count_if(F.col("a").eqNullSafe(F.col("b")))
    return long.groupBy("field").agg(F.count("*").alias("total"), same.alias("unchanged"), rounded(same / F.count("*")).alias("accuracy"))


@R.add("budget_rollup", f"SELECT o_orderkey, CAST(total AS DOUBLE) AS children, o_totalprice AS parent FROM (SELECT l_orderkey, sum({REVENUE}) AS total FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey WHERE CAST(total AS DOUBLE) > o_totalprice * 1.05::DOUBLE")
def budget_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.expr(REVENUE)).alias("total"))
    return child.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.col("total").cast("double").alias("children"), F.col("o_totalprice").alias("parent")).where("children > parent * CAST(1.05 AS DOUBLE)")


@R.add("owner_capacity", f"WITH {ITEMS_SQL} SELECT owner, count(*) AS n, count(*) FILTER (risk IN ('critical', 'high')) AS urgent FROM items GROUP BY owner HAVING count(*) FILTER (risk IN ('critical', 'high')) > 5")
def owner_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("owner").agg(F.count("*").alias("n"), F.count_if(F.col("risk").isin("critical", "high")).alias("urgent")).where("urgent > 5")


@R.add("same_name_groups", f"WITH {ITEMS_SQL} SELECT lower(trim(name)) AS key, count(*) AS n, min(id) AS first_id, 0.8::DOUBLE AS confidence FROM items GROUP BY 1 HAVING count(*) > 1")
def same_name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = items(spark, sf_dir).groupBy(F.lower(F.trim("name")).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return g.where("n > 1").withColumn("confidence", F.lit(0.8))


@R.add("date_consistency", "SELECT o_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def date_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are shipped before their order."""
    both = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.where("l_shipdate < o_orderdate").select("o_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"))
