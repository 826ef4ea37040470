"""Validation, quality gates, noise, completeness and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfolio.operators import quality
from quartzfolio.operators.quality import issue
from quartzfolio.plans.common import ITEMS_SQL, Registry, items, r, rounded, table

R = Registry()

#: field, message, severity, and the condition, which both engines read alike.
CHECKS = (
    ("business_value", "missing", "critical", "business_value IS NULL"), ("alignment", "missing", "warning", "alignment IS NULL"), ("risk", "missing", "warning", "risk IS NULL"),
    ("complexity", "missing", "info", "complexity IS NULL"), ("budget", "above 50000", "warning", "budget > 50000"), ("cost", "zero", "info", "cost = 0"), ("cost", "over budget", "warning", "cost > budget"),
    ("lifecycle", "ended but active", "critical", "lifecycle = 'end_of_life' AND status = 'active'"), ("active_users", "none", "warning", "active_users = 0"), ("name", "too long", "warning", "length(name) > 40"),
    ("risk", "critical and cheap", "critical", "risk = 'critical' AND budget < 8000"),
)


def found() -> Column:
    return quality.issues(*(issue(F.expr(when), field, message, severity) for field, message, severity, when in CHECKS))


ISSUES_SQL = f"{ITEMS_SQL}, checks AS (" + " UNION ALL ".join(f"SELECT id, '{f}' AS field, '{m}' AS message, '{s}' AS severity FROM items WHERE {w}" for f, m, s, w in CHECKS) + ")"
SCORE_SQL = f"""{ISSUES_SQL}, c AS (SELECT id, sum(CASE severity WHEN 'critical' THEN 25 WHEN 'warning' THEN 10 ELSE 2 END) AS lost, count(*) FILTER (severity = 'critical') AS critical FROM checks GROUP BY id),
scores AS (SELECT items.id, category, CAST(greatest(0, 100 - coalesce(lost, 0)) AS INTEGER) AS score, coalesce(critical, 0) AS critical FROM items LEFT JOIN c USING (id))"""


@R.add("validation_issues", f"WITH {ISSUES_SQL} SELECT * FROM checks")
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", F.explode(found()).alias("i")).select("id", "i.*")


@R.add("item_quality", f"WITH {SCORE_SQL} SELECT id, score, score >= 60 AND critical = 0 AS passed, critical > 0 OR score < 40 AS needs_review FROM scores")
def item_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).select("id", found().alias("issues")).withColumn("score", quality.score(F.col("issues")))
    critical = F.exists("issues", lambda x: x["severity"] == "critical")
    return i.select("id", "score", ((F.col("score") >= 60) & ~critical).alias("passed"), (critical | (F.col("score") < 40)).alias("needs_review"))


@R.add("quality_batch", f"WITH {SCORE_SQL} SELECT category, count(*) AS n, count(*) FILTER (score >= 60 AND critical = 0) AS passed, count(*) FILTER (critical > 0 OR score < 40) AS review, {r('avg(score)')} AS mean_score FROM scores GROUP BY category")
def quality_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).select("category", found().alias("issues")).withColumn("score", quality.score(F.col("issues")))
    critical = F.exists("issues", lambda x: x["severity"] == "critical")
    return i.groupBy("category").agg(F.count("*").alias("n"), F.count_if((F.col("score") >= 60) & ~critical).alias("passed"), F.count_if(critical | (F.col("score") < 40)).alias("review"), rounded(F.avg("score")).alias("mean_score"))


@R.add("common_issues", f"WITH {ISSUES_SQL} SELECT field, message, severity, count(*) AS n FROM checks GROUP BY ALL ORDER BY n DESC, field, message LIMIT 10")
def common_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation_issues(spark, sf_dir).groupBy("field", "message", "severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field", "message").limit(10)


GATES = (("confidence", "confidence", ">=", 0.6, True), ("completeness", "completeness", ">=", 0.7, True), ("budget", "budget", "<=", 60000.0, False), ("users", "active_users", ">", 10.0, False), ("fit", "alignment", "==", 5.0, False))
COMPLETE_SQL = "(0.7::DOUBLE * ((name <> '')::INT + (vendor <> '')::INT) / 2 + 0.3::DOUBLE * ((business_value IS NOT NULL)::INT + (alignment IS NOT NULL)::INT + (risk IS NOT NULL)::INT + (complexity IS NOT NULL)::INT + (cost > 0)::INT) / 5)"


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = F.when(F.col("cost") > 0, F.col("cost"))
    complete = 0.7 * quality.filled("name", "vendor") / 2 + 0.3 * quality.filled("business_value", "alignment", "risk", "complexity", "costs") / 5
    return items(spark, sf_dir).withColumn("costs", costs).withColumns({"completeness": complete, "confidence": F.expr("CAST(id * 7919 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)")})


GATE_TESTS = {"==": "abs({c} - {at}) <= 0.01::DOUBLE"}
GATES_SQL = f"{ITEMS_SQL}, m AS (SELECT *, {COMPLETE_SQL} AS completeness, CAST(id * 7919 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS confidence FROM items)"


@R.add("quality_gate_eval", f"WITH {GATES_SQL} SELECT id, " + ", ".join(f"coalesce({GATE_TESTS.get(s, '{c} ' + s + ' {at}::DOUBLE').format(c=c, at=at)}, false) AS {n}" for n, c, s, at, _ in GATES) + f", coalesce(confidence >= 0.6::DOUBLE, false) AND coalesce(completeness >= 0.7::DOUBLE, false) AS passed FROM m")
def quality_gate_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gate of every item; only the blocking ones decide."""
    tests = {n: quality.gate(F.col(c), s, at) for n, c, s, at, _ in GATES}
    passed = F.lit(True)
    for n, _, _, _, blocking in GATES:
        passed = passed & tests[n] if blocking else passed
    return measured(spark, sf_dir).select("id", *(t.alias(n) for n, t in tests.items()), passed.alias("passed"))


@R.add("completeness", f"WITH {GATES_SQL} SELECT vendor, count(*) AS n, {r('avg(completeness)')} AS completeness, count(*) FILTER (completeness >= 0.99::DOUBLE) AS whole FROM m GROUP BY vendor")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).groupBy("vendor").agg(F.count("*").alias("n"), rounded(F.avg("completeness")).alias("completeness"), F.count_if(F.col("completeness") >= 0.99).alias("whole"))


@R.add("confidence_breakdown", f"WITH {GATES_SQL} SELECT id, {r('least(0.99::DOUBLE, 0.35::DOUBLE * confidence + 0.4::DOUBLE * completeness + 0.15::DOUBLE * CASE WHEN cost > 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END + 0.1::DOUBLE * CASE WHEN n_dependencies > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS confidence FROM m")
def confidence_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, fields, source and context, weighed; 0.99 at most."""
    total = 0.35 * F.col("confidence") + 0.4 * F.col("completeness") + 0.15 * F.when(F.col("cost") > 0, 1.0).otherwise(0.5) + 0.1 * F.when(F.col("n_dependencies") > 0, 1.0).otherwise(0.0)
    return measured(spark, sf_dir).select("id", rounded(F.least(F.lit(0.99), total)).alias("confidence"))


LINES_SQL = "n AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS name, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)"
NOISE_SQL = "coalesce(length(name) < 3 OR length(name) > 300 OR len(string_split_regex(trim(name), ' +')) > 25 OR (length(name) > 100 AND lower(name) = name) OR " + " OR ".join(f"regexp_matches(name, '{p}')" for p in quality.NOISE) + ", true)"


@R.add("noise_filter", f"WITH {LINES_SQL} SELECT doc_id, count(*) AS lines, count(*) FILTER ({NOISE_SQL}) AS noise, CAST(min(line) FILTER (NOT {NOISE_SQL}) AS INTEGER) AS first_name FROM n GROUP BY doc_id")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document are no name of an item, and the first that is."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "name"))
    noise = quality.is_noise(F.col("name"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(noise).alias("noise"), F.min(F.when(~noise, F.col("line"))).alias("first_name"))


CLEAN_SQL = "html"
for _entity, _sign in quality.ENTITIES.items():
    CLEAN_SQL = f"replace({CLEAN_SQL}, '{_entity}', '{_sign.replace(chr(39), chr(39) * 2)}')"
CLEAN_SQL = f"regexp_replace(replace({CLEAN_SQL}, chr(65533), ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"


@R.add("encoding_check", f"SELECT page_id, contains(html, chr(65533)) AS broken, regexp_matches(html, '&(amp|lt|gt|quot|#39|nbsp);') AS entities, length({CLEAN_SQL}) AS n_clean, md5({CLEAN_SQL}) AS clean FROM pages")
def encoding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = quality.cleaned(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.contains("html", F.lit("�")).alias("broken"), F.col("html").rlike("&(amp|lt|gt|quot|#39|nbsp);").alias("entities"), F.length(clean).cast("long").alias("n_clean"), F.md5(clean).alias("clean"))


#: Words that tell a language.
ITALIAN = ("prodotto", "servizio", "prezzo", "descrizione", "categoria", "nome", "codice", "listino", "articolo", "importo", "fornitore", "quantità", "totale", "fattura", "ordine", "cliente", "data")
ENGLISH = ("product", "service", "price", "description", "category", "name", "code", "item", "amount", "total", "vendor", "quantity", "invoice", "order", "customer", "date")
PREFIX_SQL = "CASE doc_id % 5 WHEN 0 THEN 'Prodotto e servizio, prezzo e codice. ' WHEN 1 THEN 'Product name and price, order date. ' WHEN 2 THEN 'nome prodotto: invoice and amount ' ELSE '' END"


@R.add("language_guess", f"WITH w AS (SELECT doc_id, lower({PREFIX_SQL} || coalesce(text, '')) AS t FROM documents), c AS (SELECT doc_id, " + " + ".join(f"contains(t, '{x}')::INT" for x in ITALIAN) + " AS it, " + " + ".join(f"contains(t, '{x}')::INT" for x in ENGLISH) + " AS en FROM w) SELECT doc_id, CASE WHEN it > 2 * en THEN 'it' WHEN en > 2 * it THEN 'en' WHEN it > 0 AND en > 0 THEN 'mixed' ELSE 'en' END AS language FROM c")
def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Italian, English or both, by the words of lists that a text holds."""
    text = F.lower(F.concat(F.expr(PREFIX_SQL), F.coalesce("text", F.lit(""))))
    has = lambda of: sum((F.contains("t", F.lit(w)).cast("int") for w in of), F.lit(0))
    c = table(spark, sf_dir, "documents").select("doc_id", text.alias("t")).select("doc_id", has(ITALIAN).alias("it"), has(ENGLISH).alias("en"))
    it, en = F.col("it"), F.col("en")
    return c.select("doc_id", F.when(it > 2 * en, "it").when(en > 2 * it, "en").when((it > 0) & (en > 0), "mixed").otherwise("en").alias("language"))
