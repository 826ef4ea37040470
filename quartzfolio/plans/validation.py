"""Raw items: rules, corrections, verdicts, and the functions that read their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfolio.operators import validation as va
from quartzfolio.operators.tables import spread
from quartzfolio.plans.common import Registry, r, rounded, table
from quartzfolio.plans.portfolio import case

R = Registry()


def numbered(*values: str) -> dict[int, str]:
    return dict(enumerate(values))


#: Messy items from parts: expressions that both engines read alike.
RAW = {
    "id": "p_partkey", "name": case("p_partkey % 23", numbered("NULL", "''", "'x'", "'test'", "'n/a'", "'---'", "'  ' || p_name || '  '", "upper(p_name)", "'xxx item'", "'TBD'", "'Aaaaaargh item'", "'Demo product'", "'   '"), "p_name"),
    "description": case("p_partkey % 19", numbered("NULL", "'lorem ipsum dolor'", "'budget: 12.500 euro'", "'€ 40k all in'", "'requires ' || p_name", "'servizio di supporto gestito'", "'progetto di migrazione'", "'prodotto per la piattaforma'", "'about 3,5 mln in total'", "repeat('long ', 1001)"), "'plain text'"),
    "vendor": case("p_partkey % 13", numbered("NULL", "'MSFT'", "'microsoft corp'", "'AWS'", "'sap se'", "'HP'", "'X'", "' Oracle Corp '", "'test vendor'"), "p_brand"),
    "category": case("p_partkey % 11", numbered("NULL", "'Security'", "'data-analytics'", "'cloud'", "'X'", "'ERP systems'", "'professional services'", "'networkin'"), "p_type"),
    "price": case("p_partkey % 7", numbered("'€ 1.234,56'", "'$2,345.60'", "'12k'", "'150M'", "'n/a'", "'-5'"), "CAST(p_size AS STRING)"), "budget": case("p_partkey % 6", numbered("'100.000 €'", "'250k'", "''", "NULL", "'-1000'"), "CAST(p_size * 10 AS STRING)"),
    "quantity": "CAST(p_size AS STRING)", "owner": case("p_partkey % 14", numbered("'J'", "NULL"), "'owner ' || p_brand"),
    "status": case("p_partkey % 10", numbered("'Attivo'", "'in corso'", "'active'", "'bozza '", "'weird'", "NULL", "'sospeso'", "'activ'"), "'completed'"), "priority": case("p_partkey % 9", numbered("'alta'", "'1'", "'Urgent'", "'very high'", "NULL", "'zzz'", "'critical'"), "'medium'"),
    "type": case("p_partkey % 8", numbered("'prodotto'", "'Service'", "'software'", "'consulting'", "NULL", "'thing'", "'servizio'"), "'product'"), "sku": case("p_partkey % 5", numbered("NULL", "'AB 12'", "'A-1_2/3.x'"), "'SKU' || CAST(p_partkey AS STRING)"),
    "start_date": case("p_partkey % 15", numbered("'soon'", "NULL", "'2024-12-01'"), "'2024-03-01'"), "end_date": case("p_partkey % 16", numbered("'2023-01-01'", "NULL", "'later'"), "'2025-06-30'"), "users": "p_partkey * 37 % 500 - 3",
    "lifecycle": "CASE p_partkey % 4 WHEN 0 THEN 'end_of_life' ELSE 'growth' END",
}
RAW_SQL = "raw AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in RAW.items()) + " FROM part)"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part")).selectExpr(*(f"{e} AS {n}" for n, e in RAW.items()))


def words(of) -> str:
    return "[" + ", ".join(f"'{w}'" for w in of) + "]"


def enum_sql(c: str, allowed) -> str:
    v = f"lower(trim({c}))"
    cases = " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in va.MEANING.items() if m in allowed)
    return f"CASE WHEN {v} = '' THEN NULL ELSE coalesce(CASE {v} {cases} END, CASE WHEN list_contains({words(allowed)}, {v}) THEN {v} END, list_filter({words(allowed)}, lambda a: contains(a, {v}) OR contains({v}, a))[1]) END"


#: SQL of a price text: symbols off, Italian or English decimals, k and m.
PRICE_PLAIN = "regexp_replace(lower(coalesce({0}, '')), '[€$£\\s]|eur|usd|gbp', '', 'g')"


def price_sql(c: str) -> str:
    p = PRICE_PLAIN.format(c)
    bare = f"regexp_replace({p}, '[km]$', '')"
    digits = f"CASE WHEN regexp_matches({bare}, ',\\d{{1,2}}$') THEN replace(replace({bare}, '.', ''), ',', '.') WHEN regexp_matches({bare}, '\\.\\d{{1,2}}$') THEN replace({bare}, ',', '') ELSE regexp_replace({bare}, '[^0-9-]', '', 'g') END"
    return f"(coalesce(TRY_CAST(regexp_extract({digits}, '^(-?\\d*\\.?\\d+)', 1) AS DOUBLE), 0) * CASE WHEN ends_with({p}, 'k') THEN 1000 WHEN ends_with({p}, 'm') THEN 1000000 ELSE 1 END)"


@R.add("enum_normalize", f"WITH {RAW_SQL} SELECT id, " + ", ".join(f"{enum_sql(f, a)} AS {f}" for f, a in va.ALLOWED.items()) + " FROM raw")
def enum_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("id", *(va.normalized(F.col(f), a).alias(f) for f, a in va.ALLOWED.items()))


def rule_rows() -> str:
    out = []
    full = lambda f: f"coalesce({f} <> '', false)"
    for f, required, least, most in va.LENGTHS:
        if required:
            out.append((f, "required", "error", f"NOT {full(f)}"))
        if least:
            out.append((f, "short", "warning", f"{full(f)} AND length({f}) < {least}"))
        out.append((f, "cut", "warning", f"length({f}) > {most}"))
    for f, most in va.MOST.items():
        out += [(f, "low", "warning", f"{full(f)} AND {price_sql(f)} < 0"), (f, "high", "warning", f"{full(f)} AND {price_sql(f)} > {most}")]
    out.append(("sku", "pattern", "warning", f"{full('sku')} AND NOT regexp_matches(sku, '{va.SKU}')"))
    out.append(("name", "invalid", "error", f"{full('name')} AND (" + " OR ".join(f"regexp_matches(name, '{p}')" for p in va.NO_NAME) + ")"))
    out += [(f, "unknown", "warning", f"{full(f)} AND ({enum_sql(f, a)}) IS NULL") for f, a in va.ALLOWED.items()]
    return " UNION ALL ".join(f"SELECT id, '{f}' AS field, '{k}' AS kind, '{s}' AS severity FROM raw WHERE {w}" for f, k, s, w in out)


RULES_SQL = f"{RAW_SQL}, found AS ({rule_rows()})"


@R.add("validate_items", f"WITH {RULES_SQL} SELECT * FROM found")
def validate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of raw items by the thirteen rules."""
    return raw(spark, sf_dir).select("id", F.inline(va.rule_issues()))


@R.add("validate_split", f"WITH {RULES_SQL}, n AS (SELECT id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM found GROUP BY id) SELECT raw.id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS valid, coalesce(errors, 0) > 0 OR 0.8::DOUBLE - 0.1::DOUBLE * coalesce(errors, 0) - 0.05::DOUBLE * coalesce(warnings, 0) < 0.5 AS quarantined, {r('greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.8::DOUBLE - 0.1::DOUBLE * coalesce(errors, 0) - 0.05::DOUBLE * coalesce(warnings, 0)))')} AS score FROM raw LEFT JOIN n USING (id)")
def validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid, invalid and quarantined items, with the score of the batch gate."""
    n = lambda s: F.size(F.filter("i", lambda x: x["severity"] == s)).cast("long")
    rows = raw(spark, sf_dir).select("id", va.rule_issues().alias("i")).select("id", n("error").alias("errors"), n("warning").alias("warnings"))
    value = F.lit(0.8) - F.lit(0.1) * F.col("errors") - F.lit(0.05) * F.col("warnings")
    score = rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    return rows.select("*", (F.col("errors") == 0).alias("valid"), ((F.col("errors") > 0) | (value < 0.5)).alias("quarantined"), score.alias("score"))


@R.add("validation_fixes", f"WITH {RAW_SQL} " + " UNION ALL ".join([f"SELECT id, '{f}' AS field, {enum_sql(f, a)} AS value FROM raw WHERE {f} <> '' AND {enum_sql(f, a)} <> lower({f})" for f, a in va.ALLOWED.items()] + [f"SELECT id, '{f}', substr({f}, 1, {most}) FROM raw WHERE {f} <> '' AND substr({f}, 1, {most}) <> lower({f})" for f, _, _, most in va.LENGTHS if most < 10**9 and f != "name"]))
def validation_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("id", F.inline(va.fixes()))


NEAR_SQL = "trim(regexp_replace(lower(category), '[\\s-]', '_', 'g'))"
NEAR_CTE = f"""n AS (SELECT id, {NEAR_SQL} AS c FROM raw), cats(o, a) AS (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(va.CATEGORIES))}),
near AS (SELECT id, arg_max(a, (s, -o)) AS near, max(s) AS s FROM (SELECT id, o, a, CASE WHEN a = c THEN 1.0 WHEN contains(a, c) OR contains(c, a) THEN least(length(a), length(c))::DOUBLE / greatest(length(a), length(c)) ELSE 0 END::DOUBLE AS s FROM n, cats WHERE c IS NOT NULL) GROUP BY id)"""


def guardian_rows() -> str:
    full = lambda f: f"coalesce({f} <> '', false)"
    day = lambda f: f"TRY_CAST({f} AS DATE)"
    value = price_sql("budget")
    out = [(f, "missing", "critical", f"NOT {full(f)}") for f in ("name", "type")] + [(f, "format", "warning", f"{full(f)} AND {day(f)} IS NULL") for f in ("start_date", "end_date")]
    out.append(("budget", "format", "warning", f"{full('budget')} AND NOT regexp_matches(regexp_replace(budget, '[€$£,\\s]', '', 'g'), '^-?[0-9.]*[0-9]')"))
    out.append(("type", "format", "warning", f"{full('type')} AND NOT list_contains({words(va.TYPES)}, lower(trim(type))) AND NOT regexp_matches(lower(type), 'product|software|hardware|service|consulting|managed')"))
    out += [("budget", "range", "critical", f"{value} < 0"), ("budget", "range", "warning", f"{value} > 1e9"), ("users", "range", "critical", "users < 0"), ("users", "range", "warning", "users > 1e7")]
    out += [("end_date", "inconsistent", "warning", f"{day('end_date')} < {day('start_date')}"), ("status", "inconsistent", "warning", "lifecycle = 'end_of_life' AND status = 'active'"), ("budget", "inconsistent", "info", f"priority = 'critical' AND {value} < 1000")]
    for f in ("name", "description", "vendor"):
        out += [(f, k, s, f"regexp_matches({f}, '{p}')") for k, (p, s) in va.SUSPICIOUS.items()]
        out.append((f, "repetition", "info", f"len(list_filter(string_split(coalesce({f}, ''), ''), lambda ch: ch <> '' AND contains({f}, repeat(ch, 5)))) > 0"))
    out.append(("vendor", "short", "info", f"length(vendor) <= 2 AND NOT list_contains({words(va.SHORT_VENDORS)}, upper(vendor))"))
    out.append(("category", "unknown", "info", f"{full('category')} AND s <= 0.5"))
    out += [(f, "unknown", "info", f"{full(f)} AND NOT list_contains({words(known)}, lower(trim({f})))") for f, known in (("status", va.KNOWN_STATUSES), ("priority", va.KNOWN_PRIORITIES))]
    return " UNION ALL ".join(f"SELECT id, '{f}' AS field, '{k}' AS kind, '{s}' AS severity FROM g WHERE {w}" for f, k, s, w in out)


GUARD_SQL = f"{RAW_SQL}, {NEAR_CTE}, g AS (SELECT raw.*, near, s FROM raw LEFT JOIN near USING (id)), found AS ({guardian_rows()})"
COST_SQL = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in va.ITEM_COST.items()) + " END"
FIELD_COST_SQL = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in va.FIELD_COST.items()) + " END"
VENDOR_SQL = "CASE lower(trim(vendor)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in va.VENDORS.items()) + " END"
NUMBER_SQL = "regexp_extract(regexp_replace(budget, '[€$£,\\s]', '', 'g'), '^(-?[0-9]+(?:\\.[0-9]+)?)', 1)"
GUESS_SQL = "CASE WHEN regexp_matches(lower(type), 'product|software|hardware') THEN 'product' WHEN regexp_matches(lower(type), 'service|consulting|managed') THEN 'service' END"
CORRECT_SQL = f"""corrections AS (SELECT id, 'budget' AS field, budget AS old, {NUMBER_SQL} AS new, 0.95::DOUBLE AS confidence FROM g WHERE budget <> '' AND {NUMBER_SQL} <> ''
UNION ALL SELECT id, 'type', type, {GUESS_SQL}, 0.8 FROM g WHERE type <> '' AND NOT list_contains({words(va.TYPES)}, lower(trim(type))) AND {GUESS_SQL} IS NOT NULL UNION ALL SELECT id, 'vendor', vendor, {VENDOR_SQL}, 0.95 FROM g WHERE {VENDOR_SQL} IS NOT NULL
UNION ALL SELECT id, 'vendor', vendor, trim(vendor), 1.0 FROM g WHERE vendor <> trim(vendor) UNION ALL SELECT id, 'category', category, near, s FROM g WHERE category <> '' AND s > 0.5 AND s < 1)"""


@R.add("guardian_issues", f"WITH {GUARD_SQL} SELECT * FROM found")
def guardian_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("id", F.inline(va.guardian_issues()))


@R.add("guardian_corrections", f"WITH {GUARD_SQL}, {CORRECT_SQL} SELECT id, field, old, new, {r('confidence')} AS confidence, confidence >= 0.85 AS applied FROM corrections")
def guardian_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir).select("id", F.inline(va.guardian_corrections()))
    return rows.withColumn("applied", F.col("confidence") >= 0.85).withColumn("confidence", rounded(F.col("confidence")))


@R.add("guardian_verdict", f"""WITH {GUARD_SQL}, {CORRECT_SQL}, s AS (SELECT id, greatest(0, 100 - sum({COST_SQL})) AS score, count(*) FILTER (severity = 'critical') AS critical FROM found GROUP BY id), l AS (SELECT id, count(*) AS doubtful FROM corrections WHERE confidence < 0.85 GROUP BY id)
SELECT raw.id, CAST(coalesce(score, 100) AS INTEGER) AS score, coalesce(score, 100) >= 60 AS passed, coalesce(critical, 0) > 0 OR coalesce(doubtful, 0) > 2 OR coalesce(score, 100) < 40 AS needs_review FROM raw LEFT JOIN s USING (id) LEFT JOIN l USING (id)""")
def guardian_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir).select("id", va.guardian_issues().alias("i"), va.guardian_corrections().alias("c")).withColumn("score", va.score(F.col("i"), va.ITEM_COST))
    review = F.exists("i", lambda x: x["severity"] == "critical") | (F.size(F.filter("c", lambda x: x["confidence"] < 0.85)) > 2) | (F.col("score") < 40)
    return rows.select("id", "score", (F.col("score") >= 60).alias("passed"), review.alias("needs_review"))


@R.add("field_scores", f"WITH {GUARD_SQL} SELECT id, field, CAST(greatest(0, 100 - sum({FIELD_COST_SQL})) AS INTEGER) AS score FROM found GROUP BY ALL")
def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the fields that have an issue."""
    rows = raw(spark, sf_dir).select("id", va.guardian_issues().alias("i"))
    fields = F.array_distinct(F.transform("i", lambda x: x["field"]))
    each = rows.select("id", "i", F.explode_outer(fields).alias("field")).where("field IS NOT NULL")  # explode would make the issues again, to look for empty ones
    costs = va.names({k: str(v) for k, v in va.FIELD_COST.items()})
    lost = F.aggregate("i", F.lit(0), lambda s, x: s + F.when(x["field"] == F.col("field"), F.element_at(costs, x["severity"]).cast("int")).otherwise(0))
    return each.select("id", "field", F.greatest(F.lit(0), 100 - lost).alias("score"))


@R.add("corrected_items", f"""WITH {GUARD_SQL}, {CORRECT_SQL}, a AS (SELECT * FROM corrections WHERE confidence >= 0.85) SELECT g.id, coalesce(b.new, budget) AS budget, coalesce(v.new, vendor) AS vendor, coalesce(c.new, category) AS category
FROM g LEFT JOIN a b ON b.id = g.id AND b.field = 'budget' LEFT JOIN (SELECT id, arg_max(new, confidence) FILTER (true) AS new FROM (SELECT id, new, -confidence AS confidence FROM a WHERE field = 'vendor') GROUP BY id) v ON v.id = g.id LEFT JOIN a c ON c.id = g.id AND c.field = 'category'""")
def corrected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the applied corrections; a dictionary name comes before a trim."""
    rows = raw(spark, sf_dir).withColumn("c", F.filter(va.guardian_corrections(), lambda x: x["confidence"] >= 0.85))
    new = lambda f: F.coalesce(F.get(F.filter("c", lambda x: x["field"] == f), 0)["new"], F.col(f)).alias(f)
    return rows.select("id", new("budget"), new("vendor"), new("category"))


@R.add("type_check", f"WITH {RAW_SQL} SELECT id, TRY_CAST(price AS DOUBLE) IS NOT NULL AS price_number, TRY_CAST(start_date AS DATE) IS NOT NULL AS start_date_ok, lower(coalesce(status, '')) IN ('true', 'false') AS status_boolean FROM raw")
def type_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("id", F.col("price").try_cast("double").isNotNull().alias("price_number"), F.try_to_date("start_date", "yyyy-MM-dd").isNotNull().alias("start_date_ok"), F.lower(F.coalesce("status", F.lit(""))).isin("true", "false").alias("status_boolean"))


FILLED = ("name", "category", "type", "vendor", "owner", "lifecycle", "status", "priority", "description", "sku", "price", "quantity", "start_date", "end_date", "budget")


@R.add("field_completeness", f"WITH {RAW_SQL} SELECT id, {r('(' + ' + '.join(f'coalesce({c} <> {chr(39)}{chr(39)}, false)::INT' for c in FILLED) + ') / 15.0::DOUBLE', 2)} AS completeness FROM raw")
def field_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of fifteen fields, the share that has a value."""
    n = sum((F.when(va.empty(c), 0).otherwise(1) for c in FILLED), F.lit(0))
    return raw(spark, sf_dir).select("id", rounded(n / 15.0, 2).alias("completeness"))


@R.add("battery_quality", f"""WITH {RAW_SQL}, v AS (SELECT coalesce(category, '-') AS catalog, coalesce(length(trim(name)) >= 3 AND NOT regexp_matches(name, '^[0-9]+$'), false) AS named, coalesce(length(trim(category)) >= 2, false) AS placed, lower(trim(name)) AS key FROM raw),
d AS (SELECT catalog, sum(n - 1) AS again FROM (SELECT catalog, key, count(*) AS n FROM v WHERE named GROUP BY ALL) GROUP BY catalog)
SELECT v.catalog, count(*) AS n, {r('(sum(named::INT) + sum(placed::INT)) / (2.0::DOUBLE * count(*))')} AS accuracy, {r('(count(*) - sum(named::INT) + coalesce(any_value(again), 0)) / count(*)::DOUBLE')} AS noise FROM v LEFT JOIN d USING (catalog) GROUP BY v.catalog""")
def battery_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of names and categories and share of noise in each catalog."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    v = raw(spark, sf_dir).select(F.coalesce("category", F.lit("-")).alias("catalog"), ok((F.length(F.trim("name")) >= 3) & ~F.col("name").rlike("^[0-9]+$")).alias("named"), ok(F.length(F.trim("category")) >= 2).alias("placed"), F.lower(F.trim("name")).alias("key"))
    g = v.groupBy("catalog", "key", "named").agg(F.count("*").alias("n"), F.count_if("placed").alias("p")).groupBy("catalog")
    t = g.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("named"), F.col("n")).otherwise(0)).alias("named"), F.sum("p").alias("placed"), F.sum(F.when(F.col("named"), F.col("n") - 1).otherwise(0)).alias("again"))
    n = F.col("n")
    return t.select("catalog", "n", rounded((F.col("named") + F.col("placed")) / (2.0 * n)).alias("accuracy"), rounded((n - F.col("named") + F.col("again")) / n).alias("noise"))
