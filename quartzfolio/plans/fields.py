"""The functions that read fields, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfolio.functions import items as fi
from quartzfolio.functions import strings
from quartzfolio.operators import validation as va
from quartzfolio.plans.common import Registry, r, rounded, table
from quartzfolio.plans.validation import RAW_SQL, VENDOR_SQL, raw

R = Registry()


def held_sql(v: str, of: dict, default: str) -> str:
    exact = "CASE " + v + " " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in of.items()) + " END"
    return f"coalesce({exact}, CASE " + " ".join(f"WHEN contains({v}, '{k}') THEN '{m}'" for k, m in of.items()) + f" ELSE '{default}' END)"


def kind_sql(text: str, of: dict, default: str = "NULL") -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in of.items()) + f" ELSE {default} END"


@R.add("status_priority_map", f"WITH {RAW_SQL} SELECT id, CASE WHEN coalesce(status, '') = '' THEN 'proposed' ELSE {held_sql('lower(trim(status))', fi.STATUS_OF, 'proposed')} END AS status, CASE WHEN coalesce(priority, '') <> '' THEN {held_sql('lower(trim(priority))', fi.PRIORITY_OF, 'medium')} END AS priority FROM raw")
def status_priority_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("id", fi.item_status(F.col("status")).alias("status"), fi.item_priority(F.col("priority")).alias("priority"))


@R.add("type_hints", f"WITH {RAW_SQL} SELECT id, {kind_sql('lower(description)', fi.TYPE_WORDS)} AS hint, {kind_sql('lower(description)', fi.DEPENDENCY_WORDS)} AS relation FROM raw")
def type_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("description")
    return raw(spark, sf_dir).select("id", fi.first_kind(d, fi.TYPE_WORDS).alias("hint"), fi.first_kind(d, fi.DEPENDENCY_WORDS).alias("relation"))


def section_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{k}'" for k, p in fi.SECTION_OF.items()) + " ELSE 'body' END"


TITLE_SQL = "CASE doc_id % 6 WHEN 0 THEN 'Appendix ' WHEN 1 THEN 'Indice ' WHEN 2 THEN 'Overview of ' WHEN 3 THEN 'References ' WHEN 4 THEN 'Glossario ' ELSE '' END || split_part(text, chr(10), 1)"


@R.add("section_types", f"WITH t AS (SELECT doc_id, {TITLE_SQL} AS title FROM documents) SELECT doc_id, {section_sql('title')} AS type FROM t")
def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(*map(F.lit, ("Appendix ", "Indice ", "Overview of ", "References ", "Glossario ", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    title = F.concat(prefix, F.split_part("text", F.lit("\n"), F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(fi.section_type(title), F.lit("body")).alias("type"))


@R.add("vendor_canonical", f"WITH {RAW_SQL} SELECT id, coalesce({VENDOR_SQL}, trim(regexp_replace(vendor, '(?i)[,.]?\\s*(inc|corp|corporation|ltd|llc|gmbh|spa|s\\.p\\.a|srl|ag|se)\\.?\\s*$', ''))) AS vendor FROM raw")
def vendor_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known vendor's name, else the name without its legal form."""
    known = F.try_element_at(va.names(va.VENDORS), F.lower(F.trim("vendor")))
    bare = F.trim(F.regexp_replace("vendor", r"(?i)[,.]?\s*(inc|corp|corporation|ltd|llc|gmbh|spa|s\.p\.a|srl|ag|se)\.?\s*$", ""))
    return raw(spark, sf_dir).select("id", F.coalesce(known, bare).alias("vendor"))


CLEAN = "regexp_replace(lower({0}), '[^a-z0-9_\\s]', ' ', 'g')"


@R.add("text_keys", f"""WITH {RAW_SQL} SELECT id, trim(regexp_replace({CLEAN.format("name")}, '\\s+', ' ', 'g')) AS plain, CASE WHEN category IS NULL THEN 'other' ELSE regexp_replace(regexp_replace(lower(category), '[^a-z]', '_', 'g'), '_+', '_', 'g') END AS category,
regexp_replace(lower(name), '[^a-z0-9._-]', '_', 'g') AS file_name, 'item:' || substr(sha256(name), 1, 16) AS cache_key, regexp_replace(regexp_replace(regexp_replace(lower(trim(category)), '[^a-z0-9_À-ſ]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS column_name FROM raw""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of names: for comparison, categories, files, caches, columns."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("name"), r"[^a-z0-9_\s]", " "), r"\s+", " "))
    kind = F.regexp_replace(F.regexp_replace(F.lower("category"), "[^a-z]", "_"), "_+", "_")
    return raw(spark, sf_dir).select(
        "id", plain.alias("plain"), F.coalesce(kind, F.lit("other")).alias("category"), F.regexp_replace(F.lower("name"), "[^a-z0-9._-]", "_").alias("file_name"),
        F.concat(F.lit("item:"), F.substring(F.sha2("name", 256), 1, 16)).alias("cache_key"), strings.column_name(F.col("category")).alias("column_name"),
    )


@R.add("relevance_labels", "WITH s AS (SELECT event_id, CAST(event_id * 104729 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS x FROM events) SELECT event_id, CASE WHEN x >= 0.9 THEN 'Excellent' WHEN x >= 0.8 THEN 'Very Good' WHEN x >= 0.7 THEN 'Good' WHEN x >= 0.6 THEN 'Moderate' ELSE 'Fair' END AS label FROM s")
def relevance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", fi.relevance((F.col("event_id") * 104_729 % 1000) / 1000.0).alias("label"))


# JavaScript-like number texts; the SQL has no look-ahead, so it takes thousands off one by one.
THOUSANDS = "regexp_replace(regexp_replace(regexp_replace({0}, '[.,](\\d{{3}})', '\\1', 'g'), '[.,](\\d{{3}})', '\\1', 'g'), ',', '.', 'g')"
CELL_T = "regexp_replace(trim({0}), '[$€£¥₹]', '', 'g')"


def budget_cell_sql(c: str) -> str:
    s = f"lower(trim({THOUSANDS.format(f'regexp_replace({c}, {chr(39)}[€$£]{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}))"
    return f"TRY_CAST(regexp_extract({s}, '^(-?\\d*\\.?\\d+)', 1) AS DOUBLE) * CASE WHEN contains({s}, 'k') THEN 1000 WHEN contains({s}, 'm') THEN 1000000 ELSE 1 END"


def text_budget_sql(c: str) -> str:
    out = []
    for p in fi.BUDGETS:
        whole, digits = f"lower(regexp_extract({c}, '{p}', 0))", f"regexp_extract({c}, '{p}', 1)"
        tail = f"regexp_replace({whole}, 'budget|euro', '', 'g')"
        out.append(f"TRY_CAST(regexp_extract({THOUSANDS.format(digits)}, '^(\\d*\\.?\\d+)', 1) AS DOUBLE) * CASE WHEN contains({tail}, 'k') THEN 1000 WHEN contains({tail}, 'm') THEN 1000000 ELSE 1 END")
    return f"coalesce({', '.join(out)})"


CELL_S = f"CASE WHEN regexp_matches({CELL_T.format('price')}, '\\d,\\d{{2}}$') THEN replace(replace({CELL_T.format('price')}, '.', ''), ',', '.') WHEN regexp_matches({CELL_T.format('price')}, '\\d\\.\\d{{2}}$') THEN replace({CELL_T.format('price')}, ',', '') ELSE {CELL_T.format('price')} END"


@R.add("number_texts", f"WITH {RAW_SQL} SELECT id, {r(budget_cell_sql('budget'), 2)} AS budget, {r(text_budget_sql('description'), 2)} AS in_text, CASE WHEN regexp_matches(trim(price), '(?i)^(-|n/?a)?$') THEN NULL ELSE {r(f'TRY_CAST(regexp_extract(trim({CELL_S}), {chr(39)}^(-?[0-9]*\\.?[0-9]+){chr(39)}, 1) AS DOUBLE)', 2)} END AS cell FROM raw")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of cells, budgets that texts name, and typed cells."""
    return raw(spark, sf_dir).select("id", rounded(fi.budget_number(F.col("budget")), 2).alias("budget"), rounded(fi.budget_in_text(F.col("description")), 2).alias("in_text"), rounded(fi.cell_number(F.col("price")), 2).alias("cell"))


YES_SQL = "CASE p_partkey % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'sì' WHEN 2 THEN 'FALSE' WHEN 3 THEN '✗' WHEN 4 THEN '-' ELSE 'maybe' END"


@R.add("cell_booleans", f"WITH s AS (SELECT p_partkey, lower(trim({YES_SQL})) AS t FROM part) SELECT p_partkey, CASE WHEN t IN ('yes', 'true', 'si', 'sì', '✓', '✔') THEN true WHEN t IN ('no', 'false', '✗', '✘') THEN false END AS value FROM s")
def cell_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fi.cell_boolean(F.expr(YES_SQL)).alias("value"))


ROI_SQL = "((b - c) / c * 100)"


@R.add("roi_scores", f"WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 50000 ELSE o_totalprice END::DOUBLE AS b, CASE WHEN o_orderkey % 7 = 0 THEN 30000 ELSE o_custkey % 90 * 1000 + 500 END::DOUBLE AS c FROM orders) SELECT o_orderkey, {r(f'CASE WHEN {ROI_SQL} > 200 THEN 100 WHEN {ROI_SQL} > 100 THEN 80 + ({ROI_SQL} - 100) / 5 WHEN {ROI_SQL} > 50 THEN 60 + ({ROI_SQL} - 50) WHEN {ROI_SQL} > 0 THEN 30 + {ROI_SQL} ELSE greatest(0.0::DOUBLE, 30 + {ROI_SQL} / 2) END')} AS score FROM s")
def roi_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    benefit = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice"))
    cost = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_custkey") % 90 * 1000 + 500).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rounded(fi.roi_score(benefit, cost)).alias("score"))


@R.add("score_clamp", "SELECT l_orderkey, l_linenumber, floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN l_linenumber = 3 THEN 50 ELSE l_extendedprice / 500 - 20 END)) + 0.5) AS score FROM lineitem")
def score_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / 500 - 20)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fi.clamp_score(x).alias("score"))


FILE_SQL = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' 2024-05-06 v2.1.pdf' WHEN 1 THEN ' v3.xlsx' WHEN 2 THEN ' 17 of 20.csv' ELSE '.txt' END"


@R.add("filename_patterns", f"WITH s AS (SELECT {FILE_SQL} AS f FROM part), p AS (SELECT regexp_replace(regexp_replace(regexp_replace(f, '\\.[^.]+$', ''), '\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}', '<date>'), 'v?\\d+(\\.\\d+)*', '<version>') AS pattern FROM s) SELECT pattern, count(*) AS n FROM p GROUP BY pattern")
def filename_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(fi.filename_pattern(F.expr(FILE_SQL)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


@R.add("quarter_labels", "WITH d AS (SELECT o_orderkey, date_trunc('quarter', o_orderdate) + to_months(CAST(3 * (o_orderkey % 7) AS INTEGER)) AS q FROM orders) SELECT o_orderkey, 'Q' || quarter(q) || ' ' || year(q) AS label FROM d")
def quarter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", fi.quarter_label(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 7).cast("int")).alias("label"))


@R.add("period_totals", "WITH b AS (SELECT TIMESTAMP '2024-01-20 12:00:00' AS t), p(period, start) AS (SELECT 'hourly', t - INTERVAL 1 HOUR FROM b UNION ALL SELECT 'daily', t - INTERVAL 1 DAY FROM b UNION ALL SELECT 'weekly', t - INTERVAL 7 DAY FROM b UNION ALL SELECT 'monthly', t - INTERVAL 1 MONTH FROM b) SELECT period, count(*) AS n FROM events JOIN p ON ts >= start JOIN b ON ts < t GROUP BY period")
def period_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last hour, day, week and month before a moment."""
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    spans = {"hourly": "1 hour", "daily": "1 day", "weekly": "7 days", "monthly": "1 month"}
    inside = F.array_compact(F.array(*(F.when(F.col("ts") >= now - F.expr(f"INTERVAL {s}"), p) for p, s in spans.items())))
    return table(spark, sf_dir, "events").where(F.col("ts") < now).select(F.explode(inside).alias("period")).groupBy("period").agg(F.count("*").alias("n"))


@R.add("common_affixes", "WITH g AS (SELECT p_type AS kind, min(p_name) AS a, max(p_name) AS b, min(reverse(p_name)) AS ra, max(reverse(p_name)) AS rb FROM part GROUP BY 1) SELECT kind, list_max(list_filter(list_transform(generate_series(0, least(length(a), length(b))), lambda i: CASE WHEN left(a, i) = left(b, i) THEN left(a, i) END), lambda x: x IS NOT NULL)) AS prefix, reverse(list_max(list_filter(list_transform(generate_series(0, least(length(ra), length(rb))), lambda i: CASE WHEN left(ra, i) = left(rb, i) THEN left(ra, i) END), lambda x: x IS NOT NULL))) AS suffix FROM g")
def common_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all names of a type begin and end with, from the least and greatest."""
    g = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind")).agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"), F.min(F.reverse("p_name")).alias("ra"), F.max(F.reverse("p_name")).alias("rb"))
    return g.select("kind", fi.common_prefix(F.col("a"), F.col("b")).alias("prefix"), F.reverse(fi.common_prefix(F.col("ra"), F.col("rb"))).alias("suffix"))


OTHER_SQL = "CASE p_partkey % 5 WHEN 0 THEN upper(name) WHEN 1 THEN name || ' pro' WHEN 2 THEN replace(name, ' ', '  ') WHEN 3 THEN p_type ELSE name END"


@R.add("name_matching", f"""WITH s AS (SELECT p_partkey, p_name AS name, p_type FROM part), p AS (SELECT p_partkey, name, {OTHER_SQL} AS other FROM s), q AS (SELECT *, trim(regexp_replace({CLEAN.format('name')}, '\\s+', ' ', 'g')) AS a, trim(regexp_replace({CLEAN.format('other')}, '\\s+', ' ', 'g')) AS b FROM p)
SELECT p_partkey, {r('1 - levenshtein(name, other)::DOUBLE / greatest(length(name), length(other))')} AS exact_case, {r('CASE WHEN a = b THEN 1.0::DOUBLE WHEN contains(a, b) OR contains(b, a) THEN least(0.95::DOUBLE, least(length(a), length(b))::DOUBLE / greatest(length(a), length(b)) + 0.2::DOUBLE) ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END')} AS best FROM q""")
def name_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of two names: by edits with case, and the best of equality,
    containment (raised by 0.2, 0.95 at most) and edits of the plain forms."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), "p_type").select("p_partkey", "name", F.expr(OTHER_SQL).alias("other"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_\s]", " "), r"\s+", " "))
    q = rows.select("p_partkey", "name", "other", plain("name").alias("a"), plain("other").alias("b"))
    long = lambda x, y: F.greatest(F.length(x), F.length(y))
    held = F.least(F.lit(0.95), F.least(F.length("a"), F.length("b")) / long("a", "b") + 0.2)
    best = F.when(F.col("a") == F.col("b"), 1.0).when(F.contains("a", F.col("b")) | F.contains("b", F.col("a")), held).otherwise(1 - F.levenshtein("a", "b") / long("a", "b"))
    return q.select("p_partkey", rounded(1 - F.levenshtein("name", "other") / long("name", "other")).alias("exact_case"), rounded(best).alias("best"))


JSON_SQL = "'[{\"name\": \"' || p_name || '\", \"size\": ' || CAST(p_size AS STRING) || '}, {\"name\": \"' || p_brand || '\"}, {\"name\": \"cut of'"


@R.add("recover_json", "SELECT p_partkey, p_name AS name, CAST(p_size AS BIGINT) AS size FROM part UNION ALL SELECT p_partkey, p_brand, NULL FROM part")
def recover_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole objects out of a list that breaks off."""
    objects = F.regexp_extract_all(F.expr(JSON_SQL), F.lit(r"\{[^{}]*\}"), F.lit(0))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.transform(objects, lambda o: F.from_json(o, "name string, size bigint"))).alias("o"))
    return rows.select("p_partkey", "o.*").where("name IS NOT NULL")


@R.add("deep_equality", "SELECT p_partkey, p_partkey % 3 <> 1 AS same FROM part")
def deep_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty are equal, arrays in any order."""
    k = F.col("p_partkey") % 3
    a = F.array(F.col("p_name"), F.col("p_brand"))
    b = F.when(k == 1, F.array("p_name")).when(k == 2, F.array("p_brand", "p_name")).otherwise(a)
    text = lambda x: F.to_json(F.struct(F.array_sort(x).alias("x")))
    empty = F.coalesce(F.when(k == 0, F.lit("")), F.lit("")) == F.coalesce(F.lit(None).cast("string"), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", ((text(a) == text(b)) & empty).alias("same"))


@R.add("fill_merge", f"WITH {RAW_SQL}, o AS (SELECT lower(trim(name)) AS key, id, nullif(vendor, '') AS vendor, nullif(category, '') AS category FROM raw WHERE trim(coalesce(name, '')) <> '') SELECT key, count(*) AS n, arg_min(vendor, id) FILTER (vendor IS NOT NULL) AS vendor, arg_min(category, id) FILTER (category IS NOT NULL) AS category FROM o GROUP BY key")
def fill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one name as one; a field is that of the first that has it."""
    o = raw(spark, sf_dir).where(F.trim(F.coalesce("name", F.lit(""))) != "").select(F.lower(F.trim("name")).alias("key"), "id", F.nullif("vendor", F.lit("")).alias("vendor"), F.nullif("category", F.lit("")).alias("category"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    return o.groupBy("key").agg(F.count("*").alias("n"), first("vendor"), first("category"))


@R.add("most_common", "WITH c AS (SELECT p_brand AS brand, p_type AS kind, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL) SELECT brand, arg_max(kind, (n, -first)) AS kind, max(n) AS n FROM c GROUP BY brand")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value of each group, the one met first of equals."""
    c = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return c.groupBy("brand").agg(F.max_by("kind", F.struct("n", -F.col("first"))).alias("kind"), F.max("n").alias("n"))


@R.add("derived_profile", "SELECT c_custkey, CASE c_custkey % 7 WHEN 1 THEN 'initial' WHEN 2 THEN 'developing' WHEN 3 THEN 'defined' WHEN 4 THEN 'managed' WHEN 5 THEN 'optimized' ELSE 'unknown' END AS maturity, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE floor((c_nationkey + CAST(c_custkey % 100 AS DOUBLE)) / 2 + 0.5) END AS innovation FROM customer")
def derived_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label of a maturity level from 1 to 5, and the mean of two scores, 0 where one lacks."""
    level = (F.col("c_custkey") % 7).cast("int")
    label = F.coalesce(F.get(F.array(*map(F.lit, fi.MATURITY)), level - 1), F.lit("unknown"))
    a, b = F.col("c_nationkey"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 100)
    return table(spark, sf_dir, "customer").select("c_custkey", label.alias("maturity"), F.coalesce(F.floor((a + b) / 2.0 + 0.5), F.lit(0)).cast("double").alias("innovation"))


NAME_SQL = "CASE p_partkey % 8 WHEN 0 THEN '25504446' WHEN 1 THEN '504B0304' WHEN 2 THEN '89504E47' WHEN 3 THEN 'EFBBBF41' WHEN 4 THEN 'FFFE4100' WHEN 5 THEN 'FEFF0041' WHEN 6 THEN 'FFD8FF00' ELSE 'E9206162' END"
EXT_SQL = "CASE p_partkey % 8 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.XLSX' WHEN 2 THEN 'c.png' WHEN 3 THEN 'd.csv' WHEN 4 THEN 'e.txt' WHEN 5 THEN 'f' WHEN 6 THEN 'g.jpeg' ELSE 'h.odd' END"


@R.add("file_formats", f"WITH s AS (SELECT p_partkey, {NAME_SQL} AS h, lower({EXT_SQL}) AS f FROM part) SELECT p_partkey, CASE h WHEN '25504446' THEN 'pdf' WHEN '504B0304' THEN 'xlsx' WHEN '89504E47' THEN 'image' WHEN 'FFD8FF00' THEN 'image' END AS magic, CASE regexp_extract(f, '[a-z]+$') WHEN 'pdf' THEN 'pdf' WHEN 'xlsx' THEN 'xlsx' WHEN 'png' THEN 'image' WHEN 'csv' THEN 'csv' WHEN 'txt' THEN 'text' WHEN 'jpeg' THEN 'image' END AS extension, CASE h WHEN 'EFBBBF41' THEN 'utf-8' WHEN 'FFFE4100' THEN 'utf-16le' WHEN 'FEFF0041' THEN 'utf-16be' WHEN '25504446' THEN 'utf-8' WHEN '504B0304' THEN 'utf-8' ELSE 'iso-8859-1' END AS encoding FROM s")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format by first bytes and by extension, and encoding."""
    from quartzfolio.sources import formats

    content = F.unhex(F.expr(NAME_SQL))
    return table(spark, sf_dir, "part").select("p_partkey", formats.magic(content).alias("magic"), formats.by_extension(F.expr(EXT_SQL)).alias("extension"), formats.encoding(content).alias("encoding"))
