"""From raw columns, texts and pages to items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfolio.functions import numbers, strings
from quartzfolio.sources import catalogs, formats
from quartzfolio.plans.common import Registry, r, rounded, table

R = Registry()

RAW_SQL = "raw AS (SELECT 'e' || event_id AS key, props AS content FROM events UNION ALL SELECT 'p' || page_id, html FROM pages UNION ALL SELECT 'o' || o_orderkey, o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority FROM orders)"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("key"), F.col("props").alias("content"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), F.col("html").alias("content"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"), F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("content"))
    return events.unionByName(pages).unionByName(orders)


@R.add("sniff_content", f"""WITH {RAW_SQL}, l AS (SELECT key, content, split_part(content, chr(10), 1) AS line FROM raw) SELECT key, CASE WHEN regexp_matches(content, '(?i)<(html|head|body|div|table|!doctype)') THEN 'html' WHEN regexp_matches(content, '^\\s*[\\[{{]') AND regexp_matches(content, '[\\]}}]\\s*$') THEN 'json'
WHEN len(string_split(line, ',')) > 2 OR len(string_split(line, ';')) > 2 THEN 'csv' WHEN len(string_split(line, chr(9))) > 2 THEN 'tsv' ELSE 'text' END AS format FROM l""")
def sniff_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("key", formats.sniff(F.col("content")).alias("format"))


@R.add("csv_delimiter", "WITH l AS (SELECT p_partkey, replace(p_name || ' ' || p_type, ' ', CASE p_partkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END) AS line FROM part) SELECT p_partkey, CASE WHEN contains(line, ',') THEN 'comma' WHEN contains(line, ';') THEN 'semicolon' WHEN contains(line, chr(9)) THEN 'tab' WHEN contains(line, '|') THEN 'bar' ELSE 'comma' END AS delimiter FROM l")
def csv_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.element_at(F.array(*map(F.lit, formats.DELIMITERS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    line = F.replace(F.concat_ws(" ", "p_name", "p_type"), F.lit(" "), sign)
    names = F.create_map(*(F.lit(x) for kv in ((",", "comma"), (";", "semicolon"), ("\t", "tab"), ("|", "bar")) for x in kv))
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(names, formats.delimiter(line)).alias("delimiter"))


COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")
TYPED_SQL = " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS v FROM s" for c in COLUMNS)
CASES = " ".join(f"WHEN bool_and(regexp_matches(v, '{p}')) THEN '{t}'" for t, p in formats.TYPES.items())


@R.add("infer_types", f"WITH s AS (SELECT * FROM part ORDER BY p_partkey LIMIT 10), u AS ({TYPED_SQL}) SELECT name, CASE {CASES} ELSE 'string' END AS type FROM u WHERE v IS NOT NULL GROUP BY name")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of each column by its first ten values: the first pattern that all fit."""
    s = table(spark, sf_dir, "part").orderBy("p_partkey").limit(10).select(*(F.col(c).cast("string") for c in COLUMNS))
    u = s.unpivot([], list(COLUMNS), "name", "v").where("v IS NOT NULL")
    kind = F.lit("string")
    for t, p in reversed(formats.TYPES.items()):
        kind = F.when(F.bool_and(F.col("v").rlike(p)), t).otherwise(kind)
    return u.groupBy("name").agg(kind.alias("type"))


@R.add("column_profile", "WITH s AS (SELECT * FROM part), u AS (" + TYPED_SQL + f") SELECT name, count(*) AS n, count(DISTINCT v) AS n_distinct, min(v) AS low, max(v) AS high, {r('avg((v IS NULL OR v = chr(32))::INT)')} AS null_share FROM u GROUP BY name")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "part").select(*(F.col(c).cast("string") for c in COLUMNS)).unpivot([], list(COLUMNS), "name", "v")
    empty = F.avg((F.col("v").isNull() | (F.col("v") == " ")).cast("int"))
    return u.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("v").alias("n_distinct"), F.min("v").alias("low"), F.max("v").alias("high"), rounded(empty).alias("null_share"))


PARTS = {"a": "100 + p_partkey * 137 % 900", "b": "1 + p_partkey % 9", "c": "10 + p_partkey % 90"}
PRICE = "CASE p_partkey % 5 WHEN 0 THEN concat('€ ', b, '.', a, ',', c) WHEN 1 THEN concat('$', b, ',', a, '.', c) WHEN 2 THEN concat(a, 'k') WHEN 3 THEN concat(b, '.5M') ELSE 'n/a' END"


@R.add("currency_parse", "WITH s AS (SELECT p_partkey, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in PARTS.items()) + f" FROM part) SELECT p_partkey, {r('CASE p_partkey % 5 WHEN 0 THEN b * 1000 + a + c / 100 WHEN 1 THEN b * 1000 + a + c / 100 WHEN 2 THEN a * 1000 WHEN 3 THEN (b + 0.5) * 1000000 ELSE 0.0 END', 2)} AS price FROM s")
def currency_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in four ways; the SQL has the numbers they were made of."""
    s = table(spark, sf_dir, "part").selectExpr("p_partkey", *(f"CAST({e} AS STRING) AS {n}" for n, e in PARTS.items())).select("p_partkey", F.expr(PRICE).alias("text"))
    return s.select("p_partkey", rounded(numbers.currency(F.col("text")), 2).alias("price"))


@R.add("date_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written as D/M/Y or Y-M-D; others have none."""
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "d/M/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", F.coalesce(F.try_to_date("t", "d/M/yyyy"), F.try_to_date("t", "yyyy-MM-dd")).alias("day"))


@R.add("split_tags", "WITH s AS (SELECT unnest(list_filter(list_transform(string_split_regex(replace(p_type, ' ', CASE p_partkey % 4 WHEN 0 THEN ' , ' WHEN 1 THEN ';' WHEN 2 THEN '|' ELSE '/ /' END), '[,;|/]'), lambda x: trim(x)), lambda x: x <> '')) AS tag FROM part) SELECT tag, count(*) AS n FROM s GROUP BY tag")
def split_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    between = F.element_at(F.array(*map(F.lit, (" , ", ";", "|", "/ /"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.explode(catalogs.split_technologies(F.replace("p_type", F.lit(" "), between))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@R.add("extract_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects out of fenced answers."""
    answer = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nthat is all"))
    return table(spark, sf_dir, "events").select("event_id", catalogs.from_json_text(answer, "k bigint")["k"].alias("k"))


@R.add("csv_scan", "SELECT p_partkey, p_name AS name, p_brand AS vendor, p_type AS category, CAST(p_size AS DOUBLE) AS price FROM part")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted lines of text back to columns, and these to items."""
    line = F.concat_ws(";", F.concat(F.lit('"'), "p_name", F.lit('"')), "p_brand", F.concat(F.lit(' "'), "p_type", F.lit('"')), F.col("p_size").cast("string"))
    cells = F.from_csv(line, "Nome string, Brand string, Categoria string, Prezzo string", {"sep": ";", "ignoreLeadingWhiteSpace": "true"})
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_number"), cells.alias("c")).select("row_number", "c.*")
    out = catalogs.to_items(rows, catalogs.map_columns(["Nome", "Brand", "Categoria", "Prezzo"]))
    return out.select(F.get_json_object("raw", "$.row_number").cast("long").alias("p_partkey"), "name", "vendor", "category", "price")


ITEM_LIST = "concat('Our list', chr(10), '- ', p_name, ': ', p_type, chr(10), '  by ', p_brand, chr(10), '2. ', p_type, ' - ', p_brand)"


@R.add("list_items", "SELECT p_partkey, 1::BIGINT AS item, p_name AS name, p_type || ' by ' || p_brand AS description FROM part UNION ALL SELECT p_partkey, 2, p_type, p_brand FROM part")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of bulleted lists; the SQL has the values they were made of."""
    return catalogs.list_items(table(spark, sf_dir, "part").select("p_partkey", F.expr(ITEM_LIST).alias("text")), "p_partkey")


@R.add("markdown_table", "SELECT p_partkey, p_name AS name, p_brand AS vendor FROM part")
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('| Name | Brand |', chr(10), '|---|:--|', chr(10), '| ', p_name, ' | ', p_brand, ' |')")
    rows = catalogs.markdown_rows(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey")
    return rows.where("line > 0").select("p_partkey", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("vendor"))


@R.add("page_items", "WITH t AS (SELECT page_id, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages) SELECT page_id, nullif(title, '') AS name, length(body) AS n_chars, md5(body) AS digest FROM t")
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and visible text of web pages."""
    p = table(spark, sf_dir, "pages").select("page_id", catalogs.page_title(F.col("html")).alias("name"), catalogs.page_text(F.col("html")).alias("body"))
    return p.select("page_id", "name", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("digest"))


@R.add("section_headings", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), n AS (SELECT doc_id, max(line) AS last FROM l GROUP BY 1), h AS (SELECT doc_id, line FROM l WHERE s <> '' AND length(s) <= 60) SELECT doc_id, line AS first_line, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, last) AS last_line FROM h JOIN n USING (doc_id)")
def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines start sections, which end where the next begins. Lines of a
    document stay in its row: no shuffle."""
    lines = F.split("text", "\n")
    heads = F.filter(F.transform(lines, lambda s, i: F.when((s != "") & (F.length(s) <= 60), i + 1)), lambda x: x.isNotNull())
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", heads.alias("h"), F.size(lines).alias("n"))
    spans = F.transform("h", lambda x, i: F.struct(x.cast("long").alias("first_line"), F.coalesce(F.get("h", i + 1) - 1, F.col("n")).cast("long").alias("last_line")))
    return d.select("doc_id", F.inline(spans))


@R.add("unpivot_long", "SELECT l_returnflag AS row_category, 'O' AS column_category, count(*) FILTER (l_linestatus = 'O') AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'F', count(*) FILTER (l_linestatus = 'F') FROM lineitem GROUP BY 1")
def unpivot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross table to its long form."""
    cross = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("O"), F.count_if(F.col("l_linestatus") == "F").alias("F"))
    return cross.unpivot(["l_returnflag"], ["O", "F"], "column_category", "n").withColumnRenamed("l_returnflag", "row_category")


@R.add("changed_fields", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'brand' END AS changed FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'size' FROM part WHERE p_partkey % 3 = 0")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of corrected rows that differ and have a value."""
    p = table(spark, sf_dir, "part")
    old = F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string"))
    new = F.create_map(F.lit("name"), F.lit(""), F.lit("brand"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit("!"))).otherwise(F.col("p_brand")), F.lit("size"), (F.col("p_size") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)).cast("string"))
    diff = F.map_keys(F.map_filter(F.map_zip_with(old, new, lambda k, a, b: (b != "") & (strings.normalized(a) != strings.normalized(b)) | (b != "") & (a != b)), lambda k, v: v))
    return p.select("p_partkey", F.explode(diff).alias("changed"))
