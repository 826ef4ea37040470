"""Files to items end to end, column mapping, templates, tables, relations, duplicates, catalog search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfolio.functions import strings
from quartzfolio.functions.numbers import currency
from quartzfolio.functions.similarity import jaro_winkler
from quartzfolio.operators import containment, likeness
from quartzfolio.operators.tables import join_by_weight, materialize, shuffled
from quartzfolio.plans.common import Registry, r, rounded, table
from quartzfolio.plans.portfolio import ITEMS_SQL as P_SQL
from quartzfolio.plans.portfolio import case
from quartzfolio.plans.portfolio import items as p_items
from quartzfolio.plans.validation import RAW_SQL, numbered, price_sql, raw
from quartzfolio.sources.catalogs import ALIASES

R = Registry()

# ---- column names of files to fields

HEADERS = numbered("'Nome Prodotto'", "'Prezzo (EUR)'", "'Brand'", "'Categoria'", "'Descrizione'", "'Stato'", "'SKU code'", "'Quantita'", "'Owner'", "'Budget 2024'", "'vendor_name'", "'Nome'", "'zzz'", "'technologie'", "'Prioritaa'")
COLUMN = {"file": "CAST(floor(p_partkey / 6) AS BIGINT)", "pos": "CAST(p_partkey % 6 AS INT)", "name": case("(p_partkey * 7 + floor(p_partkey / 6)) % 16", HEADERS, "'Tipo'")}
ALIAS_ROWS = [(f, a) for f, names in ALIASES.items() for a in names]
PLAIN_SQL = "regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9_À-ſ]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
MAPPING_SQL = f"""cols AS (SELECT {', '.join(f'{e} AS {n}' for n, e in COLUMN.items())} FROM part), d AS (SELECT DISTINCT name, {PLAIN_SQL} AS k FROM cols), al(field, alias) AS (VALUES {', '.join(f"('{f}', '{a}')" for f, a in ALIAS_ROWS)}),
s AS (SELECT name, field, {r("max(CASE WHEN k = alias THEN 0.98::DOUBLE ELSE greatest(CASE WHEN contains(k, alias) OR contains(alias, k) THEN 0.9::DOUBLE * least(length(k), length(alias)) / greatest(length(k), length(alias)) ELSE 0.0::DOUBLE END, CASE WHEN 1 - levenshtein(k, alias)::DOUBLE / greatest(length(k), length(alias)) >= 0.75 THEN 0.85::DOUBLE * (1 - levenshtein(k, alias)::DOUBLE / greatest(length(k), length(alias))) ELSE 0.0::DOUBLE END, CASE WHEN jaro_winkler_similarity(k, alias) >= 0.9 THEN 0.85::DOUBLE * jaro_winkler_similarity(k, alias) ELSE 0.0::DOUBLE END) END)")} AS score FROM d CROSS JOIN al GROUP BY ALL),
b AS (SELECT name, arg_max(field, (score, field)) AS field, max(score) AS score FROM s WHERE score >= 0.6 GROUP BY name), m AS (SELECT file, pos, cols.name, field, score FROM cols JOIN b USING (name)),
mapped AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY file, field ORDER BY score DESC, pos) = 1)"""


def mapped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, pos, name, field, score): the best field of each column by alias,
    containment and spelling, 0.6 at least; a field goes to one column of a file.
    Only distinct names meet the aliases, which are a literal."""
    cols = table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in COLUMN.items()))
    aliases = F.broadcast(spark.createDataFrame(ALIAS_ROWS, "field string, alias string"))
    k, a = F.col("k"), F.col("alias")
    pairs = cols.select("name").distinct().withColumn("k", strings.column_name(F.col("name"))).crossJoin(aliases)
    small, large = F.least(F.length(k), F.length(a)), F.greatest(F.length(k), F.length(a))
    edit, spelled = 1 - F.levenshtein(k, a) / large, jaro_winkler("k", "alias")
    held = F.when(F.contains(k, a) | F.contains(a, k), F.lit(0.9) * small / large).otherwise(0.0)
    fuzzy = F.greatest(held, F.when(edit >= 0.75, F.lit(0.85) * edit).otherwise(0.0), F.when(spelled >= 0.9, F.lit(0.85) * spelled).otherwise(0.0))
    s = pairs.groupBy("name", "field").agg(rounded(F.max(F.when(k == a, 0.98).otherwise(fuzzy))).alias("score")).where("score >= 0.6")
    b = s.groupBy("name").agg(F.max_by("field", F.struct("score", "field")).alias("field"), F.max("score").alias("score"))
    m = cols.join(F.broadcast(b), "name")  # one row a distinct name that has a field
    best = m.groupBy("file", "field").agg(F.min_by(F.struct("pos", "name", "score"), F.struct(-F.col("score"), "pos")).alias("x"))
    return best.select("file", "x.pos", "x.name", "field", "x.score")


@R.add("map_columns", f"WITH {MAPPING_SQL} SELECT * FROM mapped")
def map_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_columns(spark, sf_dir)


@R.add("mapping_review", f"WITH {MAPPING_SQL} SELECT cols.file, count(*) FILTER (score >= 0.85) AS confident, count(*) FILTER (score < 0.85) AS to_review, count(*) FILTER (score IS NULL) AS unmapped FROM cols LEFT JOIN mapped ON mapped.file = cols.file AND mapped.pos = cols.pos GROUP BY cols.file")
def mapping_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in COLUMN.items())).select("file", "pos")
    s = F.col("score")
    rows = cols.join(mapped_columns(spark, sf_dir).select("file", "pos", "score"), ["file", "pos"], "left")
    return rows.groupBy("file").agg(F.count_if(s >= 0.85).alias("confident"), F.count_if(s < 0.85).alias("to_review"), F.count_if(s.isNull()).alias("unmapped"))


TRANSFORMS = {"price": "currency_parse", "budget": "currency_parse", "technologies": "split", "status": "lowercase", "priority": "lowercase"}


@R.add("mapping_transforms", f"WITH {MAPPING_SQL} SELECT DISTINCT name, field, 'trim' || CASE field {' '.join(f'WHEN {chr(39)}{f}{chr(39)} THEN {chr(39)},{t}{chr(39)}' for f, t in TRANSFORMS.items())} ELSE '' END AS transforms FROM mapped")
def mapping_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.try_element_at(F.create_map(*(F.lit(x) for kv in TRANSFORMS.items() for x in kv)), F.col("field"))
    return mapped_columns(spark, sf_dir).select("name", "field").distinct().select("name", "field", F.concat_ws(",", F.lit("trim"), more).alias("transforms"))


#: Templates: name, columns by pattern, words of the file name.
TEMPLATES = (("catalog", ("nome", "brand", "categoria"), "list"), ("budget", ("budget", "owner"), "plan"), ("stock", ("sku", "quantit", "prezzo"), "stock"))


def template_sql() -> str:
    one = lambda n, ps, w: f"SELECT file, '{n}' AS template, {r('(0.5::DOUBLE * (' + ' + '.join(f'bool_or(contains(lower(name), {chr(39)}{p}{chr(39)}))::INT' for p in ps) + f') / {len(ps)} + 0.2::DOUBLE * (CASE file % 3 WHEN 0 THEN {chr(39)}list{chr(39)} WHEN 1 THEN {chr(39)}plan{chr(39)} ELSE {chr(39)}stock{chr(39)} END = {chr(39)}{w}{chr(39)})::INT) / 0.7::DOUBLE')} AS score FROM cols GROUP BY file"
    return " UNION ALL ".join(one(*t) for t in TEMPLATES)


@R.add("template_match", f"WITH cols AS (SELECT {', '.join(f'{e} AS {n}' for n, e in COLUMN.items())} FROM part), s AS ({template_sql()}) SELECT file, arg_max(template, (score, CASE template WHEN 'catalog' THEN 2 WHEN 'budget' THEN 1 ELSE 0 END)) AS template, max(score) AS score FROM s GROUP BY file HAVING max(score) >= 0.5")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template with the best share of columns (0.5) and file name (0.2), over
    the weights that are there; the first of equals."""
    cols = table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in COLUMN.items()))
    word = F.element_at(F.array(*(F.lit(w) for _, _, w in TEMPLATES)), (F.col("file") % 3 + 1).cast("int"))
    name = F.lower("name")
    g = cols.groupBy("file").agg(*(sum((F.bool_or(F.contains(name, F.lit(p))).cast("int") for p in ps), F.lit(0)).alias(t) for t, ps, _ in TEMPLATES))
    scores = F.array(*(F.struct(rounded((F.lit(0.5) * F.col(t) / len(ps) + F.lit(0.2) * (word == w).cast("int")) / 0.7).alias("s"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, ps, w) in enumerate(TEMPLATES)))
    return g.select("file", F.array_max(scores).alias("b")).where("b.s >= 0.5").select("file", F.col("b.t").alias("template"), F.col("b.s").alias("score"))


# ---- a file of lines to items, with statistics

#: Lines with quotes, doubled quotes, separators inside, empty cells and missing ends.
LINE = """CASE WHEN id % 31 = 0 THEN '"broken ' || CAST(id AS STRING) || '";x' WHEN id % 37 = 0 THEN '' ELSE '"' || replace(coalesce(name, ''), '"', '""') || CASE WHEN id % 5 = 0 THEN '; "" size' ELSE '' END || '";' || coalesce(vendor, '') || ';"' || coalesce(category, '') || '";"' || replace(price, '"', '') || '"' END"""
INGEST_SQL = f"""{RAW_SQL}, cells AS (SELECT id, CASE WHEN id % 31 = 0 THEN 'broken ' || id WHEN id % 37 = 0 THEN NULL ELSE nullif(trim(coalesce(name, '') || CASE WHEN id % 5 = 0 THEN '; " size' ELSE '' END), '') END AS name, CASE WHEN id % 31 = 0 THEN 'x' WHEN id % 37 = 0 THEN NULL ELSE nullif(trim(coalesce(vendor, '')), '') END AS vendor,
  CASE WHEN id % 31 = 0 OR id % 37 = 0 THEN NULL ELSE nullif(coalesce(category, ''), '') END AS category, CASE WHEN id % 31 = 0 OR id % 37 = 0 THEN NULL ELSE {price_sql('price')} END AS price FROM raw),
named AS (SELECT *, lower(name) AS key FROM cells WHERE name IS NOT NULL), kept AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY key, coalesce(vendor, '') ORDER BY id) = 1),
ingested AS (SELECT *, {r("(0.98::DOUBLE + 0.98::DOUBLE + CASE WHEN category IS NULL THEN 0.0::DOUBLE ELSE 0.98::DOUBLE END + CASE WHEN price IS NULL OR price = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END) / 4")} AS confidence, (vendor IS NULL)::INT + (category IS NULL)::INT + (price IS NULL OR price = 0)::INT AS to_review FROM kept)"""


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to items: cells read with their quotes, empty ones null, rows without
    a name dropped, the first of each name and vendor kept, with a confidence and
    the number of fields to review."""
    lines = raw(spark, sf_dir).select("id", F.expr(LINE).alias("line"))
    cells = F.from_csv("line", "name string, vendor string, category string, price string", {"sep": ";", "escape": '"', "mode": "PERMISSIVE"})
    rows = lines.select("id", cells.alias("c")).select("id", "c.*")
    text = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    named = rows.select("id", text("name"), text("vendor"), text("category"), F.when(F.col("price").isNotNull(), currency(F.col("price"))).alias("price")).where("name IS NOT NULL")
    best = named.groupBy(F.lower("name").alias("key"), F.coalesce("vendor", F.lit("")).alias("by")).agg(F.min_by(F.struct("id", "name", "vendor", "category", "price"), "id").alias("x")).select("x.*")
    dull = F.col("price").isNull() | (F.col("price") == 0)
    sure = (F.lit(0.98) + 0.98 + F.when(F.col("category").isNull(), 0.0).otherwise(0.98) + F.when(dull, 0.5).otherwise(0.9)) / 4
    review = F.col("vendor").isNull().cast("int") + F.col("category").isNull().cast("int") + dull.cast("int")
    return best.withColumns({"confidence": rounded(sure), "to_review": review})


@R.add("ingest_items", f"WITH {INGEST_SQL} SELECT id, name, vendor, category, price, confidence, to_review FROM ingested")
def ingest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, sf_dir)


@R.add("ingest_statistics", f"WITH {INGEST_SQL} SELECT (SELECT count(*) FROM raw) AS total_rows, count(*) AS items, (SELECT count(*) FROM raw) - count(*) AS skipped, {r('avg(confidence)', 4)} AS mean_confidence, CAST(sum(to_review) AS BIGINT) AS fields_to_review FROM ingested")
def ingest_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = raw(spark, sf_dir).agg(F.count("*").alias("total_rows"))  # one row
    g = ingested(spark, sf_dir).agg(F.count("*").alias("items"), rounded(F.avg("confidence"), 4).alias("mean_confidence"), F.sum("to_review").alias("fields_to_review"))
    return g.crossJoin(total).withColumn("skipped", F.col("total_rows") - F.col("items"))


# ---- tables of cells

CELL_SQL = "cells AS (SELECT floor(p_partkey / 12)::BIGINT AS sheet, (p_partkey % 12) // 3 AS row, p_partkey % 3 AS col, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN (p_partkey % 12) // 3 = 3 THEN 'Total' ELSE p_name END ELSE CAST(p_size AS VARCHAR) END AS text FROM part)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    row = F.floor(k % 12 / 3)
    text = F.when(k % 3 != 0, F.col("p_size").cast("string")).when(row == 3, "Total").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.floor(k / 12).alias("sheet"), row.alias("row"), (k % 3).alias("col"), text.alias("text"))


@R.add("table_rows", f"WITH {CELL_SQL} SELECT sheet, row, max(text) FILTER (col = 0) AS name, CAST(max(text) FILTER (col = 1) AS BIGINT) AS first, CAST(max(text) FILTER (col = 2) AS BIGINT) AS second FROM cells GROUP BY ALL HAVING NOT regexp_matches(coalesce(max(text) FILTER (col = 0), ''), '(?i)^(sub)?total')")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a table to rows; totals are dropped."""
    at = lambda i: F.max(F.when(F.col("col") == i, F.col("text")))
    g = cells(spark, sf_dir).groupBy("sheet", "row").agg(at(0).alias("name"), at(1).cast("long").alias("first"), at(2).cast("long").alias("second"))
    return g.where(~F.coalesce(F.col("name"), F.lit("")).rlike("(?i)^(sub)?total"))


@R.add("transposed_tables", f"WITH {CELL_SQL} SELECT sheet, col, string_agg(row || '=' || text, ';' ORDER BY row) AS item FROM cells GROUP BY ALL")
def transposed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column of a table is an item; its rows are the fields."""
    pair = F.struct("row", F.concat(F.col("row").cast("string"), F.lit("="), "text").alias("t"))
    g = cells(spark, sf_dir).groupBy("sheet", "col").agg(F.array_sort(F.collect_list(pair)).alias("p"))  # the rows of one table
    return g.select("sheet", "col", F.array_join(F.transform("p", lambda x: x["t"]), ";").alias("item"))


MONTHS_SQL = "m AS (SELECT DISTINCT o_orderpriority AS sheet, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m FROM orders WHERE o_orderdate IS NOT NULL), c AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY y, m) - 1 AS col FROM m)"


def header_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of a sheet for each priority of orders, over three rows: years,
    quarters and months with an order, and the columns that each spans."""
    o = table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL")
    m = o.selectExpr("o_orderpriority AS sheet", "year(o_orderdate) AS y", "quarter(o_orderdate) AS q", "month(o_orderdate) AS m").distinct()
    c = m.selectExpr("*", "row_number() OVER (PARTITION BY sheet ORDER BY y, m) - 1 AS col")  # a row for each month of a sheet
    rows = c.select("sheet", "col", F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.concat_ws("-", *k).alias("key"), F.concat(F.lit(p), F.col(t).cast("string")).alias("t")) for i, (k, p, t) in enumerate(((("y",), "", "y"), (("y", "q"), "Q", "q"), (("y", "m"), "M", "m")))))).alias("x")).select("sheet", "col", "x.*")
    return rows.groupBy("sheet", "level", "key", "t").agg(F.min("col").alias("a"), F.max("col").alias("b"))


@R.add("header_paths", f"WITH {MONTHS_SQL} SELECT sheet, col, y || ' > Q' || q || ' > M' || m AS path FROM c")
def header_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers over several rows: those that cover a column, by level."""
    c = header_spans(spark, sf_dir).select("sheet", "level", "t", F.explode(F.sequence("a", "b")).alias("col"))
    p = c.groupBy("sheet", "col").agg(F.array_sort(F.collect_list(F.struct("level", "t"))).alias("p"))  # a row a level
    return p.select("sheet", "col", F.array_join(F.transform("p", lambda x: x["t"]), " > ").alias("path"))


# ---- relations; what is related to is a name with the number of its items, so that no group is paired out

REQUIRES = ("requires", "depends on", "prerequisite", "richiede", "dipende da")


@R.add("name_references", f"WITH {RAW_SQL}, n AS (SELECT lower(p_name) AS mentioned, count(*) AS n FROM part GROUP BY 1) SELECT id, mentioned, n, CASE WHEN regexp_matches(lower(description), '{'|'.join(REQUIRES)}') THEN 'depends_on' ELSE 'related_to' END AS kind FROM raw JOIN n ON contains(' ' || lower(description) || ' ', ' ' || mentioned || ' ') AND length(mentioned) > 5")
def name_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that descriptions hold as whole words. Names and distinct texts meet on a name's
    first word, and only those are compared; a name stands for all its items. Words and items
    know their text by its digest."""
    names = table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("mentioned")).agg(F.count("*").alias("n")).where(F.length("mentioned") > 5)
    names = names.withColumn("word", F.split_part("mentioned", F.lit(" "), F.lit(1)))
    rows = raw(spark, sf_dir).where("description IS NOT NULL").select("id", F.lower("description").alias("d")).withColumn("text_id", F.sha2("d", 256))
    texts = materialize(rows.groupBy("text_id").agg(F.first("d").alias("d"), F.count("*").alias("k")), "texts")
    words = texts.select("text_id", F.explode(F.array_distinct(F.split("d", " "))).alias("word"))
    kind = F.when(F.col("d").rlike("|".join(REQUIRES)), "depends_on").otherwise("related_to")
    near = containment.across(words, names, ["word"]).join(texts, "text_id")
    held = near.where(F.contains(F.concat(F.lit(" "), "d", F.lit(" ")), F.concat(F.lit(" "), "mentioned", F.lit(" ")))).select("text_id", "k", "mentioned", "n", kind.alias("kind"))
    return join_by_weight(rows.select("id", "text_id"), held, ["text_id"], "k", rows.count()).select("id", "mentioned", "n", "kind")


COMPATIBLE = (("Security", "Infrastructure"), ("Applications", "Data Analytics"), ("Integration", "Applications"), ("Cloud", "Infrastructure"), ("Development", "Cloud"))


@R.add("category_links", f"WITH {P_SQL}, b(src, dst) AS (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{c}{chr(39)})' for a, c in COMPATIBLE)}), k AS (SELECT tenant, category, count(*) AS n, min(id) AS first FROM items GROUP BY ALL) SELECT x.tenant, src, dst, x.n AS src_items, y.n AS dst_items, x.n * y.n AS pairs, x.first AS src_first, y.first AS dst_first FROM b JOIN k x ON x.category = src JOIN k y ON y.category = dst AND y.tenant = x.tenant")
def category_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which categories of a tenant go together, by a bridge: a row for each two
    categories with the number of their pairs of items."""
    k = p_items(spark, sf_dir).groupBy("tenant", "category").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    b = F.broadcast(spark.createDataFrame(list(COMPATIBLE), "src string, dst string"))
    x = k.select("tenant", F.col("category").alias("src"), F.col("n").alias("src_items"), F.col("first").alias("src_first")).join(b, "src")
    y = k.select("tenant", F.col("category").alias("dst"), F.col("n").alias("dst_items"), F.col("first").alias("dst_first"))
    return x.join(y, ["tenant", "dst"]).withColumn("pairs", F.col("src_items") * F.col("dst_items"))


@R.add("known_recommendations", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey * 2 IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def known_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations of ids that exist."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("p_partkey"))
    return lines.join(table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey"), "p_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@R.add("phase_lookup", "WITH p AS (SELECT o_orderkey AS phase, l_partkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey), f AS (SELECT item, min(phase) AS phase FROM p GROUP BY item) SELECT p_partkey AS item, phase FROM part LEFT JOIN f ON item = p_partkey")
def phase_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phase that names an item, null for none."""
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.min("l_orderkey").alias("phase"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")).join(first, "item", "left")


@R.add("grid_of_types", f"WITH {P_SQL}, g AS (SELECT tenant, count(*) FILTER (category = 'Infrastructure' AND alignment >= 6) AS a, count(*) FILTER (category = 'Applications' AND alignment >= 6) AS b FROM items GROUP BY tenant) SELECT tenant, a AS infrastructure, b AS applications, a * b AS links FROM g WHERE a * b > 0")
def grid_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong infrastructure against strong applications: counts, not pairs."""
    strong = lambda k: F.count_if((F.col("category") == k) & (F.col("alignment") >= 6))
    g = p_items(spark, sf_dir).groupBy("tenant").agg(strong("Infrastructure").alias("infrastructure"), strong("Applications").alias("applications"))
    return g.withColumn("links", F.col("infrastructure") * F.col("applications")).where("links > 0")


# ---- duplicates against a store

SPLIT = "p_partkey % 3 = 0"
STORED = "lower(p_name) AS name, p_type AS kind, p_brand AS vendor, CASE WHEN p_size % 4 = 0 THEN NULL ELSE concat(lower(p_type), ' item of size ', p_size % 8) END AS told"
KINDS_SQL = f"new AS (SELECT {STORED}, min(p_partkey) AS id, count(*) AS n FROM part WHERE {SPLIT} GROUP BY 1, 2, 3, 4), old AS (SELECT {STORED}, min(p_partkey) AS id FROM part WHERE NOT ({SPLIT}) GROUP BY 1, 2, 3, 4)"
STORED_SPARK = ("lower(p_name) AS name", "p_type AS kind", "p_brand AS vendor", STORED.split("p_brand AS vendor, ")[1].replace("p_size % 8", "coalesce(CAST(p_size % 8 AS STRING), '')"))  # concat of DuckDB skips nulls
LIKE_SQL = "(1 - levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1})))"
SCORE_SQL = f"(0.4::DOUBLE * {LIKE_SQL.format('new.name', 'old.name')} + CASE WHEN new.told IS NOT NULL AND old.told IS NOT NULL THEN 0.2::DOUBLE * {LIKE_SQL.format('new.told', 'old.told')} ELSE 0 END + 0.15::DOUBLE * (new.kind = old.kind)::INT + 0.1::DOUBLE * (new.vendor = old.vendor)::INT) / CASE WHEN new.told IS NOT NULL AND old.told IS NOT NULL THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END"


@R.add("existing_duplicates", f"WITH {KINDS_SQL}, s AS (SELECT new.id, new.n, old.id AS existing, {r(SCORE_SQL)} AS score FROM new CROSS JOIN old) SELECT id, n, count(*) AS n_links, arg_max(existing, (score, -existing)) AS existing, max(score) AS score, max(score) > 0.95 AS keep_existing FROM s WHERE score > 0.85 GROUP BY id, n")
def existing_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New kinds of items (equal ones are one row) that the store has, by name,
    description, category and vendor: how many stored kinds are alike, and the
    likest; kinds without a name, category or vendor have no links. A pair that is
    alike enough loses at most 0.15 of all weights, so its names are alike and its
    categories equal. Kinds of one vendor are compared one by one; another vendor's
    likeness is the same whoever it is, so there sorts (name, category, description)
    are compared, with the number of their kinds."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", SPLIT + " AS fresh", *STORED_SPARK)
    keys = ["name", "kind", "vendor", "told"]
    whole = p.where("fresh IS NOT NULL AND name IS NOT NULL AND kind IS NOT NULL AND vendor IS NOT NULL")
    kinds = materialize(whole.groupBy("fresh", *keys).agg(F.min("p_partkey").alias("id"), F.count("*").alias("n")), "kinds")
    new = kinds.where("fresh").select(*keys, "id", "n")
    old = kinds.where("NOT fresh").select(*keys, F.col("id").alias("existing"))
    least = 1 - 0.15 * 0.85 / 0.4
    like = materialize(likeness.value_pairs(kinds.select("name"), "edit", least, likeness.edit_likeness(F.col("a"), F.col("b"))), "like")
    like = like.select(F.col("a").alias("name"), F.col("b").alias("b_name"), "like")
    renamed = lambda of: of.withColumnsRenamed({"name": "b_name", "told": "b_told"})
    told = F.col("told").isNotNull() & F.col("b_told").isNotNull()

    def score(of_told: Column, vendor: float) -> Column:
        total = F.lit(0.4) * F.col("like") + F.when(told, 0.2 * of_told).otherwise(0.0) + 0.15 + vendor
        return rounded(total / F.when(told, 0.85).otherwise(0.65))

    def scored(left: DataFrame, right: DataFrame, on: list[str], vendor: float) -> DataFrame:
        pairs = shuffled(shuffled(left).join(like, "name")).join(renamed(right), ["b_name", *on])
        at_best = pairs.where(score(F.lit(1.0), vendor) > 0.85)  # before descriptions are compared
        return at_best.withColumn("l", likeness.edit_likeness(F.col("told"), F.col("b_told"))).withColumn("s", score(F.col("l"), vendor)).where("s > 0.85")

    own = scored(new, old, ["kind", "vendor"], 0.1)
    own = own.select("id", "n", F.when(score(F.col("l"), 0.0) > 0.85, 0).otherwise(1).cast("long").alias("links"), "existing", "s")  # the others are counted below
    sort = ["name", "kind", "told"]
    stored = old.groupBy(*sort).agg(F.count("*").alias("links"), F.min("existing").alias("existing"))
    best = F.max_by("existing", F.struct("s", -F.col("existing"))).alias("existing")
    others = scored(new.select(*sort).distinct(), stored, ["kind"], 0.0).groupBy(*sort).agg(F.sum("links").alias("links"), best, F.max("s").alias("s"))
    # of one's own vendor the likest of a sort is likelier yet, and among ``own``; without a description another vendor's reaches 0.846
    linked = own.unionByName(shuffled(new).join(others, sort).select("id", "n", "links", "existing", "s"))
    found = linked.groupBy("id", "n").agg(F.sum("links").alias("n_links"), best, F.max("s").alias("score"))
    return found.withColumn("keep_existing", F.col("score") > 0.95)


FULL_SQL = "(" + " + ".join(f"CASE WHEN coalesce({c} <> '', false) THEN 0.5::DOUBLE + 0.5::DOUBLE * 0.8::DOUBLE ELSE 0.0::DOUBLE END" for c in ("name", "vendor", "category", "price", "status")) + ") / 7"


@R.add("canonical_items", f"WITH {RAW_SQL}, k AS (SELECT lower(trim(name)) AS key, id, {r(FULL_SQL)} AS complete FROM raw WHERE trim(coalesce(name, '')) <> '') SELECT key, count(*) AS n, min(id) AS keep_first, arg_max(id, (complete, -id)) AS keep_best, max(complete) AS complete FROM k GROUP BY key")
def canonical_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of items with one name the first, and the most complete one."""
    full = sum((F.when(F.coalesce(F.col(c) != "", F.lit(False)), F.lit(0.5) + F.lit(0.5) * 0.8).otherwise(0.0) for c in ("name", "vendor", "category", "price", "status")), F.lit(0.0)) / 7
    k = raw(spark, sf_dir).where(F.trim(F.coalesce("name", F.lit(""))) != "").select(F.lower(F.trim("name")).alias("key"), "id", rounded(full).alias("c"))
    return k.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("keep_first"), F.max_by("id", F.struct("c", -F.col("id"))).alias("keep_best"), F.max("c").alias("complete"))


# ---- catalog search



@R.add("query_terms", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM benchmark) WHERE length(word) > 2 AND word NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'are', 'was') GROUP BY word HAVING count(*) > 1")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of queries: longer than two letters and not too common."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word"))
    words = words.where((F.length("word") > 2) & ~F.col("word").isin("the", "and", "for", "with", "that", "this", "from", "are", "was"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")


TERMS = ("license", "data", "software", "public", "market")


@R.add("bm25_legacy", f"""WITH w AS (SELECT doc_id, length(text) AS chars, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, any_value(chars) AS chars, count(*) AS words, {', '.join(f"count(*) FILTER (word = '{t}') AS t{i}" for i, t in enumerate(TERMS))} FROM w WHERE word <> '' GROUP BY doc_id), a AS (SELECT avg(chars)::DOUBLE AS mean FROM n)
SELECT doc_id, {r(' + '.join(f't{i} * 2.2::DOUBLE / (t{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * words / mean))' for i in range(len(TERMS))))} AS score FROM n, a WHERE {' + '.join(f't{i}' for i in range(len(TERMS)))} > 0""")
def bm25_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term scores without the rareness of terms; length in words against a mean in signs."""
    w = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.length("text").alias("chars"), F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).where("word <> ''")
    n = w.groupBy("doc_id").agg(F.max("chars").alias("chars"), F.count("*").alias("words"), *(F.count_if(F.col("word") == t).alias(f"t{i}") for i, t in enumerate(TERMS)))
    mean = n.agg(F.avg(F.col("chars").cast("double")).alias("mean"))  # one row
    t = [F.col(f"t{i}") for i in range(len(TERMS))]
    score = sum((x * 2.2 / (x + 1.2 * (F.lit(0.25) + F.lit(0.75) * F.col("words") / F.col("mean"))) for x in t), F.lit(0.0))
    return n.where(sum(t, F.lit(0)) > 0).crossJoin(F.broadcast(mean)).select("doc_id", rounded(score).alias("score"))


PRODUCT, MAKER, KEYWORDS = "red widget", "brand#1", ("promo", "small")


@R.add("match_scores", f"""WITH s AS (SELECT p_partkey, CASE WHEN lower(p_name) = '{PRODUCT}' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE * (contains(lower(p_name), 'red')::INT + contains(lower(p_name), 'widget')::INT) / 2 END + CASE WHEN lower(p_brand) = '{MAKER}' THEN 0.3::DOUBLE ELSE 0 END + 0.5::DOUBLE * ((contains(lower(p_name || ' ' || p_type), '{KEYWORDS[0]}'))::INT + (contains(lower(p_name || ' ' || p_type), '{KEYWORDS[1]}'))::INT) / 2 AS x FROM part)
SELECT p_partkey, {r('least(1.0::DOUBLE, x)')} AS score FROM s WHERE x > 0""")
def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a product of the catalog fits: name, or words of it; maker; keywords."""
    name, words = F.lower("p_name"), PRODUCT.split()
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    share = lambda t, of: sum((F.contains(t, F.lit(w)).cast("int") for w in of), F.lit(0)) / len(of)
    x = F.when(name == PRODUCT, 0.9).otherwise(F.lit(0.7) * share(name, words)) + F.when(F.lower("p_brand") == MAKER, 0.3).otherwise(0.0) + F.lit(0.5) * share(text, KEYWORDS)
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("x")).where("x > 0").select("p_partkey", rounded(F.least(F.lit(1.0), F.col("x"))).alias("score"))
