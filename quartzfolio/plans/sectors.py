"""Sectors, taxonomies, types and sources of items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfolio.operators import sectors as se
from quartzfolio.operators import taxonomy as tx
from quartzfolio.plans.common import Registry, r, rounded, table
from quartzfolio.plans.portfolio import ITEMS_SQL as P_SQL
from quartzfolio.plans.portfolio import case
from quartzfolio.plans.portfolio import items as p_items

R = Registry()

HINTS = dict(enumerate((
    "'organic coffee and dairy snack food'", "'medical device for hospital patient and clinical health record'", "'vehicle engine brake pads'", "'silk apparel garment'", "'solar turbine for the power plant grid'", "'bank loan and credit card payment'",
    "'freight shipping and supply chain'", "'perfume and skincare lotion'", "'tractor seed fertilizer'", "'university training course'", "'hotel booking and restaurant'", "'cement concrete at the building site'", "'software api database cloud saas erp'", "'coffee hotel'", "'car bank'",
)))
TEXT = {"id": "p_partkey", "company": "CAST(floor(p_partkey / 7) AS BIGINT)", "text": f"p_name || ' ' || {case('p_partkey % 26', HINTS, chr(39) * 2)}"}
TEXT_SQL = "t AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in TEXT.items()) + " FROM part)"
DICT_SQL = "dict(sector, word, weight) AS (VALUES " + ", ".join(f"('{s}', '{w}', {x}::DOUBLE)" for s, ws in se.WORDS.items() for w, x in ws) + ")"
SCORES_SQL = f"""{TEXT_SQL}, {DICT_SQL}, tokens AS (SELECT id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM t),
hits AS (SELECT id, sector, weight FROM tokens JOIN dict USING (word) WHERE NOT contains(word, ' ') UNION ALL SELECT id, sector, weight * 1.2::DOUBLE FROM t JOIN dict ON contains(lower(text), word) WHERE contains(word, ' ')),
kw AS (SELECT id, sector, least(1.0::DOUBLE, {r('sum(weight) / 5', 9)}) AS score FROM hits GROUP BY ALL)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in TEXT.items()))


def keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.keyword_scores(texts(spark, sf_dir).select("id", "text"), se.dictionary(spark))


def best_sql(scores: str) -> str:
    return f"""x AS (SELECT id, sector, score, coalesce(lead(score) OVER w, 0) AS next, row_number() OVER w AS n FROM {scores} WINDOW w AS (PARTITION BY id ORDER BY score DESC, sector)),
det AS (SELECT t.id, CASE WHEN score >= 0.2 THEN sector ELSE 'unknown' END AS sector, CASE WHEN score >= 0.5 AND score - next > 0.15 THEN least(score, 0.95::DOUBLE) WHEN score >= 0.2 THEN score ELSE 0.3 END::DOUBLE AS confidence FROM t LEFT JOIN x ON x.id = t.id AND n = 1)"""


@R.add("sector_keywords", f"WITH {SCORES_SQL} SELECT id, sector, {r('score')} AS score FROM kw")
def sector_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword(spark, sf_dir).select("id", "sector", rounded(F.col("score")).alias("score"))


@R.add("sector_detect", f"WITH {SCORES_SQL}, {best_sql('kw')} SELECT id, sector, {r('confidence')} AS confidence FROM det")
def sector_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.detected(texts(spark, sf_dir), keyword(spark, sf_dir)).withColumn("confidence", rounded(F.col("confidence")))


SEMANTIC = "CAST((id * 31 + length(sector) * 7) % 100 AS DOUBLE) / CAST(100 AS DOUBLE)"


@R.add("sector_hybrid", f"WITH {SCORES_SQL}, names AS (SELECT DISTINCT sector FROM dict WHERE sector LIKE '%e'), sem AS (SELECT id, sector, {SEMANTIC} AS score FROM t CROSS JOIN names), h AS (SELECT id, sector, {r('0.4::DOUBLE * coalesce(kw.score, 0) + 0.6::DOUBLE * coalesce(sem.score, 0)', 9)} AS score FROM kw FULL JOIN sem USING (id, sector)), {best_sql('h')} SELECT id, sector, {r('confidence')} AS confidence FROM det")
def sector_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and semantic scores (here: given ones for a few sectors) together."""
    names = [s for s in se.WORDS if s.endswith("e")]
    sem = texts(spark, sf_dir).select("id", F.explode(F.array(*map(F.lit, names))).alias("sector")).withColumn("score", F.expr(SEMANTIC))
    h = se.hybrid(keyword(spark, sf_dir), sem).withColumn("score", rounded(F.col("score"), 9))
    return se.detected(texts(spark, sf_dir), h).withColumn("confidence", rounded(F.col("confidence")))


@R.add("company_sector", f"""WITH {TEXT_SQL}, {DICT_SQL}, h AS (SELECT company, sector, floor(sum(weight) * 1e6 + 0.5) AS w FROM t JOIN dict ON contains(lower(text), word) GROUP BY ALL), n AS (SELECT company, count(*) AS n FROM t GROUP BY company),
k AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY w DESC, sector) AS place, max(w) OVER (PARTITION BY company) AS top, sum(w) OVER (PARTITION BY company) AS total FROM h),
o AS (SELECT company, string_agg(sector, ',' ORDER BY place) AS others FROM (SELECT * FROM k WHERE place > 1 AND w >= 0.3::DOUBLE * top QUALIFY row_number() OVER (PARTITION BY company ORDER BY place) <= 2) GROUP BY company)
SELECT n.company, CASE WHEN n >= 3 AND k.sector IS NOT NULL THEN k.sector ELSE 'unknown' END AS sector, CASE WHEN n >= 3 AND k.sector IS NOT NULL THEN coalesce(others, '') ELSE '' END AS others, CASE WHEN n >= 3 AND k.sector IS NOT NULL THEN {r('least(0.95::DOUBLE, top / total + 0.3::DOUBLE)')} ELSE 0.3 END::DOUBLE AS confidence FROM n LEFT JOIN k ON k.company = n.company AND place = 1 LEFT JOIN o ON o.company = n.company""")
def company_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.company_sectors(texts(spark, sf_dir), se.dictionary(spark)).withColumn("confidence", rounded(F.col("confidence")))


def code_sql(codes, bonus: float) -> str:
    rows = ", ".join(f"({i}, '{c}', {level}, '{s}', '{w}', {len([x for x in d.split() if len(x) > 2])})" for i, (c, level, s, d) in enumerate(codes) for w in d.split() if len(w) > 2)
    return f"""WITH {SCORES_SQL}, {best_sql('kw')}, code(o, code, level, sector, word, words) AS (VALUES {rows}), m AS (SELECT t.id, o, code, level, code.sector AS cs, det.sector AS sector, count(*)::DOUBLE / any_value(words) AS share FROM t JOIN det USING (id) JOIN code ON contains(lower(text), word) GROUP BY ALL),
s AS (SELECT id, o, code, {r(f"share * CASE WHEN cs = sector THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END + {bonus}::DOUBLE * level")} AS score FROM m) SELECT id, code, score FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, o) = 1"""


def with_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).join(se.detected(texts(spark, sf_dir), keyword(spark, sf_dir)).select("id", "sector"), "id")


@R.add("cpv_match", code_sql(se.CPV, 0.05))
def cpv_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.best_code(with_sector(spark, sf_dir), se.CPV, 0.05)


@R.add("ateco_match", code_sql(se.ATECO, 0.1))
def ateco_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.best_code(with_sector(spark, sf_dir), se.ATECO, 0.1)


#: A taxonomy of three levels from the parts: types, their brands, and sizes of these.
LEVELS = (("lower(substr(p_type, 1, 3))", "lower(p_type)"), ("concat(lower(substr(p_type, 1, 3)), '.', substr(p_brand, 7))", "lower(concat(p_type, ' ', p_brand))"), ("concat(lower(substr(p_type, 1, 3)), '.', substr(p_brand, 7), '.', p_size)", "min(lower(concat(p_type, ' ', p_brand, ' ', p_name)))"))
CODES = " UNION ALL ".join(f"SELECT {code} AS code, {text if text.startswith('min') else f'min({text})'} AS description, CASE WHEN min(p_type) = 'PROMO' THEN NULL ELSE length(min(p_type)) % 2 = 0 END AS service FROM part GROUP BY 1" for code, text in LEVELS)
ASKING = ("p_partkey AS id", "concat(p_name, ' ', p_brand, CASE WHEN p_partkey % 3 = 0 THEN concat(' ', p_type) ELSE '' END) AS text", "CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 = 1 END AS service")
ASKED = f"SELECT {', '.join(ASKING)} FROM part"
BAG_SQL = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9#]+'), lambda w: length(w) > 2))"
MATCHED_SQL = f"""codes AS ({CODES}), asked AS ({ASKED}), c AS (SELECT code, len(string_split(code, '.')) AS level, service AS kind, unnest({BAG_SQL.format('description')}) AS word, len({BAG_SQL.format('description')}) AS size FROM codes),
i AS (SELECT id, service, unnest({BAG_SQL.format('text')}) AS word FROM asked), h AS (SELECT id, code, level, size, count(*) AS n FROM i JOIN c USING (word) WHERE service IS NULL OR kind IS NULL OR service = kind GROUP BY ALL),
matched AS (SELECT id, code, {r('n::DOUBLE / size + 0.05::DOUBLE * level')} AS score FROM h WHERE {r('n::DOUBLE / size + 0.05::DOUBLE * level')} >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, code) = 1)"""


def taxonomy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Codes, and the items that ask for one."""
    part = table(spark, sf_dir, "part")
    levels = [part.groupBy(F.expr(code).alias("code")).agg(F.expr(text if text.startswith("min") else f"min({text})").alias("description"), F.expr("CASE WHEN min(p_type) = 'PROMO' THEN NULL ELSE length(min(p_type)) % 2 = 0 END").alias("service")) for code, text in LEVELS]
    asked = part.selectExpr(*ASKING)
    return reduce(DataFrame.unionByName, levels), asked


@R.add("taxonomy_match", f"WITH {MATCHED_SQL} SELECT id, code, score FROM matched")
def taxonomy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best code of each item in a taxonomy that is a table."""
    codes, asked = taxonomy(spark, sf_dir)
    return tx.best_codes(asked, codes, 0.05)


@R.add("taxonomy_rollup", f"WITH {MATCHED_SQL}, u AS (SELECT code, unnest(range(1, len(string_split(code, '.')) + 1)) AS level FROM matched) SELECT array_to_string(string_split(code, '.')[:level], '.') AS code, level, count(*) AS items FROM u GROUP BY 1, 2")
def taxonomy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items every code has, with all below it."""
    codes, asked = taxonomy(spark, sf_dir)
    return tx.rolled_up(tx.best_codes(asked, codes, 0.05))


@R.add("code_search", f"WITH codes AS ({CODES}), q AS (SELECT DISTINCT lower(p_name) AS query FROM part), s AS (SELECT query, code, {r('length(query)::DOUBLE / length(description)')} AS score FROM q JOIN codes ON contains(description, query)) SELECT query, code, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, code) AS place FROM s QUALIFY place <= 10")
def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each name the codes whose description holds it."""
    codes, _ = taxonomy(spark, sf_dir)
    return tx.search_codes(codes, table(spark, sf_dir, "part").select(F.col("p_name").alias("query")))


TYPE_WEIGHTS = {"product": (("platform", 0.6), ("software", 0.8), ("suite", 0.5), ("server", 0.6)), "service": (("hosting", 0.7), ("support", 0.6), ("consulting", 0.9), ("gateway", 0.4)), "initiative": (("project", 0.8), ("migration", 0.7))}


def type_score_sql(k: str) -> str:
    return " + ".join(f"CASE WHEN contains(x, '{w}') THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for w, v in TYPE_WEIGHTS[k])


@R.add("type_detection", f"WITH {P_SQL}, s AS (SELECT id, lower(coalesce(name, '') || ' ' || coalesce(description, '')) AS x FROM items), v AS (SELECT id, " + ", ".join(f"{type_score_sql(k)} AS {k}" for k in TYPE_WEIGHTS) + f" FROM s) SELECT id, CASE WHEN greatest({', '.join(TYPE_WEIGHTS)}) = 0 THEN 'product' " + " ".join(f"WHEN {k} = greatest({', '.join(TYPE_WEIGHTS)}) THEN '{k}'" for k in TYPE_WEIGHTS) + f" END AS type, {r('least(0.95::DOUBLE, greatest(' + ', '.join(TYPE_WEIGHTS) + '))')} AS score FROM v")
def type_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type with the highest summed weight of its words, the first of equals."""
    x = F.lower(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    total = lambda k: reduce(lambda a, b: a + b, (F.when(F.contains(x, F.lit(w)), v).otherwise(0.0) for w, v in TYPE_WEIGHTS[k]))
    best = F.array_max(F.array(*(F.struct(total(k).alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(TYPE_WEIGHTS))))
    rows = p_items(spark, sf_dir).select("id", best.alias("b"))
    return rows.select("id", F.when(F.col("b.s") > 0, F.col("b.k")).otherwise("product").alias("type"), rounded(F.least(F.lit(0.95), F.col("b.s"))).alias("score"))


#: Sources of an enrichment with their weight and priority.
SOURCES = (("history", 0.9, 1), ("catalog", 0.85, 2), ("registry", 0.7, 3), ("taxonomy", 0.6, 4))
FOUND = {s: f"CASE WHEN p_partkey % {m} = 0 THEN CAST(p_partkey * {k} % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END" for (s, _, _), m, k in zip(SOURCES, (2, 3, 4, 5), (37, 53, 71, 97), strict=True)}


@R.add("enrichment_sources", "WITH e AS (SELECT p_partkey AS id, " + ", ".join(f"{x} AS {s}" for s, x in FOUND.items()) + f" FROM part), u AS ({' UNION ALL '.join(f'SELECT id, {chr(39)}{s}{chr(39)} AS source, {s} AS c, {w}::DOUBLE AS w, {p} AS place FROM e WHERE {s} >= 0.5' for s, w, p in SOURCES)}) SELECT e.id, arg_min(source, place) AS source, CASE WHEN count(source) = 0 THEN 0.3 ELSE {r('least(0.99::DOUBLE, sum(c * w) / sum(w))')} END::DOUBLE AS confidence, count(source) AS n FROM e LEFT JOIN u USING (id) GROUP BY e.id")
def enrichment_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of 0.5 or more count; the first in priority fills, and the
    confidence is their weighed mean, 0.99 at most; 0.3 for none."""
    e = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", *(f"{x} AS {s}" for s, x in FOUND.items()))
    found = F.filter(F.array(*(F.struct(F.lit(s).alias("source"), F.col(s).alias("c"), F.lit(w).alias("w")) for s, w, _ in SOURCES)), lambda x: x["c"] >= 0.5)
    total = lambda f: F.aggregate("f", F.lit(0.0), f)
    sure = F.least(F.lit(0.99), total(lambda a, x: a + x["c"] * x["w"]) / total(lambda a, x: a + x["w"]))
    return e.select("id", found.alias("f")).select("id", F.get("f", 0)["source"].alias("source"), F.when(F.size("f") == 0, 0.3).otherwise(rounded(sure)).alias("confidence"), F.size("f").cast("long").alias("n"))


CATEGORY_PATTERNS = (("security", "firewall|identity|audit"), ("data", "reports|analytics|database"), ("platform", "kubernetes|cloud|server"), ("business", "erp|crm"))


@R.add("category_from_results", f"WITH {P_SQL}, m AS (SELECT tenant, id, CASE {' '.join(f'WHEN regexp_matches(lower(name), {chr(39)}{p}{chr(39)}) THEN {chr(39)}{k}{chr(39)}' for k, p in CATEGORY_PATTERNS)} END AS category FROM items) SELECT tenant, arg_max(category, id) FILTER (category IS NOT NULL) AS category, count(category) AS n FROM m GROUP BY tenant")
def category_from_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a tenant's results in order, the category that the last known one has."""
    kind = reduce(lambda out, kp: F.when(F.lower("name").rlike(kp[1]), kp[0]).otherwise(out), reversed(CATEGORY_PATTERNS), F.lit(None).cast("string"))
    m = p_items(spark, sf_dir).select("tenant", "id", kind.alias("category"))
    return m.groupBy("tenant").agg(F.max_by("category", F.when(F.col("category").isNotNull(), F.col("id"))).alias("c"), F.count("category").alias("n")).withColumnRenamed("c", "category")
