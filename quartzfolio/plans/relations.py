"""Documents to each other, sections, aliases, semantic search, strategies and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzfolio.functions import items as fi
from quartzfolio.operators import containment, references, search
from quartzfolio.operators.scoring import settled
from quartzfolio.operators import validation as va
from quartzfolio.operators.windows import adaptive_threshold
from quartzfolio.plans.common import ITEMS_SQL, Registry, items, r, rounded, table
from quartzfolio.plans.portfolio import ITEMS_SQL as P_SQL
from quartzfolio.plans.portfolio import case
from quartzfolio.plans.portfolio import items as p_items
from quartzfolio.plans.prioritize import SCORED_SQL, scored
from quartzfolio.plans.similarity import COSINE_SQL
from quartzfolio.plans.validation import RAW_SQL, numbered, raw

R = Registry()

# ---- documents

FILE_SQL = "replace(p_name, ' ', '_') || CASE p_partkey % 5 WHEN 0 THEN '_v' || CAST(p_partkey % 4 + 1 AS STRING) WHEN 1 THEN '_rev' || CAST(p_partkey % 3 + 1 AS STRING) WHEN 2 THEN '_part' || CAST(p_partkey % 3 + 1 AS STRING) WHEN 3 THEN '_appendix' ELSE '' END || '.pdf'"
STEM_SQL = "regexp_replace(file, '(_v[0-9]+|_rev[0-9]+|_part[0-9]+|_appendix)?\\.pdf$', '')"
KINDS = (("version", "_v[0-9]+\\.pdf$", 0.95), ("revision", "_rev[0-9]+\\.pdf$", 0.85), ("part", "_part[0-9]+\\.pdf$", 0.9), ("appendix", "_appendix\\.pdf$", 0.75))


@R.add("document_relations", f"WITH d AS (SELECT p_partkey AS id, {FILE_SQL} AS file FROM part), s AS (SELECT id, {STEM_SQL} AS stem, CASE {' '.join(f'WHEN regexp_matches(file, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{k}{chr(39)}' for k, p, _ in KINDS)} ELSE 'main' END AS kind, coalesce(TRY_CAST(regexp_extract(file, '([0-9]+)\\.pdf$', 1) AS INTEGER), 0) AS no FROM d) SELECT stem, kind, count(*) AS n, max(no) AS last_no, arg_max(id, (no, id)) AS latest, CASE kind {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {c}' for k, _, c in KINDS)} ELSE 1 END::DOUBLE AS confidence FROM s GROUP BY stem, kind")
def document_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions, revisions, parts and appendices of one document by file names:
    a row for each kind with its latest file, in place of all pairs."""
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(FILE_SQL).alias("file"))
    kind, sure = F.lit("main"), F.lit(1.0)
    for k, p, c in reversed(KINDS):
        kind, sure = F.when(F.col("file").rlike(p), k).otherwise(kind), F.when(F.col("kind") == k, c).otherwise(sure)
    s = d.select("id", F.regexp_replace("file", r"(_v[0-9]+|_rev[0-9]+|_part[0-9]+|_appendix)?\.pdf$", "").alias("stem"), kind.alias("kind"), F.coalesce(F.regexp_extract("file", r"([0-9]+)\.pdf$", 1).try_cast("int"), F.lit(0)).alias("no"))
    g = s.groupBy("stem", "kind").agg(F.count("*").alias("n"), F.max("no").alias("last_no"), F.max_by("id", F.struct("no", "id")).alias("latest"))
    return g.withColumn("confidence", sure)


#: Documents are known by their first four words.
TITLE = "regexp_extract(lower(text), '^[^a-z]*([a-z]+ [a-z]+ [a-z]+ [a-z]+)', 1)"


@R.add("content_references", f"""WITH d AS (SELECT doc_id, lower(text) AS low, {TITLE} AS title FROM documents), t AS (SELECT title AS found, count(*) AS n FROM d WHERE title <> '' GROUP BY 1),
h AS (SELECT doc_id, count(*) AS titles, sum(n)::BIGINT AS documents FROM d JOIN t ON contains(low, found) AND found <> coalesce(title, '') GROUP BY doc_id)
SELECT doc_id, coalesce(titles, 0) AS titles, coalesce(documents, 0) AS documents, CASE WHEN titles > 0 THEN 'references' WHEN regexp_matches(low, '{references.SEE_APPENDIX.replace(chr(92) + "s", "[ \t\n\r]")}') THEN 'supplements' END AS relation,
CASE WHEN titles > 0 THEN 0.7::DOUBLE WHEN regexp_matches(low, '{references.SEE_APPENDIX.replace(chr(92) + "s", "[ \t\n\r]")}') THEN 0.6::DOUBLE END AS confidence FROM d LEFT JOIN h USING (doc_id)""")
def content_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents' texts hold the titles of others, or point to an appendix."""
    return references.content_references(table(spark, sf_dir, "documents").select("doc_id", "text"), F.expr(TITLE))


TOC = "'Contents' || chr(10) || '1. Scope of ' || p_name || ' ... ' || CAST(1 + p_size % 3 AS STRING) || chr(10) || '2. Parts ... ' || CAST(5 + p_size % 4 AS STRING) || chr(10) || 'no entry' || chr(10) || '3. Appendix ... ' || CAST(12 + p_size % 5 AS STRING)"


@R.add("toc_sections", f"WITH l AS (SELECT p_partkey AS id, unnest(string_split({TOC}, chr(10))) AS s FROM part), t AS (SELECT id, regexp_extract(s, '^[0-9]+\\. (.+) \\.\\.\\. ([0-9]+)$', 1) AS title, TRY_CAST(regexp_extract(s, '^[0-9]+\\. (.+) \\.\\.\\. ([0-9]+)$', 2) AS INTEGER) AS first FROM l) SELECT id, title, first AS first_page, coalesce(lead(first) OVER (PARTITION BY id ORDER BY first) - 1, 20) AS last_page FROM t WHERE first IS NOT NULL")
def toc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a table of contents; each ends before the next begins. Lines of
    a document stay in its row."""
    p = r"^[0-9]+\. (.+) \.\.\. ([0-9]+)$"
    lines = F.filter(F.split(F.expr(TOC), "\n"), lambda s: s.rlike(p))
    each = F.array_sort(F.transform(lines, lambda s: F.struct(F.regexp_extract(s, p, 2).cast("int").alias("first"), F.regexp_extract(s, p, 1).alias("title"))))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), each.alias("e"))
    spans = F.transform("e", lambda x, i: F.struct(x["title"].alias("title"), x["first"].alias("first_page"), F.coalesce(F.get("e", i + 1)["first"] - 1, F.lit(20)).alias("last_page")))
    return rows.select("id", F.inline(spans))


@R.add("document_plan", "SELECT source, coalesce(lang, '-') AS lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(ceil(length(text) / 3000.0)) AS BIGINT) AS pages, max(length(text)) AS longest FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def document_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be read: documents, pages of 3000 signs, the longest."""
    n = F.length("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("source", F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count("*").alias("n"), F.sum(n).cast("long").alias("chars"), F.sum(F.ceil(n / 3000.0)).cast("long").alias("pages"), F.max(n).cast("long").alias("longest"))


@R.add("paragraph_chunks", "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL), c AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(s) - 1 AS before FROM p) SELECT doc_id, CAST(before // 2000 AS BIGINT) AS chunk, count(*) AS lines, CAST(sum(length(s)) AS BIGINT) AS chars FROM c GROUP BY ALL")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines gathered into chunks by where they begin, 2000 signs each; a text is
    folded in its row."""
    lines = F.split("text", "\n")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<chunk:bigint,size:bigint>>").alias("out"))
    folded = F.aggregate(lines, start, lambda s, x: F.struct((s["at"] + F.length(x) + 1).cast("long").alias("at"), F.array_append(s["out"], F.struct(F.floor(s["at"] / 2000).cast("long").alias("chunk"), F.length(x).cast("long").alias("size"))).alias("out")))
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.inline(folded["out"]))
    return rows.groupBy("doc_id", "chunk").agg(F.count("*").alias("lines"), F.sum("size").alias("chars"))


@R.add("rag_documents", f"WITH {P_SQL} SELECT id, name || coalesce(chr(10) || description, '') || coalesce(chr(10) || 'Vendor: ' || vendor, '') || coalesce(chr(10) || 'Category: ' || category, '') AS content, sha256(name || coalesce(chr(10) || description, '') || coalesce(chr(10) || 'Vendor: ' || vendor, '') || coalesce(chr(10) || 'Category: ' || category, '')) AS hash FROM items")
def rag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as documents of a vector store, with the hash that they are kept by."""
    label = lambda k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(k), F.col(c)))
    content = F.concat_ws("\n", "name", "description", label("Vendor: ", "vendor"), label("Category: ", "category"))
    return p_items(spark, sf_dir).select("id", content.alias("content"), F.sha2(content, 256).alias("hash"))


# ---- names

ALIASES = {"crm cloud": "Salesforce", "sap erp core": "SAP ERP", "power bi reports": "Power BI", "kubernetes platform": "Kubernetes", "red widget": "Widget R", "blue widget": "Widget B"}
ALIAS_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items()) + " END"
PLAIN_SQL = "trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def plain(c: str):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_\s]", " "), r"\s+", " "))


@R.add("canonical_names", f"WITH {P_SQL}, p AS (SELECT id, name, {PLAIN_SQL} AS k FROM items) SELECT id, coalesce({ALIAS_SQL.format('k')}, name) AS canonical, {ALIAS_SQL.format('k')} IS NOT NULL AS known FROM p")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.try_element_at(va.names(ALIASES), plain("name"))
    return p_items(spark, sf_dir).select("id", F.coalesce(known, F.col("name")).alias("canonical"), known.isNotNull().alias("known"))


@R.add("semantic_classes", f"WITH {RAW_SQL}, p AS (SELECT id, nullif({PLAIN_SQL}, '') AS k FROM raw), c AS (SELECT id, coalesce({ALIAS_SQL.format('k')}, k) AS key, {ALIAS_SQL.format('k')} IS NOT NULL AS by_alias FROM p WHERE k IS NOT NULL) SELECT key, count(*) AS n, min(id) AS first_id, CASE WHEN bool_or(by_alias) THEN 0.99 ELSE 1.0 END::DOUBLE AS confidence FROM c GROUP BY key HAVING count(*) > 1")
def semantic_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one product: the same alias, or the same plain name."""
    k = F.nullif(plain("name"), F.lit(""))
    c = raw(spark, sf_dir).select("id", k.alias("k")).where("k IS NOT NULL").withColumn("known", F.try_element_at(va.names(ALIASES), F.col("k")))
    g = c.groupBy(F.coalesce("known", "k").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.when(F.bool_or(F.col("known").isNotNull()), 0.99).otherwise(1.0).alias("confidence"))
    return g.where("n > 1")


@R.add("name_dedup_longest", f"WITH {RAW_SQL}, k AS (SELECT lower(trim(name)) AS key, id, coalesce(description, '') AS d FROM raw WHERE trim(coalesce(name, '')) <> '') SELECT key, count(*) AS n, arg_max(id, (length(d), -id)) AS kept FROM k GROUP BY key")
def name_dedup_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of items with one name that with the longest description."""
    k = raw(spark, sf_dir).where(F.trim(F.coalesce("name", F.lit(""))) != "").select(F.lower(F.trim("name")).alias("key"), "id", F.length(F.coalesce("description", F.lit(""))).alias("d"))
    return k.groupBy("key").agg(F.count("*").alias("n"), F.max_by("id", F.struct("d", -F.col("id"))).alias("kept"))


PART_WORDS = "(?i)phase|step|part|module|component|fase|parte|modulo"
#: Names of parts: some are steps or modules of others, with words before and after.
MODULE_SQL = "CASE p_partkey % 6 WHEN 0 THEN p_name || ' module' WHEN 1 THEN 'Phase ' || p_size || ': ' || p_name || ' rollout' WHEN 2 THEN split_part(p_name, ' ', 2) ELSE p_name END"


@R.add("part_of", f"""WITH d AS (SELECT p_partkey AS id, p_type AS kind, lower({MODULE_SQL}) AS name FROM part), c AS (SELECT kind, name, count(*) AS n, min(id) AS first FROM d WHERE kind <> '' AND name <> '' GROUP BY ALL)
SELECT a.kind, a.name, b.name AS whole, a.n AS n_parts, b.n AS n_wholes, a.first AS first_part, b.first AS first_whole, 0.75::DOUBLE AS confidence FROM c a JOIN c b ON b.kind = a.kind AND contains(a.name, b.name) AND length(b.name) < length(a.name) WHERE regexp_matches(a.name, '{PART_WORDS}')""")
def part_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components, by a word of their name, and the wholes of the same category
    whose names theirs hold; a row for each two names, with the items of each."""
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.expr(MODULE_SQL).alias("name"))
    return containment.part_of(d, F.col("name").rlike(PART_WORDS))


# ---- relations of items

RELATION_SQL = case("p_partkey % 9", numbered("'conflicts with the old one'", "'requires a server'", "'works with all'", "'successor to it'", "'plugin for mail'"), "'alone'")


@R.add("conflicts", f"WITH d AS (SELECT p_partkey AS id, {RELATION_SQL} AS d FROM part) SELECT id, 'conflicts_with' AS kind FROM d WHERE contains(d, 'conflicts with') OR contains(d, 'incompatible with') OR contains(d, 'not compatible') OR contains(d, 'cannot use with')")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = fi.first_kind(F.expr(RELATION_SQL), fi.DEPENDENCY_WORDS)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind")).where("kind = 'conflicts_with'")


@R.add("date_dependencies", "SELECT a.o_orderkey AS src, b.o_orderkey AS dst, date_diff('day', a.o_orderdate, b.l_last) AS days FROM orders a JOIN (SELECT o_orderkey, max(l_shipdate) AS l_last FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) b ON b.o_orderkey = a.o_orderkey // 2 AND a.o_orderkey > 0 WHERE a.o_orderdate < b.l_last")
def date_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What starts before the thing that it depends on (the order of half its
    number) has ended."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("dst")).agg(F.max("l_shipdate").alias("ends"))
    ordered = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dst")).join(last, "dst")
    src = table(spark, sf_dir, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("src"), "o_orderdate", F.floor(F.col("o_orderkey") / 2).alias("dst"))
    return src.join(ordered, "dst").where("o_orderdate < ends").select("src", "dst", F.datediff("ends", "o_orderdate").cast("long").alias("days"))


@R.add("cross_validation", f"""WITH {ITEMS_SQL}, i AS (SELECT 'budget' AS rule, 'warning' AS severity, count(*) AS n FROM items WHERE cost > budget UNION ALL SELECT 'owner', 'warning', count(*) FROM (SELECT owner FROM items WHERE risk IN ('critical', 'high') GROUP BY owner HAVING count(*) > 5)
UNION ALL SELECT 'name', 'info', count(*) FROM (SELECT name FROM items GROUP BY name HAVING count(*) > 1) UNION ALL SELECT 'end', 'error', count(*) FROM items WHERE lifecycle = 'end_of_life' AND phase = 1) SELECT *, severity = 'error' AND n > 0 AS fails FROM i""")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks across items as one report."""
    i = items(spark, sf_dir)
    n = lambda df, rule, severity: df.agg(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.count("*").alias("n"))
    owners = i.where("risk IN ('critical', 'high')").groupBy("owner").count().where("count > 5")
    out = n(i.where("cost > budget"), "budget", "warning").unionByName(n(owners, "owner", "warning")).unionByName(n(i.groupBy("name").count().where("count > 1"), "name", "info")).unionByName(n(i.where("lifecycle = 'end_of_life' AND phase = 1"), "end", "error"))
    return out.withColumn("fails", (F.col("severity") == "error") & (F.col("n") > 0))


# ---- search as a whole

@R.add("semantic_search", f"""WITH {COSINE_SQL}, t AS (SELECT query, vec_id, (1 + floor(cosine * 1e8 + 0.5) / 1e8) / 2 AS cosine, row_number() OVER (PARTITION BY query ORDER BY floor(cosine * 1e5 + 0.5) DESC, vec_id) AS place FROM s QUALIFY place <= 30),
f AS (SELECT * FROM t WHERE cosine >= 0.1), g AS (SELECT query, cosine, cosine - lead(cosine) OVER (PARTITION BY query ORDER BY cosine DESC) AS gap FROM f), c AS (SELECT query, CASE WHEN count(*) < 3 THEN 0.7 ELSE least(0.9::DOUBLE, greatest(0.5::DOUBLE, arg_max(cosine, gap))) END AS cut FROM g GROUP BY query),
m AS (SELECT query, vec_id, cosine FROM f JOIN c USING (query) WHERE cosine >= cut) SELECT query, vec_id, {r('cosine', 5)} AS cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS place FROM m QUALIFY place <= 10""")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty candidates of each query at a low threshold, cut at the widest gap
    of their scores (cosines moved to 0 to 1), ten at most."""
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = search.nearest(vecs.where("vec_id % 20 = 0"), vecs, 30, 8).select("query", "vec_id", ((1 + F.col("cosine")) / 2).alias("cosine")).where("cosine >= 0.1")
    cut = adaptive_threshold(near, "query", "cosine")
    kept = near.join(cut, "query").where("cosine >= threshold")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id")).cast("long")
    return kept.select("query", "vec_id", rounded(F.col("cosine"), 5).alias("cosine"), place.alias("place")).where("place <= 10")


# ---- what to do next

@R.add("quick_wins", f"WITH {SCORED_SQL} SELECT vendor, id, score FROM scored WHERE score >= 50 AND complexity = 'low' AND recommendation IN ('invest', 'optimize') QUALIFY row_number() OVER (PARTITION BY vendor ORDER BY score DESC, id) <= 3")
def quick_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quartzfolio.operators.windows import top_per_group

    rows = settled(scored(spark, sf_dir)).where("score >= 50 AND complexity = 'low' AND recommendation IN ('invest', 'optimize')").select("vendor", "id", "score")
    return top_per_group(rows, ["vendor"], [F.desc("score"), "id"], 3).select("vendor", "id", "score")


@R.add("implementation_strategy", f"WITH {ITEMS_SQL} SELECT id, CASE WHEN risk = 'critical' AND complexity = 'high' THEN 'phased' WHEN n_dependencies > 3 THEN 'coordinated' WHEN complexity = 'low' THEN 'big_bang' WHEN risk = 'low' THEN 'iterative' ELSE 'standard' END AS strategy, CASE WHEN id % 2 = 0 THEN 'in_house' WHEN complexity = 'high' THEN 'partner' ELSE 'outsourced' END AS delivery FROM items")
def implementation_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    how = F.when((c("risk") == "critical") & (c("complexity") == "high"), "phased").when(c("n_dependencies") > 3, "coordinated").when(c("complexity") == "low", "big_bang").when(c("risk") == "low", "iterative").otherwise("standard")
    return items(spark, sf_dir).select("id", how.alias("strategy"), F.when(c("id") % 2 == 0, "in_house").when(c("complexity") == "high", "partner").otherwise("outsourced").alias("delivery"))


@R.add("strategic_gaps", f"WITH {P_SQL}, g AS (SELECT tenant, category, avg(coalesce(alignment, 5)::DOUBLE) AS now, count(*) AS n FROM items WHERE category IS NOT NULL GROUP BY ALL) SELECT tenant, category, {r('8 - now', 4)} AS gap FROM g WHERE now < 8 QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY {r('8 - now', 4)} DESC, category) <= 6")
def strategic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six categories that are furthest below the target of 8, for each tenant."""
    g = p_items(spark, sf_dir).where("category IS NOT NULL").groupBy("tenant", "category").agg(F.avg(F.coalesce("alignment", F.lit(5)).cast("double")).alias("now")).where("now < 8")
    g = g.select("tenant", "category", rounded(8 - F.col("now"), 4).alias("gap"))
    return g.withColumn("n", F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc("gap"), "category"))).where("n <= 6").drop("n")


#: What a missing field weighs by its section.
ASKED = (("name", 10), ("vendor", 6), ("category", 8), ("budget", 7), ("status", 4), ("priority", 5), ("description", 3))


@R.add("open_questions", f"WITH {RAW_SQL}, u AS (" + " UNION ALL ".join(f"SELECT id, '{f}' AS field, {w} AS weight FROM raw WHERE NOT coalesce({f} <> '', false)" for f, w in ASKED) + ") SELECT id, string_agg(field, ',' ORDER BY weight DESC) AS fields, CAST(sum(weight) AS BIGINT) AS weight FROM u GROUP BY id")
def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that are missing, the weightiest first."""
    order = sorted(ASKED, key=lambda x: -x[1])
    missing = F.array_compact(F.array(*(F.when(va.empty(f), F.struct(F.lit(f).alias("f"), F.lit(w).alias("w"))) for f, w in order)))
    rows = raw(spark, sf_dir).select("id", missing.alias("m")).where(F.size("m") > 0)
    return rows.select("id", F.array_join(F.transform("m", lambda x: x["f"]), ",").alias("fields"), F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x["w"]).alias("weight"))


@R.add("next_review_batch", f"WITH {SCORED_SQL} SELECT vendor, id FROM scored WHERE score_confidence < 0.8 QUALIFY row_number() OVER (PARTITION BY vendor ORDER BY score_confidence, id) <= 5")
def next_review_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quartzfolio.operators.windows import top_per_group

    rows = settled(scored(spark, sf_dir)).where("score_confidence < 0.8").select("vendor", "id", "score_confidence")
    return top_per_group(rows, ["vendor"], ["score_confidence", "id"], 5).select("vendor", "id")


@R.add("tenant_isolation", f"WITH {P_SQL}, users AS (SELECT c_custkey AS user_id, c_custkey % 5 AS tenant FROM customer WHERE c_custkey < 3) SELECT user_id, id FROM items JOIN users USING (tenant)")
def tenant_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user sees the rows of the own tenant only."""
    users = table(spark, sf_dir, "customer").where("c_custkey < 3").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 5).alias("tenant"))
    return p_items(spark, sf_dir).join(users, "tenant").select("user_id", "id")


@R.add("inferred_attributes", f"WITH {P_SQL}, c AS (SELECT vendor, deployment, count(*) AS n FROM items GROUP BY ALL), m AS (SELECT vendor, arg_max(deployment, (n, deployment)) AS usual FROM c GROUP BY vendor) SELECT items.id, CASE WHEN license_type = 'Enterprise' THEN 'subscription' WHEN user_count > 1000 THEN 'per_user' ELSE 'one_time' END AS pricing, coalesce(nullif(items.deployment, 'hybrid'), usual) AS deployment FROM items LEFT JOIN m ON m.vendor IS NOT DISTINCT FROM items.vendor")
def inferred_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing attributes by rules, then by what is most common for the vendor."""
    i = p_items(spark, sf_dir)
    c = i.groupBy("vendor", "deployment").agg(F.count("*").alias("n")).groupBy(F.coalesce("vendor", F.lit("")).alias("v")).agg(F.max_by("deployment", F.struct("n", "deployment")).alias("usual"))
    pricing = F.when(F.col("license_type") == "Enterprise", "subscription").when(F.col("user_count") > 1000, "per_user").otherwise("one_time")
    rows = i.withColumn("v", F.coalesce("vendor", F.lit(""))).join(c, "v", "left")
    return rows.select("id", pricing.alias("pricing"), F.coalesce(F.nullif("deployment", F.lit("hybrid")), "usual").alias("deployment"))


@R.add("suite_consolidation", f"WITH {P_SQL} SELECT tenant, vendor, count(*) AS n, count(DISTINCT category) AS categories FROM items WHERE vendor IN ('Microsoft', 'Oracle', 'SAP SE', 'IBM') GROUP BY ALL HAVING count(*) >= 3")
def suite_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large vendors of which a tenant has three items or more."""
    g = p_items(spark, sf_dir).where(F.col("vendor").isin("Microsoft", "Oracle", "SAP SE", "IBM")).groupBy("tenant", "vendor")
    return g.agg(F.count("*").alias("n"), F.countDistinct("category").alias("categories")).where("n >= 3")


#: Conditions on features of a pattern: equality of values, and order.
CONDITIONS = (("status", "eq", "outdated"), ("risk", "ne", "low"), ("active_users", "gte", 100), ("category", "contains", "eco"))


@R.add("pattern_conditions", f"WITH {ITEMS_SQL} SELECT id, coalesce(status = 'outdated', false) AS eq, risk IS DISTINCT FROM 'low' AS ne, coalesce(active_users >= 100, false) AS gte, coalesce(contains(lower(category), 'eco'), false) AS contains_ FROM items")
def pattern_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of condition; a missing value passes ``ne`` only."""
    tests = {"eq": lambda c, v: c.eqNullSafe(F.lit(v)), "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)), "gte": lambda c, v: F.coalesce(c >= v, F.lit(False)), "contains": lambda c, v: F.coalesce(F.contains(F.lower(c), F.lit(v)), F.lit(False))}
    return items(spark, sf_dir).select("id", *(tests[k](F.col(f), v).alias("contains_" if k == "contains" else k) for f, k, v in CONDITIONS))


@R.add("expiry_cleanup", "SELECT event_type, count(*) AS kept FROM events WHERE ts + to_days(CAST(1 + event_id % 20 AS INTEGER)) >= TIMESTAMP '2024-01-20' GROUP BY event_type")
def expiry_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose time to live has not run out."""
    ends = F.col("ts") + F.make_dt_interval(days=(1 + F.col("event_id") % 20).cast("int"))
    return table(spark, sf_dir, "events").where(ends >= F.lit("2024-01-20").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("kept"))


@R.add("normalized_items", f"WITH {RAW_SQL} SELECT id, trim(name) AS name, coalesce(CASE lower(trim(vendor)) {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in va.VENDORS.items())} END, trim(vendor)) AS vendor, {r('least(0.99::DOUBLE, 0.35::DOUBLE * CASE WHEN type IS NULL THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END + 0.4::DOUBLE * (coalesce(vendor <> ' + chr(39) * 2 + ', false)::INT + coalesce(category <> ' + chr(39) * 2 + ', false)::INT) / 2 + 0.15::DOUBLE + 0.1::DOUBLE)')} AS confidence FROM raw WHERE trim(coalesce(name, '')) <> ''")
def normalized_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with clean names and known vendors, and what is trusted of them."""
    vendor = F.coalesce(F.try_element_at(va.names(va.VENDORS), F.lower(F.trim("vendor"))), F.trim("vendor"))
    full = sum((F.when(va.empty(c), 0).otherwise(1) for c in ("vendor", "category")), F.lit(0))
    sure = F.lit(0.35) * F.when(F.col("type").isNull(), 0.5).otherwise(0.9) + F.lit(0.4) * full / 2 + 0.15 + 0.1
    rows = raw(spark, sf_dir).where(F.trim(F.coalesce("name", F.lit(""))) != "")
    return rows.select("id", F.trim("name").alias("name"), vendor.alias("vendor"), rounded(F.least(F.lit(0.99), sure)).alias("confidence"))
