"""Text and item similarity, duplicates, vectors and ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfolio.functions import similarity, strings, vectors
from quartzfolio.operators import dedup, likeness, search, vector_index
from quartzfolio.operators.tables import materialize, shared_path
from quartzfolio.operators.windows import fold_maps, running_sum
from quartzfolio.plans.common import ITEMS_SQL, Registry, items, r, rounded, table

R = Registry()


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of parts; the least id stands for a name, ``n`` items have it."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.count("*").alias("n"))


PAIRS_SQL = "d AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1), p AS (SELECT a.id, a.name, b.id AS other, b.name AS other_name FROM d a JOIN d b ON a.id < b.id)"


@R.add("levenshtein_pairs", f"WITH {PAIRS_SQL}, s AS (SELECT id, other, {r('1 - levenshtein(lower(name), lower(other_name))::DOUBLE / greatest(length(name), length(other_name))')} AS likeness FROM p) SELECT * FROM s WHERE likeness >= 0.8")
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = rounded(strings.edit_similarity(F.col("name"), F.col("other_name"))).alias("likeness")
    return likeness.name_pairs(names(spark, sf_dir), "edit", 0.8).select("id", "other", like).where("likeness >= 0.8")


@R.add("jaro_winkler_pairs", f"WITH {PAIRS_SQL}, s AS (SELECT id, other, {r('jaro_winkler_similarity(lower(name), lower(other_name))')} AS likeness FROM p) SELECT * FROM s WHERE likeness >= 0.9")
def jaro_winkler_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = likeness.name_pairs(names(spark, sf_dir), "jaro_winkler", 0.9).select("id", "other", F.lower("name").alias("a"), F.lower("other_name").alias("b"))
    return pairs.select("id", "other", rounded(similarity.jaro_winkler("a", "b")).alias("likeness")).where("likeness >= 0.9")


NGRAM_SQL = f"""WITH {PAIRS_SQL}, n AS (SELECT id AS k, substr(lower(name), i::BIGINT, 2) AS g, count(*)::DOUBLE AS c FROM d, generate_series(1, 60) AS t(i) WHERE i < length(name) GROUP BY ALL),
z AS (SELECT k, sqrt(sum(c * c)) AS norm FROM n GROUP BY k), x AS (SELECT p.id, other, sum(a.c * b.c) AS dot FROM p JOIN n a ON a.k = p.id JOIN n b ON b.k = other AND b.g = a.g GROUP BY ALL)
SELECT id, other, {r('dot / (u.norm * v.norm)')} AS likeness FROM x JOIN z u ON u.k = id JOIN z v ON v.k = other WHERE {r('dot / (u.norm * v.norm)')} >= 0.7"""


@R.add("ngram_cosine_pairs", NGRAM_SQL)
def ngram_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = rounded(strings.bigram_cosine(F.lower("name"), F.lower("other_name"))).alias("likeness")
    return likeness.name_pairs(names(spark, sf_dir), "cosine", 0.7).select("id", "other", like).where("likeness >= 0.7")


@R.add("normalize_text", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", strings.normalized(F.concat("p_name", F.lit(" / "), "p_type")).alias("plain"), strings.slug(F.col("p_type")).alias("slug"))


STOP_SQL = ", ".join(f"'{w}'" for w in strings.STOP_WORDS)


@R.add("keywords", f"""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9àèéìòù]+')) AS word FROM documents), k AS (SELECT word FROM w WHERE length(word) >= 3 AND word NOT IN ({STOP_SQL}))
SELECT word, count(*) AS n FROM k GROUP BY word HAVING count(*) >= 20""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of documents with the number of documents that have them."""
    split = F.split(F.lower("text"), r"[^a-z0-9àèéìòù]+")
    own = F.array_distinct(F.filter(split, lambda w: (F.length(w) >= 3) & ~w.isin(*strings.STOP_WORDS)))
    words = table(spark, sf_dir, "documents").select(F.explode(own).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 20")


@R.add("dedup_exact_hash", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL")
def dedup_exact_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.by_content(table(spark, sf_dir, "documents"), "text", "doc_id")


#: Items to be compared: parts with a stock code and a description, either of them missing from some.
COMPARED = {
    "id": "p_partkey", "name": "p_name", "vendor": "p_brand", "category": "p_type", "price": "CAST(p_retailprice * (5 + p_partkey % 60) AS DOUBLE)",
    "sku": "CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE substr(md5(concat(p_partkey - p_partkey % 3, '')), 1, 8) END",
    "description": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(p_type, ' goods, size ', p_size % 10) END",
}


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in COMPARED.items()))


PLAIN_SQL = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
EDIT_SQL = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1 ELSE 1 - levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1})) END"
PROFILES_SQL = f"""src AS (SELECT {", ".join(f"{e} AS {n}" for n, e in COMPARED.items())} FROM part),
plain AS (SELECT id, price, {", ".join(f"{PLAIN_SQL.format(c)} AS {c}" for c in ("name", "vendor", "category", "sku", "description"))} FROM src WHERE name IS NOT NULL),
prof AS (SELECT min(id) AS id, count(*) AS copies, name, sku, description, vendor, category, price FROM plain GROUP BY ALL),
vals AS (SELECT name AS v, 'name' AS kind FROM prof UNION SELECT description, 'description' FROM prof WHERE description IS NOT NULL),
grams AS (SELECT kind, v, substr(v, i::BIGINT, 2) AS g, count(*)::DOUBLE AS c FROM vals, generate_series(1, 200) AS t(i) WHERE i < length(v) GROUP BY ALL),
norms AS (SELECT kind, v, sqrt(sum(c * c)) AS norm FROM grams GROUP BY ALL),
dots AS (SELECT a.kind, a.v AS a, b.v AS b, sum(a.c * b.c) AS dot FROM grams a JOIN grams b USING (kind, g) WHERE a.v <> b.v GROUP BY ALL),
duo AS (SELECT x.kind, x.v AS a, y.v AS b, greatest(length(x.v), length(y.v)) // 2 - 1 AS reach FROM vals x JOIN vals y USING (kind) WHERE x.v <> y.v),
walk(kind, a, b, reach, i, taken, matched) AS (
  SELECT kind, a, b, reach, 1, list_transform(range(length(b)), lambda x: false), '' FROM duo
  UNION ALL
  SELECT kind, a, b, reach, i + 1, list_transform(taken, lambda t, k: t OR coalesce(k = j, false)), matched || CASE WHEN j IS NULL THEN '' ELSE a[i] END FROM (
    SELECT *, list_filter(range(greatest(1, i - reach), least(length(b), i + reach) + 1), lambda j: NOT taken[j] AND b[j] = a[i])[1] AS j FROM walk WHERE i <= length(a))),
jaros AS (
  SELECT kind, a, b, CASE WHEN matched = '' THEN 0 ELSE (length(matched)::DOUBLE / length(a) + length(matched)::DOUBLE / length(b)
      + (length(matched) - len(list_filter(range(1, length(matched) + 1), lambda k: matched[k] <> list_filter(string_split(b, ''), lambda c, p: taken[p])[k])) / 2.0::DOUBLE) / length(matched)) / 3 END AS jaro
  FROM walk WHERE i = length(a) + 1),
likes AS (
  SELECT x.kind, x.v AS a, y.v AS b, CASE WHEN x.v = y.v THEN 1.0::DOUBLE ELSE greatest(
      jaro + 0.1::DOUBLE * ({" + ".join(f"(length(x.v) >= {i} AND length(y.v) >= {i} AND left(x.v, {i}) = left(y.v, {i}))::INT" for i in range(1, 5))}) * (1 - jaro),
      coalesce(dot / (m.norm * n.norm), 0), {EDIT_SQL.format("x.v", "y.v")}) END AS sim
  FROM vals x JOIN vals y USING (kind) LEFT JOIN dots ON dots.kind = x.kind AND dots.a = x.v AND dots.b = y.v LEFT JOIN jaros ON jaros.kind = x.kind AND jaros.a = x.v AND jaros.b = y.v
    LEFT JOIN norms m ON m.kind = x.kind AND m.v = x.v LEFT JOIN norms n ON n.kind = x.kind AND n.v = y.v)"""


def weighted_sql(least: float) -> str:
    """All pairs of profiles, without a filter; ``links`` are those alike enough."""
    edit = {c: EDIT_SQL.format(f"a.{c}", f"b.{c}") for c in ("sku", "vendor", "category")}
    like = edit | {"name": "n.sim", "description": "d.sim", "price": "CASE WHEN a.price = b.price THEN 1 ELSE 1 - abs(a.price - b.price) / greatest(abs(a.price), abs(b.price)) END"}
    both = {c: f"a.{c} IS NOT NULL AND b.{c} IS NOT NULL" for c in likeness.WEIGHTS}
    total = " + ".join(f"CASE WHEN {both[c]} THEN {w}::DOUBLE * ({like[c]}) ELSE 0 END" for c, w in likeness.WEIGHTS.items())
    weight = " + ".join(f"CASE WHEN {both[c]} THEN {w}::DOUBLE ELSE 0 END" for c, w in likeness.WEIGHTS.items())
    return f"""{PROFILES_SQL}, links AS (
  SELECT a.id, b.id AS other, {r(f"({total}) / ({weight})")} AS likeness FROM prof a JOIN prof b ON a.id < b.id
    JOIN likes n ON n.kind = 'name' AND n.a = a.name AND n.b = b.name LEFT JOIN likes d ON d.kind = 'description' AND d.a = a.description AND d.b = b.description
  WHERE {r(f"({total}) / ({weight})")} >= {least})"""


@R.add("item_similarity_join", f"""WITH RECURSIVE {weighted_sql(0.9)},
ends AS (SELECT id, other, likeness FROM links UNION ALL SELECT other, id, likeness FROM links),
n AS (SELECT ends.id, sum(copies)::BIGINT AS n_links, arg_max(other, (likeness, -other)) AS best, max(likeness) AS likeness FROM ends JOIN prof ON prof.id = other GROUP BY ends.id),
classes AS (SELECT id, min(id) OVER (PARTITION BY name, sku, description, vendor, category, price) AS class_id FROM plain)
SELECT classes.id, class_id, copies, coalesce(n_links, 0) AS n_links, best, n.likeness FROM classes JOIN prof ON prof.id = class_id LEFT JOIN n ON n.id = class_id""")
def item_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its class of equal items, and how many items of other
    classes it is linked to by weighted likeness, with the likest."""
    it = compared(spark, sf_dir)
    prof = materialize(likeness.profiles(it), "profiles")
    n = likeness.link_counts(prof, 0.9).withColumnRenamed("id", "class_id")
    classes = prof.select(F.col("id").alias("class_id"), "copies").join(n, "class_id", "left").fillna(0, ["n_links"])
    return likeness.members(it, prof).join(classes, "class_id")


def clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Classes of equal items, and ``id, head, likeness`` to it of each."""
    prof = materialize(likeness.profiles(compared(spark, sf_dir)), "profiles")
    return prof, materialize(likeness.leaders(prof, likeness.DUPLICATE), "heads")


@R.add("dedup_greedy")
def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its class of equal items and the first head before it that
    is at least 0.7 alike, else itself."""
    prof, heads = clusters(spark, sf_dir)
    return likeness.members(compared(spark, sf_dir), prof).join(heads.withColumnRenamed("id", "class_id"), "class_id").select("id", "class_id", "head")


@R.add("duplicate_groups")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every cluster of duplicates the mean likeness to its head, whether that
    confirms it, the item to keep, which is the first or the most complete one, and
    the values merged from all, those of the most complete items first."""
    it = compared(spark, sf_dir)
    prof, heads = clusters(spark, sf_dir)
    full = sum((F.when(F.coalesce(F.col(c).cast("string") != "", F.lit(False)), 0.5 + 0.5 * 0.8).otherwise(0.0) for c in likeness.WEIGHTS), F.lit(0.0))
    head_of = likeness.members(it, prof).join(heads.withColumnRenamed("id", "class_id"), "class_id").select("id", "class_id", "head")
    rows = it.withColumn("complete", rounded((full + 0.2 * 0.8) / 7)).join(head_of, "id")
    best = dedup.merged(rows, "head", list(likeness.WEIGHTS), "complete")
    kept = rows.groupBy("head").agg(F.min("id").alias("keep_first"), F.max_by("id", F.struct("complete", -F.col("id"))).alias("keep_best"))
    mean = heads.where("id <> head").groupBy("head").agg(rounded(F.avg("likeness")).alias("likeness"))
    groups = best.where("n > 1").join(kept, "head").join(mean, "head", "left").fillna(1.0, ["likeness"])  # only equal items
    return groups.withColumn("confirmed", F.col("likeness") >= likeness.CONFIRMED)


WORDS_SQL = "t AS (SELECT p_name || ' ' || p_type || ' ' || p_brand AS text, min(p_partkey) AS id FROM part GROUP BY 1), k AS (SELECT DISTINCT id, unnest(string_split(lower(text), ' ')) AS word FROM t)"


@R.add("jaccard_pairs", f"""WITH {WORDS_SQL}, z AS (SELECT id, count(*) AS n FROM k GROUP BY id), c AS (SELECT a.id, b.id AS other, count(*) AS shared FROM k a JOIN k b ON a.word = b.word AND a.id < b.id GROUP BY ALL)
SELECT c.id, other, {r('shared::DOUBLE / (x.n + y.n - shared)')} AS likeness FROM c JOIN z x ON x.id = c.id JOIN z y ON y.id = other WHERE shared::DOUBLE / (x.n + y.n - shared) >= 0.75""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts of parts that share words; equal texts are one row."""
    texts = table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text")).agg(F.min("p_partkey").alias("id"))
    return likeness.jaccard_join(texts.select("id", F.split(F.lower("text"), " ").alias("words")), 0.75).withColumn("likeness", rounded(F.col("likeness")))


@R.add("minhash_lsh_pairs")
def minhash_lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate names of parts: 20 bands of 5 seeded hashes over letter
    triples, verified by exact Jaccard; copies are tied to their least id."""
    return dedup.lsh_pairs(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text")), 0.75)


COSINE_SQL = """q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query, vec_id, label, list_sum(list_transform(list_zip(q, embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS cosine FROM q CROSS JOIN embeddings WHERE vec_id <> query)"""


@R.add("cosine_topk", f"WITH {COSINE_SQL} SELECT query, vec_id, {r('cosine', 5)} AS cosine, row_number() OVER (PARTITION BY query ORDER BY floor(cosine * 1e5 + 0.5) DESC, vec_id) AS place FROM s QUALIFY place <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of a stated query set, which meets all vectors in
    blocks; the ten best of every block come first."""
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.nearest(vecs.where("vec_id % 20 = 0"), vecs, 10, 5)


@R.add("vector_index_topk")
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each query whose id is divisible by 20, from an
    index of all vectors that is written and read back."""
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    (centroids, probes), path = vector_index.learn(vecs), shared_path(spark, "index")
    vector_index.build(vecs, centroids, path)
    return vector_index.search(spark.read.parquet(path), centroids, vecs.where("vec_id % 20 = 0"), 10, probes)


@R.add("cosine_matrix_label", f"""WITH v AS (SELECT label, i, avg(x)::DOUBLE AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM v GROUP BY label)
SELECT a.label, b.label AS other, {r('sum(a.x * b.x) / (any_value(x.norm) * any_value(y.norm))', 5)} AS cosine FROM v a JOIN v b ON a.i = b.i AND a.label < b.label JOIN n x ON x.label = a.label JOIN n y ON y.label = b.label GROUP BY 1, 2""")
def cosine_matrix_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the mean vectors of each two labels (a few labels)."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vec = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    other = vec.select(F.col("label").alias("other"), F.col("v").alias("w"))
    return vec.join(F.broadcast(other), F.col("label") < F.col("other")).select("label", "other", rounded(vectors.cosine(F.col("v"), F.col("w")), 5).alias("cosine"))


QUERY_TERMS = ("license", "data", "software", "public", "market")
TERM_LIST = ", ".join(f"'{t}'" for t in QUERY_TERMS)
BM25_SQL = f"""w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, count(*) AS words FROM w WHERE word <> '' GROUP BY 1),
c AS (SELECT avg(words)::DOUBLE AS mean, count(*) AS docs FROM n), tf AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word IN ({TERM_LIST}) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
b AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * words / mean))) AS bm25 FROM tf JOIN df USING (word) JOIN n USING (doc_id) CROSS JOIN c GROUP BY doc_id)"""


@R.add("bm25_topk", f"WITH {BM25_SQL} SELECT doc_id, {r('bm25', 5)} AS bm25 FROM b ORDER BY floor(bm25 * 1e5 + 0.5) DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search.bm25(table(spark, sf_dir, "documents").where("text IS NOT NULL"), QUERY_TERMS)
    return scored.select("doc_id", rounded(F.col("bm25"), 5).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(20)


COMMON_SQL = ", ".join(f"'{w}'" for w in search.COMMON_TERMS)
ASKED_SQL = "SELECT DISTINCT query, word FROM (SELECT {key} AS query, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM {table} WHERE {key} % 20 = 0) WHERE length(word) >= 3 AND word NOT IN ({common})"
WORD_ROWS_SQL = "w AS (SELECT doc_id, length(text) AS signs, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents), tf AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY ALL)"


@R.add("bm25_query_topk", f"""WITH a AS ({ASKED_SQL.format(key='item_id', table='benchmark', common=COMMON_SQL)}), {WORD_ROWS_SQL}, n AS (SELECT doc_id, sum(tf) AS words FROM tf GROUP BY 1), c AS (SELECT avg(words)::DOUBLE AS mean, count(*) AS docs FROM n), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query, doc_id, {r('sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * words / mean)))', 5)} AS bm25 FROM a JOIN tf USING (word) JOIN df USING (word) JOIN n USING (doc_id) CROSS JOIN c GROUP BY query, doc_id)
SELECT query, doc_id, bm25, row_number() OVER (PARTITION BY query ORDER BY bm25 DESC, doc_id) AS place FROM s QUALIFY place <= 20""")
def bm25_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for each passage with an id divisible by 20."""
    asked = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query"), "text")
    return search.bm25_for(asked, table(spark, sf_dir, "documents").select("doc_id", "text"), 20)


@R.add("hybrid_rank", f"""WITH {COSINE_SQL}, near AS (SELECT query, vec_id AS doc_id, floor(cosine * 1e8 + 0.5) / 1e8 AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY floor(cosine * 1e8 + 0.5) DESC, vec_id) <= 30),
a AS ({ASKED_SQL.format(key='doc_id', table='documents', common=COMMON_SQL)}), {WORD_ROWS_SQL},
size AS (SELECT doc_id, coalesce(length(text), 0) AS signs, coalesce((SELECT sum(tf) FROM tf WHERE tf.doc_id = documents.doc_id), 0) AS words FROM documents),
c AS (SELECT query, doc_id, cosine, coalesce(signs, 0) AS signs, coalesce(words, 0) AS words, avg(coalesce(signs, 0)) OVER (PARTITION BY query) AS mean FROM near LEFT JOIN size USING (doc_id) WHERE cosine >= 0.35),
x AS (SELECT c.query, c.doc_id, any_value(cosine) AS cosine, floor(coalesce(sum(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * words / mean))), 0) * 1e8 + 0.5) / 1e8 AS bm25 FROM c LEFT JOIN (a JOIN tf USING (word)) h ON h.query = c.query AND h.doc_id = c.doc_id GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN query IN (SELECT query FROM a) THEN 0.7::DOUBLE * CASE WHEN max(cosine) OVER q > min(cosine) OVER q THEN (cosine - min(cosine) OVER q) / (max(cosine) OVER q - min(cosine) OVER q) ELSE 0.5 END
  + 0.3::DOUBLE * CASE WHEN max(bm25) OVER q > min(bm25) OVER q THEN (bm25 - min(bm25) OVER q) / (max(bm25) OVER q - min(bm25) OVER q) ELSE 0.5 END ELSE cosine END AS z FROM x WINDOW q AS (PARTITION BY query))
SELECT query, doc_id, {r('z', 5)} AS score, row_number() OVER (PARTITION BY query ORDER BY {r('z', 5)} DESC, doc_id) AS place FROM m QUALIFY place <= 10""")
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document with an id divisible by 20 and a vector: thirty candidates
    by cosine, ranked anew with the terms of its text; the ten best."""
    vecs, docs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = vecs.where("vec_id % 20 = 0").join(docs, F.col("vec_id") == F.col("doc_id"), "left").select(F.col("vec_id").alias("query"), "text", "embedding")
    return search.reranked(asked, docs, vecs, 10)


@R.add("adaptive_cutoff", f"""WITH {COSINE_SQL}, t AS (SELECT query, floor(cosine * 1e8 + 0.5) / 1e8 AS cosine, row_number() OVER (PARTITION BY query ORDER BY floor(cosine * 1e5 + 0.5) DESC, vec_id) AS place FROM s QUALIFY place <= 10),
g AS (SELECT query, cosine, cosine - lead(cosine) OVER (PARTITION BY query ORDER BY cosine DESC) AS gap FROM t)
SELECT query, {r('CASE WHEN count(*) < 3 THEN 0.7 ELSE least(0.9::DOUBLE, greatest(0.5::DOUBLE, arg_max(cosine, gap))) END', 5)} AS threshold FROM g GROUP BY query""")
def adaptive_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query the score above the widest gap of its ten best."""
    from quartzfolio.operators.windows import adaptive_threshold

    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    best = search.nearest(vecs.where("vec_id % 20 = 0"), vecs, 10, 8)
    return adaptive_threshold(best, "query", "cosine").withColumn("threshold", rounded(F.col("threshold"), 5))


@R.add("min_max_norm", f"SELECT event_type, event_id, {r('CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.5 END')} AS scaled FROM events WINDOW w AS (PARTITION BY event_type)")
def min_max_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds are aggregated and joined back, so that no type meets in one task."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    bounds = e.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)
    return e.join(bounds, "event_type").select("event_type", "event_id", rounded(scaled).alias("scaled"))


@R.add("catalog_match", f"""WITH {ITEMS_SQL} SELECT id, name, CAST(10 * (contains(lower(name), 'red') AND contains(lower(category), 'promo'))::INT + 3 * contains(lower(name), 'red')::INT + 2 * contains(lower(category), 'promo')::INT AS BIGINT) AS score FROM items
WHERE contains(lower(name), 'red') OR contains(lower(category), 'promo') ORDER BY score DESC, id LIMIT 20""")
def catalog_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search of items: three for a term of the name, two for one of the
    category, ten more for all."""
    name, kind = F.contains(F.lower("name"), F.lit("red")), F.contains(F.lower("category"), F.lit("promo"))
    score = F.when(name & kind, 10).otherwise(0) + F.when(name, 3).otherwise(0) + F.when(kind, 2).otherwise(0)
    return items(spark, sf_dir).where(name | kind).select("id", "name", score.cast("long").alias("score")).orderBy(F.desc("score"), "id").limit(20)


@R.add("conversation_search", "SELECT conv_id, count(*) AS hits, min(turn) AS first_turn FROM conversations WHERE list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), 'the') OR list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), 'ok') GROUP BY conv_id")
def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.lower("text"), "[^a-z0-9]+")
    return table(spark, sf_dir, "conversations").where(F.arrays_overlap(words, F.array(F.lit("the"), F.lit("ok")))).groupBy("conv_id").agg(F.count("*").alias("hits"), F.min("turn").alias("first_turn"))


@R.add("running_context", f"""WITH {ITEMS_SQL}, o AS (SELECT vendor, id, sum(length(name || chr(10))) OVER (PARTITION BY vendor ORDER BY business_value DESC NULLS LAST, id) AS used FROM items)
SELECT vendor, count(*) AS n, CAST(max(used) AS BIGINT) AS used FROM o WHERE used <= 6000 GROUP BY vendor""")
def running_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each vendor's best items fit in a context of 6000 signs."""
    rows = items(spark, sf_dir).select("vendor", "id", F.coalesce(-F.col("business_value"), F.lit(0)).alias("step"), (F.length("name") + 1).alias("size"))
    o = running_sum(rows, ["vendor"], F.col("step"), ["id"], "size", "used")
    return o.where("used <= 6000").groupBy("vendor").agg(F.count("*").alias("n"), F.max("used").alias("used"))


@R.add("chunk_documents")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 1024 signs that overlap by 128."""
    return search.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@R.add("upsert_latest", "WITH u AS (SELECT user_id, event_type, ts, event_id, value, 0 AS fresh FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT user_id, event_type, ts, event_id, value + 1, 1 FROM events WHERE event_id % 3 = 0) SELECT user_id, event_type, event_id, value FROM u QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY fresh DESC, ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace stored ones of their key; both sides send a row a key."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return dedup.upsert(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0").withColumn("value", F.col("value") + 1), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@R.add("union_sources", """SELECT 'part' AS origin, p_partkey AS key, p_name AS name, p_type AS category, NULL::DOUBLE AS balance FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL, s_acctbal FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name, c_mktsegment, c_acctbal FROM customer""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with different columns under common names."""
    kinds = {"part": ("p_partkey", "p_name", {"p_type": "category"}), "supplier": ("s_suppkey", "s_name", {"s_acctbal": "balance"}), "customer": ("c_custkey", "c_name", {"c_mktsegment": "category", "c_acctbal": "balance"})}
    out = None
    for origin, (key, name, more) in kinds.items():
        part = table(spark, sf_dir, origin).select(F.lit(origin).alias("origin"), F.col(key).alias("key"), F.col(name).alias("name"), *(F.col(c).alias(n) for c, n in more.items()))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select("origin", "key", "name", "category", "balance")


@R.add("multi_query_fold", f"""WITH RECURSIVE h AS (SELECT user_id, value::DOUBLE AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f(user_id, n, state) AS (SELECT user_id, n, v FROM h WHERE n = 1 UNION ALL SELECT f.user_id, f.n + 1, (f.state + h.v) / 2 FROM f JOIN h ON h.user_id = f.user_id AND h.n = f.n + 1)
SELECT user_id, {r('arg_max(state, n)')} AS score FROM f GROUP BY user_id""")
def multi_query_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of one key averaged in pairs as they come."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    line = (F.lit(0.5), F.col("value") / 2, F.lit(float("-inf")), F.lit(float("inf")))
    out = fold_maps(e, ["user_id"], ["ts", "event_id"], line, None)
    return out.select("user_id", rounded(F.col("state")).alias("score"))
