"""Ranked search: nearest vectors by blocks, BM25, hybrid ranks, chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzfolio.functions.numbers import half_up
from quartzfolio.operators.windows import top_per_group

#: Queries of a block; a task holds one block and streams vectors by.
BLOCK = 256


def nearest(queries: DataFrame, vecs: DataFrame, k: int, places: int) -> DataFrame:
    """The ``k`` nearest vectors (vec_id, embedding) of each query by cosine, a
    query itself left out.

    Queries lie in blocks of 256; every block meets every part of the vectors as
    a matrix product in a task of its own, which returns the best k of each query
    there, and only those are ranked together. Scores are rounded to ``places``
    digits before ranking; the lesser id wins ties. Rows without a vector or with a
    null in it neither ask nor are found.
    """
    whole = "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)"
    queries, vecs = queries.where(whole), vecs.where(whole)
    n = queries.count()
    blocks, parts = -(-n // BLOCK) or 1, max(1, int(vecs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = lambda c, m, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), key("vec_id", blocks, 1).alias("block"), F.lit(True).alias("asks")).withColumn("part", every(parts))
    right = vecs.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), key("vec_id", parts, 2).alias("part"), F.lit(False).alias("asks")).withColumn("block", every(blocks))

    def best(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        q, r = group[group["asks"]], group[~group["asks"]]
        if q.empty or r.empty:
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        unit = []
        for g in (q, r):
            m = np.stack(g["v"].to_numpy()).astype(np.float64)
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            unit.append(np.divide(m, norm, out=np.zeros_like(m), where=norm > 0))
        s = np.floor(unit[0] @ unit[1].T * 10.0**places + 0.5) / 10.0**places
        qs, rs = q["id"].to_numpy(), r["id"].to_numpy()
        order = np.argsort(rs, kind="stable")
        s, rs = s[:, order], rs[order]
        s[qs[:, None] == rs[None, :]] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query": np.repeat(qs, top.shape[1]), "vec_id": rs[top].ravel(), "cosine": np.take_along_axis(s, top, axis=1).ravel()})
        return out[np.isfinite(out["cosine"])]

    some = left.unionByName(right).groupBy("block", "part").applyInPandas(best, "query long, vec_id long, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id")
    return some.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def bm25(docs: DataFrame, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of the documents (doc_id, text) that have one of the terms. Texts are
    read and split once: their words become rows, which are counted before they
    leave the task. One row of totals is joined back."""
    found = docs.select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).where("word <> ''")
    of = range(len(terms))
    n = found.groupBy("doc_id").agg(F.count("*").alias("words"), *(F.count_if(F.col("word") == t).alias(f"tf{i}") for i, t in enumerate(terms)))
    totals = n.agg(F.count("*").alias("docs"), F.avg("words").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in of))
    score = F.lit(0.0)
    for i in of:
        t = F.col(f"tf{i}")
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + F.when(t > 0, idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("words") / F.col("mean")))).otherwise(0.0)
    hit = F.greatest(*(F.col(f"tf{i}") for i in of)) if len(terms) > 1 else F.col("tf0")
    return n.where(hit > 0).crossJoin(F.broadcast(totals)).select("doc_id", score.alias("bm25"))  # one row


#: Words too common to be asked for, and the shortest that are.
COMMON_TERMS, SHORTEST = ("the", "and", "for", "with", "that", "this", "from", "are", "was"), 3


def terms(text: Column) -> Column:
    """Words of a text in its order, repeats too."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def asked_terms(queries: DataFrame) -> DataFrame:
    """``query, word``: distinct words of three letters or more that aren't common."""
    words = queries.select("query", F.explode(F.array_distinct(terms(F.col("text")))).alias("word"))
    return words.where((F.length("word") >= SHORTEST) & ~F.col("word").isin(*COMMON_TERMS))


def postings(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, word, tf, words`` of the words in ``wanted`` (word), and one row of
    the number of documents with a word and their mean length. Texts are read once
    for either; only words that are wanted leave a task."""
    few = wanted.select("word").distinct()
    rows = docs.select("doc_id", terms(F.col("text")).alias("w")).where(F.size("w") > 0)
    totals = rows.agg(F.count("*").alias("docs"), F.avg(F.size("w").cast("double")).alias("mean"))
    found = rows.select("doc_id", F.size("w").alias("words"), F.explode("w").alias("word")).join(few, "word", "left_semi")
    return found.groupBy("doc_id", "word", "words").agg(F.count("*").alias("tf")), totals


def bm25_for(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, places: int = 5) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of each query (query, text) by BM25 of
    its terms, in one join of terms with postings. A query's scores are cut to its
    best in each of many parts before those of a query meet. Queries and documents
    without a word have no result; the lesser id wins ties."""
    asked = asked_terms(queries)
    found, totals = postings(docs, asked)
    df = found.groupBy("word").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(totals)).select("word", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")  # one row of totals
    weighed = found.join(idf, "word").select("doc_id", "word", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("words") / F.col("mean")))).alias("x"))
    scores = asked.join(weighed, "word").groupBy("query", "doc_id").agg(F.sum("x").alias("bm25"))
    return top_per_group(scores.withColumn("bm25", half_up(F.col("bm25"), places)), ["query"], [F.desc("bm25"), "doc_id"], k, salt="doc_id")


def reranked(queries: DataFrame, docs: DataFrame, vecs: DataFrame, k: int, alpha: float = 0.7, least: float = 0.7, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best of each query (query, text, embedding): three times as many by
    cosine, of at least half of ``least``, ranked anew by ``alpha`` of the scaled
    cosine and the rest of the scaled score of the query's terms, in which lengths
    in words go by the mean length of the query's candidates in signs. A query
    without terms keeps its order by cosine."""
    near = nearest(queries.select(F.col("query").alias("vec_id"), "embedding"), vecs, 3 * k, 8).where(F.col("cosine") >= least / 2).select("query", F.col("vec_id").alias("doc_id"), "cosine")
    asked = asked_terms(queries)
    told = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("signs"), terms(F.coalesce("text", F.lit(""))).alias("w"))
    sizes = near.join(told.select("doc_id", "signs", F.size("w").alias("words")), "doc_id", "left").fillna(0, ["signs", "words"])
    mean = sizes.groupBy("query").agg(F.avg("signs").alias("mean"))
    tf = told.join(near.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode("w").alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
    hits = sizes.join(mean, "query").join(asked, "query").join(tf, ["doc_id", "word"])
    x = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("words") / F.col("mean")))
    scored = near.join(hits.groupBy("query", "doc_id").agg(F.sum(x).alias("bm25")), ["query", "doc_id"], "left").withColumn("bm25", half_up(F.coalesce("bm25", F.lit(0.0)), 8))
    bounds = scored.groupBy("query").agg(F.min("cosine").alias("s0"), F.max("cosine").alias("s1"), F.min("bm25").alias("k0"), F.max("bm25").alias("k1"))
    has = asked.select("query").distinct().withColumn("has", F.lit(True))
    both = scored.join(bounds, "query").join(has, "query", "left")
    score = F.when(F.col("has"), F.lit(alpha) * min_max("cosine", "s0", "s1") + F.lit(1 - alpha) * min_max("bm25", "k0", "k1")).otherwise(F.col("cosine"))
    return top_per_group(both.select("query", "doc_id", half_up(score, 5).alias("score")), ["query"], [F.desc("score"), "doc_id"], k, salt="doc_id")


def min_max(c: str, low: str, high: str) -> Column:
    return F.when(F.col(high) > F.col(low), (F.col(c) - F.col(low)) / (F.col(high) - F.col(low))).otherwise(0.5)


def cut(text: str, most: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Places of chunks: at most ``most`` signs, ended in their last 30 % at a
    paragraph, else a sentence, a line or a word, if there is one."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            floor = at + most * 7 // 10
            for mark in ("\n\n", ". ", "\n", " "):
                found = text.rfind(mark, floor, end)
                if found >= 0:
                    end = found + len(mark)
                    break
        if end - at >= least or not out:
            out.append((at, end))
        else:
            out[-1] = (out[-1][0], end)
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def chunks(docs: DataFrame, most: int = 1024, overlap: int = 128, least: int = 100) -> DataFrame:
    """Chunks (doc_id, chunk, start, length, text) of each text; a last one below
    ``least`` joins the one before. Null and empty texts have none."""
    schema = pa.schema([("doc_id", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows = [(doc, i, s, e - s, text[s:e]) for i, (s, e) in enumerate(cut(text or "", most, overlap, least))]
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, chunk long, start long, length long, text string")
