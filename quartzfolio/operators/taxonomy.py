"""Codes of a taxonomy from a table, found by an inverted index of their words.

A code's level is the number of its parts, which dots divide; its ancestors are what
its first parts say. Words of three letters or
more count, each once. Null and empty texts find nothing; a null service flag fits
either kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfolio.operators.references import holding
from quartzfolio.operators.windows import top_per_group

#: The score of a match at least, and how many codes a search shows.
LEAST, SHOWN = 0.3, 10


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9#]+"), lambda w: F.length(w) > 2))


def index(codes: DataFrame) -> DataFrame:
    """``word, code, level, kind, size``: postings of codes (code, description,
    service) by the words of their descriptions, ``size`` of them. Of codes that no
    item can tell apart, with the same words, level and kind, the first stands."""
    of = codes.select("code", F.size(F.split("code", "[.]")).alias("level"), F.col("service").alias("kind"), F.array_sort(words(F.col("description"))).alias("w"))
    of = of.groupBy("w", "level", "kind").agg(F.min("code").alias("code"))
    return of.select("code", "level", "kind", F.size("w").alias("size"), F.explode("w").alias("word"))


def best_codes(items: DataFrame, codes: DataFrame, bonus: float) -> DataFrame:
    """``id, code, score`` of the code that an item (id, text, service) fits best: the
    share of the code's own words that it has, and ``bonus`` for each level, ``LEAST``
    at least; the first code of equals. Items with the same words are matched once,
    and a bag of words sends one row a word."""
    bags = items.select("id", F.array_sort(words(F.col("text"))).alias("w"), "service").where(F.size("w") > 0)
    kinds = bags.groupBy("w", "service").agg(F.min("id").alias("bag"))
    asked = kinds.select("bag", "service", F.explode("w").alias("word"))
    fits = F.col("service").isNull() | F.col("kind").isNull() | (F.col("service") == F.col("kind"))
    hits = asked.join(index(codes), "word").where(fits).groupBy("bag", "code", "level", "size").agg(F.count("*").alias("n"))
    score = F.floor((F.col("n") / F.col("size") + F.lit(bonus) * F.col("level")) * 1e6 + 0.5) / 1e6
    best = hits.select("bag", "code", score.alias("score")).where(F.col("score") >= LEAST).groupBy("bag").agg(F.min(F.struct((-F.col("score")).alias("less"), "code")).alias("b"))
    found = kinds.join(best, "bag").select("w", F.col("service").alias("s"), "b.code", (-F.col("b.less")).alias("score"))
    return bags.join(found, (bags["w"] == found["w"]) & F.col("service").eqNullSafe(F.col("s"))).select("id", "code", "score")


def rolled_up(matched: DataFrame) -> DataFrame:
    """``code, level, items``: how many matched items (id, code) each code and each of
    its ancestors has. Codes are counted first, so that roots don't gather rows."""
    n = matched.groupBy("code").agg(F.count("*").alias("n"))
    up = n.select("n", "code", F.explode(F.sequence(F.lit(1), F.size(F.split("code", "[.]")))).alias("level"))
    return up.select("n", "level", F.expr("substring_index(code, '.', level)").alias("code")).groupBy("code", "level").agg(F.sum("n").alias("items"))


def search_codes(codes: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, code, score, place``: the codes whose description holds a query
    (query), the ``SHOWN`` with the greatest share of it first."""
    numbered = queries.where("query <> ''").select(F.lower("query").alias("query")).distinct().withColumn("pattern_id", F.xxhash64("query"))
    low = codes.select(F.col("code").alias("doc_id"), F.lower("description").alias("text"))
    hits = holding(low, numbered.select("pattern_id", F.col("query").alias("pattern"))).join(numbered, "pattern_id").join(low, "doc_id")
    score = F.floor(F.length("query") / F.length("text") * 1e6 + 0.5) / 1e6
    ranked = hits.select("query", F.col("doc_id").alias("code"), score.alias("score"))
    return top_per_group(ranked, ["query"], [F.desc("score"), "code"], SHOWN, salt="code")
