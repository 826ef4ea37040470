"""Many patterns in many texts: one automaton, one pass over each text.

Patterns are distinct strings; an automaton over all of them goes to the workers
once, if they are within ``MOST_BYTES``, and finds in one pass which of them a text
holds, overlaps included. More patterns are dealt by a hash to several automata, and
texts go through each of them; where patterns have rare words, ``graph.mentions``
joins on those instead. Null and empty patterns are in no text; null texts hold none.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the patterns of one automaton, which takes some 30 to 40 times as many in each worker.
MOST_BYTES = 8 << 20
BUILT: dict[str, ahocorasick.Automaton] = {}
#: What points to an appendix, and how sure the relations are.
SEE_APPENDIX = r"see\s+(appendix|allegato|annex|attachment|supplement)"
REFERS, SUPPLEMENTS = 0.7, 0.6


def automaton(key: str, patterns: list[str]) -> ahocorasick.Automaton:
    """Built once in a worker; another set of patterns replaces it."""
    if key not in BUILT:
        BUILT.clear()
        made = ahocorasick.Automaton()
        for i, p in enumerate(patterns):
            made.add_word(p, i)
        made.make_automaton()
        BUILT[key] = made
    return BUILT[key]


def holding(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``doc_id, pattern_id``, once each, where a text (doc_id, text) holds a pattern
    (pattern_id, pattern)."""
    spark = texts.sparkSession
    known = patterns.where("pattern <> ''").groupBy("pattern").agg(F.min("pattern_id").alias("pattern_id"))
    total = known.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    shards, out = max(1, -(-total // MOST_BYTES)), None
    kind = texts.schema["doc_id"].dataType.simpleString()
    for shard in range(shards):
        own = known.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == shard).collect()  # MOST_BYTES or so
        shipped = spark.sparkContext.broadcast(([r["pattern"] for r in own], [r["pattern_id"] for r in own]))
        key = f"{spark.sparkContext.applicationId}-{shipped._jbroadcast.id()}"

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, key=key) -> Iterator[pa.RecordBatch]:
            words, ids = shipped.value
            for b in batches:
                docs, found = [], []
                if words:
                    walk = automaton(key, words)
                    for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                        hits = {i for _, i in walk.iter(text)} if text else ()
                        docs += [doc] * len(hits)
                        found += [ids[i] for i in hits]
                yield pa.record_batch([pa.array(docs, b.schema.field("doc_id").type), pa.array(found, pa.int64())], names=["doc_id", "pattern_id"])

        part = texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, pattern_id long")
        out = part if out is None else out.unionByName(part)
    same = patterns.where("pattern <> ''").select(F.col("pattern_id").alias("same_id"), "pattern").join(known, "pattern")
    return out.join(same, "pattern_id").select("doc_id", F.col("same_id").alias("pattern_id"))


def content_references(docs: DataFrame, title: Column) -> DataFrame:
    """Of each document (doc_id, text) the relations that its text tells: how many
    documents with another title it refers to, as its text holds their title in
    whatever case, and under how many titles; else whether it points to an appendix.
    Equal titles are one class, so that a title that very many documents have is one
    pattern, not one link for each of them."""
    low = docs.select("doc_id", F.lower("text").alias("text"), title.alias("title"))
    titles = low.where("title <> ''").groupBy("title").agg(F.min("doc_id").alias("pattern_id"), F.count("*").alias("n"))
    hits = holding(low, titles.select("pattern_id", F.col("title").alias("pattern"))).join(titles.withColumnRenamed("title", "of"), "pattern_id")
    own = low.select("doc_id", "title")
    other = hits.join(own, "doc_id").where("title IS NULL OR title <> of").groupBy("doc_id").agg(F.count("*").alias("titles"), F.sum("n").alias("documents"))
    rows = low.select("doc_id", F.coalesce(F.col("text").rlike(SEE_APPENDIX), F.lit(False)).alias("appendix")).join(other, "doc_id", "left").fillna(0, ["titles", "documents"])
    sure = F.when(F.col("titles") > 0, REFERS).when(F.col("appendix"), SUPPLEMENTS)
    relation = F.when(F.col("titles") > 0, "references").when(F.col("appendix"), "supplements")
    return rows.select("doc_id", "titles", "documents", relation.alias("relation"), sure.alias("confidence"))
