"""From raw documents to packed training sequences, stage by stage.

Every stage but the last returns the columns of ``documents``; each works on all
that the one before has kept, and passes on further columns, whatever their
names and types. Null and empty texts go in the first stage; a null id is kept,
and counts as the least of its group. Very long texts are read whole by every
stage. Repeated rows and ties: the third stage leaves one. With an empty table
every stage returns an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfolio.llm import language_id, ngram_join, packing, quality_classifier
from quartzfolio.llm.common import materialize, table
from quartzfolio.llm.queries import tokenizer_spec

#: Score below which a document goes.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from their weak labels,
    doesn't reject."""
    _, scorer = quality_classifier.learn(docs)
    return docs.where(quality_classifier.scored(docs, scorer) >= LEAST_QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without a letter, and
    those that don't fit the language nearest to them, go."""
    model = language_id.learn(docs)
    rows = docs.select(F.struct("*").alias("row"), language_id.predicted(docs, model).alias("said"))
    return rows.where(F.col("said.fits")).select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies."""
    return ngram_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in sequences."""
    return packing.pack(docs, tokenizer_spec())


STAGES = [("quality", quality), ("language", language), ("deduplicate", deduplicate), ("pack", pack)]

#: The first two stages learn from the corpus, which SQL cannot express; tests
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of ``documents`` after all stages; each stage but the last ends
    with a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
