"""Patterns in texts against ``in`` over all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quartzfolio.operators import references as rf


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_holding(spark, most, monkeypatch):
    monkeypatch.setattr(rf, "MOST_BYTES", most)
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [(i, some(rng.randrange(0, 60))) for i in range(80)] + [(100, None), (101, ""), (None, "abba"), (102, "ab" * 20_000)]
    patterns = [(i, some(rng.randrange(1, 5))) for i in range(30)] + [(50, None), (51, ""), (52, "ab"), (53, "ab")]
    got = sorted(map(str, map(tuple, rf.holding(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(patterns, "pattern_id long, pattern string")).collect())))
    assert got == sorted(str((d, p)) for d, t in texts for p, w in patterns if t and w and w in t)
    none = spark.createDataFrame([], "pattern_id long, pattern string")
    assert rf.holding(spark.createDataFrame(texts, "doc_id long, text string"), none).count() == 0


def test_content_references(spark):
    docs = [(1, "Alpha report"), (2, "alpha report"), (3, "Beta notes; see the ALPHA REPORT"), (4, "gamma: see  Appendix B"), (5, None), (6, "beta notes and alpha report"), (7, "")]
    titles = {1: "alpha report", 2: "alpha report", 3: "beta notes", 4: "gamma", 6: "beta notes"}
    title = F.create_map(*(F.lit(x) for kv in titles.items() for x in kv))[F.col("doc_id")]
    got = {r["doc_id"]: (r["titles"], r["documents"], r["relation"], r["confidence"]) for r in rf.content_references(spark.createDataFrame(docs, "doc_id long, text string"), title).collect()}
    nothing = (0, 0, None, None)
    assert got == {1: nothing, 2: nothing, 3: (1, 2, "references", 0.7), 4: (0, 0, "supplements", 0.6), 5: nothing, 6: (1, 2, "references", 0.7), 7: nothing}
