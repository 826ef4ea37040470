"""Names in names against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quartzfolio.operators import containment as ct


def some_names(rng, n):
    words = ["mail", "mails", "mailserver", "erp", "data", "database", "hub", "é", "x", "core", "encore", "a b", ""]
    return [None if rng.random() < 0.03 else " ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(n)] + [f"system nr{i}" for i in range(30)]


@pytest.mark.parametrize("most", [2000, 5])
def test_contained(spark, most, monkeypatch):
    monkeypatch.setattr(ct, "MOST", most)
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [(rng.choice("pq"), some(rng.randrange(0, 20))) for _ in range(150)] + [("p", None), ("p", "ab" * 3000), ("p", "ab"), ("p", "ab")]
    patterns = [(rng.choice("pqr"), some(rng.randrange(1, 8))) for _ in range(80)] + [("p", None), ("p", ""), ("p", "a"), ("p", "a"), ("p", "abab")]
    got = ct.contained(spark.createDataFrame(texts, "within string, text string").repartition(3), spark.createDataFrame(patterns, "within string, pattern string"))
    want = {(w, t, p) for w, t in texts for v, p in patterns if w == v and t and p and p in t}
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("most", [2000, 3])
def test_overlaps(spark, most, monkeypatch):
    monkeypatch.setattr(ct, "MOST", most)
    rng = random.Random(4)
    items = [(rng.choice(["s", "t", None]), n.upper() if n and rng.random() < 0.3 else n, "z") for n in some_names(rng, 120)]
    low = [(t, (n or "").lower()) for t, n, _ in items]

    def linked(a, b):
        return a in b or b in a or any(len(w) > 3 and w in b for w in a.split(" ")) or any(len(w) > 3 and w in a for w in b.split(" "))

    want = {}
    for i, (t, n) in enumerate(low):
        want[t, n] = (sum(x == (t, n) for x in low), sum(linked(n, m) for j, (u, m) in enumerate(low) if j != i and u == t))
    rows = ct.overlaps(spark.createDataFrame(items, "tenant string, name string, pattern string")).collect()
    assert {(r["tenant"], r["name"]): (r["n"], r["n_links"]) for r in rows} == want and len(rows) == len(want)
    assert ct.overlaps(spark.createDataFrame([], "tenant int, name string")).count() == 0


def test_a_word_of_all_names_is_one_class(spark):
    names = spark.range(4000).select(F.lit(1).alias("tenant"), F.concat(F.lit("system n"), "id").alias("name"))
    rows = ct.overlaps(names).groupBy("n", "n_links").count().collect()
    # "n1" is no long word, but "n1000" is one that only its own name holds
    assert [tuple(r) for r in rows] == [(1, 3999, 4000)]


def test_part_of(spark):
    rows = [(1, "a", "Mail Module 2"), (2, "a", "mail"), (3, "a", "MAIL"), (4, "a", "mail module"), (5, "b", "mail step"), (6, "b", "hub"), (7, "a", None), (8, None, "mail part"), (9, "a", ""), (10, "a", "mail module 2"), (11, "a", "party")]
    is_part = F.col("name").rlike("module|step|part")
    got = ct.part_of(spark.createDataFrame(rows, "id long, kind string, name string"), is_part)
    want = {("a", "mail module 2", "mail", 2, 2, 1, 2, 0.75), ("a", "mail module 2", "mail module", 2, 1, 1, 4, 0.75), ("a", "mail module", "mail", 1, 2, 4, 2, 0.75)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == 3
