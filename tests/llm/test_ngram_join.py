import random
from collections import defaultdict

import numpy as np
import pytest

from quartzfolio.llm import ngram_join as nj
from quartzfolio.llm.common import table


def grams(text, n=nj.N):
    words = (text or "").encode().split()
    k = min(n, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute(rows):
    """(class_id, copy_of, copies, n_links, n_linked_texts) of every row, by all pairs."""
    sets = [grams(t) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    common = defaultdict(int)
    for ids in by.values():
        for x in range(len(ids)):
            for y in range(x):
                common[ids[y], ids[x]] += 1
    links, root = defaultdict(set), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), c in common.items():
        if c >= nj.SIMILARITY * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
            links[i].add(j), links[j].add(i)
            a, b = sorted([find(i), find(j)])
            root[b] = a
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    out = {}
    for i, (doc_id, _) in enumerate(rows):
        same = [rows[j][0] for j in links[i] if sets[j] == sets[i]] + [doc_id]
        texts = {sets[j] for j in links[i]} - {sets[i]}
        out[doc_id] = (min(members[find(i)]), min(same), len(same), len(links[i]), len(texts))
    return out


def result(df):
    return {r["doc_id"]: (r["class_id"], r["copy_of"], r["copies"], r["n_links"], r["n_linked_texts"]) for r in df.collect()}


def test_bands_reach_the_recall():
    for s, recall in ((0.8, 0.9999), (0.5, 0.99), (0.95, 0.999), (1.0, 0.9)):
        b, r = nj.bands_and_rows(s, recall)
        assert 1 - (1 - s**r) ** b >= recall - 1e-9
        assert b * r <= nj.MOST_HASHES


def test_too_few_hashes_are_refused():
    with pytest.raises(ValueError, match="hashes"):
        nj.bands_and_rows(0.2, 0.9999, 16)


def test_a_bucket_of_twenty_million_texts(spark):
    from pyspark.sql import functions as F

    banded = spark.range(20_000_000).select(F.col("id").alias("node"), F.lit(100).cast("long").alias("size"), F.explode(F.array(F.lit(0), F.lit(1))).alias("band"), F.lit(5).cast("long").alias("hash"))
    got = [tuple(r) for r in nj.bucket_table(banded).collect()]
    assert got == [(0, 5, 20_000_000, 100_000)]  # the second has the same texts


def test_heavy_keys_are_joined_like_others(spark):
    rows = spark.createDataFrame([(1, i) for i in range(300)] + [(i, i) for i in range(2, 40)], "k long, v long")
    of_key = rows.groupBy("k").count()
    got = nj.join_by_weight(rows, of_key.withColumn("name", of_key["k"] * 10), ["k"], "count", rows.count())
    assert sorted(map(tuple, got.collect())) == sorted((k, v, 10 * k) for k, v in rows.collect())


def test_columns_that_cannot_be_ordered(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b c d e f", "z"), (1, "a b c d e f", "y"), (2, "other words of some kind here", "x"), (3, None, "w")], "doc_id long, text string, s string")
    docs = docs.select("*", F.array(F.create_map("s", F.lit(1))).alias("maps"), F.struct(F.create_map("s", "s").alias("m")).alias("inner"), F.parse_json(F.lit("[1]")).alias("v"))
    assert sorted((r["doc_id"], r["s"]) for r in nj.one_of_each(docs).collect()) == [(1, "y"), (2, "x"), (3, "w")]


def test_documents_against_all_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(nj.join(docs)) == brute(rows)


def near_copies(seed, n, words=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [400, 7])
def test_large_groups_are_split_without_loss(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK_TEXTS", block)
    texts = near_copies(1, 60) + near_copies(2, 25) + ["same text of seven words in all"] * 30 + [f"one of many quite different texts {i} {i + 1} {i * 7}" for i in range(50)]
    random.Random(3).shuffle(texts)
    rows = list(enumerate(texts))
    got = result(nj.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    want = brute(rows)
    assert got == want
    assert max(v[3] for v in want.values()) > 20


def test_blocks_without_texts_count_no_pair_again(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_BYTES", 300)
    texts = [f"{t}{end}" for i in range(30) for t in near_copies(i, 1) for end in ("", " tail")]
    rows = list(enumerate(texts))
    got = result(nj.join(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute(rows)
    assert {v[3:] for v in want.values()} == {(1, 1)}
    assert got == want


def test_one_of_each(spark):
    texts = near_copies(5, 20) + ["alone in the world with its own words"] + [None, "", " \n"]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(0, texts[0], "k"), (0, texts[0], "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = nj.one_of_each(docs)
    assert got.columns == docs.columns
    want = {c for c, *_ in brute([(i, t) for i, t, _ in rows[:-2]]).values()}
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "quite another text with more words"), (5, "one"), (6, "one"), (6, "one"), (7, None), (8, None), (9, " "), (10, "z" * 100_000), (11, "y " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    got = sorted(((r["doc_id"], r["class_id"], r["copies"], r["n_links"]) for r in nj.join(docs).collect()), key=str)
    want = [(None, None, 2, 1), (4, None, 2, 1), (4, 4, 1, 0), (5, 5, 3, 2), (6, 5, 3, 2), (6, 5, 3, 2), (7, 7, 1, 0), (8, 8, 1, 0), (9, 9, 1, 0), (10, 10, 1, 0), (11, 11, 1, 0)]
    assert got == sorted(want, key=str)
    assert nj.join(docs.limit(0)).count() == 0
    assert nj.one_of_each(docs.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    chain = [(i + 1, i) for i in range(40)] + [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    got = {r["node"]: r["root"] for r in nj.components(spark.createDataFrame(chain, "node long, root long")).collect()}
    root = {i: i for e in chain for i in e}
    for _ in range(100):
        for a, b in chain:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}
