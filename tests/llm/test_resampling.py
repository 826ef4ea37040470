import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartzfolio.llm import resampling as rs
from quartzfolio.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(AZ))


def features(text):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(feature, buckets=10_000):
    return zlib.crc32(feature.encode()) % buckets


def by_hand(docs, target, buckets=10_000, least=20, percent=5):
    """Rows (doc_id, n_features, weight, score, rank)."""
    s = Counter(bucket(f, buckets) for _, t in docs for f in features(t))
    t = Counter(bucket(f, buckets) for x in target for f in features(x))
    n_s, n_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        fs = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f, buckets)] for f in fs)
        rows.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((i for i, d in enumerate(docs) if len(words(d[1])) >= least), key=lambda i: (-rows[i][3], rows[i][0] is not None, rows[i][0]))
    for rank, i in enumerate(order[: percent * len(order) // 100], 1):
        rows[i][4] = rank
    return sorted(map(tuple, rows), key=str)


def test_whole_table(spark, sf_dir):
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = sorted((tuple(r) for r in rs.resample(docs, target).collect()), key=str)
    want = by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert got == want
    assert sum(r[4] is not None for r in got) > 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abZ9 .é漢\x7f\n", max_size=40), min_size=1, max_size=6), st.integers(1, 4), st.sampled_from([3, 16, 1 << 19]), st.sampled_from([0, 4, 48]))
def test_hashes_over_segments(texts, orders, segment, columns):
    before = rs.SEGMENT, rs.COLUMNS
    rs.SEGMENT, rs.COLUMNS = segment, columns
    try:
        raw = [t.encode().translate(rs.PLAIN) for t in texts]
        found, sizes, n_words = rs.hashed(b" ".join(raw) + b" ", np.cumsum([len(r) + 1 for r in raw]) - 1, orders, 10_000)
    finally:
        rs.SEGMENT, rs.COLUMNS = before
    assert n_words.tolist() == [len(words(t)) for t in texts]
    for t, part in zip(texts, np.split(found, np.cumsum(sizes)[:-1]), strict=True):
        w = words(t)
        want = [bucket(" ".join(w[i - k : i + 1])) for i in range(len(w)) for k in range(min(orders, i + 1))]
        assert part.tolist() == want


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK", 1000)
    rng = np.random.default_rng(5)
    some = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 50, n))
    docs = [(i, some(30)) for i in range(200)] + [(7, some(25))] * 3 + [(None, some(40)), (None, None), (300, None), (301, ""), (302, " .,! "), (303, some(60_000)), (304, some(19)), (305, "x" * 90_000), (-1, some(20))]
    frame = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, weight int, rank string").repartition(5)
    target = spark.createDataFrame([("w1 w2 w3 w2 w1",), (None,), ("",)], "text string")
    got = sorted((tuple(r) for r in rs.resample(frame, target).collect()), key=str)
    assert got == by_hand(docs, ["w1 w2 w3 w2 w1"])
    assert rs.resample(frame.limit(0), target).count() == 0
    nothing = sorted((tuple(r) for r in rs.resample(frame, target.limit(0)).collect()), key=str)
    assert nothing == by_hand(docs, [])
    twice = rs.resample(frame, target, buckets=7, least_words=0, percent=100).collect()
    assert sorted(r["rank"] for r in twice) == list(range(1, len(docs) + 1))


def test_equal_scores(spark):
    rows = [(i, 30, 100) for i in range(500)] + [(None, 30, 100), (900, 30, 101), (901, 3, 999)]
    got = rs.draw(spark.createDataFrame(rows, "doc_id long, n_words long, score long").repartition(7)).where("rank is not null").collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got) == [(1, 900), (2, None), *((i + 3, i) for i in range(23))]


def test_buckets_must_fit(spark):
    with pytest.raises(ValueError, match="16-bit"):
        rs.stream(spark.createDataFrame([], "doc_id long, text string"), buckets=70_000)
