import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quartzfolio.llm import quality_classifier as qc
from quartzfolio.llm.common import table

BLANKS = " \t\n\v\f\r"


def brute_plain(text):
    n = 0
    for w in re.findall(f"[^{BLANKS}]+", text):
        w = "".join("x" if ord(c) > 127 else c for c in w)
        n += bool(re.fullmatch("[A-Za-z][a-z]*[.,;:!?]?", w))
    return n


@pytest.mark.parametrize("text", ["", "One two.", "été ça Va, vA x1 a.b (c) . ,", " lead\ttab\nend!! ok! ", "Ünder ÜN", "A", "a,", "# a | b"])
def test_plain_words(text):
    assert qc.plain_words(text.encode()) == brute_plain(text)


def test_measures():
    m = qc.measures("Ab # ab ab | x.\n\nsame line\nsame line!!")
    assert (m["words"], m["signs"], m["stutters"], m["lines"], m["dup_lines"], m["capitals"], m["marks"], m["symbols"]) == (10, 2, 1, 3, 0, 1, 2, 2)


def test_votes_round_trip():
    v = qc.votes("A quite plain sentence, nothing else. " * 9)
    assert len(qc.digits(v)) == len(qc.LABELLERS)
    assert set(qc.digits(v)) <= {-1, 0, 1}
    assert qc.votes(None) is None
    assert qc.votes(" \n") is None


def test_estimate_recovers_planted_accuracies():
    rng = np.random.default_rng(1)
    n, k = 40_000, len(qc.LABELLERS)
    good = rng.random(n) < 0.8
    accuracy = np.linspace(0.65, 0.95, k)
    v = np.where(rng.random((n, k)) < accuracy, good[:, None], ~good[:, None]).astype(int)
    v[rng.random((n, k)) < 0.3] = qc.NONE
    patterns = (v + 1) @ 3 ** np.arange(k)[::-1]
    found = qc.estimate(Counter(patterns.tolist()))
    assert abs(found.prior - 0.8) < 0.02
    assert np.abs(found.accuracy() - accuracy).max() < 0.03
    said = np.array([found.posterior[p] >= 0.5 for p in patterns.tolist()])
    assert (said == good).mean() > 0.97


def test_labelled_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r for r in qc.judge(docs).collect()}
    assert len(got) == docs.count()
    said = [(r["quality"], got[r["doc_id"]]["kept"]) for r in table(spark, sf_dir, "labels").collect()]
    assert np.mean([k for q, k in said if q == 1]) > 0.95
    assert np.mean([not k for q, k in said if q == 0]) > 0.8


def test_verdicts_against_plain_loops(spark, sf_dir):
    """Patterns counted, estimated and sampled again by hand give the same scorer."""
    docs = table(spark, sf_dir, "documents")
    texts = [r["text"] for r in docs.collect()]
    patterns = [p for p in map(qc.votes, texts) if p is not None]
    labels, scorer = qc.learn(docs)
    by_hand = qc.estimate(Counter(patterns))
    assert labels.posterior == by_hand.posterior
    used = sorted({t for t in texts if qc.votes(t) is not None})  # the table is smaller than the sample
    again = qc.fit(used, np.array([by_hand.posterior[qc.votes(t)] for t in used]), by_hand.prior)
    assert np.allclose(again.weights, scorer.weights, atol=1e-6)
    for r, t in zip(sorted(qc.judge(docs).collect(), key=lambda r: r["doc_id"]), [r["text"] for r in docs.orderBy("doc_id").collect()], strict=True):
        z = 0.0 if not (t or "").split() else 1 / (1 + np.exp(-(float(qc.features(t, qc.measures(t)) @ again.weights) + again.bias)))
        assert abs(r["score"] - z) < 1e-4
        assert r["kept"] == (r["score"] >= 0.5)


def test_repeated_ids_are_learned_by_their_texts(spark):
    good = [" ".join(f"plain{'abcdefgh'[(i * j) % 8]} words" for j in range(40)) for i in range(1, 30)]
    bad = [" ".join(f"#{i}$ %% {j}&|" for j in range(40)) for i in range(1, 30)]
    docs = spark.createDataFrame([(1, t) for t in good + bad], "doc_id long, text string")
    kept = sorted(qc.judge(docs).select("kept").collect())
    assert [r["kept"] for r in kept] == [False] * len(bad) + [True] * len(good)


def test_odd_inputs(spark):
    random.seed(2)
    prose = [" ".join(random.choice(["stone", "river", "the", "walks", "over"]) for _ in range(60)) for _ in range(40)]
    rows = [(i, t, 1) for i, t in enumerate(prose)] + [(None, prose[0], 1), (7, prose[7], 2), (900, None, 1), (901, "", 1), (902, " \n", 1), (903, "x" * 400_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = qc.judge(docs).collect()
    assert len(got) == len(rows)
    assert all(r["score"] == 0 and not r["kept"] for r in got if r["doc_id"] in (900, 901, 902))
    assert all(r["kept"] for r in got if r["doc_id"] is None or r["doc_id"] < 900)
    assert qc.judge(docs.limit(0)).count() == 0
    assert zlib.crc32(b"symbols:0") % (1 << qc.BITS) < 1 << qc.BITS


def test_all_of_one_label():
    assert qc.fit(["a b c"] * 3, np.ones(3)).score("anything else") > 0.99
    assert qc.fit(["a b c"] * 3, np.zeros(3)).score("anything else") < 0.01
