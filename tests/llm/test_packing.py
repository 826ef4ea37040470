import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quartzfolio.llm import packing as pk
from quartzfolio.llm.common import materialize, table

SPEC = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(SPEC)
OURS = pk.TokenIds(SPEC)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdLRSTVM'  \n\t.!éÉßÿÞ×÷0123-"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_are_those_of_the_library(text):
    assert OURS.common(["plain"]) == [b"plain"]
    assert np.frombuffer(OURS.encode([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", None, "it's WE'LL they'd 'S x''s", "a<|endoftext|>b", "ÀÉÎ×÷ßÿ naïve x\x85y\x1cz", "don't" * 9, "é Å ΑΣ", "x" * 99_000])
def test_special_cases(text):
    assert np.frombuffer(OURS.encode([text])[0], "<u4").tolist() == LIBRARY.encode(text or "", add_special_tokens=False).ids


def check(pieces, texts, window):
    """Every id in one piece, sequences gapless; returns the share of padding."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(texts)
    for doc_id, ps in by_doc.items():
        ids = np.array([*LIBRARY.encode(texts[doc_id] or "", add_special_tokens=False).ids, pk.END_ID], "<u4")
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at
            assert p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= window
    return 1 - sum(p["length"] for p in pieces) / (len(by_sequence) * window)


@pytest.mark.parametrize("window", [4, 16, 64, 4096])
def test_documents(spark, sf_dir, window):
    docs = table(spark, sf_dir, "documents").limit(120 if window < 4096 else 100_000).cache()
    check(pk.pack(docs, SPEC, window).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, window)


def test_ids_are_carried(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(100)
    rows = pk.place(materialize(pk.pieces(docs, SPEC, 64), "test-pieces"), 64).collect()
    got = {}
    for p in sorted(rows, key=lambda p: (p["doc_id"], p["start"])):
        got[p["doc_id"]] = got.get(p["doc_id"], b"") + p["ids"]
    for r in docs.collect():
        assert np.frombuffer(got[r["doc_id"]], "<u4").tolist() == [*LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids, pk.END_ID]


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "same words here", 5), (4, "same words here", 5), (5, "long " * 30_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    check(pk.pack(docs, SPEC).collect(), {i: t for i, t, _ in rows}, 4096)
    twice = pk.pack(spark.createDataFrame([(None, "a b c", 1)] * 3, docs.schema), SPEC).collect()
    assert sum(p["length"] for p in twice) == 12
    assert pk.pack(docs.limit(0), SPEC).count() == 0


def places_of(counts, window):
    """All places of a plan, by hand: every number of every length once, and
    sequences without gaps; returns the number of sequences."""
    made = pk.plan(counts, window)
    at, used = {}, {}
    for length, low, high, sequence, offset in made.rows.tolist():
        assert low == at.get(length, 0)
        at[length] = high
        for i in range(high - low):
            used.setdefault(sequence + i, []).append((offset, length))
    assert at == {n: c for n, c in enumerate(counts.tolist()) if c}
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(used) == list(range(made.sequences))
    for length in np.flatnonzero(counts).tolist():
        numbers = np.arange(counts[length])
        sequence, offset = made.place(np.full(len(numbers), length), numbers)
        assert all((o, length) in used[q] for q, o in zip(sequence.tolist(), offset.tolist(), strict=True))
    return made


def test_combinations_place_most_ids():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(6.3, 0.9, 20_000).astype(int), 9000) % 4096
    counts = np.bincount(lengths[lengths > 0], minlength=4097)
    made = places_of(counts, 4096)
    total = (counts * np.arange(4097)).sum()
    assert made.combined > 0.95 * total
    assert made.combined + made.greedy == total
    assert total > 0.99 * made.sequences * 4096


def test_least_squares_takes_what_fits():
    counts = np.zeros(4097, np.int64)
    counts[[1000, 3096, 2048, 1365, 4096]] = [500, 500, 200, 900, 7]
    assert places_of(counts, 4096).greedy < 0.02 * (counts * np.arange(4097)).sum()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 300), max_size=30), st.sampled_from([100, 101, 1030]))
def test_any_histogram(of, window):
    counts = np.zeros(window + 1, np.int64)
    for n, c in of.items():
        counts[n] = c
    places_of(counts, window)


def test_lengths_that_cannot_be_combined():
    counts = np.zeros(4097, np.int64)
    counts[3000] = 50
    assert places_of(counts, 4096).sequences == 50
    assert len(pk.plan(np.zeros(4097, np.int64), 4096).rows) == 0
