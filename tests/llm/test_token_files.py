import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quartzfolio.llm import token_files as tf
from quartzfolio.llm.common import shared_path, table
from quartzfolio.llm.queries import op12_token_files

SPEC = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(SPEC)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def crc(text):
    return zlib.crc32(np.array(ids_of(text), "<u4").tobytes())


def by_hand(docs):
    """Rows in ascending order of distinct ids."""
    out, start = [], 0
    for doc_id, text in sorted(docs):
        n = len(ids_of(text))
        out.append((doc_id, start, n, crc(text)))
        start += n
    return out


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = sorted(map(tuple, op12_token_files(spark, sf_dir).collect()))
    assert got == by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=200), st.sets(st.integers(-(2**63), 2**63 - 1), max_size=50))
def test_perfect_hash(keys, others):
    keys, others = np.array(sorted(keys), np.int64), np.array(sorted(others - keys), np.int64)
    slots = tf.PerfectHash.of(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    shard = tf.Shard(tf.shard_bytes(keys, 0, np.full(len(keys), 3), np.arange(3 * len(keys)), 4) + b"\n")
    assert shard.rows_of(keys).tolist() == list(range(len(keys)))
    assert (shard.rows_of(others) == -1).all()
    assert shard.ids.tolist() == list(range(3 * len(keys)))


def test_many_keys():
    """Minimal, a few bits a key, and unknown keys are turned away by fingerprints."""
    keys = np.arange(200_000, dtype=np.int64) * 7919 - 5
    made = tf.PerfectHash.of(keys)
    assert np.array_equal(np.sort(made.slots(keys)), np.arange(len(keys)))
    assert made.sizes.sum() < 4.5 * len(keys)
    unknown = keys + 1
    at = made.slots(unknown)
    prints = np.zeros(len(keys), np.uint32)
    prints[made.slots(keys)] = tf.fingerprints(keys)
    assert (prints[at[at >= 0]] == tf.fingerprints(unknown[at >= 0])).sum() <= 2


def test_equal_keys_are_no_index():
    with pytest.raises(ValueError, match="distinct"):
        tf.PerfectHash.of(np.array([5, 5]))


ODD = [(i, f"text number {i} it's", 9) for i in range(-40, 200)] + [(7, f"again {i % 3}", 9) for i in range(150)] + [(500, None, 9), (501, "", 9), (502, "long " * 20_000, 9), (503, "漢字 <|endoftext|>", 9), (None, None, 9), (None, "no key", 9)]


@pytest.mark.parametrize("shards", [1, 6])
def test_odd_rows(spark, shards):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, start int").repartition(3)
    path = shared_path(spark, "test")
    tf.write(docs, SPEC, path, shards=shards)
    rows = tf.read(spark, path, with_ids=True).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in rows) == sorted((i is not None, i or 0, crc(t)) for i, t, _ in ODD)
    at, last = 0, None
    for r in sorted(rows, key=lambda r: r["start"]):  # gapless, ascending, keyless rows first
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert last is None or r["doc_id"] >= last
        at, last = at + r["n_tokens"], r["doc_id"]
    if shards > 1:
        assert tf.files(spark, path).where("least <= 7 and greatest >= 7").count() > 1  # the key with many rows is spread


@pytest.mark.parametrize("few", [0, 100_000])
def test_lookup(spark, few, monkeypatch):
    monkeypatch.setattr(tf, "FEW_REQUESTS", few)
    path = shared_path(spark, "test")
    tf.write(spark.createDataFrame(ODD, "doc_id long, text string, start int"), SPEC, path, shards=5)
    wanted = [7, -40, 502, 503, 9999, -9999, None, 7]
    got = tf.lookup(spark, path, spark.createDataFrame([(k,) for k in wanted], "doc_id long")).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted((i, np.array(ids_of(t), "<u4").tobytes()) for i, t, _ in ODD if i in wanted and i is not None)
    places = {(r["doc_id"], r["start"]) for r in tf.read(spark, path).collect()}
    assert all((r["doc_id"], r["start"]) in places for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = shared_path(spark, "test")
    tf.write(docs, SPEC, path)
    assert tf.read(spark, path).count() == 0
    assert tf.lookup(spark, path, docs).count() == 0
    with pytest.raises(ValueError, match="no shard"):
        tf.Shard(b"\0" * 100)
