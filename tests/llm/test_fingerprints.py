import hashlib

import numpy as np
import pytest

from quartzfolio.llm import fingerprints as fp


def brute(text, k=fp.K, picks=fp.PICKS, hashes=fp.HASHES):
    """Straight from the definition: one loop for each permutation."""
    codes = [ord(c) for c in text]
    if not codes:
        return np.zeros(hashes, np.uint32)
    h = fp.kmer_hashes(np.array(codes, np.uint32), k)
    seen, x = {}, []
    for v in h.tolist():
        x.append(int(fp.mix64(np.array([(v + seen.get(v, 0) * int(fp.GOLDEN)) % 2**64], np.uint64))[0]))
        seen[v] = seen.get(v, 0) + 1
    out = []
    for a in fp.odd_multipliers(hashes, 17).tolist():
        least = sorted(range(len(x)), key=lambda i: x[i] * a % 2**64)[:picks]
        picked = [int(h[i]) for i in sorted(least)]
        picked = [int(fp.GOLDEN)] * (picks - len(picked)) + picked
        t = int(fp.GOLDEN)
        for v in picked:
            t = int(fp.mix64(np.array([(t * int(fp.BASE) + v) % 2**64], np.uint64))[0])
        out.append(max(t >> 32, 1))
    return np.array(out, np.uint32)


@pytest.mark.parametrize("text", ["", "a", "abcdefgh", "abcdefghi", "xyz" * 40, "Éléphant près de l’eau 🐘 " * 5, "a" * 100])
def test_signature_is_the_definition(text):
    assert fp.signature(text).tolist() == brute(text).tolist()


def test_order_matters():
    a, b = "alpha beta gamma delta " * 3, "the quick brown fox jumps over it " * 3
    same_kmers = fp.likeness(fp.signature(a + b), fp.signature(b + a))
    assert same_kmers < 0.9
    assert fp.likeness(fp.signature(a + b), fp.signature(a + b + "!")) > same_kmers


def test_shared_part_changes_nothing():
    a, b, c = (fp.code_points(t) for t in ("one two three one two three " * 4, "three one two", "nine ten one two three " * 2))
    got = fp.signatures(a, b, c)
    assert got[0].tolist() == fp.signatures(a[:0], np.concatenate([a, b]))[0].tolist()
    assert got[1].tolist() == fp.signatures(a[:0], np.concatenate([a, c]))[0].tolist()


@pytest.mark.parametrize("buckets", [1, 3, 8])
def test_edited_texts(spark, buckets):
    texts = ["word one two three " * 9, "", None, "ab", "another text that is longer than the others " * 8, "word one two three " * 9, "né 🐘" * 30]
    rows = [(10 * i + 3, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)
    got = {r["doc_id"]: r for r in fp.fingerprint_edited(docs, buckets=buckets).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, text, _) in enumerate(rows):
        own, other = text or "", texts[i - 1] or ""
        edited = own[: len(own) - len(own) // 3] + other[: len(own) // 3]
        r = got[doc_id]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fp.as_text(brute(own))
        assert r["edited_fingerprint"] == fp.as_text(brute(edited))
        assert r["near_edited"] == fp.likeness(brute(own), brute(edited))
        assert r["near_next"] == fp.likeness(brute(own), brute(other))
    plain = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprint(docs).collect()}
    assert plain == {k: r["fingerprint"] for k, r in got.items()}


def test_empty_one_row_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert fp.fingerprint_edited(spark.createDataFrame([], schema)).count() == 0
    one = fp.fingerprint_edited(spark.createDataFrame([(5, "only text here")], schema)).collect()
    assert one[0]["near_next"] == 1.0
    assert one[0]["edited_sha256"] == hashlib.sha256(b"only text only").hexdigest()
    again = fp.fingerprint_edited(spark.createDataFrame([(5, "only text here")] * 3 + [(None, "z" * 50), (7, "q" * 20)], schema)).collect()
    assert len(again) == 5


@pytest.mark.parametrize("buckets", [4, 12])
def test_one_id_and_null_ids_with_most_rows(spark, buckets):
    rows = [(5, f"text {i} of the hot id " * 3) for i in range(60)] + [(None, f"no id {i} " * 4) for i in range(40)] + [(i, f"other {i} words") for i in range(20)] + [(5, "text 3 of the hot id " * 3)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = fp.in_order(docs, buckets).where("NOT is_copy").groupBy("bucket", "id").count().collect()
    assert max(r["count"] for r in held) < 60
    got = fp.fingerprint_edited(docs, buckets=buckets).collect()
    ties = {t: h for t, h in docs.selectExpr("text", "xxhash64(text) AS h").distinct().collect()}
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], ties[r[1]]), reverse=True)
    want = []
    for i, (doc_id, text) in enumerate(order):
        other = order[(i + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 3] + other[: len(text) // 3]
        want.append((doc_id, hashlib.sha256(edited.encode()).hexdigest(), fp.likeness(brute(text), brute(other))))
    assert sorted(((r["doc_id"], r["edited_sha256"], r["near_next"]) for r in got), key=str) == sorted(want, key=str)
