"""Document fingerprints by Order MinHash.

Each of ``hashes`` permutations selects the ``picks`` minimal
occurrence-numbered character k-mers of a text, puts them back in text order
and hashes that tuple. Two texts agree in a component if they share the k-mers
*and* their order, so agreement follows edit distance, not only set overlap.

Defined results. Null text: as empty. Empty texts have the all-zero
fingerprint, like one another and unlike any other text. A text shorter than
``k`` has one k-mer, itself padded with zeros. Equal texts have equal
fingerprints, whatever row or partition they are in. Very long texts are hashed
whole. Rows with equal ids are ordered by a hash of their texts, the greatest
first. A null id comes after all other ids. Further columns of the input are not
read.

Hot keys. Buckets are ranges of ids with about as many rows each; an id (or the
null id) that fills several of them is split by ranges of that hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfolio.llm.common import GOLDEN, code_points, mix64, odd_multipliers

K, PICKS, HASHES = 8, 2, 32
BASE = np.uint64(0x100000001B3)
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
BLOCK = 8
LOWEST_ID = -(2**63)

OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-mer; of a non-empty shorter text, of the padded text."""
    n = len(codes)
    if not n:
        return np.empty(0, np.uint64)
    c = np.zeros(max(n, k), np.uint64)
    c[:n] = codes
    m = len(c) - k + 1
    h = c[:m] + np.uint64(1)
    for j in range(1, k):
        h = h * BASE + c[j : j + m]
    return mix64(h)


def numbered(shared: np.ndarray, *tails: np.ndarray) -> list[np.ndarray]:
    """Occurrence-numbered hashes of the k-mers of ``shared`` and of each tail,
    every tail counted as if it alone followed ``shared``. One sort does all."""
    h = np.concatenate([shared, *tails])
    n = len(h)
    if not n:
        return [h[:0] for _ in range(1 + len(tails))]
    bits = np.uint64(n.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
    at, head = (key & low).astype(np.int64), key & ~low
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(head[1:], head[:-1], out=new[1:])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ends = np.cumsum([len(shared), *map(len, tails)])
    part = np.searchsorted(ends, at, side="right")
    occurrence = np.arange(n) - start
    for j in range(1, len(tails)):  # those of earlier tails don't count
        earlier = np.concatenate([[0], np.cumsum((part >= 1) & (part <= j))])
        own = part == j + 1
        occurrence[own] -= (earlier[np.arange(n)] - earlier[start])[own]
    x = np.empty(n, np.uint64)
    x[at] = mix64(h[at] + occurrence.astype(np.uint64) * GOLDEN)
    return np.split(x, ends[:-1])


def minimal(x: np.ndarray, multipliers: np.ndarray, picks: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and places of the ``picks`` least under each permutation; places
    are -1 where there are fewer."""
    m = len(multipliers)
    values, places = np.full((m, picks), LAST), np.full((m, picks), -1, np.int64)
    if not len(x):
        return values, places
    rows = np.arange(BLOCK)
    for b in range(0, m, BLOCK):
        v = x[None, :] * multipliers[b : b + BLOCK, None]
        r = rows[: len(v)]
        for p in range(min(picks, len(x))):
            i = v.argmin(axis=1)
            values[b : b + BLOCK, p], places[b : b + BLOCK, p] = v[r, i], i
            v[r, i] = LAST
    return values, places


def tuples(values: np.ndarray, places: np.ndarray, h: np.ndarray, picks: int) -> np.ndarray:
    """Component of each permutation: hash of the selected k-mers in text order."""
    m = len(values)
    if not len(h):
        return np.zeros(m, np.uint32)
    order = np.argsort(values, axis=1, kind="stable")[:, :picks]
    chosen = np.sort(np.take_along_axis(places, order, axis=1), axis=1)
    picked = np.where(chosen >= 0, h[np.maximum(chosen, 0)], GOLDEN)
    t = np.full(m, GOLDEN)
    for p in range(picks):
        t = mix64(t * BASE + picked[:, p])
    return np.maximum(t >> np.uint64(32), np.uint64(1)).astype(np.uint32)


def signatures(shared: np.ndarray, *tails: np.ndarray, k: int = K, picks: int = PICKS, hashes: int = HASHES) -> list[np.ndarray]:
    """Order MinHash of ``shared`` followed by each of the tails (code points);
    what lies wholly in the shared part is hashed and searched once."""
    multipliers = odd_multipliers(hashes, 17)
    whole = [kmer_hashes(np.concatenate([shared, t]), k) for t in tails]
    common = max(0, len(shared) - k + 1) if all(len(shared) + len(t) >= k for t in tails) else 0
    parts = numbered(whole[0][:common], *(w[common:] for w in whole))
    v0, p0 = minimal(parts[0], multipliers, picks)
    out = []
    for w, x in zip(whole, parts[1:], strict=True):
        v, p = minimal(x, multipliers, picks)
        p = np.where(p >= 0, p + common, -1)
        out.append(tuples(np.hstack([v0, v]), np.hstack([p0, p]), w, picks))
    return out


def signature(text: str | None, **how: int) -> np.ndarray:
    return signatures(code_points(""), code_points(text), **how)[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components, from 0 to 1."""
    return float(np.mean(a == b))


def as_text(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, k: int = K, picks: int = PICKS, hashes: int = HASHES) -> DataFrame:
    """doc_id, n_chars and fingerprint of each row of ``docs``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
                "fingerprint": pa.array([as_text(signature(t, k=k, picks=picks, hashes=hashes)) for t in texts], pa.string()),
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of (bucket, is_copy, id, tie, doc_id, text): buckets are ranges of ids
    and text hashes, and after a bucket's lowest row comes a copy of the next one.

    Only a few numbers for each bucket reach the driver; the texts are shuffled
    once.
    """
    spark = docs.sparkSession
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST_ID))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own_id.alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    at = docs.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)] or [0.5], 10 * buckets + 100)).first()[0]
    bounds, times = np.unique(np.array(at or [0], np.int64), return_counts=True)
    parts_of = np.where(times > 1, times, 0)  # a bound met often has buckets of its own
    first = np.concatenate([[0], np.cumsum(1 + parts_of)])

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series, ties: pd.Series) -> pd.Series:
        i, tie = ids.to_numpy(), ties.to_numpy()
        j = np.searchsorted(bounds, i, side="left")
        k = np.minimum(j, len(bounds) - 1)
        parts = np.where((j < len(bounds)) & (bounds[k] == i), parts_of[k], 0)
        part = np.where(parts > 0, 1 + np.floor((tie / 2.0**64 + 0.5) * parts), 0)
        return pd.Series((first[j] + np.minimum(part, parts)).astype(np.int32))

    heads = docs.select("id", "tie", bucket_of("id", "tie").alias("bucket")).groupBy("bucket").agg(F.max(F.struct("id", "tie")).alias("h")).select("bucket", "h.*").orderBy("bucket").collect()
    places = [*(r["bucket"] for r in heads[1:]), *(r["bucket"] for r in heads[:1])]  # the bucket that is before a head's own
    copies = spark.createDataFrame([(r["id"], r["tie"], to) for r, to in zip(heads, places, strict=True)], "id long, tie long, bucket int")  # a row for each bucket
    extra = docs.join(F.broadcast(copies), ["id", "tie"]).select("bucket", F.lit(True).alias("is_copy"), "id", "tie", "doc_id", "text")
    own = docs.select(bucket_of("id", "tie").alias("bucket"), F.lit(False).alias("is_copy"), "id", "tie", "doc_id", "text")
    return own.unionByName(extra)


def fingerprint_edited(docs: DataFrame, k: int = K, picks: int = PICKS, hashes: int = HASHES, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last ``n_chars // 3`` code points replaced by the
    first as many (or all) of the next document in descending order of ids;
    after the last comes the first.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_order(docs, buckets or 4 * parts).repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket", "is_copy", F.desc("id"), F.desc("tie"), F.desc("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = {"k": k, "picks": picks, "hashes": hashes}
        held: tuple | None = None  # bucket, is_copy, doc_id, text, its code points, what needs the next row's fingerprint
        out: list[tuple] = []

        def close(row: tuple, head: np.ndarray) -> tuple:
            codes = row[4]
            cut = len(codes) // 3
            keep, tail = codes[: len(codes) - cut], codes[len(codes) - cut :]
            new = head[:cut]
            own, edited = signatures(keep, tail, new, **how)
            digest = hashlib.sha256(np.concatenate([keep, new]).astype("<u4").tobytes().decode("utf-32-le").encode()).hexdigest()
            return own, (row[2], len(codes), digest, as_text(own), as_text(edited), likeness(own, edited))

        def flush() -> pa.RecordBatch:
            cols = [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in OUT]
            out.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, OUT, strict=True)], schema=OUT)

        waiting: tuple | None = None  # a closed row that still lacks near_next
        for b in batches:
            for bucket, is_copy, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "is_copy", "doc_id", "text")), strict=True):
                if held is not None and held[0] == bucket and held[1]:
                    continue  # a further row with the id of the copied one
                codes = code_points(text)
                row = (bucket, is_copy, doc_id, text, codes)
                if held is not None and held[0] == bucket:
                    own, said = close(held, codes)
                    if waiting is not None:
                        out.append((*waiting[1], likeness(waiting[0], own)))
                    waiting = (own, said)
                if is_copy and waiting is not None:
                    out.append((*waiting[1], likeness(waiting[0], signatures(codes[:0], codes, **how)[0])))
                    waiting = None
                held = row
                if len(out) >= 2000:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, OUT_DDL)
