"""Resampling of documents by importance for a target distribution.

Word runs are hashed into buckets. Each document's buckets are written, as packed
16-bit numbers one after another with the sizes of the documents, to a table of
blocks: the stream. For the counts, every block is sorted and run-length encoded,
and runs are merged by bucket; only so many numbers as there are buckets reach
the driver. The stream is then read once more: the gains of its buckets are
gathered, and ``np.add.reduceat`` sums them by document. Nothing is hashed
twice, and no counts are held by document.

The draw takes the highest scores, weight plus Gumbel noise from a hash of the
id: sampling without replacement in proportion to exp(weight / 1000). Ranks are
counted in bands of scores, of which only the highest are sorted.

Defined results. Null and empty texts have no feature and weight 0, and are not
drawn if fewer than ``least_words`` words are asked for at least. A null id is
noised as an empty one and ranks before others of its score. Repeated rows are
documents of their own; equal in id and score, they take their ranks in any
order. Very long texts are hashed in segments, runs over their edges included.
An empty corpus gives no rows; an empty target has no counts, so that gains fall
with the corpus counts. Further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfolio.llm.common import materialize

BUCKETS, ORDERS, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bands of scores between the share drawn, doubled, and the highest score.
BANDS = 200
#: Bytes of text hashed at once, and of text in a block of the stream, a document more.
SEGMENT, BLOCK = 1 << 19, 1 << 21
#: Bytes up to which words are hashed together, one byte of each at a time.
COLUMNS = 48

#: Words are digits, a to z and all beyond ASCII; the rest of ASCII separates.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def crc_table() -> np.ndarray:
    """Remainders of the bytes by the reversed CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = crc_table()
BLANK = 32


def extended(state: np.ndarray, b: np.ndarray, starts: np.ndarray, sizes: np.ndarray, by_size: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of words; ``by_size`` are the words' numbers,
    the longest first."""
    out = state.copy()
    long = int(np.searchsorted(-sizes[by_size], -COLUMNS, "left"))
    for i in by_size[:long].tolist():
        out[i] = ~zlib.crc32(b[starts[i] : starts[i] + sizes[i]].tobytes(), int(~state[i])) & 0xFFFFFFFF
    rest = by_size[long:]
    s, at, left = state[rest], starts[rest], sizes[rest]
    for p in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -p, "left"))
        s[:n] = CRC[(s[:n] ^ b[at[:n] + p]) & 255] ^ (s[:n] >> 8)
    out[rest] = s
    return out


def hashed(raw: bytes, ends: np.ndarray, orders: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of up to ``orders`` words of texts, one after another,
    how many each text has, and its words. ``raw`` are the texts in PLAIN, each
    followed by a blank, ``ends`` where those blanks are."""
    parts, n_features, n_words = [], np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    at, carry = 0, 0
    while at < len(raw):
        to = min(len(raw), at + SEGMENT)
        while raw[to - 1] != BLANK:  # words aren't cut
            to += 1
        first = at - carry
        b = np.frombuffer(raw[first:to], np.uint8)
        word = b != BLANK
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        of = np.searchsorted(ends, starts + first)
        by_size = np.argsort(-sizes, kind="stable")
        new = starts + first >= at
        state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
        found, there = np.zeros((len(starts), orders), np.uint16), np.zeros((len(starts), orders), bool)
        for k in range(orders):
            if k:  # a run of one word less, up to the word before, and a blank
                state = np.concatenate([state[:1], state[:-1]]) if len(state) else state
                state = CRC[(state ^ np.uint32(BLANK)) & 255] ^ (state >> 8)
            state = extended(state, b, starts, sizes, by_size)
            found[:, k] = ~state % np.uint32(buckets)
            there[k:, k] = new[k:] & (of[k:] == of[: len(of) - k])
        n_words += np.bincount(of[new], minlength=len(ends))
        n_features += np.bincount(of, there.sum(axis=1), minlength=len(ends)).astype(np.int64)
        parts.append(found[there])
        carry = to - first - int(starts[-(orders - 1)]) if orders > 1 and len(starts) >= orders - 1 else to - first if orders > 1 else 0
        at = to
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16), n_features, n_words


STREAM = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("buckets", pa.binary())])
STREAM_DDL = "doc_ids array<long>, n_words array<long>, sizes array<long>, buckets binary"


def stream(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """Blocks of bucket numbers, from rows ``doc_id, text``."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            at = 0
            while at < len(ids):
                raw, to, room = [], at, BLOCK
                while to < len(ids) and (room > 0 or to == at):
                    raw.append((texts[to] or "").encode().translate(PLAIN))
                    room -= len(raw[-1])
                    to += 1
                ends = np.cumsum([len(r) + 1 for r in raw]) - 1
                found, sizes, words = hashed(b" ".join(raw) + b" ", ends, orders, buckets)
                yield pa.record_batch([pa.array([x], f.type) for x, f in zip((ids[at:to], words, sizes, found.astype("<u2").tobytes()), STREAM, strict=True)], schema=STREAM)
                at = to

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STREAM_DDL)


def counts(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket stands in the stream: runs of sorted blocks, merged."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column("buckets"):
                in_order = np.sort(np.frombuffer(x.as_buffer(), "<u2"), kind="stable")
                first = np.flatnonzero(np.diff(in_order.astype(np.int64), prepend=-1))
                total[in_order[first]] += np.diff(first, append=len(in_order))
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there), pa.array(total[there])], schema=schema)

    out = np.zeros(buckets, np.int64)
    for r in blocks.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, floor of 1000 times the log of how much likelier it is in the
    target; counts are raised by one."""
    many, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + many) / ((s + 1.0) * (t_all + many)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(blocks: DataFrame, by_bucket: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document of the stream."""
    shipped = blocks.sparkSession.sparkContext.broadcast(by_bucket)  # one number a bucket
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, words, sizes, found in zip(*(b.column(c) for c in ("doc_ids", "n_words", "sizes", "buckets")), strict=True):
                gained = shipped.value[np.frombuffer(found.as_buffer(), "<u2")]
                n = sizes.values.to_numpy()
                has = np.flatnonzero(n)
                weight = np.zeros(len(n), np.int64)
                if len(has):
                    weight[has] = np.add.reduceat(gained, (np.cumsum(n) - n)[has])
                yield pa.record_batch([ids.values, words.values, sizes.values, pa.array(weight)], schema=schema)

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise, in thousandths, from the SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of a table with ``n_words``, ``score`` and ``doc_id``, and in ``rank``
    the place of those drawn. Only bands of scores that hold drawn rows are sorted."""
    spark = scored.sparkSession
    may = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    lowest = max(0.0, 1 - 2 * percent / 100)
    at = [lowest + (1 - lowest) * i / BANDS for i in range(BANDS)]
    found = scored.where(may).agg(F.count("*").alias("n"), F.percentile_approx("score", at, 10_000).alias("bounds")).first()
    bounds = np.unique(np.array(found["bounds"] or [0], np.int64))
    n_drawn = percent * found["n"] // 100

    @F.arrow_udf("int")
    def band(score: pa.Array) -> pa.Array:
        return pa.array(len(bounds) - np.searchsorted(bounds, score.to_numpy(), "right"), pa.int32())

    rows = scored.withColumn("band", F.when(may, band("score")).otherwise(len(bounds) + 1))
    sizes = {r["band"]: r["count"] for r in rows.where(may).groupBy("band").count().collect()}  # a row a band
    before, offsets = 0, []
    for b in sorted(sizes):
        if before < n_drawn:
            offsets.append((b, before))
            before += sizes[b]
    last = offsets[-1][0] if offsets else -1
    high = rows.where(F.col("band") <= last).join(F.broadcast(spark.createDataFrame(offsets, "band int, before long")), "band")
    columns = [f"`{c}`" for c in scored.columns]
    ranked = high.selectExpr(*columns, "before + row_number() OVER (PARTITION BY band ORDER BY score DESC, doc_id) AS place")
    rest = rows.where(F.col("band") > last).selectExpr(*columns, "cast(NULL AS long) AS rank")
    return ranked.selectExpr(*columns, f"CASE WHEN place <= {n_drawn} THEN cast(place AS long) END AS rank").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every document's features, weight, score and rank in the draw of ``percent``
    of those with ``least_words`` words; ``target`` has a column ``text``."""
    blocks = materialize(stream(docs, orders, buckets), "stream")
    wanted = stream(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), orders, buckets)
    of = weights(blocks, gains(counts(blocks, buckets), counts(wanted, buckets)))
    scored = materialize(of.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    return draw(scored, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
