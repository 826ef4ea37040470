"""Packing of tokenised documents into sequences of a fixed window.

Documents are cut into whole windows and a rest, and written with their ids as
pieces. Lengths are counted; only their histogram goes to the driver, in classes
of a few ids. There combinations of few classes that fill the window, or
nearly, are enumerated, non-negative least squares finds how often to repeat
each, and the counts are rounded: down first, then by the largest remainders for
which lengths are left. What is left after that is packed greedily by best fit,
the longest first. Which piece takes which place follows from its number among
the pieces of its length, so that ids stay where they were written: only narrow
columns are shuffled.

Defined results. Null and empty texts are the end id alone. Repeated rows are
packed each for itself. Very long texts are whole windows and a rest; every id
lies in one piece, and offsets in a sequence have no gap. Pieces of one length
(ties) are taken in the order of tasks and rows. Padding is what the sequences
have less than a window: a few ids a piece in combinations, more only
where the lengths that are there can't fill a window. An empty table has no
pieces. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfolio.llm.common import kept_by_worker, materialize
from quartzfolio.llm.tokens import TokenIds, ended

WINDOW, END_ID = 4096, 2
#: Lengths are planned in so many classes, of 8 ids each for a window of 4096.
CLASSES = 512
#: Times that a class is repeated in a combination, and how many classes, those
#: with the most ids, are tried as its second one.
REPEATS, FREQUENT = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64), 24
BATCH = 500


def pieces(docs: DataFrame, spec: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of every row, which ends with the end id: its whole windows and a
    rest, with their ids. ``number`` is a piece's place among those of its length
    in its task. ``spec`` is the tokenizer's JSON."""
    shipped = docs.sparkSession.sparkContext.broadcast(spec)  # a tokenizer file, of fixed size
    digest = hashlib.sha256(spec.encode()).hexdigest()
    schema = pa.schema([("task", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("number", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = kept_by_worker("tokens", digest, lambda: TokenIds(shipped.value)), TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                rows, first = [], 0
                ids, sizes = ended(*encoder.flat(part.column("text").to_pylist()), end_id)
                raw = ids.astype("<u4").tobytes()
                for doc, n in zip(part.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                    for start in range(0, n, window):
                        size = min(window, n - start)
                        rows.append((task, doc, n, start, size, seen[size], raw[4 * (first + start) : 4 * (first + start + size)]))
                        seen[size] += 1
                    first += n
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "task long, doc_id long, doc_tokens long, start long, length long, number long, ids binary")


def combinations(counts: np.ndarray, longest: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to three classes (columns, 0 for none) and their multiplicities that fill
    the window, by the ``longest`` length of each class, but for a sixty-fourth: a
    class some times, then a frequent one or none, then the largest that fits."""
    have = np.flatnonzero(counts > 0)
    found = [np.zeros((0, 6), np.int64)]
    sizes = longest[have]
    second = have[np.argsort(-counts[have] * sizes, kind="stable")[:FREQUENT]].tolist()
    for k in REPEATS:
        for b in [0, *second] if len(have) else []:
            left = window - k * sizes - longest[b]
            ok = (left >= 0) & (counts[have] >= k)
            a, i = have[ok], np.searchsorted(sizes, left[ok], "right")
            c = np.where(i > 0, have[i - 1], 0)
            found.append(np.stack([a, np.full(len(a), b), c, np.full(len(a), k), np.full(len(a), int(b > 0)), (c > 0).astype(np.int64)], 1))
    all_ = np.concatenate(found)
    classes, times = all_[:, :3].copy(), all_[:, 3:].copy()
    for i, j in ((0, 1), (0, 2), (1, 2)):  # a class named twice
        same = (classes[:, i] == classes[:, j]) & (times[:, j] > 0)
        times[same, i] += times[same, j]
        times[same, j] = classes[same, j] = 0
    order = np.argsort(-classes, axis=1, kind="stable")
    classes, times = np.take_along_axis(classes, order, 1), np.take_along_axis(times, order, 1)
    ok = ((counts[classes] >= times) | (times == 0)).all(1) & ((longest[classes] * times).sum(1) >= window - window // 64)
    both = np.unique(np.hstack([classes, times])[ok], axis=0)
    return both[:, :3], both[:, 3:]


def least_squares(classes: np.ndarray, times: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts with the least squared distance, in ids, of the
    classes used from the histogram, by accelerated projected gradients."""
    n = len(classes)
    if not n:
        return np.zeros(0)
    scale = np.arange(len(counts)) / len(counts)
    weights, target = times * scale[classes], counts * scale
    use = lambda x: np.bincount(classes.ravel(), (weights * x[:, None]).ravel(), minlength=len(target))
    back = lambda r: (weights * r[classes]).sum(axis=1)
    v = np.ones(n)
    for _ in range(20):
        v = back(use(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y + step * back(target - use(y)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded(x: np.ndarray, classes: np.ndarray, times: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeat counts, and what is left of each class: those of ``x`` rounded
    down, one more by the largest remainders, then as many as there are lengths
    for, in the order of ``x``."""
    left, out = counts.astype(np.int64).copy(), np.zeros(len(x), np.int64)

    def take(i: int, most: int) -> None:
        parts = [(a, k) for a, k in zip(classes[i].tolist(), times[i].tolist(), strict=True) if k]
        n = min(most, *(int(left[a]) // k for a, k in parts))
        out[i] += n
        for a, k in parts:
            left[a] -= k * n

    by_size = np.argsort(-x, kind="stable").tolist()
    for i in by_size:
        take(i, int(x[i] + 1e-6))
    for i in np.argsort(out - x, kind="stable").tolist():
        if x[i] > out[i]:
            take(i, 1)
    for i in by_size:
        take(i, int(counts.sum()))
    return out, left


@dataclass
class Plan:
    """Places of pieces: number ``low`` to ``high`` of a length have ``offset`` in
    the sequences from ``sequence`` on, in turn."""

    rows: np.ndarray  # length, low, high, sequence, offset; sorted
    combined: int  # ids placed by combinations
    greedy: int  # ids placed by best fit
    sequences: int

    def place(self, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and number."""
        r = self.rows
        first, last = np.searchsorted(r[:, 0], length, "left"), np.searchsorted(r[:, 0], length, "right")
        lows = r[:, 1]
        while (wide := last - first > 1).any():  # a binary search in each piece's own range
            mid = (first + last) // 2
            up = lows[np.minimum(mid, len(r) - 1)] <= at
            first, last = np.where(wide & up, mid, first), np.where(wide & ~up, mid, last)
        return r[first, 3] + at - r[first, 1], r[first, 4]


def best_fit(left: list[tuple[int, int, int]], window: int, sequence: int) -> tuple[list[tuple[int, ...]], int]:
    """Places of (length, low, n), the longest first, each where the least space
    is left; equal sequences are handled together."""
    rows, runs = [], []  # runs of sequences: space, first, how many
    for a, low, n in sorted(left, reverse=True):
        while n:
            i = bisect_left(runs, (a, -1, -1))
            if i < len(runs):
                space, first, many = runs.pop(i)
            else:
                space, first, many = window, sequence, -(-n // (window // a))
                sequence += many
            each = space // a
            full = min(many, n // each)
            if not full:
                each, full = n, 1
            for k in range(each):
                rows.append((a, low, low + full, first, window - space + k * a))
                low += full
            n -= each * full
            for run in ((space - each * a, first, full), (space, first + full, many - full)):
                if run[0] and run[2]:
                    insort(runs, run)
    return rows, sequence


def plan(counts: np.ndarray, window: int) -> Plan:
    """From the histogram of lengths, up to the window itself."""
    unit = max(1, window // CLASSES)
    of = -(-np.arange(window) // unit)
    by_class = np.bincount(of, weights=counts[:window]).astype(np.int64)
    by_class[0] = 0
    longest = np.zeros(len(by_class), np.int64)
    np.maximum.at(longest, of, np.where(counts[:window] > 0, np.arange(window), 0))
    classes, times = combinations(by_class, longest, window)
    repeats, left = rounded(least_squares(classes, times, by_class), classes, times, by_class)
    # pieces of a class in the order of their lengths: where each length begins
    starts = np.concatenate([[0], np.cumsum(counts[:window])])
    begins = np.searchsorted(of, np.arange(len(by_class)))  # first length of a class
    taken = np.zeros(len(by_class), np.int64)
    rows, sequence = [], int(counts[window])
    if sequence:
        rows.append((window, 0, sequence, 0, 0))
    for i in np.flatnonzero(repeats).tolist():
        n = int(repeats[i])
        slots = []
        for a, k in zip(classes[i].tolist(), times[i].tolist(), strict=True):
            for _ in range(k):
                slots.append(int(starts[begins[a]] + taken[a]))
                taken[a] += n
        edges = {0, n}
        for at in slots:
            low, high = np.searchsorted(starts, [at + 1, at + n])
            edges.update((starts[low:high] - at).tolist())
        edges = sorted(edges)
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            offset = 0
            for at in slots:
                length = int(np.searchsorted(starts, at + s, "right")) - 1
                low = at + s - int(starts[length])
                rows.append((length, low, low + e - s, sequence + s, offset))
                offset += length
        sequence += n
    rest = []
    for a in np.flatnonzero(left).tolist():
        at = starts[begins[a]] + taken[a]
        for length in range(begins[a], begins[a] + unit):
            if length < window and (n := int(starts[length + 1] - max(starts[length], at))) > 0:
                rest.append((length, int(max(starts[length], at) - starts[length]), n))
    greedy, sequence = best_fit(rest, window, sequence)
    table = np.array(sorted(rows + greedy), np.int64).reshape(-1, 5)
    amount = sum(a * n for a, _, n in rest)
    return Plan(table, int((counts[:window] * np.arange(window)).sum()) - amount, amount, sequence)


def place(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``pieces`` (read from a table) with ``sequence_id`` and ``offset``.
    Its other columns are shuffled with them: leave ids out, or take a digest."""
    spark = cut.sparkSession
    counts = np.zeros(window + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most `window` rows
        counts[r["length"]] = r["count"]
    shipped = spark.sparkContext.broadcast(plan(counts, window))  # some rows for each combination and length: no more for more documents
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    offsets = by_task.selectExpr("length", "task", "sum(n) OVER (PARTITION BY length ORDER BY task) - n AS earlier")

    @F.arrow_udf("sequence_id long, offset long")
    def placed(length: pa.Array, at: pa.Array) -> pa.Array:
        sequence, offset = shipped.value.place(length.to_numpy(), at.to_numpy())
        return pa.StructArray.from_arrays([pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["sequence_id", "offset"])

    rows = cut.join(offsets, ["length", "task"]).withColumn("p", placed("length", F.col("earlier") + F.col("number")))
    return rows.select(*(c for c in cut.columns if c not in ("task", "number")), "p.*")


def pack(docs: DataFrame, spec: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document, written with their ids to a table in the shared
    folder, and their places; of the ids their CRC-32 is taken where they lie."""
    cut = materialize(pieces(docs, spec, window, end_id), "pieces")
    return place(cut.select("task", "number", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
