"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of vote patterns, of the whole corpus,
estimates how often each labeller is right on good and on bad documents; the
posterior of a pattern labels its documents, and a bounded sample of these
trains a hashed linear scorer, whose score decides.

Defined results. Null and empty texts: score 0, rejected. If all documents get
the same label the scorer keeps them all (or, all bad, rejects them all). Equal
texts, whatever their ids, are learned from once and have equal scores; ids may
be null or repeated. Very long texts are measured whole. An empty table keeps
nothing and learns a scorer that keeps all. Further columns are passed on or
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfolio.llm.common import materialize, ngram_features
from quartzfolio.llm.quality_rules import BLANK, CAPITALS, MARKS, SYMBOLS, repeated_words

GOOD, BAD, NONE = 1, 0, -1
BITS, ORDERS = 12, (1, 2, 3)
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
#: Of each byte: 0 blank, 1 small letter, 2 capital, 3 sign that may end a word, 4 other.
KINDS = np.full(256, 4, np.uint8)
for kind, of in enumerate((BLANK, LETTERS, CAPITALS, b".,;:!?")):
    KINDS[np.frombuffer(of, np.uint8)] = kind


def too_much(value: float, bad: float) -> int:
    return BAD if value >= bad else NONE


def symbols(m: dict) -> int:
    return too_much(m["symbols"] / m["chars"], 0.08)


def capitals(m: dict) -> int:
    return too_much(m["capitals"] / m["chars"], 0.4)


def marks(m: dict) -> int:
    return too_much(m["marks"] / m["words"], 0.3)


def lone_signs(m: dict) -> int:
    return too_much(m["signs"] / m["words"], 0.1)


def repetition(m: dict) -> int:
    return NONE if m["words"] < 20 else too_much(m["repeated"] / m["words"], 0.5)


def lines_again(m: dict) -> int:
    return NONE if m["lines"] < 4 else too_much(m["dup_lines"] / m["lines"], 0.3)


def stutter(m: dict) -> int:
    return NONE if m["words"] < 20 else too_much(m["stutters"] / m["words"], 0.2)


def squeeze(m: dict) -> int:
    return NONE if m["bytes"] < 200 else too_much(-m["squeezed"] / m["bytes"], -0.15)


def letters(m: dict) -> int:
    share = m["letters"] / m["bytes"]
    return GOOD if share >= 0.94 else BAD if share < 0.9 else NONE


def prose(m: dict) -> int:
    share = m["plain"] / m["words"]
    return GOOD if share >= 0.95 else BAD if share < 0.85 else NONE


def word_length(m: dict) -> int:
    off = abs(m["chars"] / m["words"] - 5.5)
    return GOOD if off <= 2 else BAD if off >= 4 else NONE


LABELLERS = (symbols, capitals, marks, lone_signs, repetition, lines_again, stutter, squeeze, letters, prose, word_length)


def measures(text: str) -> dict[str, float]:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    return {
        "words": len(words), "bytes": len(raw) - less(BLANK), "chars": len(text) - less(BLANK), "symbols": less(SYMBOLS), "capitals": less(CAPITALS),
        "marks": less(MARKS), "letters": less(LETTERS), "signs": sum(len(w) == 1 and not w.isalnum() for w in words), "lines": len(lines),
        "dup_lines": len(lines) - len(set(lines)), "repeated": repeated_words(words), "plain": plain_words(raw),
        "stutters": sum(map(eq, words, words[1:])), "squeezed": len(zlib.compress(raw, 1)),
    }


def plain_words(raw: bytes) -> int:
    """Words of letters, capital at most the first, and at most one sign at the
    end. Bytes beyond ASCII count as small letters."""
    k = KINDS[np.frombuffer(raw, np.uint8)]
    blank = np.concatenate([[True], k == 0, [True]])
    first, last = blank[:-2], blank[2:]
    bad = (k == 4) | (k == 3) & ~last | (k == 2) & ~first | (k > 2) & first
    starts = np.flatnonzero((k != 0) & first)
    return len(starts) - int(np.count_nonzero(np.logical_or.reduceat(bad & (k != 0), starts))) if len(starts) else 0


def votes(text: str | None) -> int | None:
    """The votes as digits of a number in base 3, nothing being 0; None if there is no word."""
    m = measures(text or "")
    if not m["words"]:
        return None
    out = 0
    for f in LABELLERS:
        out = 3 * out + f(m) + 1
    return out


def digits(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        pattern, d = divmod(pattern, 3)
        out.append(d - 1)
    return out[::-1]


@dataclass
class Labels:
    """What expectation-maximisation found."""

    prior: float
    votes: np.ndarray  # votes[c, j, v]: how often labeller j votes v (nothing, bad, good) on class c
    posterior: dict[int, float]  # of being good, for each pattern

    def accuracy(self) -> np.ndarray:
        """How often each labeller is right when it votes."""
        joint = self.votes * np.array([1 - self.prior, self.prior])[:, None, None]
        return (joint[BAD, :, 1] + joint[GOOD, :, 2]) / joint[:, :, 1:].sum((0, 2))


def estimate(counts: dict[int, int], rounds: int = 200) -> Labels:
    """From the number of documents with each vote pattern. A vote is taken to
    be likelier on its own class, which settles which class is which."""
    patterns = sorted(counts)
    v = np.array([digits(p) for p in patterns], np.int8).reshape(len(patterns), len(LABELLERS)) + 1
    n = np.array([counts[p] for p in patterns], np.float64)
    good = np.clip(((v == 2).sum(1) - 1.5 * (v == 1).sum(1)) / len(LABELLERS) + 0.5, 0.02, 0.98)
    theta, prior = np.full((2, len(LABELLERS), 3), 1 / 3), 0.5
    for _ in range(rounds if len(n) else 0):
        mass = np.stack([n * (1 - good), n * good])
        prior = float(np.clip(mass[1].sum() / n.sum(), 0.001, 0.999))
        for k in range(3):
            theta[:, :, k] = mass @ (v == k) + 0.5
        theta /= theta.sum(2, keepdims=True)
        theta[BAD, :, 1] = np.maximum(theta[BAD, :, 1], theta[GOOD, :, 1])
        theta[GOOD, :, 2] = np.maximum(theta[GOOD, :, 2], theta[BAD, :, 2])
        theta /= theta.sum(2, keepdims=True)
        odds = np.full(len(n), np.log(prior / (1 - prior)))
        for k in range(3):
            odds += (v == k) @ np.log(theta[GOOD, :, k] / theta[BAD, :, k])
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return Labels(prior, theta, dict(zip(patterns, good.tolist(), strict=True)))


#: What the scorer sees of the measures, each in eighths: a part, and of what.
SHARES = (("symbols", "chars"), ("capitals", "chars"), ("marks", "words"), ("signs", "words"), ("repeated", "words"), ("stutters", "words"), ("squeezed", "bytes"), ("plain", "words"), ("letters", "bytes"))
SHORT = 300


def features(text: str, m: dict[str, float]) -> np.ndarray:
    """Hashed n-grams of the whole text, fainter if it is short, and hashed
    steps of its measures."""
    x = ngram_features(text, BITS, ORDERS) * min(1.0, (len(text) / SHORT) ** 0.5)
    for part, whole in SHARES:
        step = min(8, int(8 * m[part] / m[whole]))
        x[zlib.crc32(f"{part}:{step}".encode()) % len(x)] += 0.3
    return x


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        m = measures(text or "")
        if not m["words"]:
            return 0.0
        z = float(features(text, m) @ self.weights) + self.bias
        return float(1 / (1 + np.exp(-max(min(z, 40), -40))))


def fit(texts: list[str], target: np.ndarray, prior: float = 0.5, epochs: int = 30, rate: float = 4.0, decay: float = 1e-5, seed: int = 5) -> Scorer:
    """Logistic regression on soft labels, both classes weighing the same, then
    moved to the ``prior`` share of good documents."""
    share = float(np.mean(target >= 0.5)) if len(target) else 1.0
    if share in (0.0, 1.0):
        return Scorer(np.zeros(1 << BITS, np.float32), 40.0 if share else -40.0)
    x = np.stack([features(t, measures(t)) for t in texts])
    weight = np.where(target >= 0.5, 0.5 / share, 0.5 / (1 - share))
    w, bias, rng = np.zeros(1 << BITS), 0.0, np.random.default_rng(seed)
    for e in range(epochs):
        step = rate / (1 + e)
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
            z = x[rows] @ w + bias
            g = weight[rows] * (target[rows] - 1 / (1 + np.exp(-np.clip(z, -40, 40))))
            w += step * (g @ x[rows] / len(rows) * 8 - decay * w)
            bias += 0.1 * step * g.mean()
    return Scorer(w.astype(np.float32), float(bias + np.log(prior / (1 - prior))))


def vote_table(docs: DataFrame) -> DataFrame:
    """Hash, size and vote pattern of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"hash": b.column("hash"), "size": b.column("size"), "pattern": pa.array([votes(t) for t in b.column("text").to_pylist()], pa.int64())})

    return docs.select(F.xxhash64("text").alias("hash"), F.length("text").cast("long").alias("size"), "text").mapInArrow(run, "hash long, size long, pattern long")


def learn(docs: DataFrame, per_class: int = 2000, chars: int = 12_000_000) -> tuple[Labels, Scorer]:
    """Accuracies from all documents; the scorer from about ``per_class`` texts,
    of about ``chars`` code points, with each label."""
    spark = docs.sparkSession
    seen = materialize(vote_table(docs), "votes").where("pattern IS NOT NULL")
    counts = {r["pattern"]: r for r in seen.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("size").alias("chars")).collect()}  # 3 ** 11 at most
    labels = estimate({p: r["n"] for p, r in counts.items()})
    rates = []
    for c in (BAD, GOOD):
        of = [p for p, q in labels.posterior.items() if (q >= 0.5) == bool(c)]
        if of:
            rate = min(per_class / sum(counts[p]["n"] for p in of), chars / max(1, sum(counts[p]["chars"] for p in of)))
            rates += [(p, rate) for p in of]
    wanted = F.broadcast(spark.createDataFrame(rates, "pattern long, rate double"))  # a row a pattern
    spot = F.pmod(F.xxhash64("hash"), F.lit(1_000_003)) / 1_000_003.0
    picked = seen.join(wanted, "pattern").where(spot < F.col("rate")).select("hash").distinct()
    picked = picked.orderBy(F.xxhash64("hash"), "hash").limit(4 * per_class)  # a number a row
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("hash"), "text").join(F.broadcast(picked), "hash")
    rows = sorted(r["text"] for r in texts.groupBy("hash").agg(F.min("text").alias("text")).collect())  # copies meet first
    return labels, fit(rows, np.array([labels.posterior[votes(t)] for t in rows]), labels.prior)


def scored(docs: DataFrame, scorer: Scorer, text: str = "text") -> Column:
    """Score of the texts of a column of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)  # of fixed size

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([shipped.value.score(t) for t in column.to_pylist()], pa.float64())

    return run(F.col(text))


def judge(docs: DataFrame, threshold: float = 0.5, per_class: int = 2000) -> DataFrame:
    """doc_id, score and kept of every document."""
    _, scorer = learn(docs, per_class)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select("doc_id", scored(rows, scorer).alias("score")).withColumn("kept", F.col("score") >= threshold)
