"""Quality rules: a decision list learned from labelled text statistics.

``text_statistics`` counts, ``learn`` grows and prunes conjunctions of
thresholds by sequential covering, and ``Rules.verdict`` is the ordered list as
one Spark conditional expression.

Defined results. Null and empty texts have zero counts (and so fail the base
rules). Repeated rows give repeated rows. Labels that are null or lack a
document are not used; of several labels of a document the lowest holds. With
no usable labels, or labels of one class, the list is empty and every document
that passes the base rules is kept. Of conditions with the same gain the first
in the order of ``FEATURES`` is taken. Very long texts are counted whole. Further
columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfolio.llm.common import materialize

BLANK = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
MARKS = b"!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks")
STATS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])
STATS_DDL = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)])


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    v = len(known)
    pairs = ids[:-1] * v + ids[1:]
    if v >= 2_000_000:  # three ids no longer fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * v + ids[2:]
    s = np.sort(windows)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, windows)
    hit = twice[np.minimum(at, len(twice) - 1)] == windows
    inside = np.zeros(n, bool)
    inside[:-2] |= hit
    inside[1:-1] |= hit
    inside[2:] |= hit
    return int(inside.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one whole text."""
    raw = (text or "").encode()
    words = raw.split()  # of bytes: at the six ASCII blanks alone
    lines = [x for x in raw.split(b"\n") if x.strip()]
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    return len(words), len(text or "") - less(BLANK), less(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), less(CAPITALS), less(MARKS)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts(t) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * len(COUNTS)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], schema=STATS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STATS_DDL)


def share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


#: What the conditions compare, from the counts.
FEATURES: dict[str, Column | str] = {
    "symbol_share": ("n_symbols", "word_chars"), "capital_share": ("n_capitals", "word_chars"), "mark_share": ("n_marks", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words"), "dup_lines": ("n_dup_lines", None), "words": ("n_words", None),
}


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return share(a, b) if b else F.col(a).cast("double")


@dataclass
class Rule:
    """A conjunction of (feature, sign, threshold); sign is ``>`` or ``<=``."""

    conditions: list[tuple[str, str, float]]
    caught: int = 0
    wrong: int = 0

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, at in self.conditions:
            out &= x[name] > at if sign == ">" else x[name] <= at
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, at in self.conditions:
            out = out & (feature(name) > at if sign == ">" else feature(name) <= at)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {t:.6g}" for n, s, t in self.conditions)


@dataclass
class Rules:
    """Ordered rules that reject; what none covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def number(self) -> Column:
        """Number from 1 of the first rule that covers a row, else 0."""
        if not self.rules:
            return F.lit(0)
        out = F.when(self.rules[0].column(), 1)
        for i, r in enumerate(self.rules[1:], 2):
            out = out.when(r.column(), i)
        return out.otherwise(0)

    def rejects(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_or.reduce([r.covers(x) for r in self.rules] or [np.zeros(len(next(iter(x.values()))), bool)])


def best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, tuple[str, str, float] | None]:
    """The threshold with the highest FOIL gain on these rows."""
    n, p = len(bad), int(bad.sum())
    best: tuple[float, tuple[str, str, float] | None] = (1e-9, None)
    if p in (0, n):
        return best
    base = np.log2(p / n)
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        s, hits = v[order], np.cumsum(bad[order])
        edge = np.flatnonzero(s[1:] > s[:-1])
        if not len(edge):
            continue
        low_p, low_n = hits[edge], edge + 1
        for sign, pp, nn in (("<=", low_p, low_n), (">", p - low_p, n - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / nn) - base), -1.0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), (name, sign, float((s[edge[i]] + s[edge[i] + 1]) / 2)))
    return best


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[tuple[str, str, float]]:
    conditions: list[tuple[str, str, float]] = []
    rows = np.ones(len(bad), bool)
    while len(conditions) < most and bad[rows].any() and not bad[rows].all():
        _, c = best_condition({k: v[rows] for k, v in x.items()}, bad[rows])
        if c is None:
            break
        conditions.append(c)
        rows = Rule(conditions).covers(x)
    return conditions


def prune(conditions: list[tuple[str, str, float]], x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop final conditions as long as (caught - wrong) / covered doesn't fall."""
    best, worth = Rule(conditions), -2.0
    for k in range(len(conditions), 0, -1):
        r = Rule(conditions[:k])
        c = r.covers(x)
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        if p + n and (w := (p - n) / (p + n)) >= worth:
            best, worth = Rule(conditions[:k], p, n), w
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, max_rules: int = 16, max_conditions: int = 4, least_precision: float = 0.9, least_caught: int = 2) -> Rules:
    """Sequential covering: ``fold`` 0 to 2 grows a rule, 3 prunes it, and all rows
    that earlier rules leave say whether it is precise enough to stay."""
    out, left = Rules(), np.ones(len(bad), bool)
    for _ in range(max_rules):
        g, h = left & (fold != 3), left & (fold == 3)
        conditions = grow({k: v[g] for k, v in x.items()}, bad[g], max_conditions)
        if not conditions:
            break
        r = prune(conditions, {k: v[h] for k, v in x.items()}, bad[h])
        c = r.covers(x) & left
        caught, wrong = int((c & bad).sum()), int((c & ~bad).sum())
        if caught < least_caught or caught < least_precision * (caught + wrong):
            break
        out.rules.append(Rule(r.conditions, caught, wrong))
        left &= ~c
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn_from(stats: DataFrame, labels: DataFrame, sample: int = 20_000, **how: float) -> Rules:
    """Learn from at most ``sample`` labelled rows, those with the least hash."""
    wanted = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = (
        stats.join(F.broadcast(wanted), "doc_id")  # at most `sample` rows of two numbers
        .where(~base_failed())
        .select("doc_id", (F.col("quality") == 0).alias("bad"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).alias("fold"), *(feature(f).alias(f) for f in FEATURES))
        .orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(sample).toPandas()
    )
    return learn({f: rows[f].to_numpy(np.float64) for f in FEATURES}, rows["bad"].to_numpy(bool), rows["fold"].to_numpy(np.int64), **how)


def judge(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """Counts, base verdict, number of the rule that rejects (0: none) and
    ``kept`` for every document. The counts are taken once and written to the
    shared folder; learning and judging read them, not the texts."""
    stats = materialize(text_statistics(docs), "text-statistics")
    rules = learn_from(stats, labels, sample)
    return (
        stats.withColumn("base_failed", base_failed())
        .withColumn("rule_number", rules.number().cast("int"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule_number") == 0))
    )
