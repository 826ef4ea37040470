"""Language identification in two steps: family first, then close relatives.

Texts become hashed counts of character n-grams. One-versus-rest linear
machines choose the language family; within it, a linear support vector
machine for each pair of languages votes. All are trained here, by Pegasos
steps on a bounded sample of labelled rows.

A text fits its language if its n-grams are about as likely there as those of
the texts that were learned from; how far below their mean it may be follows
from these, and is more for short texts. A text of a language that was not
learned gets the nearest one, but doesn't fit it.

Defined results. Null text, and text without a letter: ``und`` with score 0.
Labels that are null are not learned from. A language that ``families`` doesn't
name is a family of its own. With one learned language every text with a letter
is of it; with none, ``und``. Ties of votes go to the larger summed margin, then
to the first name. Equal texts (repeated rows) have equal results. Very long
texts are read whole. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfolio.llm.common import ngram_features

BITS = 14
DIMENSIONS = 1 << BITS
ORDERS = (1, 2, 3)
BATCH = 256
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"), "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"), "uralic": ("fi", "et", "hu"), "turkic": ("tr", "az", "kk"),
}
UNKNOWN = "und"
#: A text may be so many times as far below the mean as all but a hundredth of those learned from.
SLACK = 1.5


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(text: str | None) -> np.ndarray:
    """Hashed n-gram counts of the whole text under a root, at unit length."""
    return ngram_features((text or "").lower(), BITS, ORDERS)


def svm(x: np.ndarray, use: np.ndarray, y: np.ndarray, epochs: int, rate: float, seed: int) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with hinge loss, from
    the rows that ``use`` numbers; the two classes weigh the same. ``y`` is 1 or
    -1 for each of those."""
    n, d = len(use), x.shape[1]
    w, mean = np.zeros(d + 1, np.float64), np.zeros(d + 1, np.float64)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    rng, t, kept = np.random.default_rng(seed), 0, 0
    for e in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 32)):
            t += 1
            step = 1 / (rate * (t + 10))
            out = (y[rows] * (x[use[rows]] @ w[:-1] + w[-1])) < 1
            w[:-1] *= 1 - step * rate
            if out.any():
                r = rows[out]
                g = weight[r] * y[r] * (step / len(rows))
                w[:-1] += g @ x[use[r]]
                w[-1] += 0.1 * g.sum()
            if e >= epochs // 2:
                kept += 1
                mean += (w - mean) / kept
    return mean


@dataclass
class Model:
    """Trained machines; columns of ``weights`` are those of ``families``, then
    of ``pairs``."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    spread: np.ndarray
    #: Of each language, in the order of names: logarithms of how likely n-grams are, their mean in a text, and how far below it a text may be.
    languages: list[str]
    likely: np.ndarray
    mean: np.ndarray
    reach: np.ndarray

    def fits(self, x: np.ndarray, sizes: list[int], langs: list[str]) -> list[bool]:
        """Whether texts (features, code points) are like those of their language."""
        if not self.languages:
            return [False] * len(x)
        at = [self.languages.index(v) for v in langs]
        below = self.mean[at] - shortfall(x, self.likely)[np.arange(len(x)), at]
        return (below * certainty(np.array(sizes)) <= self.reach[at]).tolist()

    def predict(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        names, langs, scores = list(self.families), [], []
        if not names:
            return [UNKNOWN] * len(x), [0.0] * len(x)
        margins = (x @ self.weights[:-1] + self.weights[-1]) / self.spread if self.weights.shape[1] else np.zeros((len(x), 0))
        of_pair = {p: i + (len(names) if len(names) > 1 else 0) for i, p in enumerate(self.pairs)}
        for m in margins:
            family, sure = names[0], 1.0
            if len(names) > 1:
                top = np.argsort(-m[: len(names)], kind="stable")
                family, sure = names[top[0]], sigmoid((m[top[0]] - m[top[1]]) / 2)
            members = self.families[family]
            votes = dict.fromkeys(members, 0)
            summed = dict.fromkeys(members, 0.0)
            least = dict.fromkeys(members, np.inf)
            for a, b in combinations(members, 2):
                v = float(m[of_pair[a, b]])
                votes[a if v >= 0 else b] += 1
                for lang, s in ((a, v), (b, -v)):
                    summed[lang] += s
                    least[lang] = min(least[lang], s)
            lang = max(members, key=lambda k: (votes[k], summed[k]))
            langs.append(lang)
            scores.append(float(sure * (sigmoid(least[lang]) if len(members) > 1 else 1.0)))
        return langs, scores


def shortfall(x: np.ndarray, likely: np.ndarray) -> np.ndarray:
    """Mean logarithm of how likely the n-grams of each text are in each language."""
    shares = x * x  # features are roots of shares
    return (shares @ likely) / np.maximum(shares.sum(1, keepdims=True), 1e-9)


def certainty(sizes: np.ndarray) -> np.ndarray:
    """A mean over few n-grams varies more: the root of the size, 20 at most."""
    return np.sqrt(np.clip(sizes, 1, 400))


def sigmoid(v: float) -> float:
    return float(1 / (1 + np.exp(-4 * min(max(v, -50), 50))))


def train(texts: list[str], langs: list[str], families: Mapping[str, tuple[str, ...]] = FAMILIES, epochs: int = 6, rate: float = 1e-4, seed: int = 1) -> Model:
    """Fit on rows held in memory; the caller bounds them."""
    family_of = {x: f for f, members in families.items() for x in members}
    known = sorted(set(langs))
    grouped: dict[str, list[str]] = {}
    for x in known:
        grouped.setdefault(family_of.get(x, x), []).append(x)
    grouped = dict(sorted(grouped.items()))
    pairs = [p for members in grouped.values() for p in combinations(members, 2)]
    if not known:
        return Model({}, [], np.zeros((DIMENSIONS + 1, 0)), np.ones(0), [], np.zeros((DIMENSIONS, 0)), np.zeros(0), np.zeros(0))
    x = np.stack([features(t) for t in texts])
    y = np.array(langs)
    of = np.array([family_of.get(v, v) for v in langs])
    columns = [(np.ones(len(y), bool), of == f) for f in grouped] if len(grouped) > 1 else []
    columns += [((y == a) | (y == b), y == a) for a, b in pairs]
    weights, spread = np.zeros((DIMENSIONS + 1, len(columns))), np.ones(len(columns))
    for i, (rows, positive) in enumerate(columns):
        use = np.flatnonzero(rows)
        weights[:, i] = w = svm(x, use, np.where(positive[use], 1.0, -1.0), epochs, rate, seed + i)
        spread[i] = max(float(np.median(np.abs(x @ w[:-1].astype(np.float32) + w[-1])[use])), 1e-9)
    likely, mean, reach = np.zeros((DIMENSIONS, len(known)), np.float32), np.zeros(len(known)), np.zeros(len(known))
    sizes = np.array(list(map(len, texts)))
    for i, lang in enumerate(known):
        rows = np.flatnonzero(y == lang)
        summed = np.zeros(DIMENSIONS)
        for r in rows:
            summed += x[r].astype(np.float64) ** 2 * sizes[r]
        likely[:, i] = np.log((summed + 0.5) / (summed + 0.5).sum())
        own = shortfall(x[rows], likely[:, i : i + 1])[:, 0]
        mean[i] = np.average(own, weights=np.minimum(sizes[rows], 400))
        reach[i] = SLACK * float(np.quantile((mean[i] - own) * certainty(sizes[rows]), 0.99))
    return Model(grouped, pairs, weights.astype(np.float32), spread.astype(np.float32), known, likely, mean, reach)


def held_out() -> F.Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, per_language: int, chars: int, most: int) -> DataFrame:
    """About ``per_language`` rows, of about ``chars`` code points together, to
    learn from for each language, and about ``most`` in all (fewer of each where
    there are many languages; none is left out): those whose hash is below a
    share that the language's counts set. No sort of texts, no window."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()  # a row a language
    each = min(per_language, max(1, most // max(1, len(sizes))))
    rates = [(r["lang"], min(each / r["n"], chars / max(1, r["chars"]))) for r in sizes]
    rate = F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, rate double"))
    spot = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0
    picked = rows.select("text", F.col("lang").cast("string").alias("lang")).join(rate, "lang").where(spot < F.col("rate"))
    return picked.groupBy("lang", F.xxhash64("text").alias("hash")).agg(F.min("text").alias("text")).select("text", "lang")  # copies are learned from once


def learn(docs: DataFrame, per_language: int = 500, chars: int = 4_000_000, most: int = 20_000, families: Mapping[str, tuple[str, ...]] = FAMILIES) -> Model:
    """Train on a bounded sample of the labelled documents not held out."""
    rows = sorted(tuple(r) for r in sample(docs, per_language, chars, most).collect())
    rows = [r for r in rows if has_letter(r[0])]
    return train([t for t, _ in rows], [x for _, x in rows], families)


def predicted(docs: DataFrame, model: Model, text: str = "text") -> F.Column:
    """Struct of lang_pred, score and fits for the texts of a column of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a few machines of fixed size

    @F.arrow_udf("lang_pred string, score double, fits boolean")
    def run(column: pa.Array) -> pa.Array:
        langs: list[str] = []
        scores: list[float] = []
        fits: list[bool] = []
        for at in range(0, len(column), BATCH):
            texts = column.slice(at, BATCH).to_pylist()
            x = np.stack([features(t) for t in texts])
            got = shipped.value.predict(x)
            like = shipped.value.fits(x, [len(t or "") for t in texts], got[0])
            for t, lang, score, fit in zip(texts, *got, like, strict=True):
                known = has_letter(t)
                langs.append(lang if known else UNKNOWN)
                scores.append(score if known else 0.0)
                fits.append(fit and known)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.bool_())], ["lang_pred", "score", "fits"])

    return run(F.col(text))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Language, score and fit of every row; whole texts, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.withColumn("p", predicted(rows, model)).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.fits")
