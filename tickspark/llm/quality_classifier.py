"""Document quality by Bradley-Terry pairwise ranking (operator 8).

A document's strength is linear in measures of its text. Preference pairs put a
good document before a bad one; P(i before j) is the logistic function of the
difference of their strengths, so the weights come from logistic loss on
feature differences. The cut is a quantile of the training strengths, chosen near the share of
bad documents for the best balanced accuracy, and strengths are mapped so that
the cut has score 0.3.

Defined results: a null text counts as empty and is scored like any text;
without labels of both kinds every score is 0.5; a row without an id is never learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ._common import text_or_empty
from ._learning import held_out, labelled_documents, logistic

CUT, PAIRS_PER_BAD, PAIRS, L2 = 0.3, 16, 200_000, 1.0
_SYMBOLS = re.compile(r"[#*$%&|<>~^{}\[\]\\=_@]+")
_UPPER = re.compile(r"[^\W\d_a-zà-öø-ÿß]")
_MARKS = re.compile(r"[!?]+")
_ENDS = re.compile(r"[.!?](?=\s|$)")
_DIGITS = re.compile(r"[0-9]+")


def measures(text: str) -> list[float]:
    """Rates of a text, each without a bound on its length and none made of words of one language."""
    words = text.split()
    n, chars = len(words), len(text)
    some, body = max(n, 1), max(chars, 1)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = Counter(zip(words, words[1:], words[2:]))
    kinds = Counter(words)
    letters = chars - text.count(" ") - text.count("\n")
    return [
        np.log1p(n),
        sum(map(len, _SYMBOLS.findall(text))) / some,
        len(_UPPER.findall(text)) / max(letters, 1),
        sum(map(len, _MARKS.findall(text))) / some,
        len(_ENDS.findall(text)) / some,
        sum(map(len, _DIGITS.findall(text))) / body,
        text.count("|") / some,
        1 - len(set(lines)) / max(len(lines), 1),
        1 - len(pairs) / max(n - 2, 1) if n > 2 else 0.0,
        (max(kinds.values()) if kinds else 0) / some,
        len(kinds) / some,
        letters / some,
        np.log1p(some / max(len(lines), 1)),
        max(map(len, words), default=0) / 10.0,
        text.count(",") / some,
        float(n < 20),
    ]


N_MEASURES = len(measures(""))


@dataclass(frozen=True)
class Ranking:
    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return features(x, self.middle, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        z = (self.strength(x) - self.cut) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(x: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Each measure in robust units, and how far it is from the middle: too little and too much are both told apart."""
    z = np.clip((x - middle) / scale, -8, 8)
    return np.hstack([z, np.abs(z)])


def fit(x: np.ndarray, y: np.ndarray, seed: int = 8) -> Ranking:
    empty = Ranking(np.zeros(N_MEASURES), np.ones(N_MEASURES), np.zeros(2 * N_MEASURES), 0.0, 1.0)
    if len(x) == 0 or y.min() == y.max():
        return empty
    middle = np.median(x, axis=0)
    spread = np.percentile(x, 90, axis=0) - np.percentile(x, 10, axis=0)
    scale = np.where(spread > 1e-9, spread, np.maximum(x.std(axis=0), 1e-9))
    z = features(x, middle, scale)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    per = max(1, min(PAIRS_PER_BAD, PAIRS // len(bad)))
    losers = np.repeat(bad, per)
    winners = rng.choice(good, len(losers))
    flip = np.where(np.arange(len(losers)) % 2 == 0, 1.0, -1.0)  # both orders of a pair, so that the loss has two sides
    weights = logistic((z[winners] - z[losers]) * flip[:, None], (flip > 0).astype(float), L2, intercept=False)
    s = z @ weights
    share = len(bad) / len(x)
    best, cut = -1.0, 0.0
    for q in np.linspace(0.4 * share, min(1.6 * share, 1.0), 61):
        at = float(np.quantile(s, q))
        value = (s[good] >= at).mean() + (s[bad] < at).mean()
        if value > best:
            best, cut = value, at
    return Ranking(middle, scale, weights, cut, max(float(np.std(s)) / 4, 1e-6))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> Ranking:
    """Learn from the labelled rows outside the fold; only their measures, bounded in number, reach the driver."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([measures(t) for t in texts])

    rows = labelled_documents(docs, labels, "quality", folds, fold).select(measured(text_or_empty(F.col("text"))).alias("x"), "y")
    got = rows.toPandas()
    # the rows come in no order; sorting them makes the fit repeatable
    data = np.array(sorted([*x, float(y)] for x, y in zip(got["x"], got["y"])), dtype=float).reshape(-1, N_MEASURES + 1)
    return fit(data[:, :-1], (data[:, -1] > 0).astype(int))


def score_quality(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.3 on) to every row."""

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([measures(t) for t in texts], dtype=float).reshape(-1, N_MEASURES)))

    return docs.withColumn("score", scored(text_or_empty(F.col(text)))).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    own = docs.select("doc_id", "text")
    out = score_quality(own, train(own, labels, folds, fold))
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")
