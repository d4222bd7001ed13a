"""Toxicity by weak supervision (operator 5).

Voters say toxic, harmless or nothing of a text: a small seed lexicon, terms and word beginnings
mined from the labelled rows (a term must beat the number of terms tried), and
patterns over their hits. A generative label model estimates by expectation
maximisation each voter's rates given the hidden label, and the
correlations between voters given it, by which voters that repeat one another are
discounted; labels of the learning rows are one more voter. A logistic classifier over the votes is trained on the posterior labels.

Labels, language, source and id are never inputs of a score.

Defined results: a null text counts as empty and is scored like any text;
without labels the seed lexicon votes alone; a row without an id is never learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ._common import text_or_empty
from ._learning import held_out, labelled_documents, logistic

CUT, MIN_SUPPORT, MAX_TERMS, L2 = 0.3, 4, 400, 0.05
#: Our own seeds, common insults in four languages.
SEED = ("idiot", "moron", "stupid", "trash", "scum", "loser", "pathetic", "disgusting", "dummkopf", "abschaum", "crétin", "ordure", "imbécil", "basura")
_WORD = re.compile(r"[^\W\d_]+")
_BEGIN = 5
PATTERNS = ("one_hit", "two_hits", "three_kinds", "dense_hits", "seed_hit", "no_hit")


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def mine(rows: DataFrame) -> list[str]:
    """Words and word beginnings (``abcde*``) that tell toxic texts, by a likelihood ratio above that of the luckiest of all terms tried; at most ``MAX_TERMS``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pos, neg = Counter(), Counter()
            for text, y in zip(batch["text"], batch["y"]):
                kinds = set(terms(text))
                (pos if y else neg).update(kinds | {f"{w[:_BEGIN]}*" for w in kinds if len(w) > _BEGIN})
            names = [*pos, *(t for t in neg if t not in pos)]
            yield pd.DataFrame({"term": names, "a": [pos[t] for t in names], "b": [neg[t] for t in names]})

    sizes = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    p, n = int(sizes["p"]), int(sizes["n"]) - int(sizes["p"])
    if not p or not n:
        return []
    per = rows.select(text_or_empty(F.col("text")).alias("text"), "y").mapInPandas(count, "term string, a long, b long")
    total = per.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= MIN_SUPPORT)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    rate = (a + b) / (p + n)
    part = lambda k, of, share: F.when(k > 0, k * F.log(k / (of * share))).otherwise(0.0)
    gain = 2 * (part(a, F.lit(p), rate) + part(b, F.lit(n), rate))
    lean = (a / p) / (a / p + b / n)  # share of toxic among its texts if both kinds were as frequent
    scored = total.withColumn("gain", gain).withColumn("lean", lean).where("lean > 0.9 AND a >= 3")
    tried = total.count()
    # first the bar of the luckiest of all; then, as so many are real, the one that lets in about one lucky term for sixty of those
    bar = 2 * math.log(max(tried, 2))
    sure = scored.where(F.col("gain") >= bar).count()
    bar = min(bar, bar - 2 * math.log(max(sure, 1)) + 4.6)
    best = scored.where(F.col("gain") >= bar).orderBy(F.desc("gain"), "term").limit(MAX_TERMS)
    return [r["term"] for r in best.collect()]


@dataclass(frozen=True)
class Voters:
    mined: tuple[str, ...]

    def __post_init__(self) -> None:
        names = tuple(dict.fromkeys([*SEED, *self.mined]))
        object.__setattr__(self, "names", names)
        object.__setattr__(self, "place", {t: i for i, t in enumerate(names)})
        object.__setattr__(self, "seeds", frozenset(SEED))

    @property
    def width(self) -> int:
        return len(self.names) + len(PATTERNS)

    def votes(self, text: str) -> np.ndarray:
        """1: toxic, -1: harmless, 0: nothing."""
        place, out = self.place, np.zeros(self.width, np.int8)
        words = terms(text)
        counts = Counter(words)
        hit_words = kinds = seeds = 0
        for w, k in counts.items():
            at, begin = place.get(w), place.get(f"{w[:_BEGIN]}*") if len(w) > _BEGIN else None
            if at is not None:
                out[at] = 1
            if begin is not None:
                out[begin] = 1
            if at is not None or begin is not None:
                hit_words += k
                kinds += 1
                seeds += w in self.seeds
        n = len(self.names)
        out[n] = hit_words >= 1
        out[n + 1] = hit_words >= 2
        out[n + 2] = kinds >= 3
        out[n + 3] = 100 * hit_words >= len(words) > 0
        out[n + 4] = seeds >= 1
        out[n + 5] = -1 if hit_words == 0 else 0
        return out


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of the hidden label for each row. ``gold`` is 1, 0 or -1 (unknown).

    Rates P(vote | label) of every voter, with the labels as a voter that errs once in fifty, by EM; after each
    round the votes' correlations given the label set how much each voter counts: one over the sum of its
    correlations with all voters, itself included.
    """
    n, m = votes.shape
    if not n:
        return np.zeros(0)
    known = gold >= 0
    post = np.where(known, np.where(gold == 1, 0.98, 0.02), np.clip(0.1 + 0.2 * (votes > 0).sum(axis=1), 0.02, 0.9))
    kinds = [(votes == v).astype(float) for v in (-1, 0, 1)]
    signed = votes.astype(float)
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        log_odds = np.full(n, math.log(prior / (1 - prior)))
        # correlations given the label: of what is left of a vote after its mean under the posterior
        mean_1 = post @ signed / max(post.sum(), 1e-9)
        mean_0 = (1 - post) @ signed / max((1 - post).sum(), 1e-9)
        rest = signed - post[:, None] * mean_1 - (1 - post)[:, None] * mean_0
        norm = np.sqrt((rest * rest).sum(axis=0))
        rest = rest / np.where(norm > 1e-9, norm, 1.0)
        alike = np.clip(rest.T @ rest, 0, 1)
        alike[alike < 0.1] = 0
        np.fill_diagonal(alike, 1)
        count = 1 / alike.sum(axis=1)
        for k in kinds:
            rate_1 = (post @ k + 0.5) / (post.sum() + 1.5)
            rate_0 = ((1 - post) @ k + 0.5) / ((1 - post).sum() + 1.5)
            log_odds += k @ (count * np.log(rate_1 / rate_0))
        log_odds += np.where(known, np.where(gold == 1, 1, -1) * math.log(0.98 / 0.02), 0.0)
        was, post = post, 1 / (1 + np.exp(-np.clip(log_odds, -40, 40)))
        if np.abs(post - was).max() < 1e-6:
            break
    return post


@dataclass(frozen=True)
class Classifier:
    voters: Voters
    weights: np.ndarray

    def score(self, votes: np.ndarray) -> np.ndarray:
        z = votes @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> Classifier:
    """Learn from the labelled rows outside the fold; only their votes, bounded in number, reach the driver."""
    rows = labelled_documents(docs, labels, "toxic", folds, fold).persist()
    try:
        voters = Voters(tuple(mine(rows)))

        def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"votes": [voters.votes(t or "").tobytes() for t in batch["text"]], "y": batch["y"]})

        got = sorted((bytes(r["votes"]), r["y"]) for r in rows.mapInPandas(vote, "votes binary, y int").collect())
    finally:
        rows.unpersist()
    votes = np.frombuffer(b"".join(v for v, _ in got), np.int8).reshape(-1, voters.width)
    gold = np.array([int(y > 0) for _, y in got])
    if len(got) == 0 or gold.min() == gold.max():
        n = len(voters.names)
        weights = np.zeros(voters.width + 1)
        weights[n + 4], weights[-1] = 4.0, -3.0  # the seed lexicon alone
        return Classifier(voters, weights)
    return Classifier(voters, logistic(votes.astype(float), label_model(votes, gold), L2))


def score_toxicity(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.3 on) to every row."""

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            votes = np.array([model.voters.votes(t) for t in texts], dtype=float).reshape(-1, model.voters.width)
            yield pd.Series(model.score(votes))

    return docs.withColumn("score", scored(text_or_empty(F.col(text)))).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    own = docs.select("doc_id", "text")
    out = score_toxicity(own, train(own, labels, folds, fold))
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")
