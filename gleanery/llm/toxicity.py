"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, texts of any kind the unlabelled ones. The risk of
calling unlabelled texts toxic is corrected by the share of toxic ones among them (the
class prior), and where the corrected part turns negative, which means overfitting, the
gradient is turned round. Several classifiers, each on its own unlabelled texts, vote.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import BoundedCache, held_out, plain_words
from gleanery.llm.features import Adam, bucket, column_sums, labelled_sample, row_sums, sparse, trained

WIDTH = 1 << 20
POSITIVES = 4000  # confirmed texts a classifier is trained on, about
UNLABELLED = 6000  # unlabelled texts of each classifier, about
BAGS = 3
ROUNDS = 300
CUT = 0.7
SEED = 11
SPARSITY = 1e-3  # how fast weights that the risk does not need shrink to 0
_GRAMS = (5, 6)
_BEGINNINGS = range(4, 8)


def word_features(word: bytes) -> tuple[int, ...]:
    """A word, its beginnings and its character runs, hashed."""
    marked = b"^" + word + b"$"
    grams = {marked}
    for size in _GRAMS:
        grams.update(marked[i : i + size] for i in range(len(marked) - size + 1))
    grams.update(marked[:size] for size in _BEGINNINGS)
    return tuple(sorted({bucket(g, WIDTH) for g in grams}))


def own_words(text: str | None) -> set[bytes]:
    """The distinct words of a text in lower case."""
    return set(plain_words(text.lower())) if text else set()


@dataclass
class Classifier:
    """Weights of the features that matter, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _screen(rows: list[np.ndarray], positive: np.ndarray, width: int) -> np.ndarray:
    """Features that are clearly more, or less, usual among positives than elsewhere."""
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    in_p, in_u = np.zeros(width, np.int32), np.zeros(width, np.int32)
    for row, flag in zip(rows, positive):
        (in_p if flag else in_u)[row] += 1  # a row has a feature once
    pooled = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    return np.flatnonzero((np.abs(z) > 3.5) & (in_p + in_u >= 3))


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, prior: float, width: int = WIDTH,
             rounds: int = ROUNDS, rate: float = 0.1, ridge: float = 1e-4,
             sparsity: float = SPARSITY) -> Classifier:
    """Logistic model with the least non-negative positive-unlabelled risk.

    ``rows`` hold feature numbers, ``positive`` marks the confirmed ones, the others are
    unlabelled; ``prior`` is the share of positives among those.
    """
    chosen = _screen(rows, positive, width)
    place = np.full(width, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    found = (place[row] for row in rows)
    features, starts = sparse([own[own >= 0] for own in found])
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    weights, bias = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    adam = Adam(len(chosen) + 1, rate)
    for _ in range(rounds):
        score = row_sums(weights, features, starts) + bias
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        loss_negative = np.logaddexp(0, score)
        negative_risk = (loss_negative[~positive].sum() / n_u
                         - prior * loss_negative[positive].sum() / n_p)
        # Slopes of the risk on positives, and of the corrected risk on negatives.
        as_positive = np.where(positive, prior * (p - 1) / n_p, 0.0)
        as_negative = np.where(positive, -prior * p / n_p, p / n_u)
        slope = as_positive + as_negative if negative_risk >= 0 else -as_negative
        gradient = np.r_[column_sums(slope, features, starts, len(chosen)) + ridge * weights,
                         slope.sum()]
        step = adam.step(gradient)
        weights -= step[:-1]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * sparsity, 0.0)
        bias -= step[-1]
    return Classifier(chosen, weights, bias)


class Model:
    """Classifiers that score a text together."""

    def __init__(self, classifiers: list[Classifier]):
        self.bias = float(np.mean([c.bias for c in classifiers])) if classifiers else 0.0
        table: dict[int, float] = {}
        for c in classifiers:
            for f, w in zip(c.features.tolist(), c.weights.tolist()):
                table[f] = table.get(f, 0.0) + w / len(classifiers)
        self.table = {f: w for f, w in table.items() if abs(w) > 1e-4}
        self.known = bool(classifiers)
        self._words: BoundedCache | None = None

    def __getstate__(self):
        return self.bias, self.table, self.known

    def __setstate__(self, state):
        self.bias, self.table, self.known = state
        self._words = None

    def score(self, text: str | None) -> float:
        """Chance that a text is toxic; 0 where nothing was learnt."""
        if not self.known:
            return 0.0
        if self._words is None:
            has = self.table.__contains__
            self._words = BoundedCache(lambda w: tuple(filter(has, word_features(w))), 200_000)
        found = set()
        for word in own_words(text):
            own = self._words[word]
            if own:
                found.update(own)
        total = self.bias + sum(self.table[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _fit_bag(bag: int, texts: list[str], labels: pd.Series, prior: float) -> pd.DataFrame:
    # As bytes, features take little memory and are joined quickly.
    words = BoundedCache(lambda w: np.array(word_features(w), np.int32).tobytes(), 200_000)
    joined = (b"".join(map(words.__getitem__, own_words(t))) for t in texts)
    rows = [np.unique(np.frombuffer(own, np.int32)) for own in joined]
    model = fit_nnpu(rows, labels.notna().to_numpy(), prior)
    return pd.DataFrame([{"bag": bag, "features": model.features.tolist(),
                          "weights": model.weights.tolist(), "bias": model.bias}])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None,
          positives: int = POSITIVES, unlabelled: int = UNLABELLED, bags: int = BAGS,
          seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Model:
    """Trains on the fold that is not held out, on samples of the stated sizes.

    ``prior`` is the share of toxic texts; without it, that among the labelled texts of
    the fold. Without any confirmed toxic text the model scores everything 0.
    """
    known = F.col(label).isNotNull() & F.col(doc_id).isNotNull()
    fold = labels.where(known & ~held_out(F.col(doc_id)))
    share, count = fold.agg(F.avg((F.col(label) > 0).cast("double")),
                            F.sum((F.col(label) > 0).cast("long"))).first()
    if not count:
        return Model([])
    share = min(0.9, max(1e-3, share if prior is None else prior))
    toxic = labels.where(F.col(label) > 0)
    sample = labelled_sample(docs, toxic, label, positives, unlabelled, bags, seed, doc_id, text)
    rows = trained(sample, lambda bag, texts, marks: _fit_bag(bag, texts, marks, share),
                   "bag int, features array<long>, weights array<double>, bias double")
    return Model([
        Classifier(np.array(r.features, np.int64), np.array(r.weights), r.bias)
        for r in sorted(rows, key=lambda r: r.bag)
    ])


def scorer(docs: DataFrame, model: Model):
    """Column function: the model's score of a text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t.as_py()) for t in text], pa.float64())

    return score


def scored(docs: DataFrame, model: Model, cut: float = CUT, doc_id: str = "doc_id",
           text: str | Column = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; null texts count as empty."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
        scorer(docs, model)(text).alias("score"),
    ).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, cut: float = CUT, text: str = "text") -> DataFrame:
    """The documents that score below the cut, with all their columns."""
    return docs.where(scorer(docs, model)(text) < cut)
