"""Text quality by ordinal cumulative-link regression on graded ratings.

One set of hashed-text weights gives a text a place on a line; ordered thresholds part
the line into grades. Both are fitted to a bounded sample of ratings in one task. A text
gets its expected grade and the chance of reaching a grade, by which texts are selected.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import BoundedCache, held_out
from gleanery.llm.features import Adam, bucket, labelled_sample, sparse, trained

WIDTH = 1 << 18
HIGHER = 6000  # rated texts above the lowest grade that are learnt from, about
LOWEST = 6000  # and of the lowest grade
ROUNDS = 250
CUT = 0.5
SEED = 5
SCHEMA = "score double, expected_grade double, tail_probability double"

_PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n+")
_SHAPES = 64  # the first features are the text's measures in steps


def _shape(piece: str) -> bytes:
    """What a piece is like: its first kind of character and its length."""
    kind = (b"a" if piece.isalpha() else b"0" if piece.isdigit()
            else b"/" if piece.isspace() else b"#")
    return kind + b"%d" % min(len(piece), 9)


def piece_features(piece: str) -> tuple[int, int]:
    """A piece itself and its shape, hashed."""
    room = WIDTH - _SHAPES
    return (_SHAPES + bucket(piece.lower().encode(), room),
            _SHAPES + bucket(b"shape " + _shape(piece), room))


def _steps(text: str, pieces: int, distinct: int, marks: int) -> list[int]:
    """Length, share of marks and variety of a text, each as one of eight features."""
    length = min(7, pieces.bit_length() // 2)
    noise = min(7, int(16 * marks / max(1, pieces)))
    variety = min(7, int(8 * distinct / max(1, pieces)))
    lines = min(7, int(64 * text.count("\n") / max(1, pieces)))
    return [length, 8 + noise, 16 + variety, 24 + lines]


class Weigher:
    """Sparse rows of a text: feature numbers and values."""

    def __init__(self):
        self.known = BoundedCache(piece_features, 200_000)

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Features with the logarithm of their rates; no features for an empty text."""
        pieces = _PIECE.findall(text or "")
        if not pieces:
            return np.empty(0, np.int64), np.empty(0)
        counts: dict[str, int] = {}
        for p in pieces:
            counts[p] = counts.get(p, 0) + 1
        features, sizes = [], []
        marks = 0
        for p, n in counts.items():
            features += self.known[p]
            sizes += (n, n)
            if not p.isalnum() and not p.isspace():
                marks += n
        found, where = np.unique(np.array(features, np.int64), return_inverse=True)
        rate = np.bincount(where, np.array(sizes, float)) / len(pieces)
        measures = np.array(_steps(text, len(pieces), len(counts), marks), np.int64)
        return (np.concatenate([measures, found]),
                np.concatenate([np.ones(len(measures)), np.log1p(100 * rate)]))


class OrdinalModel:
    """Weights and ordered thresholds; ``grades`` are the ratings from low to high."""

    def __init__(self, grades: list[float], weights: dict[int, float], thresholds: list[float]):
        self.grades = grades
        self.weights = weights
        self.thresholds = np.array(thresholds, float)
        self._weigher: Weigher | None = None

    def __getstate__(self):
        return self.grades, self.weights, self.thresholds.tolist()

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: str | None, tail: float | None = None) -> tuple[float, float, float]:
        """Place on the line, expected grade, and the chance of the grade ``tail`` or more
        (the highest one if not given)."""
        if self._weigher is None:
            self._weigher = Weigher()
            self._dense = np.zeros(WIDTH)
            self._dense[list(self.weights)] = list(self.weights.values())
        features, values = self._weigher.row(text)
        place = float(self._dense[features] @ values)
        if len(self.grades) < 2:
            only = self.grades[0] if self.grades else 0.0
            return place, only, float(bool(self.grades) and (tail is None or only >= tail))
        above = 1 / (1 + np.exp(-np.clip(place - self.thresholds, -30, 30)))
        gaps = np.diff(self.grades)
        expected = self.grades[0] + float(gaps @ above)
        edge = self.grades[-1] if tail is None else tail
        at = int(np.searchsorted(self.grades, edge))
        chance = 1.0 if at == 0 else 0.0 if at == len(self.grades) else float(above[at - 1])
        return place, expected, chance


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], ratings: np.ndarray,
                rounds: int = ROUNDS, rate: float = 0.05, ridge: float = 2e-4,
                stands_for: np.ndarray | None = None) -> OrdinalModel:
    """Least penalised negative log-likelihood of the cumulative logit model, in which a row
    counts as often as the number of ratings it stands for (1 if not given).

    Every threshold is a yes-or-no question "above this grade?" with the same weights; the
    thresholds stay in order as a first one and positive gaps.
    """
    grades = np.unique(ratings)
    if len(grades) < 2:
        return OrdinalModel(grades.tolist(), {}, [])
    level = np.searchsorted(grades, ratings)
    features, starts = sparse([f for f, _ in rows])
    values = np.concatenate([v for _, v in rows]) if rows else np.empty(0)
    met = np.bincount(features, minlength=WIDTH)
    used = np.flatnonzero(met >= min(3, max(1, len(rows) // 20)))
    place = np.full(WIDTH, len(used))
    place[used] = np.arange(len(used))
    features = place[features]
    many = len(grades) - 1
    n = len(rows)
    share = np.ones(n) if stands_for is None else np.asarray(stands_for, float)
    share = share / share.sum()
    rates = np.array([np.clip(share @ (level > k), 1e-3, 1 - 1e-3) for k in range(many)])
    first = -np.log(rates / (1 - rates))
    start = np.r_[first[0], np.log(np.expm1(np.maximum(np.diff(first), 1e-3)))]
    weights, shape = np.zeros(len(used) + 1), start
    adam = Adam(len(weights) + many, rate)
    owner = np.repeat(np.arange(n), np.diff(starts))
    for _ in range(rounds):
        line = np.bincount(owner, weights[features] * values, minlength=n)
        gaps = np.logaddexp(0, shape[1:])
        cuts = np.cumsum(np.r_[shape[0], gaps])
        # Chances of being above each cut, closed by certainty and impossibility.
        above = 1 / (1 + np.exp(-np.clip(line[:, None] - cuts, -30, 30)))
        full = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        slope = full * (1 - full)
        at = np.arange(n)
        chance = np.maximum(full[at, level] - full[at, level + 1], 1e-12)
        d_line = -(slope[at, level] - slope[at, level + 1]) / chance * share
        d_cut = np.zeros((n, many + 2))
        d_cut[at, level] += slope[at, level] / chance * share
        d_cut[at, level + 1] -= slope[at, level + 1] / chance * share
        by_cut = d_cut[:, 1:-1].sum(axis=0)
        tail = np.cumsum(by_cut[::-1])[::-1]
        d_shape = np.r_[tail[0], tail[1:] / (1 + np.exp(-shape[1:]))]
        d_weights = np.bincount(features, d_line[owner] * values, minlength=len(weights))
        d_weights += ridge * weights
        d_weights[-1] = 0.0
        step = adam.step(np.r_[d_weights, d_shape])
        weights = weights - step[: len(weights)]
        shape = shape - step[len(weights) :]
    cuts = np.cumsum(np.r_[shape[0], np.logaddexp(0, shape[1:])])
    known = {int(f): float(w) for f, w in zip(used, weights[:-1]) if abs(w) > 1e-5}
    return OrdinalModel(grades.tolist(), known, cuts.tolist())


def _fit_bag(bag: int, texts: list[str], labels: pd.Series, stands_for: pd.Series) -> pd.DataFrame:
    weigher = Weigher()
    model = fit_ordinal([weigher.row(t) for t in texts], labels.to_numpy(float),
                        stands_for=stands_for.to_numpy(float))
    return pd.DataFrame([{"grades": model.grades, "features": list(model.weights),
                          "weights": list(model.weights.values()),
                          "thresholds": model.thresholds.tolist()}])


def train(docs: DataFrame, labels: DataFrame, higher: int = HIGHER, lowest: int = LOWEST,
          seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality") -> OrdinalModel:
    """Fits whole-number ratings (0 the lowest grade) of the fold that is not held out, on
    samples of the stated sizes. A drawn rating counts for those it stands for, so the chances
    do not depend on the sizes. Ratings that are null or below 0 are left out. Without ratings
    the model gives every text grade 0."""
    sample = labelled_sample(docs, labels, label, higher, lowest, 1, seed, doc_id, text, True)
    rows = trained(sample, _fit_bag, "grades array<double>, features array<long>, "
                   "weights array<double>, thresholds array<double>")
    if not rows:
        return OrdinalModel([], {}, [])
    found = rows[0]
    return OrdinalModel(found.grades, dict(zip(found.features, found.weights)), found.thresholds)


def rated(docs: DataFrame, model: OrdinalModel, tail: float | None = None, cut: float = CUT,
          doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """``doc_id, held_out, score, expected_grade, tail_probability, selected`` of every
    document; selected are those that reach the grade ``tail`` with the chance ``cut``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(SCHEMA)
    def rate(texts: pa.Array) -> pa.Array:
        found = [shared.value.score(t.as_py(), tail) for t in texts]
        columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(3)]
        return pa.StructArray.from_arrays(
            columns, ["score", "expected_grade", "tail_probability"])

    return (
        docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
                    rate(text).alias("r"))
        .select("doc_id", "held_out", "r.*")
        .withColumn("selected", F.col("tail_probability") >= cut)
    )
