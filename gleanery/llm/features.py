"""Hashed text features and bounded training samples for the text classifiers."""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import held_out, share_below


BAG_BYTES = 128 << 20  # text that one classifier is trained on, about


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, positives: int, others: int,
                    bags: int, seed: int, doc_id: str = "doc_id", text: str = "text",
                    only_labelled: bool = False) -> DataFrame:
    """``bag, text, label`` rows to train ``bags`` classifiers on, of the training fold.

    About ``positives`` rows labelled 1 or more go to every bag and about ``others`` rows
    of the rest to each one. The rest are documents of any or no label, with a null label;
    with ``only_labelled`` they are those labelled 0, all labels are kept, and ``weight`` is
    how many labelled rows a drawn one stands for. The bounds
    hold on average: rows are drawn by a hash of their id. Where texts are so long that a
    bag of that many would exceed ``BAG_BYTES``, all bounds shrink alike. An id labelled
    twice has its highest label.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    fold = rows.where(~held_out(F.col("id")))
    size = fold.agg(F.count("*"), F.avg(F.octet_length("text"))).first()
    shrink = min(1.0, BAG_BYTES / max(1.0, (size[1] or 0.0) * (positives + others)))
    positives, others = max(1, int(positives * shrink)), max(1, int(others * shrink))
    marks = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("label").alias("label"))
    )
    counts = marks.agg(F.count("*"), F.count(F.when(F.col("label") > 0, 1))).first()
    drawn = marks.where((F.col("label") > 0) & share_below(counts[1], positives, F.lit(seed), F.col("id")))
    rest = bags * others
    if only_labelled:
        zero = marks.where((F.col("label") == 0)
                           & share_below(counts[0] - counts[1], rest, F.lit(seed), F.col("id")))
        drawn = drawn.union(zero)
    # At most about positives + bags * others pairs of numbers.
    few = F.broadcast(drawn)
    every = F.sequence(F.lit(0), F.lit(bags - 1))
    one = F.array(F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(bags)).cast("int"))
    known = rows.join(few, "id").select(
        F.explode(F.when(F.col("label") > 0, every).otherwise(one)).alias("bag"), "text", "label")
    if only_labelled:
        stands_for = F.when(F.col("label") > 0, max(1.0, counts[1] / positives)).otherwise(
            max(1.0, (counts[0] - counts[1]) / rest))
        return known.withColumn("weight", stands_for)
    free = fold.where(share_below(size[0], rest, F.lit(seed + 2), F.col("id"), F.col("text")))
    return known.union(free.select(F.explode(one).alias("bag"), "text",
                                   F.lit(None).cast("int").alias("label")))


def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows one after another, and where each row starts."""
    starts = np.cumsum([0] + [len(r) for r in rows])
    return (np.concatenate(rows) if rows else np.empty(0, np.int64)).astype(np.int64), starts


def row_sums(weights: np.ndarray, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the features' weights in every row."""
    total = np.concatenate([[0.0], np.cumsum(weights[features])])
    return total[starts[1:]] - total[starts[:-1]]


def column_sums(values: np.ndarray, features: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For every feature the sum of the values of the rows that have it."""
    return np.bincount(features, np.repeat(values, np.diff(starts)), minlength=width)


def bucket(feature: bytes, width: int) -> int:
    return zlib.crc32(feature) % width


class Adam:
    """Step sizes for full-batch gradients."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.999**self.t)
        return self.rate * m / (np.sqrt(v) + 1e-8)


def trained(sample: DataFrame, fit, schema: str) -> list:
    """One model per bag, each trained in a task of its own; only weights come back."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["text", "label"], ignore_index=True)
        weights = [part["weight"]] if "weight" in part else []
        return fit(int(part["bag"].iloc[0]), part["text"].tolist(), part["label"], *weights)

    return sample.groupBy("bag").applyInPandas(one, schema).collect()
