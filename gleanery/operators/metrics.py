"""Retrieval metrics from ranked answers."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import fixed_values as fixed


def hit_rate(rank: Column, k: int) -> Column:
    """Share of questions whose labelled chunk is ranked within k; a null rank is a miss."""
    return F.avg(F.when(rank <= k, 1.0).otherwise(0.0))


def mean_reciprocal_rank(rank: Column, k: int | None = None) -> Column:
    """Mean of 1/rank, counting only ranks within k, if it is given."""
    counts = rank.isNotNull() if k is None else rank <= k
    return F.avg(F.when(counts, 1.0 / rank).otherwise(0.0))


def metric_columns(rank: Column, k_values: Sequence[int]) -> list[Column]:
    columns = [F.count(F.lit(1)).alias("num_eval_pairs")]
    for k in k_values:
        columns.append(hit_rate(rank, k).alias(f"hit_rate_at_{k}"))
        columns.append(mean_reciprocal_rank(rank, k).alias(f"mrr_at_{k}"))
    return columns


def retrieval_metrics(
    labelled: DataFrame,
    ranked: DataFrame,
    by: Sequence[str] = (),
    question_id: str = "question_id",
    chunk_id: str = "chunk_id",
    correct: str = "correct_chunk_id",
    k_values: Sequence[int] = tuple(fixed.K_VALUES),
) -> DataFrame:
    """Hit rate and MRR at every k from one ranking, over all labelled questions.

    ``labelled`` has one row per (``by``, question); without questions every metric is
    null. A ``by`` column the ranking lacks belongs to the question alone.
    """
    keys = [*[c for c in by if c in ranked.columns], question_id]
    found = ranked.select(*keys, F.col(chunk_id).alias(correct), "rank")
    matched = labelled.select(*by, question_id, correct).join(found, [*keys, correct], "left")
    return matched.groupBy(*by).agg(*metric_columns(F.col("rank"), k_values))


def leaderboard(metrics: DataFrame, by: str = "hit_rate_at_5", decimals: int = 3) -> DataFrame:
    """Results summary, best first, scores rounded for reading."""
    scores = [c for c in metrics.columns if "_at_" in c]
    rounded = [F.round(c, decimals).alias(c) if c in scores else F.col(c) for c in metrics.columns]
    return metrics.orderBy(F.desc(by), F.asc("model")).select(*rounded)
