"""Best candidate of recent results and the promotion decision."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery import fixed_values as fixed


def recent_results(
    history: DataFrame,
    n: int = fixed.RECENT_RESULTS,
    slot: Sequence[str] = (),
    tie: str = "model",
) -> DataFrame:
    """The n newest result rows, over all or per slot."""
    newest = [F.desc("evaluated_at"), F.asc(tie)]
    if not slot:
        return history.orderBy(*newest).limit(n)
    place = Window.partitionBy(*slot).orderBy(*newest)
    ranked = history.withColumn("_place", F.row_number().over(place))
    return ranked.where(F.col("_place") <= n).drop("_place")


def latest_batch(history: DataFrame, slot: Sequence[str] = ()) -> DataFrame:
    """All rows that share the newest evaluation time (per slot).

    Per slot the history is read once: tasks hand on only what is newest among their rows.
    """
    if slot:
        place = Window.partitionBy(*slot).orderBy(F.desc("evaluated_at"))
        ranked = history.where(F.col("evaluated_at").isNotNull()).withColumn(
            "_place", F.rank().over(place))
        return ranked.where(F.col("_place") == 1).drop("_place")
    newest = history.groupBy(*slot).agg(F.max("evaluated_at").alias("evaluated_at"))
    return history.join(newest, [*slot, "evaluated_at"], "left_semi")


def best_candidate(
    results: DataFrame, score: str, slot: Sequence[str] = (), tie: str = "model"
) -> DataFrame:
    """The row with the highest score; one without a number for it never wins, ties go to the
    first by ``tie``."""
    columns = [c for c in results.columns if c not in slot]
    scored = results.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    order = [F.desc(score), F.desc("evaluated_at"), F.asc(tie)]
    if not slot:
        return scored.orderBy(*order).limit(1)
    place = Window.partitionBy(*slot).orderBy(*order)
    return (
        scored.withColumn("_place", F.row_number().over(place))
        .where(F.col("_place") == 1)
        .select(*slot, *columns)
    )


def promotion_decisions(
    best: DataFrame, current: DataFrame, score: str, slot: Sequence[str]
) -> DataFrame:
    """Promote where the best candidate is strictly better than the current score.

    ``current`` is ``(slot, current_model, current_score)``, one row per slot. A slot
    without a current score counts as 0; one without candidates gets ``no_action``.
    """
    joined = current.join(best, list(slot), "full_outer")
    baseline = F.coalesce(F.col("current_score"), F.lit(0.0))
    promote = F.coalesce(F.col(score) > baseline, F.lit(False))
    return joined.select(
        *slot,
        F.when(promote, "promoted").otherwise("no_action").alias("decision"),
        F.when(promote, F.col("model")).otherwise(F.col("current_model")).alias("model"),
        F.when(promote, F.col(score)).otherwise(baseline).alias("score"),
    )
