"""Promotion of the best recent candidate into the configuration table."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.operators import config
from gleanery.operators.promotion import best_candidate, latest_batch
from gleanery.sources import tables

NO_ACTION = "no_action"
PROMOTED = "promoted"


def seed_config(spark: SparkSession, name: str, default: dict) -> bool:
    """Create the configuration table and its first row if missing; true when it seeded."""
    tables.ensure_table(spark, name, schemas.PRODUCTION_CONFIG)
    if not tables.is_empty(tables.scan(spark, name)):
        return False
    row = [default.get(f.name) for f in schemas.PRODUCTION_CONFIG]
    first = tables.local_rows(spark, [row], schemas.PRODUCTION_CONFIG)
    tables.append(first.withColumn("updated_at", F.current_timestamp()), name)
    return True


def promote_embedding(
    spark: SparkSession, results: str, config_table: str, current_score: float,
    updated_by: str = "embedding promotion",
) -> tuple[str, float]:
    """Write a new configuration when the newest batch's best hit rate beats the current one.

    Returns the outcome and the score in force afterwards.
    """
    return _promote(
        spark, results, config_table, current_score, "hit_rate_at_5",
        {"model": "embedding_model_name", "model_path": "embedding_model_path",
         "embedding_dim": "embedding_dimension"},
        updated_by,
    )


def promote_generation(
    spark: SparkSession, results: str, config_table: str, current_score: float,
    updated_by: str = "generation promotion",
) -> tuple[str, float]:
    """The same for generation models, by composite score."""
    return _promote(
        spark, results, config_table, current_score, "composite_score",
        {"model": "generation_model_name"}, updated_by,
    )


def _promote(spark, results, config_table, current_score, score, fields, updated_by):
    newest = latest_batch(tables.scan(spark, results))
    best = best_candidate(newest, score).select(*fields, score).head()
    if best is None or not best[score] > current_score:
        return NO_ACTION, current_score
    updates = {target: best[column] for column, target in fields.items()}
    history = tables.scan(spark, config_table)
    tables.append(config.next_version(history, updates, updated_by), config_table)
    return PROMOTED, best[score]


def rollback(spark: SparkSession, config_table: str, version: int) -> int:
    """Append an old version as the newest; returns the new version number."""
    history = tables.scan(spark, config_table)
    tables.append(config.rollback_to(history, version), config_table)
    return config.latest(tables.scan(spark, config_table)).head()[config.VERSION]
