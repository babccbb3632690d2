"""Create or synchronise a search index table derived from the embeddings table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import session
from gleanery.operators import keys
from gleanery.sources import tables

KEY = "chunk_id"


def sync_index(
    spark: SparkSession, embeddings: str, index: str, dimension: int, model: str | None = None
) -> dict[str, int]:
    """Bring the index to the state of the embeddings; returns rows per kind of change.

    With ``model`` only its vectors are indexed; a table that holds several needs it.

    Vectors of another dimension are rejected and counted, they never enter the index.
    An index whose stored dimension differs is rebuilt. Only keys and digests are
    compared; the changes are written to the shared folder before they are applied.
    """
    session.shared_root(spark)
    stored = tables.scan(spark, embeddings)
    if model is not None:
        stored = stored.where(F.col("model") == model)
    fits, rejected = keys.split_by_dimension(stored, "embedding", dimension)
    counts = {"insert": 0, "update": 0, "delete": 0, "rejected": rejected.count()}
    current = _current(spark, index, dimension)
    if current is None:
        tables.overwrite(fits, index)
        counts["insert"] = tables.scan(spark, index).count()
        return counts
    changes = keys.snapshot_diff(current, fits, KEY).checkpoint()
    counts.update({r["change"]: r["n"] for r in
                   changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()})
    if any(counts[kind] for kind in ["update", "delete"]):
        tables.swap(keys.apply_changes(current, fits, changes, KEY), index)
    elif counts["insert"]:
        fresh = keys.broadcast_if_few(changes.select(KEY))
        tables.append(fits.join(fresh, KEY, "left_semi"), index)
    return counts


def _current(spark: SparkSession, index: str, dimension: int) -> DataFrame | None:
    if not spark.catalog.tableExists(index):
        return None
    stored = tables.scan(spark, index)
    sample = stored.select(F.size("embedding").alias("d")).head()
    return stored if sample is None or sample["d"] == dimension else None
