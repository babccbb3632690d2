"""Versioned configuration: latest version, carry-forward and rollback, per slot."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.running import running
from gleanery.schemas import CONFIG_FIELDS

VERSION = "config_version"


def latest(history: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The row with the highest version, per slot when ``keys`` are given."""
    others = [c for c in history.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.col(VERSION)).alias("row")
    return history.groupBy(*keys).agg(newest).select(*keys, "row.*").where(
        F.col(VERSION).isNotNull()
    )


def next_version(
    history: DataFrame,
    updates: dict[str, object],
    updated_by: str,
    updated_at: Column | None = None,
) -> DataFrame:
    """One new row: latest version + 1, given fields replaced, the others carried forward."""
    unknown = set(updates) - set(CONFIG_FIELDS)
    if unknown:
        raise ValueError(f"not configuration fields: {sorted(unknown)}")
    kinds = {f.name: f.dataType for f in history.schema}
    replaced = {name: F.lit(value).cast(kinds[name]) for name, value in updates.items()}
    replaced[VERSION] = F.col(VERSION) + 1
    replaced["updated_by"] = F.lit(updated_by)
    replaced["updated_at"] = F.current_timestamp() if updated_at is None else updated_at
    return latest(history).select(
        *[replaced.get(c, F.col(c)).alias(c) for c in history.columns]
    )


def rollback_to(
    history: DataFrame, version: int, updated_at: Column | None = None
) -> DataFrame:
    """An old version re-applied as a new one; an error when it does not exist."""
    row = history.where(F.col(VERSION) == version).select(*CONFIG_FIELDS).head()
    if row is None:
        raise ValueError(f"config_version {version} not found")
    return next_version(history, row.asDict(), f"rollback_to_v{version}", updated_at)


def carry_forward(
    updates: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str] = tuple(CONFIG_FIELDS),
) -> DataFrame:
    """A log of sparse updates to full versions: number them and fill unset fields.

    Version n holds, per field, the last value set up to the n-th update of the slot.
    """
    filled = running(updates, keys, order, number=VERSION, carry=fields)
    return filled.withColumn(VERSION, F.col(VERSION).cast("int"))


def rollbacks(
    history: DataFrame,
    requests: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str] = tuple(CONFIG_FIELDS),
) -> DataFrame:
    """New rows for many rollback requests ``(keys, to_version)``, one request per slot.

    ``found`` is false, and the fields null, where the slot lacks the version.
    """
    wanted = F.when(F.col(VERSION) == F.col("to_version"), F.struct(*fields))
    matched = history.join(requests, list(keys)).groupBy(*keys, "to_version").agg(
        (F.max(VERSION) + 1).alias(VERSION), F.max(wanted).alias("row")
    )
    return matched.select(
        *keys,
        VERSION,
        F.concat(F.lit("rollback_to_v"), F.col("to_version")).alias("updated_by"),
        F.col("row").isNotNull().alias("found"),
        *[F.col(f"row.{f}").alias(f) for f in fields],
    )
