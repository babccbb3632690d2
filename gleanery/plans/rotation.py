"""Jobs on the search term table: seed, add, pause or resume, plan the next runs, record them."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import schemas, session
from gleanery.operators import keys, rotation
from gleanery.sources import parted, tables


def _fresh_terms(spark: SparkSession, terms: Sequence[str], active: bool) -> DataFrame:
    rows = [(term, active, None, 0, None) for term in terms]
    return tables.local_rows(spark, rows, schemas.SEARCH_TERMS)


def seed_terms(
    spark: SparkSession, name: str, defaults: Sequence[str], parts: int | None = None
) -> bool:
    """Create the table and its default terms if missing or empty; true when it seeded.

    With ``parts`` a new table is kept in that many hash parts, and an update rewrites the
    parts of its terms alone.
    """
    if parts and not spark.catalog.tableExists(name):
        parted.ensure_parted(spark, name, schemas.SEARCH_TERMS, "term", parts)
    elif not parted.is_parted(spark, name):
        tables.ensure_table(spark, name, schemas.SEARCH_TERMS)
    if not tables.is_empty(_terms(spark, name)):
        return False
    _append(spark, _fresh_terms(spark, defaults, True), name)
    return True


def add_terms(spark: SparkSession, name: str, terms: Sequence[str], active: bool = True) -> None:
    """Add terms that are not there yet; known ones stay as they are."""
    fresh = _fresh_terms(spark, terms, active)
    _append(spark, keys.absent_rows(_terms(spark, name), fresh, "term"), name)


def set_active(spark: SparkSession, name: str, terms: Sequence[str], active: bool) -> None:
    """Pause or resume terms, keeping their history."""
    listed = tables.local_rows(
        spark, [(term,) for term in terms], schemas.SEARCH_TERMS[:1]
    )
    _update(spark, name, listed, lambda rows: keys.set_flag(rows, listed, "term", "active", active))


def plan_runs(
    spark: SparkSession,
    name: str,
    n: int,
    increment_days: int,
    today: Column | None = None,
) -> DataFrame:
    """The next n terms with the date window each has to search.

    The plan is written to the shared folder, so what is searched and what
    :func:`record_runs` marks are the same rows, whatever happens to the table between.
    """
    session.shared_root(spark)
    day = F.current_date() if today is None else today
    due = rotation.next_terms(_terms(spark, name), n)
    windows = rotation.backfill_window(due, day, increment_days)
    return windows.select("term", "mindate", "maxdate", "maxdate_iso", "caught_up").checkpoint()


def record_runs(
    spark: SparkSession, name: str, planned: DataFrame, run_at: Column | None = None
) -> None:
    """Advance the watermark of every planned term to the last date it searched."""
    runs = planned.select(
        "term",
        (F.current_timestamp() if run_at is None else run_at).alias("run_at"),
        F.col("maxdate_iso").cast("date").alias("searched_through"),
    )
    _update(spark, name, runs, lambda rows: rotation.mark_runs(rows, runs))


def _update(
    spark: SparkSession, name: str, updates: DataFrame, change: Callable[[DataFrame], DataFrame]
) -> None:
    """Rewrites the touched parts of a table in parts, any other table whole."""
    if parted.is_parted(spark, name):
        parted.update_touched(spark, name, updates, change)
    else:
        tables.swap(change(tables.scan(spark, name)), name)


def _terms(spark: SparkSession, name: str) -> DataFrame:
    whole = not parted.is_parted(spark, name)
    return tables.scan(spark, name) if whole else parted.parted_scan(spark, name)


def _append(spark: SparkSession, rows: DataFrame, name: str) -> None:
    if parted.is_parted(spark, name):
        parted.parted_append(rows, name)
    else:
        tables.append(rows, name)
