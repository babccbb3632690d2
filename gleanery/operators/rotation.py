"""Rotation of search terms and date-windowed backfill, for any number of terms at once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import fixed_values as fixed
from gleanery.operators.keys import keyed_update


def next_terms(terms: DataFrame, n: int = 1) -> DataFrame:
    """The n active terms that ran longest ago; terms that never ran come first."""
    return (
        terms.where(F.col("active"))
        .orderBy(F.asc_nulls_first("last_run_at"), F.asc("term"))
        .limit(n)
    )


def next_term(terms: DataFrame) -> dict:
    """The next term as a dict; an error when no term is active."""
    row = next_terms(terms, 1).select("term", "last_searched_through").head()
    if row is None:
        raise ValueError("no active search term: add one or resume a paused one")
    return row.asDict()


def backfill_window(
    terms: DataFrame,
    today: Column,
    increment_days: int,
    start: str = fixed.BACKFILL_START,
) -> DataFrame:
    """Add the next search window of every term.

    From the watermark (or ``start``) forward by ``increment_days``, capped at today.
    A term that has caught up searches today only.
    """
    low = F.coalesce(F.col("last_searched_through"), F.lit(start).cast("date"))
    return (
        terms.withColumn("_low", low)
        .withColumn("_high", F.least(F.date_add("_low", increment_days), today))
        .withColumn("mindate", F.date_format("_low", "yyyy/MM/dd"))
        .withColumn("maxdate", F.date_format("_high", "yyyy/MM/dd"))
        .withColumn("maxdate_iso", F.date_format("_high", "yyyy-MM-dd"))
        .withColumn("caught_up", F.col("_high") >= today)
        .drop("_low", "_high")
    )


def within_dates(
    df: DataFrame, day: str, mindate: str | None, maxdate: str | None, today: str
) -> DataFrame:
    """Rows of a date window, both ends included; no bound at all keeps every row.

    With one bound given the other defaults to the floor date or today. The bounds
    compare the stored column itself, so they reach the Parquet scan.
    """
    if mindate is None and maxdate is None:
        return df
    low = F.lit((mindate or fixed.SEARCH_WINDOW_FLOOR).replace("/", "-")).cast("date")
    high = F.lit((maxdate or today).replace("/", "-")).cast("date")
    kind = df.schema[day].dataType.simpleString()
    after = F.date_add(high, 1).cast(kind)
    return df.where((F.col(day) >= low.cast(kind)) & (F.col(day) < after))


def mark_runs(terms: DataFrame, runs: DataFrame) -> DataFrame:
    """Terms after runs ``(term, run_at, searched_through)`` were recorded.

    Runs are reduced to one row per term first: the newest gives time and watermark,
    their number is added to the counter.
    """
    newest = F.struct("run_at", "searched_through")
    per_term = runs.groupBy("term").agg(
        F.max("run_at").alias("run_at"),
        F.max_by("searched_through", newest).alias("searched_through"),
        F.count(F.lit(1)).cast("int").alias("runs"),
    )
    return keyed_update(
        terms,
        per_term,
        ["term"],
        {
            "last_run_at": F.col("u.run_at"),
            "run_count": F.col("t.run_count") + F.col("u.runs"),
            "last_searched_through": F.col("u.searched_through"),
        },
    )


def rotation_plan(
    terms: DataFrame, today: Column, run_at: Column, increment_days: int, n: int
) -> DataFrame:
    """The next n terms with their windows and the state after they ran."""
    planned = backfill_window(next_terms(terms, n), today, increment_days)
    return planned.select(
        "term",
        "mindate",
        "maxdate",
        "caught_up",
        run_at.alias("last_run_at"),
        (F.col("run_count") + 1).alias("run_count"),
        F.col("maxdate_iso").cast("date").alias("last_searched_through"),
    )


def advance_watermarks(
    terms: DataFrame, today: Column, run_at: Column, increment_days: int
) -> DataFrame:
    """All active terms after one run each; paused terms stay as they are."""
    windows = backfill_window(terms, today, increment_days)
    runs = F.coalesce(F.col("active"), F.lit(False))
    state = {
        "last_run_at": run_at,
        "run_count": F.col("run_count") + 1,
        "last_searched_through": F.col("maxdate_iso").cast("date"),
    }
    return windows.select(
        *[F.when(runs, state[c]).otherwise(F.col(c)).alias(c) if c in state else F.col(c)
          for c in terms.columns]
    )
