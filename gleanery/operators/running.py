"""Segmented prefix scans: running values per key that no single task has to hold.

A window sends a whole key to one task. That is right for ordinary keys, so only hot keys,
those with more rows than a task should take, go another way: their rows are range
partitioned by key and order, every partition computes its own running values, and what a
partition's last key brings along is combined, partition by partition, into one carry per
partition, which a second pass adds to that partition's rows. Every fold is associative, so
the cuts may lie anywhere, and neither one key nor one stretch of equal beginnings of its
order makes a task large.
"""

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery import session

# A key is hot above this many rows, in tables of any size. The hot keys are broadcast up
# to the second number and joined like any others beyond it.
HOT_ROWS = 1_000_000
BROADCAST_HOT_KEYS = 100_000
# Range partitions are cut from a sample, so they are planned at a fraction of that number.
FILL = 0.25


@dataclass(frozen=True)
class Fold:
    """A running value: ``value`` combined from the key's first row up to this one.

    ``how`` is sum, min, max, xor or last; ``last`` is the last value that is not null.
    """

    value: Column
    how: str


_OVER: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "min": F.min, "max": F.max, "xor": F.bit_xor,
    "last": lambda value: F.last(value, ignorenulls=True),
}
_JOIN: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: a + b, "min": F.least, "max": F.greatest,
    "xor": lambda a, b: a.bitwiseXOR(b), "last": lambda a, b: b,
}


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows.

    One aggregation over the key columns alone, written to the shared folder.
    """
    session.shared_root(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") > hot_rows).checkpoint().select(*keys)


def same_keys(keys: Sequence[str], prefix: str) -> Column:
    """Equality of the keys with their prefixed copies, nulls being equal."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    folds: dict[str, Fold],
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add (or replace) a column per fold, its running value per key in ascending ``order``.

    ``order`` should be unique within a key: rows that share a place may come in any
    order. Nulls come first. ``hot`` lists the keys that no task may take whole; by default
    they are measured, as those with more than ``hot_rows`` rows.
    """
    hot = hot_keys(df, keys, hot_rows) if hot is None else hot
    if hot.isEmpty():
        return _windowed(df, keys, order, folds)
    few = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    if few.count() <= BROADCAST_HOT_KEYS:
        few = F.broadcast(few)
    same = same_keys(keys, "_hot_")
    ordinary = _windowed(df.join(few, same, "left_anti"), keys, order, folds)
    apart = ranged_scan(df.join(few, same, "left_semi"), keys, order, folds, hot_rows)
    return ordinary.unionByName(apart)


def _windowed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], folds: dict[str, Fold]
) -> DataFrame:
    so_far = (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumns({n: _OVER[f.how](f.value).over(so_far) for n, f in folds.items()})


def ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int) -> DataFrame:
    """The rows range partitioned by key and order, with their partition in ``_part``.

    They are written to the shared folder, as partition numbers have to stay the same in
    both passes, also when an executor is lost between them.
    """
    session.shared_root(rows.sparkSession)
    rows = rows.checkpoint()
    parts = max(2, math.ceil(rows.count() / max(1, FILL * hot_rows)))
    placed = rows.repartitionByRange(parts, *keys, *order)
    return placed.withColumn("_part", F.spark_partition_id()).checkpoint()


def ranged_scan(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], folds: dict[str, Fold],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """:func:`prefix_scan` in two passes over range partitions of about ``hot_rows`` rows."""
    values = {f"_in_{n}": f.value for n, f in folds.items()}
    placed = ranged(rows.withColumns(values), keys, order, hot_rows)
    folded = {n: Fold(F.col(f"_in_{n}"), f.how) for n, f in folds.items()}
    local = _windowed(placed, ["_part", *keys], order, folded)

    # A partition passes on one row per key, and only its last key goes on in the next one.
    place = F.struct(*order)
    totals = placed.groupBy("_part", *keys).agg(*[
        (F.max_by(f.value, F.when(f.value.isNotNull(), place)) if f.how == "last"
         else _OVER[f.how](f.value)).alias(n)
        for n, f in folded.items()
    ])
    by_part = Window.partitionBy(*keys).orderBy("_part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        F.col("_part").alias("_to__part"),
        *[F.col(k).alias(f"_to_{k}") for k in keys],
        F.row_number().over(by_part).alias("_nth"),
        *[_OVER[f.how](F.col(n)).over(before).alias(f"_carry_{n}") for n, f in folded.items()],
    ).where("_nth > 1")  # at most one row per partition, the key it begins with
    joined = local.join(F.broadcast(carries), same_keys(["_part", *keys], "_to_"), "left")
    return joined.select(
        *[F.col(c) for c in rows.columns if c not in folds],
        *[
            F.when(F.col(f"_carry_{n}").isNull(), F.col(n))
            .when(F.col(n).isNull(), F.col(f"_carry_{n}"))
            .otherwise(_JOIN[f.how](F.col(f"_carry_{n}"), F.col(n))).alias(n)
            for n, f in folds.items()
        ],
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    number: str | None = None,
    weight: Column | None = None,
    carry: Sequence[str] = (),
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``number`` (1, 2, ... per key in ``order``, or the running sum of ``weight``)
    and fill each ``carry`` column with its last non-null value so far.

    See :func:`prefix_scan` for ``order`` and ``hot``.
    """
    folds = {c: Fold(F.col(c), "last") for c in carry}
    if number:
        ones = F.lit(1).cast("long")
        folds[number] = Fold(ones if weight is None else weight, "sum")
    filled = prefix_scan(df, keys, order, folds, hot, hot_rows)
    return filled.select(*df.columns, *([number] if number else []))
