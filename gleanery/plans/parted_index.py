"""An index in hash parts that is synchronised part by part.

Beside the index stands a digest of every part: the number of its rows and the sum of their
hashes. A run forms the same digests of the source in one scan, compares the two short lists,
and reads and rewrites only the parts that differ. The index itself is never hashed, and one
changed row costs one part. A run that was interrupted leaves digests that do not match, so
the next one does those parts again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import keys
from gleanery.sources import parted, tables


def _digests(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """``part, rows, total`` of rows that are one per key."""
    part = parted.part_of(key, parts)
    line = F.xxhash64(key, "_digest").cast("decimal(38,0)")
    return keys.with_digest(rows, key).groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(line).alias("total"))


def _one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a key, of those that share one the row with the least digest."""
    keyed = keys.with_digest(rows.where(F.col(key).isNotNull()), key)
    return keys.first_per_key(keyed, [key], [F.asc("_digest")]).drop("_digest")


def sync_parts(
    spark: SparkSession, source: DataFrame, index: str, key: str, parts: int = 256
) -> dict:
    """Brings the index to the state of the source; returns rows per kind of change, the
    rejected rows (``keyless, repeated``) and the ``parts`` that were rewritten.
    """
    parted.ensure_parted(spark, index, source.schema, key, parts)
    digests = f"{index}__digests"
    tables.restore(spark, digests)
    once = _one_per_key(source, key)
    wanted = _digests(once, key, parts).checkpoint()
    counts = {"insert": 0, "update": 0, "delete": 0}
    counts |= keys.rejected_rows(source, key).head().asDict()
    if not spark.catalog.tableExists(digests):
        held = _digests(parted.parted_scan(spark, index), key, parts)
        tables.overwrite(held, digests)
    old = spark.table(digests).select(
        "part", F.col("rows").alias("old_rows"), F.col("total").alias("old_total"))
    same = F.col("rows").eqNullSafe(F.col("old_rows")) & F.col("total").eqNullSafe(
        F.col("old_total"))
    # At most one row per part.
    unequal = sorted(r["part"] for r in wanted.join(old, "part", "full_outer").where(~same)
                     .select("part").collect())
    if not unequal:
        return counts | {"parts": []}
    there = parted.part_of(key, parts).isin(unequal)
    fresh = once.where(there)
    held = spark.table(index).where(F.col(parted.PART).isin(unequal)).drop(parted.PART)
    changes = keys.snapshot_diff(held, fresh, key).groupBy("change").count().collect()
    counts |= {r["change"]: r["count"] for r in changes}
    parted.replace_parts(spark, index, unequal, fresh)
    tables.swap(wanted, digests)
    return counts | {"parts": unequal}
