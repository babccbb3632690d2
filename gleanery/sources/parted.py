"""Tables in hash parts of their key, of which an update rewrites only the touched ones.

A part is a folder, chosen by a hash of the key. An update finds the parts of its keys, writes
their new rows aside, and with the renaming of that side table the update counts as done: the
parts are then replaced from it, and whoever opens the table after a crash in between replaces
them again. Old rows are there before the renaming and new ones after it, never neither. One
writer at a time is assumed.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"
MODE = "spark.sql.sources.partitionOverwriteMode"
KEY, PARTS, TOUCHED = "gleanery.key", "gleanery.parts", "gleanery.touched"


def part_of(key: str | Column, parts: int) -> Column:
    """The part of a key; all null keys share one."""
    return F.pmod(F.hash(key), F.lit(parts)).cast("int")


def ensure_parted(
    spark: SparkSession, name: str, schema: T.StructType, key: str, parts: int
) -> None:
    """Create schema and table if missing, and finish an update that a crash interrupted."""
    if "." in name:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name.rsplit('.', 1)[0]}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {PART} int) USING PARQUET "
        f"PARTITIONED BY ({PART}) TBLPROPERTIES ('{KEY}' = '{key}', '{PARTS}' = '{parts}')")
    restore_parts(spark, name)


def is_parted(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name) and PART in spark.table(name).columns


def _property(spark: SparkSession, name: str, key: str) -> str:
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").where(F.col("key") == key).collect()
    return rows[0]["value"]


def parted_scan(spark: SparkSession, name: str) -> DataFrame:
    restore_parts(spark, name)
    return spark.table(name).drop(PART)


def parted_append(df: DataFrame, name: str) -> None:
    """Append by column name; rows are dealt to their parts, large parts to several files."""
    spark = df.sparkSession
    restore_parts(spark, name)
    key, parts = _property(spark, name, KEY), int(_property(spark, name, PARTS))
    dealt = df.withColumn(PART, part_of(key, parts)).select(*spark.table(name).columns)
    dealt.repartitionByRange(PART, key).write.mode("append").insertInto(name)


def update_touched(
    spark: SparkSession, name: str, updates: DataFrame,
    change: Callable[[DataFrame], DataFrame],
) -> list[int]:
    """Replaces the parts that hold keys of ``updates`` by ``change`` of their rows.

    ``change`` gets the rows of those parts and returns what they become; rows keep their
    keys. Returns the parts that were rewritten; no others are read or written.
    """
    restore_parts(spark, name)
    key, parts = _property(spark, name, KEY), int(_property(spark, name, PARTS))
    found = updates.select(part_of(key, parts).alias(PART)).distinct().collect()
    touched = sorted(row[PART] for row in found)  # no more than the table has parts
    if not touched:
        return []
    rows = spark.table(name).where(F.col(PART).isin(touched))
    replace_parts(spark, name, touched, change(rows.drop(PART)))
    return touched


def replace_parts(spark: SparkSession, name: str, touched: list[int], rows: DataFrame) -> None:
    """The parts hold ``rows`` from now on, all of which belong to them."""
    key, parts = _property(spark, name, KEY), int(_property(spark, name, PARTS))
    changed = rows.withColumn(PART, part_of(key, parts))
    side = f"{name}__changed"
    spark.sql(f"DROP TABLE IF EXISTS {side}")
    (changed.select(*spark.table(name).columns).repartitionByRange(PART, key)
     .write.format("parquet").saveAsTable(side))
    listed = ",".join(map(str, touched))
    spark.sql(f"ALTER TABLE {side} SET TBLPROPERTIES ('{TOUCHED}' = '{listed}')")
    spark.sql(f"ALTER TABLE {side} RENAME TO {name}__redo")
    restore_parts(spark, name)


def restore_parts(spark: SparkSession, name: str) -> bool:
    """Replaces the parts of a finished update, also one that a crash left; true if there was
    one. Doing it again changes nothing."""
    redo = f"{name}__redo"
    if not spark.catalog.tableExists(redo):
        return False
    touched = {int(p) for p in _property(spark, redo, TOUCHED).split(",")}
    rows = spark.table(redo)
    held = {row[PART] for row in rows.select(PART).distinct().collect()}
    before = spark.conf.get(MODE, "static")
    spark.conf.set(MODE, "dynamic")  # an overwrite of the parts that have rows, not of all
    try:
        rows.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(MODE, before)
    for part in sorted(touched - held):
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({PART} = {part})")
    spark.sql(f"DROP TABLE {redo}")
    return True
