"""Table scans, local rows and sinks over the session catalog."""

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def scan(spark: SparkSession, name_or_path: str, *columns: str) -> DataFrame:
    """Table or Parquet path, pruned to ``columns``."""
    if "/" in name_or_path:
        df = spark.read.parquet(name_or_path)
    else:
        restore(spark, name_or_path)
        df = spark.table(name_or_path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Spread an input too small to give every core a split, before costly work per row.

    The decision compares Spark's own size estimate with its smallest sensible split
    (``spark.sql.files.openCostInBytes``) per core. A larger input is never shuffled here.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    if df.isStreaming or estimated_bytes(df) >= cores * split:
        return df
    return df.repartition(cores)


def estimated_bytes(df: DataFrame) -> int:
    """Size estimate the optimizer works with; nothing is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def would_broadcast(df: DataFrame) -> bool:
    """Whether Spark itself would broadcast this side of a join."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    return not df.isStreaming and estimated_bytes(df) <= conf.autoBroadcastJoinThreshold()


def local_rows(spark: SparkSession, rows: Iterable, schema: T.StructType) -> DataFrame:
    """Rows the caller holds, with a stated schema, so that all-null columns keep their type.

    They enter through Arrow as a relation of known size, which joins can take into
    account. Time stamps without a zone count as UTC.
    """
    columns = list(zip(*rows)) or [[] for _ in schema]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def ensure_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    bucket_by: str | None = None,
    buckets: int | None = None,
) -> None:
    """Create schema and table if missing.

    Tables that are joined on one key for ever (articles, registry, chunks) should be
    bucketed on it with one bucket count: anti-joins and merges between them then
    read their buckets side by side, without a shuffle of the text. A table that an
    interrupted :func:`swap` left aside is brought back first.
    """
    restore(spark, name)
    if "." in name:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name.rsplit('.', 1)[0]}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    clustered = f"CLUSTERED BY (`{bucket_by}`) INTO {buckets} BUCKETS" if bucket_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING PARQUET {clustered}")


def append(df: DataFrame, name: str, counts: Observation | None = None) -> None:
    """Append by column name; an ``Observation`` collects the row count during the write."""
    _writer(df, name, counts).mode("append").saveAsTable(name)


def overwrite(df: DataFrame, name: str, counts: Observation | None = None) -> None:
    """Replace a table that ``df`` does not read; its columns may change."""
    _writer(df, name, counts, keep_columns=False).mode("overwrite").saveAsTable(name)


def swap(df: DataFrame, name: str) -> None:
    """Replace a table with rows derived from itself: write aside, then rename.

    One writer at a time is assumed. Every use of the table by name goes through
    :func:`restore`, so after a crash between the two renames the old rows are back; the
    old table is dropped only while one of its name exists.
    """
    spark = df.sparkSession
    restore(spark, name)
    following, previous = f"{name}__next", f"{name}__prev"
    spark.sql(f"DROP TABLE IF EXISTS {following}")
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE IF EXISTS {previous}")
    _writer(df, following, None, like=name).mode("overwrite").saveAsTable(following)
    spark.sql(f"ALTER TABLE {name} RENAME TO {previous}")
    spark.sql(f"ALTER TABLE {following} RENAME TO {name}")
    spark.sql(f"DROP TABLE {previous}")


def restore(spark: SparkSession, name: str) -> bool:
    """Undo an interrupted :func:`swap`; true when the old table was brought back."""
    if spark.catalog.tableExists(name) or not spark.catalog.tableExists(f"{name}__prev"):
        return False
    spark.sql(f"ALTER TABLE {name}__prev RENAME TO {name}")
    return True


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).isEmpty()


def _writer(
    df: DataFrame,
    name: str,
    counts: Observation | None,
    like: str | None = None,
    keep_columns: bool = True,
):
    spark = df.sparkSession
    existing = like or name
    layout = None
    if spark.catalog.tableExists(existing):
        if keep_columns:
            df = df.select(*spark.table(existing).columns)
        layout = bucket_layout(spark, existing)
    if counts is not None:
        df = df.observe(counts, F.count(F.lit(1)).alias("rows"))
    if layout:
        # One task per bucket, so a write adds one file per bucket and not one per task and bucket.
        df = df.repartition(*layout)
    writer = df.write.format("parquet")
    return writer.bucketBy(*layout) if layout else writer


def bucket_layout(spark: SparkSession, name: str) -> tuple[int, str] | None:
    """Bucket count and column of a table, so that appends keep its layout."""
    keys = [c.name for c in spark.catalog.listColumns(name) if c.isBucket]
    if not keys:
        return None
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}")
    count = described.where(F.col("col_name") == "Num Buckets").head()
    return int(count["data_type"]), keys[0]


def bucketed_alike(spark: SparkSession, *names: str) -> bool:
    """Whether all tables are bucketed with one count on one column."""
    layouts = {bucket_layout(spark, name) for name in names}
    return len(layouts) == 1 and None not in layouts
