"""Streaming ingest that stores every key once."""

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gleanery import session
from gleanery.operators.keys import broadcast_if_few, first_per_key, unseen
from gleanery.streaming import filters


def read_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Everything stored so far; an absent or empty store gives no rows."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(location)
    layout = T.StructType(
        schema.fields + [T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())]
    )
    return spark.read.schema(layout).parquet(path)


def unstored(rows: DataFrame, store: str, key: str, own: str | None = None) -> DataFrame:
    """Rows (one per key) whose key no folder of the store but ``own`` holds.

    Keys that no filter names are new without a look at the store. The others are compared
    with the folders whose filters name one of them, and with those that have no filter.
    """
    spark = rows.sparkSession
    maybe, places = _maybe(rows, store, key, own)
    if not places:
        return rows
    stored = spark.read.schema(rows.select(key).schema).parquet(
        *[f"{store}/{place}" for place in places])
    if maybe is None:
        return unseen(rows, stored, key)
    asked = broadcast_if_few(maybe.select(F.col("key").alias("_maybe")).distinct().checkpoint())
    met = F.col(key) == F.col("_maybe")
    sure = rows.join(asked, met, "left_anti")
    return sure.unionByName(unseen(rows.join(asked, met, "left_semi"), stored, key))


def _maybe(rows: DataFrame, store: str, key: str, own: str | None):
    """``key, place`` of possible hits (None: any key may be anywhere), and the folders to open."""
    spark = rows.sparkSession
    held = filters.folders_of(spark, store) - {own}
    if not held:
        return None, []
    filtered = filters.folders_of(spark, f"{store}/{filters.FILTERS}")
    bare = held - filtered
    if bare or not filtered:
        # What has no filter is opened for every key; then the filters spare nothing.
        named = _named(rows, store, key, held - bare) if held - bare else set()
        return None, sorted(bare | named)
    maybe = _hits(rows, store, key, held)
    return maybe, sorted(r["place"] for r in maybe.select("place").distinct().collect())


def _hits(rows: DataFrame, store: str, key: str, held: set[str]) -> DataFrame:
    kind = dict(rows.dtypes)[key]
    found = filters.maybe_held(rows.select(key), key, store, kind)
    return found.where(F.col("place").isin(sorted(held))).checkpoint()


def _named(rows: DataFrame, store: str, key: str, held: set[str]) -> set[str]:
    places = _hits(rows, store, key, held).select("place").distinct().collect()
    return {r["place"] for r in places}


def start_dedup_ingest(
    stream: DataFrame,
    store: str,
    key: str,
    checkpoint: str,
    order: list[Column] | None = None,
) -> StreamingQuery:
    """Store the rows of a stream whose key is not stored yet; stops when caught up.

    Every micro-batch has a folder of its own, named after the checkpoint and the
    batch, and overwrites it: a repeated batch leaves the same rows. Keys are compared
    with all other folders, so a new checkpoint over an old store adds nothing twice; a
    filter beside each folder says which of them need not be opened. Rows without a key are
    not stored, as nothing tells them apart from those of another run.
    """
    schema = stream.schema
    run = md5(checkpoint.encode(), usedforsecurity=False).hexdigest()

    def store_batch(batch: DataFrame, number: int) -> None:
        spark, place = batch.sparkSession, filters.folder(run, number)
        session.shared_root(spark)
        keyed = batch.where(F.col(key).isNotNull())
        by = order or [F.col(c).asc() for c in batch.columns]
        once = first_per_key(keyed, [key], by).select(*batch.columns).checkpoint()
        fresh = unstored(once, store, key, place)
        filters.drop_filter(spark, store, place)
        fresh.write.mode("overwrite").parquet(f"{store}/{place}")
        written = spark.read.schema(schema).parquet(f"{store}/{place}").select(key)
        filters.write_filter(written, key, store, place)

    return (
        stream.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
