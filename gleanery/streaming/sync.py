"""Triggered synchronisation of a derived index from a stream of changed rows.

Two forms: a log of newest changes that is ranked when it is read and folded from time to
time, and an index that lives in the state store of its own stream, which holds one row per
key at any time.
"""

from functools import reduce
from hashlib import md5
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators.keys import first_per_key
from gleanery.streaming.ingest import read_store


def start_index_sync(
    changes: DataFrame, log: str, key: str, version: str, checkpoint: str
) -> StreamingQuery:
    """Append the newest change per key and micro-batch to the index log.

    A change row holds the key, a ``version`` that grows with every change of a key,
    a ``deleted`` flag and the payload.
    """
    run = md5(checkpoint.encode(), usedforsecurity=False).hexdigest()

    def store_batch(batch: DataFrame, number: int) -> None:
        newest = first_per_key(batch, [key], [F.desc(version)])
        newest.write.mode("overwrite").parquet(f"{log}/run={run}/batch={number}")

    return (
        changes.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def start_state_sync(
    changes: DataFrame, key: str, version: str, checkpoint: str, provider: str = ROCKS
) -> StreamingQuery:
    """Keep the newest change of every key, deletions included, in the stream's state.

    A change row is as for :func:`start_index_sync`. The state's value is the greatest row by
    version, so late and repeated changes leave it as it is; of equal versions a deletion
    wins, then the greater payload, whose columns must have an order (no maps). Rows without
    a key are left out. A restart from the checkpoint goes on where it stopped; a micro-batch
    touches the state of its own keys alone.
    """
    spark = changes.sparkSession
    payload = [c for c in changes.columns if c not in (key, version, "deleted")]
    newest = (
        changes.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.max(F.struct(version, "deleted", *payload)).alias("newest"))
    )
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, provider)
    try:
        return (
            newest.writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def read_state_index(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """The index as the last completed micro-batch left it: a scan of the state, one row per
    key, nothing ranked or shuffled."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(f"key.{key}", "value.max.*").where(~F.col("deleted"))


def read_index(
    spark: SparkSession, log: str, schema: T.StructType, key: str, version: str
) -> DataFrame:
    """Current index: the newest row of every key that is not deleted."""
    rows = read_store(spark, log, schema).select(*schema.names)
    return first_per_key(rows, [key], [F.desc(version)]).where(~F.col("deleted"))


def compact_index(
    spark: SparkSession, log: str, schema: T.StructType, key: str, version: str
) -> int:
    """Fold the log into one row per key, deletions included; returns the folders removed.

    The snapshot is complete before the folders it was made of go, and a key's newest row
    stays the same throughout, so a crash at any point loses nothing. Folders that a stream
    adds meanwhile are left alone.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(log).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = read_store(spark, log, schema)
    held = rows.select("run", "batch").distinct().collect()
    if len(held) < 2:
        return 0
    folded = reduce(Column.__or__, [(F.col("run") == r) & (F.col("batch") == b) for r, b in held])
    newest = first_per_key(rows.where(folded).select(*schema.names), [key], [F.desc(version)])
    newest.write.parquet(f"{log}/run=snapshot-{uuid4().hex}/batch=0")
    for run, batch in held:
        files.delete(path(f"{log}/run={run}/batch={batch}"), True)
    return len(held)
