"""Bloom filters of the keys in each folder of a store.

A filter says of a key "surely not here" or "maybe". One stands beside every folder of a
store, in shards by a hash of the key, so that a micro-batch opens only the folders that may
hold one of its keys. A folder without a filter, as a crash may leave one, is always opened.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = "_filters"
SHARD_KEYS = 500_000
BITS_PER_KEY = 16
PROBES = 6  # with 16 bits a key, 1 of 1,000 absent keys is a "maybe"
GROUP_KEYS = 100_000
SCHEMA = "shard int, shards int, bits binary"


def bloom(hashes: np.ndarray) -> np.ndarray:
    """A bit array that holds the hashes; its length is a power of two."""
    size = 1 << max(6, int(len(hashes) * BITS_PER_KEY - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[_places(hashes, size).ravel()] = True
    return np.packbits(bits)


def may_hold(packed: bytes, hashes: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(packed, np.uint8)
    at = _places(hashes, len(bits) * 8)
    return ((bits[at >> 3] >> (7 - (at & 7))) & 1).all(axis=1)


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """PROBES places per hash, from its two halves."""
    whole = hashes.astype(np.int64).view(np.uint64)
    low, high = whole & np.uint64(0xFFFFFFFF), (whole >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((low[:, None] + steps * high[:, None]) & np.uint64(size - 1)).astype(np.int64)


def _hashed(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(
        F.col(key).alias("key"), F.xxhash64(key).alias("deal"),
        F.xxhash64(F.lit("filter"), key).alias("hash"))


def folder(run: str, batch: int) -> str:
    return f"run={run}/batch={batch}"


def drop_filter(spark: SparkSession, store: str, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{FILTERS}/{place}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_filter(rows: DataFrame, key: str, store: str, place: str) -> None:
    """Writes the filter of a folder's rows, in shards of some SHARD_KEYS keys."""
    shards = 1 << max(0, -(-rows.count() // SHARD_KEYS) - 1).bit_length()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bloom(np.array(h, np.int64)).tobytes() for h in batch.column("hashes").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), pa.array([shards] * len(found), pa.int32()),
                 pa.array(found, pa.binary())], names=["shard", "shards", "bits"])

    shard = F.pmod("deal", F.lit(shards)).cast("int")
    (_hashed(rows, key).groupBy(shard.alias("shard")).agg(F.collect_list("hash").alias("hashes"))
     .mapInArrow(pack, SCHEMA).write.mode("overwrite").parquet(f"{store}/{FILTERS}/{place}"))


def folders_of(spark: SparkSession, store: str) -> set[str]:
    """The store's folders, as their place below it."""
    found = set()
    root = spark._jvm.org.apache.hadoop.fs.Path(store)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/run=*/batch=*")
    for status in files.globStatus(pattern) or []:
        path = status.getPath()
        found.add(f"{path.getParent().getName()}/{path.getName()}")
    return found


def maybe_held(keys: DataFrame, key: str, store: str, kind: str) -> DataFrame:
    """``key, place`` of every key and every filtered folder that may hold it.

    ``kind`` is the key's type. Keys meet filters by shard, in groups of a bounded size.
    """
    spark = keys.sparkSession
    filters = spark.read.schema(f"{SCHEMA}, run string, batch long").parquet(f"{store}/{FILTERS}")
    hashed = _hashed(keys, key)
    total = hashed.count()
    parts = [spark.createDataFrame([], f"key {kind}, place string")]
    for row in filters.select("shards").distinct().collect():  # few powers of two
        shards = row["shards"]
        slices = -(-total // (shards * GROUP_KEYS)) or 1
        grouped = hashed.groupBy(
            F.pmod("deal", F.lit(shards)).cast("int").alias("shard"),
            F.pmod("hash", F.lit(slices)).alias("slice"),
        ).agg(F.collect_list(F.struct("key", "hash")).alias("asked"))

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held, places = [], []
                asked, ends = batch.column("asked").values, batch.column("asked").offsets.to_pylist()
                names, hashes = asked.field("key"), asked.field("hash").to_numpy()
                for i, (low, high) in enumerate(zip(ends, ends[1:])):
                    hit = may_hold(batch.column("bits")[i].as_py(), hashes[low:high])
                    at = np.flatnonzero(hit) + low
                    held.append(names.take(pa.array(at)))
                    place = folder(batch.column("run")[i].as_py(), batch.column("batch")[i].as_py())
                    places += [place] * len(at)
                if held:
                    yield pa.RecordBatch.from_arrays(
                        [pa.concat_arrays(held), pa.array(places, pa.string())],
                        names=["key", "place"])

        chosen = filters.where(F.col("shards") == shards)
        parts.append(grouped.join(chosen, "shard").mapInArrow(test, f"key {kind}, place string"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
