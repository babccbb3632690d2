"""SimHash near-duplicate groups by tiled exact comparison of 64-bit fingerprints.

Fingerprints are cut into segments, and the vector of the segments' population counts
is a fingerprint's cell. Two fingerprints within ``radius`` bits lie in cells whose
counts differ by ``radius`` in all at most, so every other pair of cells is skipped. The
remaining pairs of tiles are compared with exclusive-or and bit counts; a task returns
a spanning forest of the links it finds, never the links themselves.
"""

import itertools
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gleanery.llm.common import attach, kept, row_key, spaced_words, unused
from gleanery.llm.components import components
from gleanery.operators.keys import broadcast_if_few

SHINGLE_WORDS = 3
RADIUS = 2
HASH_SEED = 42
TILE_ROWS = 1024
FINE_ABOVE = 20_000_000  # distinct fingerprints from which cells of eight segments pay
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of a text's shingles in order; a text of fewer words has one, all its words."""
    words = spaced_words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    span = min(words_per_shingle, len(words)) - 1
    starts = itertools.chain((0,), ends)
    shingles = [joined[a : b - 1] for a, b in zip(starts, ends[span:])]
    return np.fromiter(
        map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), np.uint64, len(shingles)
    )


def simhash(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Majority bits of the shingles' hashes, as a signed 64-bit number.

    A text of fewer words has one shingle, all its words; one without words has 0.
    """
    hashes = shingle_hashes(text, words_per_shingle)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


@F.arrow_udf(LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    return pa.array([simhash(t) for t in text.to_pylist()], pa.int64())


def _cell(fp: Column, segments: int) -> Column:
    """The segments' population counts, eight bits each."""
    width = 64 // segments
    mask = -1 if segments == 1 else (1 << width) - 1
    parts = [
        F.shiftleft(
            F.bit_count(
                F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit(mask))
            ).cast("long"),
            8 * i,
        )
        for i in range(segments)
    ]
    cell = parts[0]
    for part in parts[1:]:
        cell = cell.bitwiseOR(part)
    return cell


def _steps(segments: int, radius: int) -> list[int]:
    """Differences from a cell to those that come after it within the radius, and 0.

    A step that leaves a count's range borrows from the next one and leaves a count no
    cell has, so it meets nothing.
    """
    steps = {0}
    for size in range(1, radius + 1):
        for places in itertools.combinations_with_replacement(range(segments), size):
            for signs in itertools.product((1, -1), repeat=size):
                steps.add(sum(s << (8 * p) for p, s in zip(places, signs)))
    return sorted(s for s in steps if s >= 0)


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint of two tiles to the least one it is connected with."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    in_a, in_b = near.any(axis=1), near.any(axis=0)
    a, b, near = a[in_a].astype(np.int64), b[in_b].astype(np.int64), near[np.ix_(in_a, in_b)]
    if not len(a):
        return a, b
    label_a, label_b = a.copy(), b.copy()
    top = np.iinfo(np.int64).max
    while True:
        next_b = np.minimum(label_b, np.where(near, label_a[:, None], top).min(axis=0))
        next_a = np.minimum(label_a, np.where(near, next_b[None, :], top).min(axis=1))
        if (next_a == label_a).all() and (next_b == label_b).all():
            break
        label_a, label_b = next_a, next_b
    node, least = np.concatenate([a, b]), np.concatenate([label_a, label_b])
    moved = node != least
    return node[moved], least[moved]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for home, guest in zip(batch.column("home"), batch.column("guest")):
            a = home.values.to_numpy(zero_copy_only=False).view(np.uint64)
            b = guest.values.to_numpy(zero_copy_only=False).view(np.uint64)
            found.append(_forest(a, b, radius))
        if found:
            u, v = (np.concatenate(x) for x in zip(*found))
            pairs = np.unique(np.stack([u, v], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"]
            )


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS,
                      segments: int | None = None) -> DataFrame:
    """Links (u, v) that connect all fingerprints within ``radius`` bits, as forests.

    ``prints`` has one row per fingerprint in ``fp``. The comparison is exact for every
    number of segments; more of them give smaller tiles and more pairs of tiles.
    """
    if segments is None:
        segments = 8 if prints.count() > FINE_ABOVE else 4
    steps = _steps(segments, radius)
    placed = prints.select("fp", _cell(F.col("fp"), segments).alias("cell"))
    cells = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("subs"))
    tiles = kept(
        placed.join(cells, "cell")
        .withColumn("sub", F.pmod(F.xxhash64("fp"), "subs").cast("int"))
        .groupBy("cell", "sub")
        .agg(F.collect_list("fp").alias("home"))
    )
    subs = tiles.groupBy(F.col("cell").alias("to")).agg((F.max("sub") + 1).alias("subs"))
    guests = (
        tiles.select(
            "sub", F.col("home").alias("guest"),
            F.explode(F.array(*[F.lit(s).cast("long") for s in steps])).alias("step"), "cell",
        )
        .withColumn("to", F.col("cell") + F.col("step"))
        .join(subs, "to")
        .select(
            F.col("to").alias("cell"), "guest",
            F.explode(
                F.sequence(F.when(F.col("step") == 0, F.col("sub")).otherwise(0),
                           F.col("subs") - 1)
            ).alias("sub"),
        )
    )
    pairs = tiles.join(guests, ["cell", "sub"]).select("home", "guest")
    return pairs.mapInArrow(lambda batches: _compare(batches, radius), "u long, v long")


def near_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, component_id`` of every fingerprint; the id is the least of all linked rows.

    ``prints`` has ``fp`` and ``least`` (the smallest id that has the fingerprint).
    """
    linked = components(fingerprint_links(prints, radius)).withColumnRenamed("node", "fp")
    rooted = kept(prints.join(linked, "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return attach(rooted, kept(ids), ["root"]).select("fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (hex) and ``component_id``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked, directly
    or through others. A text without words has fingerprint 0. Ids may repeat; a group
    whose ids are all null has a null ``component_id``.
    """
    marked = kept(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(text).alias("fp")))
    prints = kept(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = kept(near_groups(prints, radius))
    return attach(marked, groups, ["fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                         radius: int = RADIUS) -> DataFrame:
    """The documents with one of each group: the least id, then the least text hash.

    All columns stay, whatever their names. Null ids come after others; of rows alike in id
    and text one stays. Keys of few rows to leave out are broadcast, so texts are not
    shuffled; many are joined.
    """
    key = row_key(doc_id, text)
    marked = kept(docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text"),
        key.alias("key"), fingerprint(text).alias("fp")))
    order = F.struct(F.col("id").isNull(), "id", "text", "key")
    prints = kept(marked.groupBy("fp").agg(F.min(order).alias("least")))
    first = near_groups(prints, radius).select("fp", F.col("component_id.key").alias("first"))
    keys = marked.groupBy("fp", "key").agg(F.count(F.lit(1)).alias("rows"))
    grouped = kept(attach(kept(keys), kept(first), ["fp"]))
    out, again, name = unused(docs, "gone", "twice", "key")
    gone = kept(grouped.where("key <> first").select(F.col("key").alias(out)))
    twice = kept(grouped.where("key = first AND rows > 1").select(F.col("key").alias(again)))
    left = docs.join(broadcast_if_few(gone), key == F.col(out), "left_anti")
    if twice.isEmpty():
        return left
    alike = key == F.col(again)
    once = left.join(broadcast_if_few(twice), alike, "left_semi").withColumn(name, key)
    return left.join(broadcast_if_few(twice), alike, "left_anti").unionByName(
        once.dropDuplicates([name]).drop(name))
