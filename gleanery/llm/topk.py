"""Exact top-k by inner product with a three-phase uniform threshold.

The components of the vectors are cut into slices; each slice gives every candidate a
local score, and a candidate's score is their sum. Phase one gathers, in every task, the
candidates at the head of each slice's list, and with their sums a cutoff that k
candidates reach. Phase two broadcasts it: what is among the best must, in some slice,
reach an equal share of the cutoff (above the slice's least score). Phase three
resolves the sums of those entries exactly and ranks them. Queries come in blocks of a
bounded size; the candidates stay where they are read and are never shuffled.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 4
UNITS = 1024
BLOCK_BYTES = 16 << 20  # query vectors broadcast at a time
_CELLS = 1 << 21  # scores held by a task at a time
_EXACT = 2.0**53
_LONG = 2**63


def usable(vector: Column) -> Column:
    """Not null, and no component null, infinite or NaN."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )


def _by_length(ids: pa.Array, vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and whole-number vectors of a batch, for each length of vectors."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    ids = ids.to_numpy(zero_copy_only=False)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * float(UNITS))
    ends = np.cumsum(lengths)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        at = (ends[rows] - length)[:, None] + np.arange(length)
        yield ids[rows], flat[at]


class QueryBlock:
    """The queries of one length, and the local scores of candidates against them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, slices: int):
        self.ids = ids
        self.vectors = vectors
        dims = vectors.shape[1]
        cuts = np.linspace(0, dims, min(slices, max(1, dims)) + 1).astype(int)
        self.slices = list(zip(cuts[:-1], cuts[1:]))
        self.largest = np.abs(vectors).max() if vectors.size else 0.0

    def local_scores(self, ids: np.ndarray, vectors: np.ndarray) -> list[np.ndarray]:
        """Candidates by queries, one table per slice; -inf for a query's own row.

        Sums are exact: in 64-bit floats while they hold them, else in whole numbers.
        """
        largest = np.abs(vectors).max() if vectors.size else 0.0
        kind = float
        own = self.vectors
        if float(largest) * float(self.largest) * max(1, vectors.shape[1]) >= _EXACT:
            kind = object
            vectors = np.array([[int(x) for x in v] for v in vectors], object)
            own = np.array([[int(x) for x in v] for v in own], object)
        tables = [vectors[:, a:b] @ own[:, a:b].T for a, b in self.slices]
        same = ids[:, None] == self.ids[None, :]
        if same.any():
            for table in tables:
                table[same] = -math.inf
        return [np.asarray(t, kind) for t in tables]


def _parts(ids: np.ndarray, vectors: np.ndarray, queries: int):
    step = max(1, _CELLS // max(1, queries))
    for at in range(0, len(ids), step):
        yield ids[at : at + step], vectors[at : at + step]


def _best(owner, score, ids, k):
    """Places of each owner's k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, owner)) if score.dtype != object else np.array(
        sorted(range(len(ids)), key=lambda i: (owner[i], -score[i], ids[i])), np.int64)
    own = owner[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return order[rank < k]


def _batches(batches: Iterator[pa.RecordBatch], blocks: dict[int, QueryBlock]):
    for batch in batches:
        for ids, vectors in _by_length(batch.column(0), batch.column(1)):
            block = blocks.get(vectors.shape[1])
            if block is not None:
                for part in _parts(ids, vectors, len(block.ids)):
                    yield block, *part


def _gather(batches, blocks, k):
    """Phase one: per query the k best sums met at the head of a slice, and least scores."""
    heads: dict[int, tuple] = {}
    least: dict[int, np.ndarray] = {}
    for block, ids, vectors in _batches(batches, blocks):
        length = vectors.shape[1]
        tables = block.local_scores(ids, vectors)
        total = sum(tables[1:], tables[0])
        mine = np.stack([np.where(t == -math.inf, math.inf, t).min(axis=0) for t in tables])
        least[length] = np.minimum(least[length], mine) if length in least else mine
        places = np.concatenate([
            np.argsort(-t, axis=0)[:k] if t.dtype == object or len(ids) <= k
            else np.argpartition(-t, k - 1, axis=0)[:k] for t in tables
        ])
        score, found = np.take_along_axis(total, places, 0), ids[places]
        if length in heads:
            score = np.concatenate([heads[length][0], score])
            found = np.concatenate([heads[length][1], found])
        order = np.argsort(found, axis=0, kind="stable")
        score, found = np.take_along_axis(score, order, 0), np.take_along_axis(found, order, 0)
        score[1:][found[1:] == found[:-1]] = -math.inf  # an id counts once
        order = np.argsort(-score, axis=0, kind="stable")[:k]
        heads[length] = np.take_along_axis(score, order, 0), np.take_along_axis(found, order, 0)
    for length, (score, found) in heads.items():
        row, query = np.nonzero(score > -math.inf)
        names = blocks[length].ids
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[query]), pa.array([length] * len(query), pa.int32()),
             pa.array(found[row, query]), pa.array(score[row, query].astype(float)),
             pa.array([None] * len(query), pa.list_(pa.float64()))],
            names=["query_id", "length", "vec_id", "total", "least"])
        count = len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([length] * count, pa.int32()),
             pa.array([None] * count, pa.int64()), pa.array([None] * count, pa.float64()),
             pa.array(least[length].T.astype(float).tolist(), pa.list_(pa.float64()))],
            names=["query_id", "length", "vec_id", "total", "least"])


def _resolve(batches, blocks, cutoffs, k):
    """Phases two and three in a task: entries that reach the share of the cutoff in some
    slice, their exact sums, and of those the k best of every query."""
    kept: dict[int, tuple] = {}
    for block, ids, vectors in _batches(batches, blocks):
        length = vectors.shape[1]
        cutoff, least = cutoffs[length]
        tables = block.local_scores(ids, vectors)
        share = (cutoff - least.sum(axis=0)) / len(tables)
        entry = np.zeros(tables[0].shape, bool)
        for table, floor in zip(tables, least):
            # A little slack, as the share itself is rounded.
            entry |= (table - floor >= share - 1e-9 * np.abs(share) - 1e-6).astype(bool)
        row, query = np.nonzero(entry)
        total = sum(t[row, query] for t in tables)
        enough = np.asarray((total >= cutoff[query]) & (total > -math.inf), bool)
        row, query, total = row[enough], query[enough], total[enough]
        own = query, total, ids[row]
        if length in kept:
            own = tuple(np.concatenate(x) for x in zip(kept[length], own))
        best = _best(own[0], own[1], own[2], k)
        kept[length] = tuple(x[best] for x in own)
    for length, (query, total, ids) in kept.items():
        score = [max(-_LONG, min(_LONG - 1, int(t))) for t in total]
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks[length].ids[query]), pa.array(ids), pa.array(score, pa.int64())],
            names=["query_id", "vec_id", "score"])


def _blocks_of(queries: DataFrame, block_bytes: int) -> Iterator[pa.Table]:
    """The queries in blocks of a bounded size."""
    size = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    rows = max(1, block_bytes // (8 * max(1, size[1] or 1) + 16))
    count = max(1, math.ceil(size[0] / rows))
    for b in range(count if size[0] else 0):
        part = queries
        if count > 1:
            part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(count)) == b)
        yield part.toArrow()


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id",
               vector: str = "embedding", slices: int = SLICES,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest scores over ``vectors``.

    Scores are inner products of components in units of 1/1024, rounded down; ties go to
    the smaller id. A vector is no candidate of a query of the same id or of another
    length. Vectors that are null or hold null or non-finite components, and rows without
    an id, take no part. Scores beyond 64 bits come out as the nearest that fits. Query rows
    of one id ask once, with the least of their vectors; a repeated row of ``vectors`` is as
    many candidates.
    """

    def rows(df: DataFrame) -> DataFrame:
        return df.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
            F.col(vec_id).cast("long").alias("vec_id"),
            F.col(vector).cast("array<double>").alias("vector"),
        )

    spark = vectors.sparkSession
    candidates = rows(vectors)
    results = []
    asked = rows(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    for block in _blocks_of(asked, block_bytes):
        parts = {}
        for batch in block.combine_chunks().to_batches():
            for ids, matrix in _by_length(batch.column(0), batch.column(1)):
                parts[matrix.shape[1]] = QueryBlock(ids, matrix, slices)
        shared = spark.sparkContext.broadcast(parts)
        gathered = candidates.mapInArrow(
            lambda batches, shared=shared: _gather(batches, shared.value, k),
            "query_id long, length int, vec_id long, total double, least array<double>",
        ).persist()
        cutoffs = _cutoffs(gathered, parts, k)
        gathered.unpersist()
        limits = spark.sparkContext.broadcast(cutoffs)
        results.append(candidates.mapInArrow(
            lambda batches, shared=shared, limits=limits: _resolve(
                batches, shared.value, limits.value, k),
            "query_id long, vec_id long, score long",
        ))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    entries = results[0]
    for more in results[1:]:
        entries = entries.union(more)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        entries.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _cutoffs(gathered: DataFrame, parts: dict[int, QueryBlock], k: int) -> dict[int, tuple]:
    """Per length: every query's cutoff (-inf without k candidates) and least scores."""
    best = gathered.where("vec_id IS NOT NULL").groupBy("query_id", "length", "vec_id").agg(
        F.max("total").alias("total"))
    place = Window.partitionBy("query_id", "length").orderBy(F.desc("total"))
    reached = (
        best.withColumn("r", F.row_number().over(place)).where(F.col("r") == k)
        .select("query_id", "length", "total")
    )
    lows = gathered.where("least IS NOT NULL").select("query_id", "length", F.posexplode("least"))
    lows = lows.groupBy("query_id", "length", "pos").agg(F.min("col").alias("low"))
    cutoff = {(r[0], r[1]): r[2] for r in reached.collect()}
    least = {(r[0], r[1], r[2]): r[3] for r in lows.collect()}
    found = {}
    for length, block in parts.items():
        names = block.ids.tolist()
        limit = np.array([cutoff.get((q, length), -math.inf) for q in names])
        # Rounded to the next smaller float where the sum has no float of its own.
        limit = np.where(np.abs(limit) >= _EXACT, np.nextafter(limit, -math.inf), limit)
        low = np.array([[least.get((q, length, s), 0.0) for q in names]
                        for s in range(len(block.slices))])
        low = np.where(np.isfinite(low), low, 0.0)
        low = np.where(np.abs(low) >= _EXACT, np.nextafter(low, -math.inf), low)
        found[length] = limit, low
    return found
