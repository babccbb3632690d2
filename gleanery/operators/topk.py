"""Top-k chunks per question by cosine similarity, exact and approximate.

No plan here pairs rows in a join. Corpus vectors stream through Arrow batches, a
block of questions waits in the task as one matrix, and each task keeps only the k
best per question. What leaves a task is bounded by questions x k, and the final
ranking is an ordinary window over those rows.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gleanery import session
from gleanery.functions.encoders import unit_rows
from gleanery.functions.vectors import all_finite
from gleanery.sources.tables import estimated_bytes

# Similarities are compared after rounding, so equal vectors tie whatever the summation order.
DECIMALS = 9
QUESTION_BLOCK_BYTES = 64 << 20
SCORE_CELLS = 4_000_000
ROUGH_CELLS = 1 << 20  # of a tile of rough similarities, which stays in the cache
ROW_CELLS, PAIR_CELLS = 1 << 19, 1 << 20
MERGED_HITS = 200_000
# Winners that the tasks of one pass may hand on. Beyond it a pass before finds a floor for
# every question; the rows are the same either way.
PASS_WINNERS = 50_000_000
MAX_BUCKETS = 1 << 20


class TopK:
    """Running k best (similarity descending, id ascending) for a block of questions."""

    def __init__(self, questions: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.questions = questions
        self.floor = np.full(questions, -np.inf) if floor is None else floor.copy()
        self.seen = 0
        self.similarity = np.full((questions, k), -np.inf)
        self.ids: np.ndarray | None = None

    def offer(self, similarity: np.ndarray, ids: np.ndarray) -> None:
        """Take in a (rows x questions) block of similarities and the ids of its rows.

        NaN and minus infinity mark what is no candidate.
        """
        rows = len(ids)
        if rows == 0 or self.questions == 0:
            return
        similarity = np.round(similarity, DECIMALS)
        similarity[np.isnan(similarity)] = -np.inf
        floor = self.floor
        if rows > max(self.k, self.seen):
            floor = np.maximum(
                floor, np.partition(similarity, rows - self.k, axis=0)[rows - self.k]
            )
        hit_rows, hit_questions = np.nonzero((similarity >= floor) & (similarity > -np.inf))
        self._merge(hit_questions, similarity[hit_rows, hit_questions], ids[hit_rows])
        self.seen += rows

    def score(
        self, units: np.ndarray, rows: np.ndarray, ids: np.ndarray,
        lists: np.ndarray | None = None, wanted: np.ndarray | None = None,
    ) -> None:
        """Offer unit rows to the unit vectors of the questions.

        A product in single precision finds the pairs that may reach a question's floor; its
        error is bounded, and only those pairs are scored in full. It is made in tiles of a
        bounded size, so memory depends on neither the questions nor the rows. With ``wanted``
        (questions x lists) a row is a candidate of the questions that want its list.
        """
        if len(ids) == 0 or self.questions == 0:
            return
        margin = (units.shape[1] + 8) * 2.0**-23 + 10.0**-DECIMALS
        rough_rows = rows.astype(np.float32)
        step = max(1, ROUGH_CELLS // len(rows))
        found, waiting = [], 0
        for low in range(0, self.questions, step):
            some = slice(low, low + step)
            rough = units[some].astype(np.float32) @ rough_rows.T
            if wanted is not None:
                rough[~wanted[some][:, lists]] = -np.inf
            floor = self.floor[some] - margin
            if len(rows) > self.seen:
                floor = np.maximum(floor, _reached(rough, self.k) - 2 * margin)
            # The lowest number, so that what is no candidate never reaches the floor.
            floor = np.maximum(floor, -2).astype(np.float32)
            hits = np.flatnonzero(rough >= np.nextafter(floor, np.float32(-np.inf))[:, None])
            question, row = np.divmod(hits, len(rows))
            found.append((question + low, row))
            waiting += len(hits)
            if waiting > MERGED_HITS:
                self._score_pairs(units, rows, ids, found)
                found, waiting = [], 0
        self._score_pairs(units, rows, ids, found)
        self.seen += len(rows)

    def _score_pairs(self, units, rows, ids, found) -> None:
        if not found:
            return
        question, row = (np.concatenate(numbers) for numbers in zip(*found))
        similarity = pair_similarities(units, rows, question, row)
        kept = similarity >= self.floor[question]
        self._merge(question[kept], similarity[kept], ids[row[kept]])

    def _merge(self, question: np.ndarray, similarity: np.ndarray, ids: np.ndarray) -> None:
        """The k best of the pairs and of what their questions have; others are not touched."""
        if not len(question):
            return
        if self.ids is None:
            self.ids = np.empty(self.similarity.shape, ids.dtype)
        who, question = np.unique(question, return_inverse=True)
        held, column = np.nonzero(self.similarity[who] > -np.inf)
        question = np.concatenate([held, question])
        similarity = np.concatenate([self.similarity[who[held], column], similarity])
        ids = np.concatenate([self.ids[who[held], column], ids])
        by_id = ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((by_id, -similarity, question))
        question = question[order]
        place = np.arange(len(question)) - np.searchsorted(question, question, side="left")
        keep = place < self.k
        question, place, order = who[question[keep]], place[keep], order[keep]
        self.similarity[question, place] = similarity[order]
        self.ids[question, place] = ids[order]
        full = place == self.k - 1
        at = question[full]
        self.floor[at] = np.maximum(self.floor[at], self.similarity[at, self.k - 1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        question, column = np.nonzero(self.similarity > -np.inf)
        ids = np.empty(0, object) if self.ids is None else self.ids[question, column]
        return question, ids, self.similarity[question, column]


def _reached(rough: np.ndarray, k: int) -> np.ndarray:
    """A similarity that k rows of a (questions x rows) block reach, per question: the k-th of
    the best of groups of rows."""
    rows = rough.shape[1]
    if rows < k:
        return np.full(len(rough), -np.inf)
    groups = min(rows, 8 * k)
    each = rows // groups
    best = rough[:, : groups * each].reshape(len(rough), groups, each).max(axis=2)
    return np.partition(best, groups - k, axis=1)[:, groups - k].astype(float)


def pair_similarities(
    units: np.ndarray, rows: np.ndarray, question: np.ndarray, row: np.ndarray
) -> np.ndarray:
    """Rounded similarities of pairs of unit vectors, some pairs at a time."""
    similarity = np.empty(len(question))
    step = max(1, PAIR_CELLS // max(1, units.shape[1]))
    for low in range(0, len(question), step):
        some = slice(low, low + step)
        similarity[some] = np.einsum("ij,ij->i", units[question[some]], rows[row[some]])
    return np.round(similarity, DECIMALS)


def first_copies(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows that are left when of equal rows the k smallest ids stay.

    Equal rows are as near to everything, so no other of them is among the k best.
    """
    if vectors.size == 0 or len(ids) <= k:
        return np.arange(len(ids))
    row = np.ascontiguousarray(vectors)
    keys = row.view(np.dtype((np.void, row.itemsize * row.shape[1]))).ravel()
    _, copies, size = np.unique(keys, return_inverse=True, return_counts=True)
    if size.max() <= k:
        return np.arange(len(ids))
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], copies))
    place = np.arange(len(ids)) - (np.cumsum(size) - size)[copies[order]]
    return np.sort(order[place < k])


def vector_matrix(column: pa.Array, dimension: int | None = None) -> np.ndarray:
    """List column as a (rows x dimension) matrix; mixed, missing or null vectors are an error."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, dtype=int)
    width = dimension if dimension is not None else (int(lengths[0]) if len(lengths) else 0)
    values = column.flatten()
    if column.null_count or values.null_count or np.any(lengths != width):
        raise ValueError(f"vectors must all have dimension {width}; split off the rest first")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def score_blocks(
    best: TopK, vectors: np.ndarray, ids: np.ndarray, unit_questions: np.ndarray,
    lists: np.ndarray | None = None, wanted: np.ndarray | None = None,
) -> None:
    """Offer all rows, in blocks of a bounded size; :meth:`TopK.score` has the lists."""
    step = max(1, ROW_CELLS // max(1, vectors.shape[1]))
    for low in range(0, len(ids), step):
        some = low + first_copies(vectors[low : low + step], ids[low : low + step], best.k)
        best.score(unit_questions, unit_rows(vectors[some]), ids[some],
                   None if lists is None else lists[some], wanted)


def rank_hits(hits: DataFrame, groups: list[str], chunk_id: str, k: int) -> DataFrame:
    """The k best of the per-task winners, with their rank."""
    place = Window.partitionBy(*groups).orderBy(F.desc("similarity"), F.asc(chunk_id))
    return hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def cosine_topk(
    questions: DataFrame,
    corpus: DataFrame,
    k: int,
    question_id: str = "question_id",
    chunk_id: str = "chunk_id",
    vector: str = "embedding",
    block_bytes: int = QUESTION_BLOCK_BYTES,
    planes: "HashPlanes | None" = None,
    pass_winners: int = PASS_WINNERS,
) -> DataFrame:
    """Exact top-k: ``(question_id, chunk_id, similarity, rank)``.

    The questions are written to the shared folder once and measured. Blocks of them that
    fit ``block_bytes`` are broadcast as a matrix, one after the other, and the corpus is
    read in place for each, with no shuffle of vectors. With several blocks the winners
    of each are written before the next one begins.
    The corpus keeps the splits it is read in; a task hands on k rows per question. Where
    that would be more than ``pass_winners`` rows in all, a first pass takes the best row
    of every task: the k-th best of those is a floor that k rows reach, and the second pass
    hands on only rows that reach it, some k per question however many tasks there are. Ids are
    keys: one row per id on either side. Vectors that are null or hold a null, NaN or
    infinite component are left out, :func:`unusable` counts them. With ``planes`` only rows
    in a question's buckets are candidates, see :func:`approximate_topk`.
    """
    session.shared_root(questions.sparkSession)
    asked = questions.where(all_finite(F.col(vector))).select(question_id, vector).checkpoint()
    stored = corpus.where(all_finite(F.col(vector))).select(chunk_id, vector)
    size = asked.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("dimension")
    ).head()
    if not size["n"]:
        none = asked.sparkSession.createDataFrame(
            [], _hit_schema(asked, stored, question_id, chunk_id))
        return rank_hits(none, [question_id], chunk_id, k)
    blocks = math.ceil(size["n"] * size["dimension"] * 8 / block_bytes)
    parts = []
    for b in range(blocks):
        part = asked
        if blocks > 1:
            part = asked.where(F.pmod(F.xxhash64(question_id), F.lit(blocks)) == b)
            if part.isEmpty():
                continue
        rows = math.ceil(size["n"] / blocks)
        two_passes = splits_of(stored) * rows * k > pass_winners
        hits, shared = _broadcast_search(
            part, stored, k, question_id, chunk_id, vector, planes, two_passes)
        ranked = rank_hits(hits, [question_id], chunk_id, k)
        if blocks > 1:
            ranked = ranked.checkpoint()
            shared.unpersist()
        parts.append(ranked)
    return reduce(DataFrame.unionByName, parts)


def unusable(vectors: DataFrame, vector: str = "embedding") -> int:
    """Vectors that a search leaves out."""
    return vectors.where(~all_finite(F.col(vector))).count()


def _hit_schema(questions: DataFrame, corpus: DataFrame, question_id: str, chunk_id: str):
    return T.StructType([
        T.StructField(question_id, questions.schema[question_id].dataType),
        T.StructField(chunk_id, corpus.schema[chunk_id].dataType),
        T.StructField("similarity", T.DoubleType()),
    ])


def splits_of(corpus: DataFrame) -> int:
    """About how many tasks a scan takes, from Spark's own estimate of its size."""
    split = corpus.sparkSession.conf.get("spark.sql.files.maxPartitionBytes")
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", split.lower()).groups()
    size = int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    return max(cores, math.ceil(estimated_bytes(corpus) / max(1, size)))


def _broadcast_search(
    questions, corpus, k, question_id, chunk_id, vector, planes, two_passes=False
):
    """Hits per task for a block of questions, and the broadcast block."""
    table = questions.toArrow().combine_chunks()
    dimension = len(table[vector][0])
    matrix = vector_matrix(_one_chunk(table[vector]), dimension)
    buckets = None
    if planes is not None:
        codes = planes.codes(matrix)
        buckets = [
            {code: np.flatnonzero(codes[:, t] == code) for code in np.unique(codes[:, t]).tolist()}
            for t in range(planes.tables)
        ]
    shared = questions.sparkSession.sparkContext.broadcast(
        (_one_chunk(table[question_id]), unit_rows(matrix), buckets)
    )
    schema = _hit_schema(questions, corpus, question_id, chunk_id)

    def search(batches, k: int, floors) -> Iterator[pa.RecordBatch]:
        asked, unit_questions, buckets = shared.value
        best = TopK(len(unit_questions), k, floors.value if floors else None)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = vector_matrix(batch.column(1), dimension)
            if buckets is None:
                score_blocks(best, vectors, ids, unit_questions)
            else:
                score_buckets(best, vectors, ids, unit_questions, planes, buckets)
        place, ids, similarity = best.rows()
        yield _hit_batch(asked.take(pa.array(place)), ids, similarity, schema)

    floors = None
    if two_passes:
        heads = corpus.mapInArrow(lambda batches: search(batches, 1, None), schema)
        reached = rank_hits(heads, [question_id], chunk_id, k).where(F.col("rank") == k)
        # One number per question of the block.
        known = reached.select(question_id, "similarity").toArrow()
        place = {q: i for i, q in enumerate(table[question_id].to_pylist())}
        floor = np.full(len(place), -np.inf)
        floor[[place[q] for q in known[question_id].to_pylist()]] = known["similarity"].to_numpy()
        floors = questions.sparkSession.sparkContext.broadcast(floor)
    return corpus.mapInArrow(lambda batches: search(batches, k, floors), schema), shared


def _one_chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _hit_batch(asked: pa.Array, ids, similarity, schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            asked,
            pa.array(ids, type=to_arrow_type(schema[1].dataType)),
            pa.array(similarity, type=pa.float64()),
        ],
        names=schema.names,
    )


@dataclass(frozen=True)
class HashPlanes:
    """Sign random projections: ``tables`` independent codes of ``bits`` signs each.

    A plane is a vector of +1 and -1, its sign per dimension being the parity of the
    first hex digit of ``md5('table:bit:dimension')``, the same on every machine.
    """

    dimension: int
    bits: int
    tables: int

    def __post_init__(self):
        if self.tables << self.bits > MAX_BUCKETS:
            raise ValueError(f"at most {MAX_BUCKETS} buckets")

    def signs(self, table: int, bit: int) -> list[float]:
        digits = (
            md5(f"{table}:{bit}:{d}".encode(), usedforsecurity=False).hexdigest()[0]
            for d in range(self.dimension)
        )
        return [1.0 if int(digit, 16) % 2 == 0 else -1.0 for digit in digits]

    def matrix(self) -> np.ndarray:
        return np.array(
            [self.signs(t, b) for t in range(self.tables) for b in range(self.bits)]
        )

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """The bucket of every vector in every table."""
        signs = vectors @ _directions(self).T >= 0
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        return signs.reshape(-1, self.tables, self.bits) @ weights


@cache
def _directions(planes: HashPlanes) -> np.ndarray:
    return planes.matrix()


def score_buckets(
    best: TopK, vectors: np.ndarray, ids: np.ndarray, unit_questions: np.ndarray,
    planes: HashPlanes, asked: list[dict[int, np.ndarray]],
) -> None:
    """Offer rows to the questions they share a bucket with in any table; ``asked`` has the
    questions of every code, per table."""
    step = max(1, SCORE_CELLS // max(1, len(unit_questions)))
    for low in range(0, len(ids), step):
        block = unit_rows(vectors[low : low + step])
        codes = planes.codes(vectors[low : low + step])
        similarity = np.full((len(block), len(unit_questions)), -np.inf)
        for table, questions_of in enumerate(asked):
            order = np.argsort(codes[:, table], kind="stable")
            found, starts = np.unique(codes[order, table], return_index=True)
            for code, rows in zip(found.tolist(), np.split(order, starts[1:])):
                questions = questions_of.get(code)
                if questions is not None:
                    near = block[rows] @ unit_questions[questions].T
                    similarity[np.ix_(rows, questions)] = near
        best.offer(similarity, ids[low : low + step])


def approximate_topk(
    questions: DataFrame,
    corpus: DataFrame,
    k: int,
    planes: HashPlanes,
    question_id: str = "question_id",
    chunk_id: str = "chunk_id",
    vector: str = "embedding",
    block_bytes: int = QUESTION_BLOCK_BYTES,
) -> DataFrame:
    """Top-k among the chunks that share a bucket with the question in any table.

    The corpus is read in place, as in :func:`cosine_topk`; a task scores each row exactly,
    against the questions of its buckets only. No candidate is left out, so the answer is
    the exact top-k of the shared buckets, however hot a bucket is.
    """
    return cosine_topk(
        questions, corpus, k, question_id, chunk_id, vector, block_bytes, planes
    )
