"""Evaluation of embedding candidates in one pass over the chunks, and of judge replies."""

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleanery import fixed_values as fixed
from gleanery import schemas, session
from gleanery.functions.encoders import Candidate, checked, embed, unit_rows
from gleanery.operators import judging, metrics, topk
from gleanery.sources import tables

QUESTION_BYTES = 64 << 20
FAN_IN = 32
COUNTS = "model string, ahead binary, error string"


def evaluate_candidates(
    questions: DataFrame,
    chunks: DataFrame,
    candidates: Sequence[Candidate],
    k_values: Sequence[int] = tuple(fixed.K_VALUES),
    question_bytes: int = QUESTION_BYTES,
) -> DataFrame:
    """Metrics per candidate from ``questions (question_id, question, correct_chunk_id)``
    and ``chunks (chunk_id, chunk)``.

    A question's rank is one more than the number of chunks ahead of its labelled one, so
    tasks return a number per question, never chunks. Questions go in blocks of which text
    and vectors fit ``question_bytes``; all candidates encode the chunk text in one pass per
    block, and no chunk vector leaves its task. A candidate whose encoder fails in any task,
    or gives vectors of another width than it states or that are not finite, is left out of
    the result; :func:`evaluate_with_failures` names it.
    """
    return evaluate_with_failures(questions, chunks, candidates, k_values, question_bytes)[0].drop(
        "mrr")


def evaluate_with_failures(
    questions: DataFrame,
    chunks: DataFrame,
    candidates: Sequence[Candidate],
    k_values: Sequence[int] = tuple(fixed.K_VALUES),
    question_bytes: int = QUESTION_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """:func:`evaluate_candidates` with the reciprocal rank over all chunks (``mrr``), and
    ``(model, error)`` of the candidates that failed."""
    session.shared_root(questions.sparkSession)
    # Sampling questions reads the whole corpus, so their rows are kept once they exist.
    questions = questions.select("question_id", "question", "correct_chunk_id").checkpoint()
    ranked = label_ranks(questions, chunks, candidates, question_bytes)
    failures = ranked.where(F.col("error").isNotNull()).groupBy("model").agg(
        F.min("error").alias("error")).checkpoint()
    models = F.array(*[F.lit(c.name) for c in candidates])
    labelled = questions.select("question_id", F.explode(models).alias("model"))
    found = ranked.where(F.col("error").isNull()).select("model", "question_id", "rank")
    scored = (
        labelled.join(found, ["model", "question_id"], "left")
        .groupBy("model")
        .agg(*metrics.metric_columns(F.col("rank"), k_values),
             metrics.mean_reciprocal_rank(F.col("rank")).alias("mrr"))
        .join(F.broadcast(failures), "model", "left_anti")
    )
    described = F.create_map(
        *[
            part
            for c in candidates
            for part in (
                F.lit(c.name),
                F.struct(F.lit(c.path).alias("path"), F.lit(c.dimension).alias("dim")),
            )
        ]
    )[F.col("model")]
    described_scores = scored.select(
        "model",
        described["path"].alias("model_path"),
        described["dim"].cast("long").alias("embedding_dim"),
        *[c for c in scored.columns if c != "model"],
    )
    return described_scores, failures


def label_ranks(
    questions: DataFrame,
    chunks: DataFrame,
    candidates: Sequence[Candidate],
    question_bytes: int = QUESTION_BYTES,
) -> DataFrame:
    """``(model, question_id, rank, error)``: the place of every question's labelled chunk
    among all chunks, by similarity, then id; null where there is no such chunk. A failed
    candidate has rows without a question that carry its error.
    """
    text = chunks.select("chunk_id", "chunk")
    size = questions.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length("question")), F.lit(0)).alias("text"),
    ).head()
    width = 8 * sum(c.dimension + 2 for c in candidates)
    blocks = max(1, math.ceil((size["text"] + size["n"] * width) / question_bytes))
    parts = []
    for b in range(blocks):
        block = questions
        if blocks > 1:
            block = questions.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b)
            if block.isEmpty():
                continue
        parts.append(_block_ranks(block, text, candidates).checkpoint())
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Asked:
    """A candidate's question vectors, and its similarity of each to the labelled chunk (NaN
    where there is none)."""

    units: np.ndarray
    label: np.ndarray

    def ahead(self, vectors: np.ndarray, chunk_ids: np.ndarray, correct: np.ndarray) -> np.ndarray:
        """How many of the chunks come before each question's labelled one."""
        count = np.zeros(len(self.units), np.int64)
        step = max(1, topk.SCORE_CELLS // max(1, len(self.units)))
        for at in range(0, len(chunk_ids), step):
            ids = chunk_ids[at : at + step]
            similarity = np.round(
                unit_rows(vectors[at : at + step]) @ self.units.T, topk.DECIMALS)
            before = similarity > self.label
            # The labelled chunk itself, and equals: their sums may differ in the last digit.
            row, question = np.nonzero(np.abs(similarity - self.label) < 2 * 10.0 ** -topk.DECIMALS)
            before[row, question] = ids[row] < correct[question]
            count += before.sum(axis=0)
        return count


def _block_ranks(
    block: DataFrame, text: DataFrame, candidates: Sequence[Candidate]
) -> DataFrame:
    """Ranks for a block of questions, whose vectors are broadcast, in one pass over the text."""
    spark = block.sparkSession
    kind = block.schema["question_id"].dataType
    schema = T.StructType([
        T.StructField("model", T.StringType()), T.StructField("question_id", kind),
        T.StructField("rank", T.LongType()), T.StructField("error", T.StringType()),
    ])
    block = block.orderBy("question_id").checkpoint()
    wanted = block.select(F.col("correct_chunk_id").alias("chunk_id")).distinct()
    labels = text.join(F.broadcast(wanted), "chunk_id", "left_semi").checkpoint()
    table = block.select("question_id", "correct_chunk_id").toArrow()
    correct = table["correct_chunk_id"].to_numpy()
    asked: dict[str, Asked] = {}
    failed = []
    for candidate in candidates:
        encode = embed(checked(candidate))
        try:
            vectors = _encoded(block.select("question_id", encode("question").alias("v")), candidate)
            known = labels.select("chunk_id", encode("chunk").alias("v")).toArrow()
        except PythonException as problem:  # the encoder's own error must not end the others
            failed.append((candidate.name, None, None, _last_line(problem)))
            continue
        place = {c: i for i, c in enumerate(known["chunk_id"].to_pylist())}
        there = np.array([c in place for c in correct], bool)
        units, label = unit_rows(vectors), np.full(len(correct), np.nan)
        if there.any():
            rows = unit_rows(topk.vector_matrix(
                known["v"].combine_chunks(), candidate.dimension))[[place[c] for c in correct[there]]]
            label[there] = np.round(np.einsum("ij,ij->i", units[there], rows), topk.DECIMALS)
        asked[candidate.name] = Asked(units, label)
    shared = spark.sparkContext.broadcast((asked, correct))
    chosen = [c for c in candidates if c.name in asked]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, correct = shared.value
        encoders: dict[str, Callable] = {}
        ahead = {c.name: np.zeros(len(correct), np.int64) for c in chosen}
        errors: dict[str, str] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk_ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for candidate in chosen:
                name = candidate.name
                if name in errors:
                    continue
                try:
                    if name not in encoders:
                        encoders[name] = checked(candidate)()
                    vectors = encoders[name](texts).astype(np.float64)
                    ahead[name] += asked[name].ahead(vectors, chunk_ids, correct)
                except Exception as problem:  # reported in the result, for this candidate
                    errors[name] = f"{type(problem).__name__}: {problem}"
        yield _counts([(n, ahead[n].tobytes(), errors.get(n)) for n in ahead])

    counts = text.mapInArrow(count, COUNTS).repartition(FAN_IN).mapInArrow(_summed, COUNTS)
    # FAN_IN rows per candidate are left, of one number per question each.
    sums: dict[str, np.ndarray] = {}
    for row in counts.toArrow().to_pylist():
        if row["error"]:
            failed.append((row["model"], None, None, row["error"]))
        else:
            sums[row["model"]] = sums.get(row["model"], 0) + np.frombuffer(row["ahead"], np.int64)
    tables_ = [_no_ranks(schema)]
    for name, state in asked.items():
        there = ~np.isnan(state.label)
        rank = 1 + sums.get(name, np.zeros(len(correct), np.int64))
        n = len(correct)
        tables_.append(pa.table(
            [pa.array([name] * n, pa.string()), table["question_id"],
             pa.array(rank, pa.int64(), mask=~there), pa.nulls(n, pa.string())],
            schema=to_arrow_schema(schema)))
    tables_.append(pa.Table.from_pylist(
        [dict(zip(schema.names, row)) for row in failed], to_arrow_schema(schema)))
    return spark.createDataFrame(pa.concat_tables(tables_), schema)


def _no_ranks(schema: T.StructType) -> pa.Table:
    return to_arrow_schema(schema).empty_table()


def _encoded(rows: DataFrame, candidate: Candidate) -> np.ndarray:
    return topk.vector_matrix(rows.toArrow()["v"].combine_chunks(), candidate.dimension)


def _counts(rows: list[tuple]) -> pa.RecordBatch:
    model, ahead, error = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(model, pa.string()), pa.array(ahead, pa.binary()), pa.array(error, pa.string())],
        names=["model", "ahead", "error"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per model with the sum of its counts; one for its first error."""
    sums: dict[str, np.ndarray] = {}
    errors: dict[str, str] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["error"]:
                errors.setdefault(row["model"], row["error"])
            numbers = np.frombuffer(row["ahead"], np.int64)
            sums[row["model"]] = sums.get(row["model"], 0) + numbers
    yield _counts([(n, total.tobytes(), None) for n, total in sums.items()]
                  + [(n, b"", e) for n, e in errors.items()])


def _last_line(problem: PythonException) -> str:
    """The line of a Python worker's trace that names the error."""
    lines = [line.strip() for line in str(problem).splitlines() if line.strip()]
    named = [line for line in lines if re.match(r"[A-Za-z_.]+(Error|Exception)\b", line)]
    return (named or lines or ["failed"])[-1]


def evaluate_replies(replies: DataFrame, evaluated_at: Column | None = None) -> DataFrame:
    """Rows for the generation results table from raw judge replies ``(model, reply)``."""
    stamp = F.current_timestamp() if evaluated_at is None else evaluated_at
    return judging.judge_scores(replies).withColumn("evaluated_at", stamp)


def evaluate_embedding_tables(
    spark: SparkSession,
    chunks: str,
    questions: str,
    results: str,
    candidates: Sequence[Candidate],
    failures: str | None = None,
) -> DataFrame:
    """Score the candidates on the question table and append to the results table.

    Every row of the question table counts, repeated ones as often as they stand there.
    Returns this run's rows as a leaderboard; failed candidates go to the ``failures``
    table, if one is named.
    """
    alike = Window.partitionBy("chunk_id", "question").orderBy("chunk_id")
    asked = tables.scan(spark, questions, "question", "chunk_id").select(
        F.sha2(F.to_json(F.struct("chunk_id", "question", F.row_number().over(alike))), 256)
        .alias("question_id"),
        "question",
        F.col("chunk_id").alias("correct_chunk_id"),
    )
    text = tables.scan(spark, chunks, "chunk_id", "chunk")
    scored, failed = evaluate_with_failures(asked, text, candidates)
    if failures is not None:
        tables.ensure_table(spark, failures, schemas.FAILURES)
        tables.append(failed.withColumn("evaluated_at", F.current_timestamp()), failures)
    stamped = scored.drop("mrr").withColumn("evaluated_at", F.current_timestamp()).checkpoint()
    tables.ensure_table(spark, results, schemas.EMBEDDING_RESULTS)
    tables.append(stamped, results)
    return metrics.leaderboard(stamped)


def evaluate_generation_table(spark: SparkSession, replies: DataFrame, results: str) -> DataFrame:
    """Score judge replies ``(model, reply)`` and append to the results table."""
    session.shared_root(spark)
    scored = evaluate_replies(replies).checkpoint()
    tables.ensure_table(spark, results, schemas.GENERATION_RESULTS)
    tables.append(scored, results)
    return scored
