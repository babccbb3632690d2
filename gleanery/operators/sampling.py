"""Seeded sampling and the evaluation set."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import fixed_values as fixed
from gleanery.functions.text import seeded_key


# Samples up to this size are the smallest keys of every task, ranked by one; larger ones are
# cut where a selection by histograms finds the n-th key. The rows are the same.
ONE_TASK_ROWS = 100_000
DIGITS = 3  # hex digits a histogram looks at


def seeded_sample(
    df: DataFrame, key: str, n: int, seed: int = fixed.SAMPLE_SEED,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """n rows without replacement (all, if fewer); the same rows on every run and engine.

    A small sample is the n smallest of each task's n smallest keys. For a large one the
    n-th smallest key is found digit by digit, from counts per leading digits, and a filter
    keeps the rows up to it, so no task holds the sample. Of rows that share the last key
    any may be drawn.
    """
    if n <= one_task_rows:
        return df.orderBy(seeded_key(F.col(key), seed), F.col(key)).limit(n)
    place = seeded_key(F.col(key), seed)
    start, left = "", n
    while True:
        width = len(start) + DIGITS
        leading = F.substring(place, 1, width)
        counts = (
            df.where(place.startswith(start)).groupBy(leading.alias("leading")).count()
            .orderBy("leading").collect()  # 16 ** DIGITS rows at most
        )
        for row in counts:
            if row["count"] >= left:
                break
            left -= row["count"]
        else:
            return df  # fewer rows than asked for
        start = row["leading"]
        if row["count"] == left:
            return df.where(leading <= start)
        if row["count"] <= one_task_rows or width >= 32:
            last = df.where(leading == start).orderBy(place, F.col(key)).limit(left)
            return df.where(leading < start).unionByName(last)


def long_enough(chunk: Column, floor: int = fixed.MIN_QUESTION_CHUNK_CHARS) -> Column:
    return F.length(chunk) > floor


def question_chunks(
    chunks: DataFrame, n: int, seed: int = fixed.SAMPLE_SEED
) -> DataFrame:
    """Chunks to write questions for: long ones, sampled from the whole table."""
    return seeded_sample(chunks.where(long_enough(F.col("chunk"))), "chunk_id", n, seed)


def evaluation_set(
    sampled: DataFrame, key: str, question: Column
) -> DataFrame:
    """``(question, chunk_id, key, source_chunk)``; pairs without a question are dropped."""
    return sampled.select(
        question.alias("question"), "chunk_id", key, F.col("chunk").alias("source_chunk")
    ).where(F.length("question") > 0)
