"""Evaluation set and the prompt tables that go to language models outside Spark.

Requests leave as a column of prompts and replies come back as a table; the models are
called by whatever service the user runs.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import fixed_values as fixed
from gleanery.functions import text
from gleanery.operators import sampling
from gleanery.sources import tables


def question_requests(chunks: DataFrame, n: int) -> DataFrame:
    """Sampled chunks with the prompt that asks for a question on each."""
    sampled = sampling.question_chunks(chunks, n)
    return sampled.withColumn("prompt", text.question_prompt(F.col("chunk")))


def write_evaluation_set(
    spark: SparkSession, requests: DataFrame, name: str, question: Column, key: str = "pmid"
) -> None:
    """Replace the evaluation set; an echoed prompt is removed, empty questions are dropped."""
    asked = text.without_prompt(F.coalesce(question, F.lit("")), F.col("prompt"))
    tables.overwrite(sampling.evaluation_set(requests, key, asked), name)


def answer_requests(evaluation: DataFrame, n: int, seed: int = fixed.SAMPLE_SEED) -> DataFrame:
    """A seeded sample of the evaluation set with the prompt that asks for an answer."""
    sampled = sampling.seeded_sample(
        evaluation.select("chunk_id", "question", "source_chunk"), "chunk_id", n, seed
    )
    return sampled.withColumn(
        "prompt", text.answer_prompt(F.col("question"), F.col("source_chunk"))
    )


def judge_requests(answers: DataFrame) -> DataFrame:
    """Answers ``(model, question, source_chunk, answer)`` with the prompt for the judge."""
    prompt = text.judge_prompt(F.col("question"), F.col("source_chunk"), F.col("answer"))
    return answers.withColumn("prompt", prompt)
