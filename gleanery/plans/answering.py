"""Retrieval for question answering: top chunks and the grounded prompt."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import fixed_values as fixed
from gleanery import session
from gleanery.functions.encoders import Candidate, checked, embed
from gleanery.functions.text import answer_prompt
from gleanery.functions.vectors import has_dimension
from gleanery.operators import config
from gleanery.operators.topk import cosine_topk
from gleanery.sources import tables

BROADCAST_HITS = 1_000_000


def grounded_prompts(
    questions: DataFrame,
    embedded: DataFrame,
    k: int = fixed.ANSWER_TOP_K,
) -> DataFrame:
    """``(question_id, sources, prompt)`` per question, with at most k cited chunks.

    ``questions`` is (question_id, question, embedding), ``embedded`` is
    (chunk_id, chunk, embedding). The text is fetched for the found chunks only: the
    hits are broadcast to the chunk scan while questions x k is small, so the chunk
    table is not shuffled.
    """
    session.shared_root(questions.sparkSession)
    questions = questions.select("question_id", "question", "embedding").checkpoint()
    hits = cosine_topk(questions, embedded, k).select("question_id", "chunk_id", "rank")
    if questions.count() * k <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    cited = embedded.select("chunk_id", "chunk").join(hits, "chunk_id")
    contexts = cited.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "chunk"))).alias("cited")
    )
    context = F.array_join(
        F.transform("cited", lambda c: F.concat(F.lit("["), c["chunk_id"], F.lit("] "), c["chunk"])),
        "\n\n",
    )
    return questions.select("question_id", "question").join(contexts, "question_id").select(
        "question_id",
        F.array_join(F.transform("cited", lambda c: c["chunk_id"]), ",").alias("sources"),
        answer_prompt(F.col("question"), context).alias("prompt"),
    )


def answer_questions(
    spark: SparkSession,
    questions: DataFrame,
    index: str,
    config_table: str,
    candidates: Sequence[Candidate],
    k: int = fixed.ANSWER_TOP_K,
) -> DataFrame:
    """:func:`grounded_prompts` of ``(question_id, question)`` with the production model.

    The newest configuration names the embedding model, which must be among the
    candidates; an index that holds vectors of another width is refused.
    """
    current = config.latest(tables.scan(spark, config_table)).head()
    if current is None:
        raise ValueError(f"{config_table} has no configuration")
    name, width = current["embedding_model_name"], current["embedding_dimension"]
    chosen = next((c for c in candidates if c.name == name), None)
    if chosen is None or chosen.dimension != width:
        raise ValueError(f"no candidate {name} with {width} dimensions")
    stored = tables.scan(spark, index)
    if not tables.is_empty(stored.where(~has_dimension(F.col("embedding"), width))):
        raise ValueError(f"{index} holds vectors that do not fit {name} ({width} dimensions)")
    if "model" in stored.columns:
        stored = stored.where(F.col("model") == name)
    asked = questions.select("question_id", "question").withColumn(
        "embedding", embed(checked(chosen))("question"))
    return grounded_prompts(asked, stored, k)
