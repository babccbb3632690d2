"""Batch embedding of a chunk table, in full or for new chunks only."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.encoders import Candidate, checked, embed
from gleanery.operators.keys import unseen_wide
from gleanery.sources import tables


def embed_chunks(
    chunks: DataFrame, candidate: Candidate, existing: DataFrame | None = None
) -> DataFrame:
    """Chunk rows with ``embedding`` and ``model``; with ``existing`` (chunk_id, model) only
    what this model has not embedded yet.

    The anti-join runs before the encoder, the costly step. A vector of another width than
    the candidate states ends the job.
    """
    if existing is not None:
        done = existing.where(F.col("model") == candidate.name).select("chunk_id")
        chunks = unseen_wide(chunks, done, "chunk_id")
    encode = embed(checked(candidate))
    return tables.spread(chunks).withColumns(
        {"embedding": encode("chunk"), "model": F.lit(candidate.name)}
    )


def embed_table(
    spark: SparkSession, chunks: str, embeddings: str, candidate: Candidate, full: bool = True
) -> int:
    """Write the embeddings table: rebuilt in ``full`` mode, otherwise appended to.

    The increment is by chunk and model, so after a change of model all chunks are
    embedded again, beside the old vectors.
    """
    written = Observation()
    source = tables.scan(spark, chunks)
    if full:
        tables.overwrite(embed_chunks(source, candidate), embeddings, written)
    else:
        existing = tables.scan(spark, embeddings, "chunk_id", "model")
        tables.append(embed_chunks(source, candidate, existing), embeddings, written)
    return written.get["rows"]
