"""Incremental chunking of an article table."""

from collections.abc import Callable

from pyspark.sql import Column, Observation, SparkSession

from gleanery import schemas
from gleanery.functions.splitter import recursive_chunks
from gleanery.operators.chunks import chunk_new_documents
from gleanery.sources import tables


def chunk_table(
    spark: SparkSession,
    abstracts: str,
    chunks: str,
    splitter: Callable[[Column], Column] | None = None,
    lexical: bool = True,
) -> int:
    """Append the chunks of abstracts not chunked before; returns the rows written.

    The count is observed during the write, so the plan runs once.
    """
    tables.ensure_table(spark, chunks, schemas.CHUNKS)
    rows = chunk_new_documents(
        tables.scan(spark, abstracts, "pmid", "abstract"),
        tables.scan(spark, chunks, "pmid"),
        "pmid",
        "abstract",
        splitter or recursive_chunks(),
        lexical,
        co_bucketed=tables.bucketed_alike(spark, abstracts, chunks),
    )
    written = Observation()
    tables.append(rows, chunks, written)
    return written.get["rows"]
