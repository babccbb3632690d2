"""Documents to chunk rows."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import chunk_id, fixed_windows
from gleanery.operators.keys import unseen_wide
from gleanery.operators.running import hot_keys, running
from gleanery.sources.tables import spread

COPY_BLOCK = 100_000


def chunk_documents(
    documents: DataFrame,
    key: str,
    text: str,
    splitter: Callable[[Column], Column] = fixed_windows,
    lexical: bool = True,
) -> DataFrame:
    """Rows ``(key, chunk_id, chunk_index, chunk)``; documents without text give none.

    ``lexical`` numbers the chunks of a document in text order, otherwise by position.
    The key is the table's key, so a document is one row and its chunks can be
    numbered inside that row: no text is shuffled, whatever the length of a document.
    For rows that share a key use :func:`index_chunks`.
    """
    pieces = splitter(F.col(text))
    if lexical:
        pieces = F.sort_array(pieces)
    return (
        spread(documents.select(key, text).where(F.length(text) > 0))
        .select(key, F.posexplode(pieces).alias("chunk_index", "chunk"))
        .select(key, chunk_id(F.col(key), F.col("chunk_index")).alias("chunk_id"),
                "chunk_index", "chunk")
    )


def index_chunks(
    chunks: DataFrame, key: str, chunk: str = "chunk", hot: DataFrame | None = None
) -> DataFrame:
    """Number chunk rows of any origin by text order within each key, from 0.

    Equal chunks of one key are counted before the exchange and stay one row until
    their numbers are known, and the rows of a hot key are numbered by range partitions,
    so neither copies nor a hot key end up in one task.
    """
    hot = hot_keys(chunks, [key]) if hot is None else hot
    counted = chunks.groupBy(key, F.col(chunk).alias("chunk")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    numbered = running(
        counted, [key], ["chunk"], number="end", weight=F.col("copies"), hot=hot
    )
    # In two steps, so that no array grows with the number of copies.
    blocks = numbered.select(
        key, "chunk", "end",
        F.explode(F.sequence(F.col("end") - F.col("copies"), F.col("end") - 1,
                             F.lit(COPY_BLOCK).cast("long"))).alias("first"),
    )
    last = F.least(F.col("end"), F.col("first") + COPY_BLOCK) - 1
    index = F.col("chunk_index").cast("int")
    return blocks.select(
        key, "chunk", F.explode(F.sequence("first", last)).alias("chunk_index")
    ).select(key, chunk_id(F.col(key), index).alias("chunk_id"), index.alias("chunk_index"), "chunk")


def chunk_new_documents(
    documents: DataFrame,
    chunked: DataFrame,
    key: str,
    text: str,
    splitter: Callable[[Column], Column] = fixed_windows,
    lexical: bool = True,
    co_bucketed: bool = False,
) -> DataFrame:
    """Chunks of the documents whose key is not among the ``chunked`` rows.

    Documents without text are dropped before the join: they never give a chunk, so
    they would come back in every run.
    """
    with_text = documents.select(key, text).where(F.length(text) > 0)
    pending = unseen_wide(with_text, chunked, key, co_bucketed)
    return chunk_documents(pending, key, text, splitter, lexical)


def chunk_counts(
    documents: DataFrame,
    chunked: DataFrame,
    key: str,
    text: str,
    splitter: Callable[[Column], Column] = fixed_windows,
) -> DataFrame:
    """One row: documents, documents not chunked before, their chunks, chunks per new document.

    One pass; chunks are counted where the text is read, so only numbers are joined.
    """
    sized = spread(documents.select(key, text)).select(key, F.size(splitter(F.col(text))).alias("pieces"))
    done = chunked.select(key).distinct().withColumn("done", F.lit(True))
    new = F.col("done").isNull()
    return (
        sized.join(done, key, "left")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.count_if(new).alias("new_documents"),
            F.coalesce(F.sum(F.when(new, F.col("pieces"))), F.lit(0)).alias("chunks"),
        )
        .withColumn(
            "chunks_per_new_document",
            F.coalesce(F.try_divide(F.col("chunks"), F.col("new_documents")), F.lit(0.0)),
        )
    )
