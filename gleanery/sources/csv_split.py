"""CSV with line feeds inside quotes, read by many tasks.

Files are split between lines, so a block of one may begin inside a quoted field. Whether it
does follows from the number of quotes before it: blocks are counted first, the counts' parity
is carried from block to block, and with it every block finds the records it holds whole.
What a block begins or ends in the midst of is handed on as a fragment, at most two per
block, and fragments of one record are put together. Texts are not shuffled.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Time stamps keep their microseconds.
FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
}
WHOLE, HEAD, THROUGH, TAIL = range(4)
BATCH_ROWS = 10_000


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of blocks, in order, to records and fragments.

    ``kind`` says what a row is, ``first`` whether it begins its file.
    """
    block, pieces, open_, begins, seen = None, [], False, False, 0
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 5
        out.clear()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["file", "start", "kind", "first", "record"])

    def end_block() -> None:
        if block is not None and pieces:
            out.append((*block, THROUGH if begins else TAIL, block[1] == 0 and seen == 0,
                        "\n".join(pieces)))
            pieces.clear()

    for rows in batches:
        columns = [rows.column(n).to_pylist() for n in ("file", "start", "inside", "value")]
        for file, start, inside, value in zip(*columns):
            if (file, start) != block:
                end_block()
                block, open_, begins, seen = (file, start), inside, inside, 0
            pieces.append(value)
            open_ ^= bool(value.count('"') % 2)
            if not open_:
                kind = HEAD if begins else WHOLE
                out.append((file, start, kind, start == 0 and seen == 0, "\n".join(pieces)))
                pieces.clear()
                begins = False
                seen += 1
        if len(out) >= BATCH_ROWS:
            yield batch()
    end_block()
    if out:
        yield batch()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``first, record`` of every record, as text; line feeds inside quotes are part of it."""
    lines = (
        spark.read.option("lineSep", "\n").text(path)
        .select(F.xxhash64("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("start"), "value")
    )
    by_file = Window.partitionBy("file").orderBy("start")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "start").agg(F.sum(_quotes(F.col("value"))).alias("quotes"))
    # A row of three numbers per block.
    parity = blocks.select(
        F.col("file").alias("of"), F.col("start").alias("at"),
        (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    same = (F.col("file") == F.col("of")) & (F.col("start") == F.col("at"))
    placed = lines.join(F.broadcast(parity), same).select("file", "start", "inside", "value")
    found = placed.mapInArrow(
        _records, "file long, start long, kind int, first boolean, record string")
    whole = found.where(F.col("kind") == WHOLE).select("first", "record")
    # A record in pieces begins with a tail; of one block the head comes before the tail.
    parts = found.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", "kind")
    chains = parts.withColumn("chain", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    joined = chains.groupBy("file", "chain").agg(
        F.bool_or("first").alias("first"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("pieces"))
    glued = F.array_join(F.transform("pieces", lambda p: p["record"]), "\n")
    return whole.unionByName(joined.select("first", glued.alias("record")))


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of ``read_csv(path, schema)``, also with line feeds inside quotes, from as
    many tasks as the files have splits. Every file begins with a header row."""
    record = F.regexp_replace("record", "\r$", "")
    options = {"escape": '"', **FORMATS}
    parsed = csv_records(spark, path).where(~F.col("first")).select(record.alias("record")).where(
        F.trim("record") != "")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return parsed.select(F.from_csv("record", columns, options).alias("r")).select("r.*")
