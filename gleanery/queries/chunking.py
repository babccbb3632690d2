"""Registered queries: scans, filters and chunking of documents."""

from pyspark.sql import functions as F

from gleanery import fixed_values as fixed
from gleanery.functions import splitter as splitting
from gleanery.functions.text import fixed_windows
from gleanery.operators import chunks as ops
from gleanery.operators.sampling import long_enough
from gleanery.queries.common import LEXICAL_SQL, WINDOWS_SQL, table


def scan_project(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "lang", "source")


def length_filter(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.where(long_enough(F.col("text"))).select(
        "doc_id", F.length("text").alias("chars")
    )


def fixed_chunks(spark, sf):
    docs = table(spark, sf, "documents").where(F.length("text") > 0)
    return docs.select("doc_id", F.posexplode(fixed_windows(F.col("text"))).alias("pos", "chunk"))


def chunk_index_lexical(spark, sf):
    return ops.chunk_documents(table(spark, sf, "documents"), "doc_id", "text")


def chunk_index_position(spark, sf):
    return ops.chunk_documents(table(spark, sf, "documents"), "doc_id", "text", lexical=False)


def chunk_index_shared_key(spark, sf):
    """Many documents under one key: chunks numbered by text order within a source."""
    docs = table(spark, sf, "documents").where(F.length("text") > 0)
    rows = docs.select("source", F.explode(fixed_windows(F.col("text"))).alias("chunk"))
    return ops.index_chunks(rows, "source")


def incremental_chunk(spark, sf):
    """Chunks of the documents that carry no label yet."""
    docs, done = table(spark, sf, "documents"), table(spark, sf, "labels")
    return ops.chunk_new_documents(docs, done, "doc_id", "text")


def chunk_stats(spark, sf):
    docs, done = table(spark, sf, "documents"), table(spark, sf, "labels")
    return ops.chunk_counts(docs, done, "doc_id", "text")


def recursive_chunks(spark, sf):
    docs = table(spark, sf, "documents")
    return ops.chunk_documents(
        docs, "doc_id", "text", splitting.recursive_chunks(), lexical=False
    )


QUERIES = {
    "scan_project": scan_project,
    "length_filter": length_filter,
    "fixed_chunks": fixed_chunks,
    "chunk_index_lexical": chunk_index_lexical,
    "chunk_index_position": chunk_index_position,
    "chunk_index_shared_key": chunk_index_shared_key,
    "incremental_chunk": incremental_chunk,
    "chunk_stats": chunk_stats,
    "recursive_chunks": recursive_chunks,
}

def _recursive_sql() -> str:
    """The recursive splitter level by level.

    ``t`` holds the texts a level has to cut, ``p`` their pieces, ``r`` the runs of short
    pieces; long pieces, and texts without the separator, go to the next level. A run is
    packed by its running lengths: a window ends where the next piece would pass the size,
    and the next one starts where what is carried over fits the overlap and the size.
    """
    size, overlap = fixed.CHUNK_SIZE, fixed.CHUNK_OVERLAP
    levels = ["t0 AS (SELECT doc_id, [0] AS path, text FROM documents WHERE length(text) > 0)"]
    separators = fixed.SEPARATORS[:-1]
    for n, separator in enumerate(separators):
        mark = "'" + separator.replace("\n", "' || chr(10) || '") + "'"
        levels.append(f"""
p{n} AS (
  SELECT doc_id, path, i, piece FROM (
    SELECT doc_id, path, unnest(range(1, len(parts) + 1)) AS i,
           unnest(list_transform(parts, lambda x, k: CASE WHEN k = 1 THEN x ELSE {mark} || x END))
             AS piece
    FROM (SELECT doc_id, path, string_split(text, {mark}) AS parts FROM t{n}
          WHERE contains(text, {mark}))
  ) WHERE piece <> ''
),
r{n} AS (
  SELECT doc_id, list_append(path, CAST(min(i) AS INTEGER)) AS place, list(piece ORDER BY i) AS pieces
  FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, path ORDER BY i) AS run
    FROM p{n} WHERE length(piece) < {size}
  ) GROUP BY doc_id, path, run
),
t{n + 1} AS (
  SELECT doc_id, list_append(path, 0) AS path, text FROM t{n} WHERE NOT contains(text, {mark})
  UNION ALL
  SELECT doc_id, list_append(path, CAST(i AS INTEGER)), piece FROM p{n} WHERE length(piece) >= {size}
)""")
    runs = " UNION ALL ".join(f"SELECT * FROM r{n}" for n in range(len(separators)))
    return f"""
        WITH RECURSIVE {",".join(levels)},
        runs AS (
          SELECT *, list_transform(range(0, len(pieces) + 1),
                      lambda k: length(array_to_string(pieces[1 : k], ''))) AS upto
          FROM ({runs})
        ),
        packed AS (
          SELECT *, len(list_filter(upto, lambda v: v <= {size})) - 1 AS stop, 0 AS start FROM runs
          UNION ALL
          SELECT doc_id, place, pieces, upto,
                 len(list_filter(upto, lambda v: v <= upto[fresh + 1] + {size})) - 1, fresh
          FROM (
            SELECT *, len(list_filter(upto, lambda v:
                        v < greatest(upto[stop + 1] - {overlap}, upto[stop + 2] - {size}))) AS fresh
            FROM packed WHERE stop < len(pieces)
          )
        ),
        cut AS (
          SELECT doc_id, place, start, array_to_string(pieces[start + 1 : stop], '') AS chunk
          FROM packed
          UNION ALL
          SELECT doc_id, path, start, substring(text, start + 1, {size}) FROM (
            SELECT *, unnest(range(0, greatest(1, length(text) - {overlap}), {size - overlap}))
                     AS start
            FROM t{len(separators)}
          )
        ),
        numbered AS (
          SELECT doc_id, chunk, CAST(row_number() OVER (
                   PARTITION BY doc_id ORDER BY place, start) - 1 AS INTEGER) AS chunk_index
          FROM (SELECT doc_id, place, start,
                       trim(chunk, ' ' || chr(9) || chr(10) || chr(13)) AS chunk FROM cut)
          WHERE chunk <> ''
        )
        SELECT doc_id, doc_id || '_chunk_' || chunk_index AS chunk_id, chunk_index, chunk
        FROM numbered"""


ORACLES = {
    "recursive_chunks": _recursive_sql(),
    "scan_project": "SELECT doc_id, lang, source FROM documents",
    "length_filter": """
        SELECT doc_id, CAST(length(text) AS INTEGER) AS chars
        FROM documents WHERE length(text) > 200""",
    "fixed_chunks": f"""
        WITH {WINDOWS_SQL}
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, chunk FROM windows""",
    "chunk_index_lexical": f"""
        WITH {LEXICAL_SQL}
        SELECT doc_id, chunk_id, chunk_index, chunk FROM chunks""",
    "chunk_index_position": f"""
        WITH {WINDOWS_SQL}
        SELECT doc_id, doc_id || '_chunk_' || pos AS chunk_id,
               CAST(pos AS INTEGER) AS chunk_index, chunk FROM windows""",
    "chunk_index_shared_key": f"""
        WITH {WINDOWS_SQL},
        numbered AS (
          SELECT source, chunk, CAST(row_number() OVER (PARTITION BY source ORDER BY chunk) - 1
                                     AS INTEGER) AS chunk_index
          FROM windows JOIN documents USING (doc_id)
        )
        SELECT source, source || '_chunk_' || chunk_index AS chunk_id, chunk_index, chunk
        FROM numbered""",
    "incremental_chunk": f"""
        WITH {LEXICAL_SQL}
        SELECT doc_id, chunk_id, chunk_index, chunk FROM chunks
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "chunk_stats": f"""
        WITH {WINDOWS_SQL},
        fresh AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
        SELECT (SELECT count(*) FROM documents) AS documents,
               (SELECT count(*) FROM fresh) AS new_documents,
               (SELECT count(*) FROM windows WHERE doc_id IN (SELECT doc_id FROM fresh)) AS chunks,
               (SELECT count(*) FROM windows WHERE doc_id IN (SELECT doc_id FROM fresh))
                 / CAST((SELECT count(*) FROM fresh) AS DOUBLE) AS chunks_per_new_document""",
}
