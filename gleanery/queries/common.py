"""Table access and SQL pieces shared by the registered queries."""

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream; the glob matches a single file and a folder of parts."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


# Windows of 250 characters, each 150 further on, over the whole text of every document.
WINDOWS_SQL = """
windows AS (
  SELECT doc_id, i AS pos, substring(text, CAST(i * 150 + 1 AS BIGINT), 250) AS chunk
  FROM (
    SELECT doc_id, text,
           unnest(range(greatest(1, CAST(ceil((length(text) - 100) / 150.0) AS BIGINT)))) AS i
    FROM documents WHERE length(text) > 0
  )
)"""

LEXICAL_SQL = WINDOWS_SQL + """,
lexical AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 AS INTEGER)
           AS chunk_index, chunk
  FROM windows
),
chunks AS (
  SELECT doc_id, doc_id || '_chunk_' || chunk_index AS chunk_id, chunk_index, chunk FROM lexical
)"""


def hashed_sql(name: str, source: str, key: str, text: str, dimension: int) -> str:
    """CTE ``name(key, b, raw, v)``: hashed word counts as stored, in 32-bit floats, and scaled
    to unit length again."""
    return f"""
{name} AS (
  SELECT {key}, b, raw, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS v FROM (
    SELECT {key}, b, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE)
             AS raw
    FROM (
      SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dimension} AS b,
             CAST(count(*) AS DOUBLE) AS n
      FROM (
        SELECT {key}, unnest(string_split(replace({text}, chr(10), ' '), ' ')) AS w FROM {source}
      ) WHERE w <> '' GROUP BY 1, 2
    )
  )
)"""


def rendered_sql(template: str, **columns: str) -> str:
    """SQL expression of a prompt template with columns at its ``{name}`` places."""
    pieces = re.split("(" + "|".join(re.escape("{" + name + "}") for name in columns) + ")", template)
    return " || ".join(
        columns[piece[1:-1]] if piece[1:-1] in columns else "'" + piece.replace("'", "''") + "'"
        for piece in pieces if piece
    )
