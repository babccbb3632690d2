"""Registered queries: CSV dump and load, streams. They write below the shared folder."""

import uuid
from functools import reduce

from pyspark.sql import functions as F

from gleanery import session
from gleanery.operators.keys import keyed_update, unseen
from gleanery.queries.common import stream_table, table
from gleanery.sources import parted, tables
from gleanery.sources.csv import dump_csv, dump_tables, list_csv, read_csv
from gleanery.sources.csv_split import read_csv_split
from gleanery.streaming.ingest import read_store, start_dedup_ingest
from gleanery.streaming.sync import (
    compact_index, read_index, read_state_index, start_index_sync, start_state_sync,
)

# Table and its key, for the dump of every table without arrays.
DATABASE = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": "l_orderkey",
    "events": "event_id",
    "documents": "doc_id",
    "pages": "page_id",
    "benchmark": "item_id",
    "labels": "doc_id",
    "conversations": "conv_id",
}


def csv_roundtrip(spark, sf):
    """Tables dumped, then found and read back with their schemas: rows, key sums, and whether
    digests over all columns of all rows add up to the same before and after."""
    folder = session.scratch_path(spark, "csv-dump")
    dump_tables(list(DATABASE), lambda name: table(spark, sf, name), folder)
    loaded = []
    for name, path in list_csv(spark, folder).items():
        source = table(spark, sf, name)
        rows = read_csv(spark, path, source.schema)
        before = source.agg(_digest(source).alias("digest"))
        loaded.append(
            rows.agg(
                F.count(F.lit(1)).alias("row_count"),
                F.sum(F.col(DATABASE[name]).cast("long")).alias("key_sum"),
                _digest(rows).alias("digest"),
            ).select(
                F.lit(name).alias("table_name"), "row_count", "key_sum",
                F.col("digest").eqNullSafe(before.scalar()).alias("same_rows"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), loaded)


def _digest(df):
    """A number that depends on every value of every row, not on their order."""
    parts = [x for c in df.columns for x in (F.col(c), F.col(c).isNull())]
    return F.sum(F.xxhash64(*parts).cast("decimal(38,0)"))


def table_roundtrip(spark, sf):
    """A table made twice over, replaced, appended to and read back, with rows of our own."""
    name = f"scratch_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {name} LOCATION '{session.scratch_path(spark, 'tables')}'")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    for _ in range(2):
        tables.ensure_table(spark, f"{name}.nations", nations.schema, "n_nationkey", 2)
    for _ in range(2):
        tables.overwrite(nations, f"{name}.nations")
    own = tables.local_rows(spark, [(100, "Atlantis"), (101, None)], nations.schema)
    tables.append(own, f"{name}.nations")
    tables.swap(tables.scan(spark, f"{name}.nations").where("n_nationkey <> 0"), f"{name}.nations")
    rows = tables.scan(spark, f"{name}.nations").checkpoint()
    spark.sql(f"DROP SCHEMA {name} CASCADE")
    return rows


def touched_update(spark, sf):
    """Balances in a table of hash parts, raised for the customers of one nation."""
    name = f"scratch_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {name} LOCATION '{session.scratch_path(spark, 'parts')}'")
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    parted.ensure_parted(spark, f"{name}.customers", rows.schema, "c_custkey", 8)
    parted.parted_append(rows, f"{name}.customers")
    raised = rows.where("c_nationkey = 3").select("c_custkey")
    parted.update_touched(
        spark, f"{name}.customers", raised,
        lambda held: keyed_update(
            held, raised, ["c_custkey"], {"c_acctbal": F.col("t.c_acctbal") + 100}))
    found = parted.parted_scan(spark, f"{name}.customers").checkpoint()
    spark.sql(f"DROP SCHEMA {name} CASCADE")
    return found


def csv_load(spark, sf):
    """Customers through CSV with inferred types; another file type beside it is left out."""
    folder = session.scratch_path(spark, "csv-load")
    dump_csv(table(spark, sf, "customer"), folder, "customer")
    table(spark, sf, "region").select("r_name").write.text(f"{folder}/region.txt")
    (path,) = list_csv(spark, folder).values()
    rows = read_csv(spark, path)
    return rows.withColumn("c_custkey", F.col("c_custkey").cast("long"))


def csv_split_read(spark, sf):
    """Documents, whose texts hold line feeds, through CSV that is split between tasks."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = dump_csv(docs, session.scratch_path(spark, "csv-split"), "documents")
    rows = read_csv_split(spark, path, docs.schema)
    return rows.withColumn("text", F.md5(F.col("text").cast("binary")))


def stream_dedup_ingest(spark, sf):
    """First event of every user, read as a stream; a second run adds nothing."""
    store = session.scratch_path(spark, "ingest-store")
    events = table(spark, sf, "events")
    order = [F.asc("ts"), F.asc("event_id")]
    for run in ["first", "second"]:
        checkpoint = session.scratch_path(spark, f"ingest-{run}")
        stream = stream_table(spark, sf, "events")
        start_dedup_ingest(stream, store, "user_id", checkpoint, order).awaitTermination()
    return read_store(spark, store, events.schema).select(*events.columns)


def stream_new_documents(spark, sf):
    """Documents streamed against a registry: the same rows as the batch anti-join."""
    registry = table(spark, sf, "labels")
    store = session.scratch_path(spark, "document-store")
    stream = stream_table(spark, sf, "documents")
    fresh = unseen(stream, registry, "doc_id")
    checkpoint = session.scratch_path(spark, "document-run")
    start_dedup_ingest(fresh, store, "doc_id", checkpoint).awaitTermination()
    return read_store(spark, store, fresh.schema).select("doc_id", "lang", "n_chars")


def stream_index_sync(spark, sf):
    """Events as changes of a per-user index entry; an error event deletes the entry.

    All changes arrive twice, and the log is folded before it is read.
    """
    stream = stream_table(spark, sf, "events")
    changes = stream.select(
        "user_id", "event_id", (F.col("event_type") == "error").alias("deleted"), "value"
    )
    log = session.scratch_path(spark, "index-log")
    checkpoint = session.scratch_path(spark, "index-run")
    start_index_sync(changes, log, "user_id", "event_id", checkpoint).awaitTermination()
    again = session.scratch_path(spark, "index-run")
    start_index_sync(changes, log, "user_id", "event_id", again).awaitTermination()
    compact_index(spark, log, changes.schema, "user_id", "event_id")
    index = read_index(spark, log, changes.schema, "user_id", "event_id")
    return index.select("user_id", "event_id", "value")


def stream_state_index(spark, sf):
    """The same index from the stream's own state, every change arriving twice."""
    stream = stream_table(spark, sf, "events")
    changes = stream.select(
        "user_id", "event_id", (F.col("event_type") == "error").alias("deleted"), "value"
    )
    checkpoint = session.scratch_path(spark, "state-index")
    for _ in range(2):
        start_state_sync(
            changes.unionByName(changes), "user_id", "event_id", checkpoint).awaitTermination()
    return read_state_index(spark, checkpoint, "user_id").select("user_id", "event_id", "value")


QUERIES = {
    "csv_roundtrip": csv_roundtrip,
    "table_roundtrip": table_roundtrip,
    "touched_update": touched_update,
    "csv_load": csv_load,
    "csv_split_read": csv_split_read,
    "stream_dedup_ingest": stream_dedup_ingest,
    "stream_new_documents": stream_new_documents,
    "stream_index_sync": stream_index_sync,
    "stream_state_index": stream_state_index,
}

_NEWEST_SQL = """
    SELECT user_id, event_id, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place
      FROM events
    ) WHERE place = 1 AND event_type <> 'error'"""

ORACLES = {
    "csv_roundtrip": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count,"
        f" CAST(sum({key}) AS BIGINT) AS key_sum, true AS same_rows FROM {name}"
        for name, key in DATABASE.items()
    ),
    "table_roundtrip": """
        SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 0
        UNION ALL VALUES (100, 'Atlantis'), (101, NULL)""",
    "touched_update": """
        SELECT c_custkey, c_nationkey,
               c_acctbal + CASE WHEN c_nationkey = 3 THEN 100 ELSE 0 END AS c_acctbal
        FROM customer""",
    "csv_load": "SELECT * FROM customer",
    "csv_split_read": "SELECT doc_id, md5(text) AS text, lang, source, n_chars FROM documents",
    "stream_dedup_ingest": """
        SELECT event_id, ts, user_id, event_type, value, props FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place
          FROM events
        ) WHERE place = 1""",
    "stream_new_documents": """
        SELECT doc_id, lang, n_chars FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "stream_index_sync": _NEWEST_SQL,
    "stream_state_index": _NEWEST_SQL,
}
