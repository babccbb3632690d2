import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import session
from gleanery.operators.keys import unseen
from gleanery.sources import csv, csv_split, tables
from gleanery.streaming import filters, ingest
from gleanery.streaming.ingest import read_store, start_dedup_ingest
from gleanery.streaming.sync import (
    read_index, read_state_index, start_index_sync, start_state_sync,
)
from tests.conftest import values


def test_csv_folder_to_tables(spark, database, tmp_path):
    (tmp_path / "people.csv").write_text(
        'id,score,day,name\n1,1.5,2020-01-02,"Ö, x"\n2,2.5,2020-01-03,y\n', encoding="utf-8")
    (tmp_path / "notes.txt").write_text("id\n9\n")
    for _ in range(2):
        assert csv.load_csv_folder(spark, str(tmp_path), database) == [f"{database}.people"]
    people = spark.table(f"{database}.people")
    assert [f.dataType.simpleString() for f in people.schema] == ["int", "double", "date", "string"]
    assert values(people, "id", "name", "day") == [
        (1, "Ö, x", dt.date(2020, 1, 2)), (2, "y", dt.date(2020, 1, 3))]


def test_csv_round_trip_with_quotes_and_line_feeds(spark, tmp_path):
    rows = [(1, 'say "hi", twice', 0.1 + 0.2), (2, "two\nlines", 1e-17), (3, None, None)]
    schema = T.StructType([T.StructField("id", T.IntegerType()),
                           T.StructField("text", T.StringType()),
                           T.StructField("x", T.DoubleType())])
    df = spark.createDataFrame(rows, schema)
    path = csv.dump_csv(df, str(tmp_path), "odd")
    assert csv.list_csv(spark, str(tmp_path)).keys() == {"odd"}
    back = csv.read_csv(spark, path, schema, multi_line=True)
    assert values(back, "id", "text", "x") == values(df, "id", "text", "x")


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_and_reruns_add_nothing(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "k string, v int"
    write(spark, source, [("a", 2), ("a", 1), ("b", 3), ("b", 4)], schema)
    registry = spark.createDataFrame([("b",)], "k string")

    def run(checkpoint):
        stream = unseen(spark.readStream.schema(schema).parquet(source), registry, "k")
        start_dedup_ingest(stream, store, "k", str(tmp_path / checkpoint)).awaitTermination()
        return values(read_store(spark, store, stream.schema), "k", "v")

    assert run("one") == [("a", 1)]
    assert run("one") == [("a", 1)]
    assert run("two") == [("a", 1)]
    write(spark, source, [("c", 5), ("a", 0)], schema)
    assert run("one") == [("a", 1), ("c", 5)]
    assert run("two") == [("a", 1), ("c", 5)]


def test_repeated_batch_leaves_the_same_rows(spark, tmp_path):
    """The folder of a batch is overwritten when the batch is run again after a failure."""
    import shutil

    source, store, checkpoint = (str(tmp_path / n) for n in ["in", "store", "check"])
    write(spark, source, [("a", 1), ("b", 2)], "k string, v int")
    stream = spark.readStream.schema("k string, v int").parquet(source)
    start_dedup_ingest(stream, store, "k", checkpoint).awaitTermination()
    shutil.rmtree(f"{checkpoint}/commits")
    start_dedup_ingest(stream, store, "k", checkpoint).awaitTermination()
    assert values(read_store(spark, store, stream.schema), "k", "v") == [("a", 1), ("b", 2)]


def test_index_sync(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ["in", "log", "check"])
    schema = "k string, version long, deleted boolean, v int"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        start_index_sync(stream, log, "k", "version", checkpoint).awaitTermination()
        return values(read_index(spark, log, stream.schema, "k", "version"), "k", "v")

    write(spark, source, [("a", 1, False, 1), ("a", 2, False, 2), ("b", 1, False, 5)], schema)
    assert run() == [("a", 2), ("b", 5)]
    write(spark, source, [("b", 2, True, None), ("c", 1, False, 7)], schema)
    assert run() == [("a", 2), ("c", 7)]


def test_scratch_folder_follows_the_session(spark):
    root = session.shared_root(spark)
    set_by_cluster = spark.conf.get(session.CHECKPOINT_KEY, None)
    if set_by_cluster:
        assert root == set_by_cluster
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


@pytest.mark.parametrize("split", ["200", "3k", "64m"])
def test_quoted_line_feeds_in_split_files(spark, tmp_path, split):
    """Rows equal those of the read that takes a file whole, wherever the splits fall."""
    rng = random.Random(int(split[0]))
    schema = "a int, t string, u string"
    rows = []
    for i in range(700):
        t = rng.choice(['plain', 'line\nfeed', 'a "quoted" word', '"', '"\n"', "\n\n", " pad ", "",
                        None, "x" * 500, 'long ' * 50 + '\n' + '"y", ' * 40, "cr\r\nlf", "é\n😀"])
        rows.append((i, t, rng.choice(["z", "", None, '",\n"'])))
    df = spark.createDataFrame(rows, schema)
    path = csv.dump_csv(df.repartition(2), str(tmp_path), "t")
    want = values(csv.read_csv(spark, path, df.schema), "a", "t", "u")
    before = {c: spark.conf.get(c) for c in
              ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = csv_split.read_csv_split(spark, path, df.schema)
        tasks = spark.read.text(path).rdd.getNumPartitions()
        assert values(got, "a", "t", "u") == want
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert tasks > 10 or split == "64m"


def test_filters_hold_what_was_put_in():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 20_000):
        inside = rng.integers(-2**63, 2**63 - 1, n)
        packed = filters.bloom(inside).tobytes()
        assert filters.may_hold(packed, inside).all()
        other = rng.integers(-2**63, 2**63 - 1, 20_000)
        assert filters.may_hold(packed, other).mean() < 0.01


@pytest.mark.parametrize("shard_keys", [filters.SHARD_KEYS, 20])
def test_a_batch_opens_only_folders_its_filters_name(spark, tmp_path, monkeypatch, shard_keys):
    monkeypatch.setattr(filters, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(filters, "GROUP_KEYS", shard_keys)
    schema = "k string, v int"
    store, source = f"{tmp_path}/store", f"{tmp_path}/source"
    for start in (0, 100, 200):
        rows = [(f"k{i}", i) for i in range(start, start + 100)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        start_dedup_ingest(stream, store, "k", f"{tmp_path}/run{start}").awaitTermination()
    assert len(filters.folders_of(spark, store)) == 3
    assert filters.folders_of(spark, f"{store}/{filters.FILTERS}") == filters.folders_of(spark, store)
    asked = spark.createDataFrame(
        [(f"k{i}", -i) for i in [*range(150, 160), *range(900, 905)]], schema)
    maybe, places = ingest._maybe(asked, store, "k", None)
    (holder,) = [p for p in filters.folders_of(spark, store)
                 if spark.read.parquet(f"{store}/{p}").where("k = 'k150'").count()]
    assert places == [holder]
    assert values(ingest.unstored(asked, store, "k"), "k", "v") == [
        (f"k{i}", -i) for i in range(900, 905)]
    none = spark.createDataFrame([("z1", 1)], schema)
    assert ingest._maybe(none, store, "k", None)[1] == [] and ingest.unstored(
        none, store, "k").count() == 1
    # A folder that lost its filter is opened; the rows are the same.
    filters.drop_filter(spark, store, places[0])
    assert holder in ingest._maybe(none, store, "k", None)[1]
    assert values(ingest.unstored(asked, store, "k"), "k") == [(f"k{i}",) for i in range(900, 905)]
    rows = read_store(spark, store, spark.createDataFrame([], schema).schema)
    assert rows.count() == 300


def test_state_index(spark, tmp_path):
    """Newest versions, late and repeated ones, deletions, and restarts from the checkpoint."""
    schema = "k string, v long, deleted boolean, t string, e array<float>"
    folder, checkpoint = f"{tmp_path}/changes", f"{tmp_path}/state"
    newest = {}
    batches = [
        [("a", 1, False, "a1", [1.0]), ("b", 1, False, "b1", None), ("a", 2, False, "a2", [2.0]),
         ("c", 5, True, None, None), (None, 1, False, "lost", None)],
        [("a", 1, False, "late", [9.0]), ("b", 2, True, None, None), ("a", 2, False, "a2", [2.0]),
         ("d", 1, False, "d1", [])],
        [("b", 3, False, "b3", [3.0]), ("d", 2, True, "x", None), ("d", 1, False, "d1", [])],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        start_state_sync(stream, "k", "v", checkpoint).awaitTermination()
        for k, v, deleted, t, e in rows:
            if k and v > newest.get(k, (0,))[0]:
                newest[k] = v, deleted, t, e
        index = read_state_index(spark, checkpoint, "k")
        assert values(index, "k", "v", "t", "e") == sorted(
            [(k, v, t, e) for k, (v, deleted, t, e) in newest.items() if not deleted], key=repr)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Window", "Exchange", "Aggregate", "Sort"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) in (
        None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")


def test_scan_reads_only_named_columns(spark):
    df = tables.scan(spark, "/root/testdata/sf0.001/documents.parquet", "doc_id")
    plan = df.where(F.col("doc_id") > 5)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "GreaterThan(doc_id,5)" in plan


def test_spread_leaves_large_inputs_alone(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan(tables.spread(df))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        assert "Exchange" not in plan(tables.spread(df))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_local_rows_keep_types_of_empty_columns(spark):
    df = tables.local_rows(spark, [(None, None)], T.StructType([
        T.StructField("a", T.DateType()), T.StructField("b", T.IntegerType())]))
    assert [f.dataType.simpleString() for f in df.schema] == ["date", "int"]
    with pytest.raises(Exception):
        tables.local_rows(spark, [("x", 1)], df.schema).collect()
