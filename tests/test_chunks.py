import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.functions.splitter import RecursiveSplitter, recursive_chunks
from gleanery.functions.text import fixed_windows, render, short_name, without_prompt
from gleanery.operators.chunks import chunk_documents, chunk_new_documents, index_chunks
from gleanery.operators.running import hot_keys
from gleanery.plans.chunking import chunk_table
from gleanery.sources import tables
from tests.conftest import values

TEXTS = {
    "none": None, "empty": "", "one": "a", "exact": "b" * 250, "over": "c" * 251,
    "long": "d" * 600, "paragraphs": "first part.\n\nsecond part",
}


def windows(text, size=250, overlap=100):
    if not text:
        return []
    found, start = [text[:size]], size - overlap
    while start < len(text) - overlap:
        found.append(text[start:start + size])
        start += size - overlap
    return found


def test_fixed_windows_fixture(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "k string, t string")
    counts = dict(values(df.select("k", F.size(fixed_windows(F.col("t"))).alias("n")), "k", "n"))
    assert counts == {"none": 0, "empty": 0, "one": 1, "exact": 1, "over": 2, "long": 4,
                      "paragraphs": 1}


@pytest.mark.parametrize("size,overlap", [(250, 100), (7, 3), (5, 0), (4, 3)])
def test_fixed_windows_brute_force(spark, size, overlap):
    rng = random.Random(size)
    alphabet = "ab \n.é漢😀"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 700))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r["w"] for r in
           df.select("k", fixed_windows(F.col("t"), size, overlap).alias("w")).collect()}
    assert got == {k: windows(t, size, overlap) for k, t in enumerate(texts)}


def test_windows_need_an_overlap_below_the_size():
    with pytest.raises(ValueError):
        fixed_windows(F.lit("x"), 10, 10)
    with pytest.raises(ValueError):
        RecursiveSplitter(10, 10)


def test_recursive_splitter_fixture():
    split = RecursiveSplitter().split
    assert split(None) == [] and split("") == [] and split(" \n ") == []
    assert split("a") == ["a"]
    assert split("first part.\n\nsecond part") == ["first part.\n\nsecond part"]
    assert [len(c) for c in split("d" * 600)] == [250, 250, 250, 150]
    paragraphs = "x" * 200 + "\n\n" + "y" * 200
    assert split(paragraphs) == ["x" * 200, "y" * 200]
    words = RecursiveSplitter(11, 4).split("one two three four")
    assert words == ["one two", "two three", "four"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_recursive_splitter_properties(text, size, overlap):
    chunks = RecursiveSplitter(size, overlap).split(text)
    assert all(0 < len(chunk) <= size and chunk == chunk.strip() for chunk in chunks)
    # Nothing is lost: every visible character is covered, in order.
    position = 0
    for chunk in chunks:
        assert chunk in text
    visible = set(text.split())
    if overlap == 0 and all(len(word) < size for word in visible):
        assert "".join("".join(chunks).split()) == "".join(text.split())
    assert position == 0


def test_recursive_chunks_udf(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "k string, t string")
    rows = chunk_documents(df, "k", "t", recursive_chunks(), lexical=False)
    counts = dict(values(rows.groupBy("k").agg(F.count("*").alias("n")), "k", "n"))
    assert counts == {"one": 1, "exact": 1, "over": 2, "long": 4, "paragraphs": 1}


def test_lexical_and_position_order(spark):
    df = spark.createDataFrame([("k", "zzyyxx")], "id string, t string")
    cut = lambda c: fixed_windows(c, 2, 0)
    lexical = chunk_documents(df, "id", "t", cut)
    assert values(lexical, "chunk_id", "chunk_index", "chunk") == [
        ("k_chunk_0", 0, "xx"), ("k_chunk_1", 1, "yy"), ("k_chunk_2", 2, "zz")]
    position = chunk_documents(df, "id", "t", cut, lexical=False)
    assert values(position, "chunk_index", "chunk") == [(0, "zz"), (1, "yy"), (2, "xx")]


def test_equal_chunks_get_their_own_index(spark):
    rows = spark.createDataFrame([("d", "same"), ("d", "same"), ("e", "x")], "id string, chunk string")
    assert values(index_chunks(rows, "id"), "id", "chunk_id", "chunk_index") == [
        ("d", "d_chunk_0", 0), ("d", "d_chunk_1", 1), ("e", "e_chunk_0", 0)]


def test_index_chunks_equals_window_under_skew(spark):
    from pyspark.sql import Window

    rng = random.Random(3)
    keys = ["hot"] * 600 + [f"k{i % 40}" for i in range(1200)]
    rows = [(k, rng.choice(["copy"] * 30 + [f"{rng.choice('abc')}{i}" for i in range(30)]))
            for k in keys] + [(None, "n1"), (None, "n0")]
    df = spark.createDataFrame(rows, "id string, chunk string")
    plain = df.withColumn(
        "chunk_index", F.row_number().over(Window.partitionBy("id").orderBy("chunk")) - 1
    )
    expected = values(plain, "id", "chunk_index", "chunk")
    hot = hot_keys(df, ["id"], hot_rows=100)
    assert values(hot, "id") == [("hot",)]
    for sliced in [hot, None]:
        indexed = index_chunks(df, "id", hot=sliced)
        assert values(indexed, "id", "chunk_index", "chunk") == expected


def test_incremental_chunking_adds_nothing_twice(spark, database):
    abstracts, chunks = f"{database}.abstracts", f"{database}.chunks"
    tables.ensure_table(spark, abstracts, schemas.ABSTRACTS, "pmid", 3)
    tables.append(spark.createDataFrame([("1", "t" * 400), ("2", ""), ("3", None)],
                                        schemas.ABSTRACTS), abstracts)
    assert chunk_table(spark, abstracts, chunks) == 2
    assert chunk_table(spark, abstracts, chunks) == 0
    tables.append(spark.createDataFrame([("4", "new text")], schemas.ABSTRACTS), abstracts)
    assert chunk_table(spark, abstracts, chunks) == 1
    assert values(spark.table(chunks), "chunk_id") == [
        ("1_chunk_0",), ("1_chunk_1",), ("4_chunk_0",)]


def test_bucketed_tables_are_anti_joined_without_a_shuffle(spark, database):
    abstracts, chunks = f"{database}.abstracts", f"{database}.chunks"
    tables.ensure_table(spark, abstracts, schemas.ABSTRACTS, "pmid", 3)
    tables.ensure_table(spark, chunks, schemas.CHUNKS, "pmid", 3)
    tables.append(spark.createDataFrame([("1", "t")], schemas.ABSTRACTS), abstracts)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from gleanery.operators.keys import unseen

        pending = unseen(spark.table(abstracts), spark.table(chunks), "pmid")
        plan = pending._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert values(pending, "pmid") == [("1",)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_chunking_shuffles_no_text_of_large_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        plan = chunk_documents(docs, "doc_id", "text")._jdf.queryExecution().executedPlan()
        assert "Exchange" not in plan.toString()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_new_documents_with_null_key_stay(spark):
    docs = spark.createDataFrame([("1", "a"), (None, "b")], "id string, t string")
    done = spark.createDataFrame([("1",)], "id string")
    assert values(chunk_new_documents(docs, done, "id", "t"), "id", "chunk") == [(None, "b")]


def test_text_expressions(spark):
    df = spark.createDataFrame([("org/sub/model", "P: x P: x y ")], "m string, g string")
    row = df.select(
        short_name(F.col("m")).alias("s"),
        without_prompt(F.col("g"), F.lit("P: x")).alias("w"),
        render("{a}-{b} {c}", a=F.lit("1"), b=F.lit(None)).alias("r"),
    ).head()
    assert (row["s"], row["w"], row["r"]) == ("model", "y", "1- {c}")
