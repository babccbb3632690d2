import os
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.operators import keys
from gleanery.plans import rotation as rotation_jobs
from gleanery.plans.parted_index import sync_parts
from gleanery.plans.ingest import IngestTables, ingest, search_report
from gleanery.sources import parted, tables
from gleanery.sources.articles import parse_articles, read_article_files
from tests.conftest import values


def test_unseen_keeps_repeats_and_nulls(spark):
    searched = spark.createDataFrame([("1",), ("1",), ("2",), ("2",), (None,)], "k string")
    registry = spark.createDataFrame([("2",), ("2",)], "k string")
    assert values(keys.unseen(searched, registry, "k"), "k") == [("1",), ("1",), (None,)]
    assert keys.unseen(searched.limit(0), registry, "k").count() == 0


@contextmanager
def setting(spark, name, value):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def test_unseen_gives_the_same_rows_on_every_path(spark, monkeypatch):
    rng = random.Random(2)
    pick = lambda n: [(rng.choice([None, *map(str, range(60))]), "p" * 50) for _ in range(n)]
    rows = spark.createDataFrame(pick(300), "k string, payload string")
    registry = spark.createDataFrame(pick(80), "k string, payload string")
    known = {k for (k,) in values(registry, "k") if k is not None}
    expected = [r for r in values(rows, "k", "payload") if r[0] not in known]
    assert values(keys.unseen(rows, registry, "k"), "k", "payload") == expected
    with setting(spark, THRESHOLD, "-1"):
        assert values(keys.unseen(rows, registry, "k"), "k", "payload") == expected
        wide = keys.unseen_wide(rows, registry, "k")
        assert values(wide, "k", "payload") == expected
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        monkeypatch.setattr(keys, "BROADCAST_KEYS", 3)
        wide = keys.unseen_wide(rows, registry, "k")
        assert values(wide, "k", "payload") == expected
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan


def test_large_registry_is_not_shuffled_for_few_ids(spark):
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    ids = tables.local_rows(spark, [(1,), (10**9,)], lines.select("l_orderkey").schema)
    with setting(spark, THRESHOLD, "100000"):
        fresh = keys.unseen(ids, lines, "l_orderkey")
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi" in plan
        assert values(fresh, "l_orderkey") == [(10**9,)]


def test_insert_only_merge(spark):
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    source = spark.createDataFrame(
        [("a", 9), ("b", 3), ("b", 2), (None, 7), (None, 7)], "k string, v int")
    merged = keys.merge_insert_only(target, source, "k")
    assert values(merged, "k", "v") == [("a", 1), ("b", 2)]
    assert keys.merge_insert_only(merged, source, "k").count() == merged.count()
    assert keys.keyless(source, "k").count() == 2


def test_first_per_key_limits_before_the_exchange(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    first = keys.first_per_key(df, ["k"], [F.asc("v")])
    best = {}
    for k, v in rows:
        best[k] = min(v, best.get(k, 2))
    assert dict(values(first, "k", "v")) == best
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_seed_if_empty(spark):
    defaults = spark.createDataFrame([(1,), (2,)], "x int")
    empty = defaults.limit(0)
    assert values(keys.seed_if_empty(empty, defaults), "x") == [(1,), (2,)]
    filled = spark.createDataFrame([(7,)], "x int")
    assert values(keys.seed_if_empty(filled, defaults), "x") == [(7,)]


def test_set_flag_and_swap(spark, database):
    name = f"{database}.terms"
    tables.ensure_table(spark, name, schemas.SEARCH_TERMS)
    tables.append(
        tables.local_rows(spark, [("a", True, None, 0, None), ("b", True, None, 0, None)],
                          schemas.SEARCH_TERMS), name)
    paused = keys.set_flag(
        spark.table(name), spark.createDataFrame([("b",), ("b",), ("zz",)], "term string"),
        "term", "active", False)
    tables.swap(paused, name)
    assert values(spark.table(name), "term", "active") == [("a", True), ("b", False)]
    assert spark.table(name).schema["run_count"].dataType.simpleString() == "int"
    assert not tables.restore(spark, name)
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__prev")
    assert tables.restore(spark, name) and spark.table(name).count() == 2


def part_times(spark, name):
    """Newest change of every part folder's files."""
    location = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").head()
    root = location["data_type"].removeprefix("file:")
    return {
        folder: sorted(f for f in os.listdir(f"{root}/{folder}") if f.endswith(".parquet"))
        for folder in os.listdir(root) if folder.startswith("_part=")
    }


def raise_by(spark, keys_, amount):
    updates = spark.createDataFrame([(k, amount) for k in keys_], "k string, more int")
    return updates, lambda rows: keys.keyed_update(
        rows, updates, ["k"], {"v": F.col("t.v") + F.col("u.more")})


def test_one_updated_key_rewrites_one_part(spark, database):
    name = f"{database}.parts"
    schema = "k string, v int"
    rows = [(f"k{i}", i) for i in range(400)] + [(None, -1), ("k5", 6)]
    df = spark.createDataFrame(rows, schema)
    parted.ensure_parted(spark, name, df.schema, "k", 16)
    parted.parted_append(df, name)
    assert values(parted.parted_scan(spark, name), "k", "v") == sorted(rows, key=repr)
    before = part_times(spark, name)
    assert len(before) == 16
    updates, change = raise_by(spark, ["k5"], 1000)
    (part,) = parted.update_touched(spark, name, updates, change)
    after = part_times(spark, name)
    assert [f for f in before if before[f] != after[f]] == [f"_part={part}"]
    want = [(k, v + 1000 if k == "k5" else v) for k, v in rows]
    assert values(parted.parted_scan(spark, name), "k", "v") == sorted(want, key=repr)
    assert parted.update_touched(spark, name, updates.limit(0), change) == []
    gone = spark.createDataFrame([("k7",)], "k string")
    parted.update_touched(spark, name, gone, lambda held: held.where("false"))
    assert values(parted.parted_scan(spark, name).where("k = 'k7'"), "k") == []


def test_a_crash_between_parts_leaves_old_or_new_rows(spark, database, monkeypatch):
    name = f"{database}.parts"
    df = spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, v int")
    parted.ensure_parted(spark, name, df.schema, "k", 4)
    parted.parted_append(df, name)
    updates, change = raise_by(spark, ["k1", "k2", "k3"], 1000)

    def crash(*_):
        raise KeyboardInterrupt

    def broken(rows):
        raise RuntimeError("while the new rows are made")

    with pytest.raises(RuntimeError):
        parted.update_touched(spark, name, updates, broken)
    assert values(parted.parted_scan(spark, name), "k", "v") == values(df, "k", "v")
    restore = parted.restore_parts
    calls = []
    monkeypatch.setattr(parted, "restore_parts", lambda *a: calls.append(1) if not calls else crash())
    with pytest.raises(KeyboardInterrupt):
        parted.update_touched(spark, name, updates, change)
    monkeypatch.setattr(parted, "restore_parts", restore)
    # The worst moment: a touched part is gone and its new rows are not there yet.
    (row,) = updates.where("k = 'k1'").select(parted.part_of("k", 4).alias("p")).collect()
    spark.sql(f"ALTER TABLE {name} DROP PARTITION (_part = {row['p']})")
    want = sorted((f"k{i}", i + 1000 * (i in (1, 2, 3))) for i in range(100))
    assert values(parted.parted_scan(spark, name), "k", "v") == want
    assert not parted.restore_parts(spark, name)


def test_a_one_row_change_rewrites_one_part(spark, database):
    name, schema = f"{database}.index", "k int, t string, v array<float>"

    def sync(rows):
        return sync_parts(spark, spark.createDataFrame(rows, schema), name, "k", parts=32)

    def held():
        return sorted(values(parted.parted_scan(spark, name), "k", "t"))

    rows = {i: (i, f"t{i}", [float(i)]) for i in range(500)}
    first = sync([*rows.values(), (None, "x", None), (7, "again", None)])
    assert first["insert"] == 500 and first["keyless"] == 1 and first["repeated"] == 1
    assert len(first["parts"]) == 32 and [k for k, _ in held()] == list(range(500))
    rows[7] = next((k, t, None) for k, t in held() if k == 7)
    sync(list(rows.values()))
    before = part_times(spark, name)
    assert sync(list(rows.values())) == {
        "insert": 0, "update": 0, "delete": 0, "keyless": 0, "repeated": 0, "parts": []}
    rows[33] = (33, "changed", None)
    counts = sync(list(rows.values()))
    after = part_times(spark, name)
    assert counts["update"] == 1 and counts["insert"] == counts["delete"] == 0
    assert [f for f in before if before[f] != after[f]] == [f"_part={p}" for p in counts["parts"]]
    assert len(counts["parts"]) == 1 and (33, "changed") in held()
    # Digests of a run that stopped before it wrote them: the part is done again.
    tables.swap(spark.table(f"{name}__digests").withColumn(
        "rows", F.when(F.col("part") == counts["parts"][0], 0).otherwise(F.col("rows"))),
        f"{name}__digests")
    again = sync(list(rows.values()))
    assert again["parts"] == counts["parts"] and again["update"] == 0
    gone = sync([r for k, r in rows.items() if k >= 400])
    assert gone["delete"] == 400 and [k for k, _ in held()] == list(range(400, 500))
    assert sync([])["delete"] == 100 and held() == []


def test_term_jobs_on_a_table_in_parts(spark, database):
    name = f"{database}.terms"
    assert rotation_jobs.seed_terms(spark, name, ["a", "b", "c"], parts=4)
    assert not rotation_jobs.seed_terms(spark, name, ["a"], parts=4)
    rotation_jobs.add_terms(spark, name, ["c", "d"])
    rotation_jobs.set_active(spark, name, ["b"], False)
    planned = rotation_jobs.plan_runs(spark, name, 2, 30, F.lit("2026-01-01").cast("date"))
    rotation_jobs.record_runs(spark, name, planned)
    found = dict(values(parted.parted_scan(spark, name), "term", "run_count"))
    assert found == {"a": 1, "b": 0, "c": 1, "d": 0}


def test_snapshot_diff_all_kinds(spark):
    index = spark.createDataFrame(
        [(1, "a", [1.0]), (2, "b", None), (3, None, [3.0]), (4, "d", [4.0])],
        "k int, t string, v array<float>")
    source = spark.createDataFrame(
        [(1, "a", [1.0]), (2, None, None), (3, None, [3.5]), (5, "e", [5.0])],
        "k int, t string, v array<float>")
    changes = keys.snapshot_diff(index, source, "k")
    assert values(changes, "k", "change") == [
        (2, "update"), (3, "update"), (4, "delete"), (5, "insert")]
    after = keys.apply_changes(index, source, changes, "k")
    assert values(after, "k", "t") == values(source, "k", "t")
    assert keys.snapshot_diff(after, source, "k").count() == 0


def test_snapshots_settle_with_null_and_repeated_keys(spark):
    columns = "k int, t string"
    index = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "x"), (6, "six")], columns)
    source = spark.createDataFrame(
        [(1, "a"), (2, "c"), (2, "b"), (2, "b"), (None, "y"), (None, "z"), (5, "e"), (5, "d")],
        columns)
    assert keys.rejected_rows(source, "k").head().asDict() == {"keyless": 2, "repeated": 3}
    assert keys.rejected_rows(source.limit(0), "k").head().asDict() == {"keyless": 0, "repeated": 0}
    changes = keys.snapshot_diff(index, source, "k")
    found = dict(values(changes, "k", "change"))
    assert found[1] == "update" and found[5] == "insert" and found[6] == "delete"
    after = keys.apply_changes(index, source, changes, "k")
    assert [k for (k,) in values(after, "k")] == [1, 2, 5]
    assert dict(values(after, "k", "t"))[2] in ("b", "c")
    turned = source.select("t", "k").repartition(5)
    assert keys.snapshot_diff(after, turned, "k").count() == 0


def test_split_by_dimension(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None])], "k int, v array<float>")
    fits, rest = keys.split_by_dimension(df, "v", 2)
    assert values(fits, "k") == [(1,)] and values(rest, "k") == [(2,), (3,), (4,)]


ARTICLE = (
    "<PubmedArticle><MedlineCitation><PMID Version='1'>{pmid}</PMID><Article>{body}</Article>"
    "{mesh}</MedlineCitation></PubmedArticle>"
)


def test_article_field_rules(spark, tmp_path):
    records = [
        ARTICLE.format(pmid=1, mesh="", body=(
            "<Journal><JournalIssue><PubDate><MedlineDate>1999 Jan</MedlineDate></PubDate>"
            "</JournalIssue><Title>J &amp; K</Title></Journal><ArticleTitle>T</ArticleTitle>"
            "<ELocationID EIdType='pii'>p</ELocationID><ELocationID EIdType='doi'>10.1/x"
            "</ELocationID><Abstract><AbstractText Label='A'>one</AbstractText>"
            "<AbstractText>two</AbstractText></Abstract><AuthorList><Author><LastName>Li"
            "</LastName><ForeName>Q</ForeName></Author><Author><CollectiveName>G"
            "</CollectiveName></Author></AuthorList>")),
        ARTICLE.format(pmid=2, body="<ArticleTitle>only</ArticleTitle>", mesh=(
            "<MeshHeadingList><MeshHeading><DescriptorName UI='D1'>Cells</DescriptorName>"
            "</MeshHeading><MeshHeading><DescriptorName>Ions</DescriptorName></MeshHeading>"
            "</MeshHeadingList>")),
        "not xml",
    ]
    df = spark.createDataFrame([(r,) for r in records], "xml string")
    expected = [
        ("1", "T", "one two", "Li Q, ", "J & K", "1999 Jan", "", "10.1/x"),
        ("2", "only", "", "", "", "Unknown", "Cells, Ions", None),
    ]
    columns = ["pmid", "title", "abstract", "authors", "journal", "year", "mesh_terms", "doi"]
    parsed = parse_articles(df, "xml")
    assert values(parsed.where("pmid is not null"), *columns) == expected
    assert parsed.count() == 3

    from gleanery.sources.articles import flatten_articles

    folder = tmp_path / "xml"
    folder.mkdir()
    (folder / "a.xml").write_text(f"<PubmedArticleSet>{''.join(records[:2])}</PubmedArticleSet>")
    from_files = flatten_articles(read_article_files(spark, str(folder)))
    assert values(from_files, *columns) == expected


def test_ingest_is_idempotent(spark, database):
    names = IngestTables(*[f"{database}.{t}" for t in ["meta", "abstracts", "registry"]])
    tables.ensure_table(spark, names.meta, schemas.ARTICLE_META, "pmid", 2)
    tables.ensure_table(spark, names.abstracts, schemas.ABSTRACTS, "pmid", 2)
    tables.ensure_table(spark, names.registry, schemas.REGISTRY, "pmid", 2)
    rows = [ARTICLE.format(pmid=p, body=f"<ArticleTitle>t{p}</ArticleTitle>", mesh="")
            for p in [1, 2, 2]]
    articles = parse_articles(spark.createDataFrame([(r,) for r in rows], "xml string"), "xml")
    assert ingest(spark, articles, names) == 2
    assert ingest(spark, articles, names) == 0
    for name in [names.meta, names.abstracts, names.registry]:
        assert values(spark.table(name), "pmid") == [("1",), ("2",)]


def test_ingest_resumes_after_a_failure_before_the_registry(spark, database):
    names = IngestTables(*[f"{database}.{t}" for t in ["meta", "abstracts", "registry"]])
    for name, schema in zip([names.meta, names.abstracts, names.registry],
                            [schemas.ARTICLE_META, schemas.ABSTRACTS, schemas.REGISTRY]):
        tables.ensure_table(spark, name, schema)
    tables.append(spark.createDataFrame([("1", "kept")], schemas.ABSTRACTS), names.abstracts)
    row = ARTICLE.format(pmid=1, body="<ArticleTitle>t</ArticleTitle>", mesh="")
    articles = parse_articles(spark.createDataFrame([(row,)], "xml string"), "xml")
    assert ingest(spark, articles, names) == 1
    assert values(spark.table(names.abstracts), "pmid", "abstract") == [("1", "kept")]
    assert spark.table(names.meta).count() == spark.table(names.registry).count() == 1


def test_search_report_flags_a_full_page(spark):
    found = spark.createDataFrame([("1",), ("2",)], "k string")
    registry = spark.createDataFrame([("2",)], "k string")
    assert search_report(found, registry, "k", cap=2).head().asDict() == {
        "searched": 2, "new": 1, "truncated": True}
    assert not search_report(found, registry, "k", cap=3).head()["truncated"]
