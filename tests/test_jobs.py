"""The jobs in the order a user runs them, on one database."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.functions.encoders import Candidate, embed, hash_candidate
from gleanery.operators import config
from gleanery.plans import answering, chunking, embedding, evaluation, index, promotion, questions
from gleanery.plans import rotation, sessions
from gleanery.plans.ingest import IngestTables, ingest, ingest_records
from gleanery.sources import tables
from gleanery.sources.articles import parse_articles
from tests.conftest import values


TERMS = ["Titer", *(f"term {i}" for i in range(7))]
FIRST_CONFIG = {"config_version": 1, "updated_by": "setup", "generation_model_name": "gen",
                "embedding_model_name": "emb", "embedding_model_path": "models/emb",
                "embedding_dimension": 8}


def test_term_rotation_jobs(spark, database):
    name = f"{database}.terms"
    assert rotation.seed_terms(spark, name, TERMS) and not rotation.seed_terms(spark, name, TERMS)
    assert spark.table(name).count() == len(TERMS) == 8
    rotation.add_terms(spark, name, ["Titer", "New"], active=False)
    assert spark.table(name).count() == 9
    rotation.set_active(spark, name, ["New"], True)
    rotation.set_active(spark, name, TERMS, False)
    today = F.lit("2020-02-15").cast("date")
    for expected in ["2020-01-31", "2020-02-15", "2020-02-15"]:
        planned = rotation.plan_runs(spark, name, 1, 30, today)
        assert values(planned, "term", "maxdate_iso") == [("New", expected)]
        rotation.record_runs(spark, name, planned)
    row = spark.table(name).where("term = 'New'").head()
    assert row["run_count"] == 3 and row["last_searched_through"] == dt.date(2020, 2, 15)
    rotation.set_active(spark, name, ["New"], False)
    assert rotation.plan_runs(spark, name, 1, 30, today).count() == 0


def test_index_jobs(spark, database):
    embedded, name = f"{database}.embeddings", f"{database}.idx"
    row = lambda i, v: ("p", f"c{i}", i, f"t{i}", v, "m")
    write = lambda rows: tables.overwrite(
        tables.local_rows(spark, rows, schemas.EMBEDDINGS), embedded)
    write([row(0, [1.0, 2.0]), row(1, [3.0, 4.0]), row(2, [1.0])])
    assert index.sync_index(spark, embedded, name, 2) == {
        "insert": 2, "update": 0, "delete": 0, "rejected": 1}
    assert index.sync_index(spark, embedded, name, 2)["insert"] == 0
    write([row(1, [3.0, 5.0]), row(3, [0.0, 1.0])])
    assert index.sync_index(spark, embedded, name, 2) == {
        "insert": 1, "update": 1, "delete": 1, "rejected": 0}
    assert values(spark.table(name), "chunk_id", "embedding") == [
        ("c1", [3.0, 5.0]), ("c3", [0.0, 1.0])]
    write([row(1, [3.0, 5.0]), row(3, [0.0, 1.0]), row(4, [1.0, 1.0])])
    assert index.sync_index(spark, embedded, name, 2) == {
        "insert": 1, "update": 0, "delete": 0, "rejected": 0}
    write([row(1, [1.0, 2.0, 3.0])])
    assert index.sync_index(spark, embedded, name, 3)["insert"] == 1
    assert values(spark.table(name), "chunk_id") == [("c1",)]


def test_from_articles_to_promotion(spark, database):
    t = {n: f"{database}.{n}" for n in [
        "meta", "abstracts", "registry", "chunks", "embeddings", "idx", "questions",
        "results", "generation", "config"]}
    names = IngestTables(t["meta"], t["abstracts"], t["registry"])
    for name, schema in [(t["meta"], schemas.ARTICLE_META), (t["abstracts"], schemas.ABSTRACTS),
                         (t["registry"], schemas.REGISTRY)]:
        tables.ensure_table(spark, name, schema, "pmid", 2)
    body = " ".join(f"word{{0}}x{i} common filler text" for i in range(30))
    xml = [
        f"<PubmedArticle><MedlineCitation><PMID>{p}</PMID><Article><Abstract><AbstractText>"
        f"{body.format(p)}</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
        for p in range(6)
    ]
    articles = parse_articles(spark.createDataFrame([(x,) for x in xml], "xml string"), "xml")
    assert ingest(spark, articles, names) == 6
    made = chunking.chunk_table(spark, t["abstracts"], t["chunks"])
    assert made == spark.table(t["chunks"]).count() > 12

    small, large = hash_candidate("org/small", 8), hash_candidate("org/large", 256)
    assert embedding.embed_table(spark, t["chunks"], t["embeddings"], small) == made
    assert index.sync_index(spark, t["embeddings"], t["idx"], 8)["insert"] == made

    requests = questions.question_requests(spark.table(t["chunks"]), 5)
    echoed = F.concat("prompt", F.lit("\n What is "), F.substring("chunk", 20, 60), F.lit("?"))
    questions.write_evaluation_set(spark, requests, t["questions"], echoed)
    asked = spark.table(t["questions"])
    assert asked.columns == schemas.EVAL_QUESTIONS.names and asked.count() == 5
    assert asked.where(F.col("question").startswith("What is")).count() == 5

    board = evaluation.evaluate_embedding_tables(
        spark, t["chunks"], t["questions"], t["results"], [small, large])
    assert board.head()["model"] == "org/large"
    assert spark.table(t["results"]).columns == schemas.EMBEDDING_RESULTS.names

    promotion.seed_config(spark, t["config"], FIRST_CONFIG)
    outcome, score = promotion.promote_embedding(spark, t["results"], t["config"], 0.0)
    assert outcome == "promoted" and 0 < score <= 1
    assert config.latest(spark.table(t["config"])).head()["embedding_model_name"] == "org/large"

    answers = questions.answer_requests(asked, 3).select(
        F.lit("org/gen").alias("model"), "question", "source_chunk", F.lit("yes").alias("answer"))
    judged = questions.judge_requests(answers)
    assert judged.where(F.col("prompt").contains("Answer: yes")).count() == 3
    replies = judged.select("model", F.lit(
        '{"faithfulness": 5, "relevance": 4, "conciseness": 3}').alias("reply"))
    evaluation.evaluate_generation_table(spark, replies, t["generation"])
    assert promotion.promote_generation(spark, t["generation"], t["config"], 3.9) == (
        "promoted", pytest.approx(4.0))
    latest = config.latest(spark.table(t["config"])).head()
    assert (latest["config_version"], latest["generation_model_name"]) == (3, "org/gen")
    assert promotion.rollback(spark, t["config"], 1) == 4

    encode = embed(small.factory)
    prompts = answering.grounded_prompts(
        asked.select(F.col("chunk_id").alias("question_id"), "question",
                     encode("question").alias("embedding")),
        spark.table(t["idx"]))
    assert prompts.count() == 5
    assert prompts.where(F.size(F.split("sources", ",")) == 5).count() == 5


def test_swap_survives_a_crash_at_every_step(spark, database):
    name = f"{database}.terms"
    tables.ensure_table(spark, name, schemas.SEARCH_TERMS)
    rotation.add_terms(spark, name, ["mine1", "mine2"])
    for step in range(3):
        if step:
            spark.sql(f"CREATE TABLE {name}__next AS SELECT * FROM {name} LIMIT 0")
            spark.sql(f"ALTER TABLE {name} RENAME TO {name}__prev")
        if step == 2:
            spark.sql(f"ALTER TABLE {name}__prev RENAME TO {name}")
            spark.sql(f"CREATE TABLE {name}__prev AS SELECT * FROM {name} LIMIT 0")
        assert not rotation.seed_terms(spark, name, TERMS)
        rotation.set_active(spark, name, ["mine2"], False)
        assert values(spark.table(name), "term", "active") == [("mine1", True), ("mine2", False)]
    assert not spark.catalog.tableExists(f"{name}__prev")


def test_recorded_runs_are_the_planned_ones(spark, database):
    name = f"{database}.terms"
    rotation.seed_terms(spark, name, ["m"])
    planned = rotation.plan_runs(spark, name, 1, 30, F.lit("2020-02-15").cast("date"))
    rotation.add_terms(spark, name, ["a"])
    rotation.set_active(spark, name, ["a"], True)
    rotation.record_runs(spark, name, planned)
    assert values(spark.table(name), "term", "run_count", "last_searched_through") == [
        ("a", 0, None), ("m", 1, dt.date(2020, 1, 31))]


def test_models_do_not_mix(spark, database):
    chunks, embedded, terms = f"{database}.chunks", f"{database}.emb", f"{database}.cfg"
    rows = [("p", f"c{i}", i, f"some text {i}") for i in range(4)]
    tables.overwrite(tables.local_rows(spark, rows, schemas.CHUNKS), chunks)
    one, two = hash_candidate("one", 16), hash_candidate("two", 32)
    tables.ensure_table(spark, embedded, schemas.EMBEDDINGS)
    assert embedding.embed_table(spark, chunks, embedded, one, full=False) == 4
    assert embedding.embed_table(spark, chunks, embedded, one, full=False) == 0
    assert embedding.embed_table(spark, chunks, embedded, two, full=False) == 4
    widths = spark.table(embedded).select("model", F.size("embedding").alias("d")).distinct()
    assert values(widths, "model", "d") == [("one", 16), ("two", 32)]
    index_name = f"{database}.idx"
    assert index.sync_index(spark, embedded, index_name, 32, "two")["insert"] == 4
    promotion.seed_config(spark, terms, {**FIRST_CONFIG, "embedding_model_name": "two",
                                         "embedding_dimension": 32})
    asked = spark.createDataFrame([(1, "some text 2")], "question_id int, question string")
    prompts = answering.answer_questions(spark, asked, index_name, terms, [one, two], 2)
    assert prompts.head()["sources"].startswith("c2")
    with pytest.raises(ValueError, match="do not fit"):
        answering.answer_questions(spark, asked, embedded, terms, [one, two])
    with pytest.raises(ValueError, match="no candidate"):
        answering.answer_questions(spark, asked, index_name, terms, [one])


@pytest.mark.parametrize("question_bytes", [1 << 20, 2000])
def test_failing_candidates_are_named(spark, question_bytes):
    questions = spark.createDataFrame(
        [(i, "a b", f"c{i % 2}") for i in range(3)],
        "question_id int, question string, correct_chunk_id string")
    chunks = spark.createDataFrame([("c0", "a b"), ("c1", "x y")], "chunk_id string, chunk string")
    wrong = Candidate("wrong", "w", 384, hash_candidate("x", 8).factory)
    scores, failures = evaluation.evaluate_with_failures(
        questions, chunks, [hash_candidate("good", 16), wrong], question_bytes=question_bytes)
    assert values(scores, "model", "num_eval_pairs") == [("good", 3)]
    ((name, error),) = values(failures, "model", "error")
    assert name == "wrong" and "not 384 wide" in error


def test_known_and_unreadable_records(spark, database):
    names = IngestTables(*(f"{database}.{n}" for n in ["meta", "abstracts", "registry", "rejects"]))
    for name, schema in [(names.meta, schemas.ARTICLE_META), (names.abstracts, schemas.ABSTRACTS),
                         (names.registry, schemas.REGISTRY)]:
        tables.ensure_table(spark, name, schema)
    record = ("<PubmedArticle><MedlineCitation><PMID>{}</PMID><Article></Article>"
              "</MedlineCitation></PubmedArticle>")
    raw = spark.createDataFrame([(record.format(i % 3),) for i in range(5)] + [("<broken",)], "x string")
    assert ingest_records(spark, raw, "x", names) == 3
    assert spark.table(names.rejects).count() == 1
    more = raw.union(spark.createDataFrame([(record.format(9),)], "x string"))
    assert ingest_records(spark, more, "x", names) == 1
    assert values(spark.table(names.registry), "pmid") == [("0",), ("1",), ("2",), ("9",)]


def test_session_tables(spark, database):
    history, states = f"{database}.history", f"{database}.states"
    turns = spark.createDataFrame(
        [(s, i, "user", f"text {i}", None, None) for s in ["a", "b"] for i in range(8)],
        "session_id string, turn_number int, role string, content string, query_used string, "
        "chunks_retrieved string")
    sessions.record_turns(spark, turns, history, F.lit(dt.datetime(2026, 1, 1)))
    assert values(sessions.recent_turns(spark, history, "a"), "session_id", "turn_number") == [
        ("a", i) for i in range(3, 8)]
    for day, state in [(1, "{}"), (3, "{1}"), (2, "{2}")]:
        new = spark.createDataFrame([("a", state)], "session_id string, state_json string")
        sessions.save_states(spark, new, states, F.lit(dt.datetime(2026, 1, day)))
    assert values(sessions.current_states(spark, states), "session_id", "state_json") == [("a", "{1}")]
    assert spark.table(states).select("created_at").distinct().count() == 1
