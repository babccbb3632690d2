import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.functions import encoders, vectors
from gleanery.functions.encoders import Candidate, HashEncoder, embed, hash_candidate
from gleanery.operators import judging, metrics, sampling, topk
from gleanery.plans.answering import grounded_prompts
from gleanery.plans.embedding import embed_table
from gleanery.plans import evaluation
from gleanery.plans.evaluation import evaluate_candidates
from gleanery.sources import tables
from tests.conftest import values

DIM = 8


def random_tables(spark, questions, stored, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(questions, DIM)).astype(np.float32)
    c = rng.normal(size=(stored, DIM)).astype(np.float32)
    if copies:
        c[:copies] = c[0]
    asked = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(q)], "question_id long, embedding array<float>")
    corpus = spark.createDataFrame(
        [(f"c{i}", v.tolist()) for i, v in enumerate(c)], "chunk_id string, embedding array<float>")
    return asked, corpus.repartition(5), q.astype(float), c.astype(float)


def brute_force(q, c, k, allowed=None):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(q) @ unit(c).T, topk.DECIMALS)
    found = []
    for i, row in enumerate(scores):
        ids = [j for j in range(len(c)) if allowed is None or allowed(i, j)]
        best = sorted(ids, key=lambda j: (-row[j], f"c{j}"))[:k]
        found += [(i, f"c{j}", rank + 1) for rank, j in enumerate(best)]
    return sorted(found, key=repr)


@pytest.mark.parametrize("copies,batch", [(0, 10000), (150, 10000), (150, 7)])
def test_exact_topk_both_ways(spark, copies, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    asked, corpus, q, c = random_tables(spark, 30, 400, copies=copies)
    expected = brute_force(q, c, 5)
    together = topk.cosine_topk(asked, corpus, 5)
    assert values(together, "question_id", "chunk_id", "rank") == expected
    tiled = topk.cosine_topk(asked, corpus, 5, block_bytes=7 * 8 * DIM)
    assert values(tiled, "question_id", "chunk_id", "rank") == expected
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_join_pairs_rows_and_limits_come_before_the_exchange(spark):
    asked, corpus, *_ = random_tables(spark, 3, 20)
    plan = topk.cosine_topk(asked, corpus, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("WindowGroupLimit") == 2


def test_small_and_odd_corpora(spark):
    asked, corpus, q, c = random_tables(spark, 4, 3)
    assert topk.cosine_topk(asked, corpus, 10).count() == 12
    assert topk.cosine_topk(asked, corpus.limit(0), 10).count() == 0
    assert topk.cosine_topk(asked.limit(0), corpus, 10).count() == 0
    mixed = corpus.unionByName(spark.createDataFrame(
        [("bad", [1.0])], "chunk_id string, embedding array<float>"))
    with pytest.raises(Exception, match="dimension"):
        topk.cosine_topk(asked, mixed, 2).collect()


def test_zero_vectors_and_ties(spark):
    corpus = spark.createDataFrame(
        [("z", [0.0, 0.0]), ("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("n", [-1.0, 0.0])],
        "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [3.0, 0.0])], "question_id long, embedding array<float>")
    got = topk.cosine_topk(asked, corpus, 4)
    assert values(got, "rank", "chunk_id", "similarity") == [
        (1, "a", 1.0), (2, "b", 1.0), (3, "z", 0.0), (4, "n", -1.0)]


def test_vectors_that_are_no_numbers_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(f"c{i}", [1.0, float(i)]) for i in range(10)]
    odd = [("x", [nan, 1.0]), ("y", [inf, 1.0]), ("z", None), ("n", [None, 1.0])]
    corpus = spark.createDataFrame(rows + odd, "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, [nan, 0.0])],
                                  "question_id long, embedding array<float>")
    for parts in [1, 4]:
        got = topk.cosine_topk(asked, corpus.repartition(parts), 3)
        assert values(got, "question_id", "rank", "chunk_id") == [
            (1, 1, "c9"), (1, 2, "c8"), (1, 3, "c7")]
    assert topk.unusable(corpus) == 4


def test_approximate_topk_is_exact_within_buckets(spark):
    asked, corpus, q, c = random_tables(spark, 20, 300, copies=100)
    planes = topk.HashPlanes(DIM, bits=3, tables=2)
    directions = planes.matrix()

    def codes(m):
        return (m @ directions.T >= 0).reshape(len(m), planes.tables, planes.bits)

    qc, cc = codes(q), codes(c)
    near = lambda i, j: bool(np.any(np.all(qc[i] == cc[j], axis=1)))
    got = topk.approximate_topk(
        asked, corpus, 5, planes, block_bytes=4 * 8 * DIM)
    assert values(got, "question_id", "chunk_id", "rank") == brute_force(q, c, 5, near)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_rows(spark, size):
    from gleanery.queries import retrieval

    folder = f"/root/testdata/{size}"
    asked = retrieval._asked_rows(spark, folder).count()
    row = retrieval.ann_recall_rows(spark, folder).head()
    assert row.wanted == 10 * asked > 0 and row.recall >= 0.9


def test_bucket_bound():
    with pytest.raises(ValueError):
        topk.HashPlanes(8, bits=20, tables=4)


def test_ranks_fixture(spark):
    labelled = spark.createDataFrame([(i, "x") for i in range(5)],
                                     "question_id int, correct_chunk_id string")
    ranked = spark.createDataFrame([(0, "x", 1), (1, "x", 5), (2, "x", 6), (3, "x", 10),
                                    (4, "other", 1)], "question_id int, chunk_id string, rank int")
    row = metrics.retrieval_metrics(labelled, ranked).head()
    assert row["num_eval_pairs"] == 5
    assert row["hit_rate_at_5"] == pytest.approx(0.4)
    assert row["hit_rate_at_10"] == pytest.approx(0.8)
    assert row["mrr_at_5"] == pytest.approx(0.24)
    assert row["mrr_at_10"] == pytest.approx(0.293333, abs=1e-6)
    empty = metrics.retrieval_metrics(labelled.limit(0), ranked).head()
    assert empty["num_eval_pairs"] == 0 and empty["hit_rate_at_5"] is None


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    row = df.select(
        vectors.normalise(F.col("a")).alias("u"), vectors.normalise(F.col("z")).alias("uz"),
        vectors.cosine(F.col("a"), F.col("a")).alias("c"),
        vectors.cosine(F.col("a"), F.col("z")).alias("cz"),
    ).head()
    assert row["u"] == pytest.approx([0.6, 0.8]) and row["uz"] == [0.0, 0.0]
    assert row["c"] == pytest.approx(1.0) and row["cz"] == 0.0


def test_hash_encoder(spark):
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16
    wanted = np.zeros(16)
    for word in ["a", "b", "a"]:
        wanted[bucket(word)] += 1
    got = HashEncoder(16)(["a  b\na", "", None])
    assert got[0] == pytest.approx(wanted / np.linalg.norm(wanted))
    assert not got[1].any() and not got[2].any()
    df = spark.createDataFrame([("a  b\na",)], "t string")
    stored = df.select(embed(hash_candidate("h", 16).factory)("t").alias("e")).head()["e"]
    assert stored == pytest.approx(got[0].tolist(), abs=1e-6)


def questions_and_chunks(spark):
    words = [f"w{i} x{i % 7} y{i % 5}" for i in range(60)]
    chunks = spark.createDataFrame([(f"c{i}", w) for i, w in enumerate(words)],
                                   "chunk_id string, chunk string").repartition(3)
    questions = spark.createDataFrame([(i, f"w{i}", f"c{i}") for i in range(0, 60, 4)],
                                      "question_id int, question string, correct_chunk_id string")
    return questions, chunks


def test_evaluation_in_one_block_equals_many(spark):
    questions, chunks = questions_and_chunks(spark)
    candidates = [hash_candidate("small", 4), hash_candidate("large", 512)]
    together = evaluate_candidates(questions, chunks, candidates)
    apart = evaluate_candidates(questions, chunks, candidates, question_bytes=20_000)
    columns = ["model", "model_path", "embedding_dim", "num_eval_pairs", "hit_rate_at_5",
               "mrr_at_5", "hit_rate_at_10", "mrr_at_10"]
    rows = values(together, *columns)
    assert rows == values(apart, *columns) and len(rows) == 2
    for row in rows:
        _, _, _, n, hit5, mrr5, hit10, mrr10 = row
        assert n == 15 and 1 >= hit10 >= hit5 >= mrr5 and mrr10 >= mrr5
    assert dict((r[0], r[4]) for r in rows)["large"] > 0.8


def test_rows_that_leave_a_task_do_not_grow_with_splits(spark):
    """With floors of a first pass the winners are some k per question, not k per task."""
    rng = np.random.default_rng(3)
    corpus = spark.createDataFrame(
        [(i, v) for i, v in enumerate(rng.normal(size=(1280, 8)).tolist())],
        "chunk_id long, embedding array<double>")
    asked = corpus.where("chunk_id < 20").withColumnRenamed("chunk_id", "question_id")
    want = values(topk.cosine_topk(asked, corpus, 5), "question_id", "chunk_id", "similarity", "rank")
    counts = {}
    for parts in (8, 64):
        split = corpus.repartition(parts)
        got = topk.cosine_topk(asked, split, 5, pass_winners=0)
        assert values(got, "question_id", "chunk_id", "similarity", "rank") == want
        names = "question_id", "chunk_id", "embedding", None
        one, _ = topk._broadcast_search(asked, split, 5, *names)
        two, _ = topk._broadcast_search(asked, split, 5, *names, two_passes=True)
        counts[parts] = one.count(), two.count()
    assert counts[8][0] == 8 * 20 * 5 and counts[64][0] == 64 * 20 * 5
    assert max(c for _, c in counts.values()) <= 2 * 20 * 5


def test_ranks_of_labels_by_brute_force(spark):
    """Ranks among all chunks, with equal chunks, unknown labels and questions without words."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(12)]
    texts = {f"c{i:03}": " ".join(rng.choices(words, k=3)) for i in range(120)}
    asked = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 4))),
              rng.choice([*texts, "none", None])) for i in range(60)]
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, chunk string")
    questions = spark.createDataFrame(
        asked, "question_id int, question string, correct_chunk_id string")
    candidate = hash_candidate("h", 8)
    encoder = HashEncoder(8)
    ids = sorted(texts)
    stored = np.float32(encoder([texts[c] for c in ids])).astype(float)
    stored = stored / np.maximum(np.linalg.norm(stored, axis=1, keepdims=True), 1e-30)
    want = {}
    for q, question, label in asked:
        v = np.float32(encoder([question])).astype(float)[0]
        similarity = np.round(stored @ (v / max(np.linalg.norm(v), 1e-30)), 8)
        order = sorted(range(len(ids)), key=lambda i: (-similarity[i], ids[i]))
        want[q] = [ids[i] for i in order].index(label) + 1 if label in texts else None
    for size in (1 << 20, 3000):
        got = evaluation.label_ranks(questions, chunks.repartition(5), [candidate], size)
        assert {r["question_id"]: r["rank"] for r in got.collect()} == want
    scores, failures = evaluation.evaluate_with_failures(questions, chunks, [candidate])
    ranks = [r for r in want.values() if r]
    assert failures.count() == 0
    assert scores.head()["mrr"] == pytest.approx(sum(1 / r for r in ranks) / len(asked))


@pytest.mark.parametrize("question_bytes", [1 << 20, 2000])
def test_a_vector_that_is_not_finite_is_a_named_failure(spark, question_bytes):
    def factory():
        def encode(texts):
            vectors = HashEncoder(8)(texts)
            return np.where([["w58 " in t] for t in texts], np.nan, vectors)

        return encode

    questions, chunks = questions_and_chunks(spark)
    both = [Candidate("bad", "p", 8, factory), hash_candidate("good", 8)]
    scores, failures = evaluation.evaluate_with_failures(
        questions, chunks, both, question_bytes=question_bytes)
    assert values(scores, "model") == [("good",)]
    ((name, error),) = values(failures, "model", "error")
    assert name == "bad" and "not finite" in error


@pytest.mark.parametrize("size", [1, 2, 5])
def test_topk_passes_over_nan(size):
    best = topk.TopK(1, 3)
    similarity = np.array([[0.4], [np.nan], [0.9], [0.1], [0.5]])
    ids = np.array([10, 11, 12, 13, 14])
    for at in range(0, 5, size):
        best.offer(similarity[at : at + size].copy(), ids[at : at + size])
    assert list(best.rows()[1]) == [12, 14, 10]


def test_failing_candidate_is_left_out(spark):
    def broken():
        def encode(texts):
            if any("w59 " in text for text in texts):
                raise RuntimeError("out of memory")
            return HashEncoder(8)(texts)

        return encode

    questions, chunks = questions_and_chunks(spark)
    both = [Candidate("bad", "p", 8, broken), hash_candidate("good", 8)]
    assert values(evaluate_candidates(questions, chunks, both), "model") == [("good",)]
    apart = evaluate_candidates(questions, chunks, both, question_bytes=2000)
    assert values(apart, "model") == [("good",)]
    none = evaluate_candidates(questions, chunks, [Candidate("bad", "p", 8, broken)])
    assert none.count() == 0
    assert none.columns[:3] == ["model", "model_path", "embedding_dim"]


def test_judge_fixture(spark):
    replies = spark.createDataFrame([
        ("a", '{"faithfulness": 4, "relevance": 5, "conciseness": 3}'),
        ("a", ' {"faithfulness": 2, "conciseness": 1} '),
        ("a", "```json {}```"), ("a", ""), ("a", None),
        ("b", "no"), ("b", None)], "model string, reply string")
    got = values(judging.judge_scores(replies), "model", "avg_faithfulness", "avg_relevance",
                 "avg_conciseness", "composite_score")
    assert got == [("a", 3.0, 5.0, 2.0, pytest.approx(10 / 3)), ("b", None, None, None, 0.0)]


def test_sampling(spark):
    df = spark.createDataFrame([(f"c{i:03}", "x" * (201 if i % 2 else 200)) for i in range(50)],
                               "chunk_id string, chunk string").withColumn("pmid", F.lit("p"))
    first = values(sampling.seeded_sample(df, "chunk_id", 10), "chunk_id")
    again = values(sampling.seeded_sample(df.repartition(7), "chunk_id", 10), "chunk_id")
    assert first == again and len(first) == 10
    assert values(sampling.seeded_sample(df, "chunk_id", 10, seed=1), "chunk_id") != first
    assert sampling.seeded_sample(df, "chunk_id", 99).count() == 50
    drawn = values(sampling.question_chunks(df, 4), "chunk_id")
    assert len(drawn) == 4 and all(int(c[1:]) % 2 for (c,) in drawn)
    many = values(sampling.question_chunks(df, 25), "chunk_id")
    assert len(many) == 25 and many[-1] == ("c049",)
    pairs = sampling.evaluation_set(
        df, "pmid", F.when(F.col("chunk_id") < "c010", "q").otherwise(""))
    assert pairs.count() == 10
    assert pairs.columns == schemas.EVAL_QUESTIONS.names


@pytest.mark.parametrize("n", [1, 37, 1500, 2990, 3000, 3001])
def test_large_samples_are_the_same_rows(spark, n):
    rows = spark.createDataFrame([(f"c{i // 2}", i) for i in range(3000)], "k string, v int")
    want = values(sampling.seeded_sample(rows, "k", n), "k")
    drawn = sampling.seeded_sample(rows, "k", n, one_task_rows=0)
    assert values(drawn, "k") == want and drawn.count() == min(n, 3000)
    if n == 1500:
        plan = sampling.seeded_sample(
            rows.dropDuplicates(["k"]), "k", 750, one_task_rows=50
        )._jdf.queryExecution().optimizedPlan().toString()
        limits = re.findall(r"GlobalLimit (\d+)", plan)
        assert all(int(x) <= 50 for x in limits)


def test_grounded_prompt(spark):
    candidate = hash_candidate("h", 64)
    chunks = spark.createDataFrame(
        [("c1", "alpha beta"), ("c2", "gamma"), ("c3", "alpha")], "chunk_id string, chunk string")
    questions = spark.createDataFrame([(1, "alpha")], "question_id int, question string")
    encode = embed(candidate.factory)
    row = grounded_prompts(
        questions.withColumn("embedding", encode("question")),
        chunks.withColumn("embedding", encode("chunk")), k=2).head()
    assert row["sources"] == "c3,c1"
    assert "[c3] alpha\n\n[c1] alpha beta" in row["prompt"] and "Question: alpha" in row["prompt"]


def test_embedding_job(spark, database):
    chunks, embedded = f"{database}.chunks", f"{database}.embeddings"
    tables.ensure_table(spark, chunks, schemas.CHUNKS)
    row = lambda i: ("p", f"p_chunk_{i}", i, f"text {i}")
    tables.append(tables.local_rows(spark, [row(0), row(1)], schemas.CHUNKS), chunks)
    candidate = hash_candidate("h", 16)
    assert embed_table(spark, chunks, embedded, candidate) == 2
    tables.append(tables.local_rows(spark, [row(2)], schemas.CHUNKS), chunks)
    assert embed_table(spark, chunks, embedded, candidate, full=False) == 1
    assert embed_table(spark, chunks, embedded, candidate, full=False) == 0
    assert spark.table(embedded).where(F.size("embedding") == 16).count() == 3
    assert embed_table(spark, chunks, embedded, hash_candidate("h", 32)) == 3


@pytest.mark.parametrize("floors", [False, True])
def test_work_per_question_does_not_grow_with_the_questions(monkeypatch, floors):
    """Rows come in blocks as large for many questions as for few, and what a task sorts is some
    k rows per question. Copies and ties by id are the rows of a plain ranking."""
    rng = np.random.default_rng(5)
    units = topk.unit_rows(rng.normal(size=(20_000, 8)))
    stored = rng.normal(size=(6_000, 8))
    stored[1_000:3_000] = stored[0]
    stored[3_000:3_100] = 0
    units[7], units[8] = topk.unit_rows(stored[:1])[0], 0
    ids = rng.permutation(6_000)
    some = np.arange(40)
    near = np.round(units[some] @ topk.unit_rows(stored).T, topk.DECIMALS)
    order = [np.lexsort((ids, -row))[:10] for row in near]
    floor = None
    if floors:
        floor = np.full(len(units), -1.0)
        floor[some] = [row[o[-1]] for row, o in zip(near, order)]
    entries, sort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: entries.append(len(keys[0])) or sort(keys))
    best = topk.TopK(len(units), 10, floor)
    topk.score_blocks(best, stored, ids, units)
    question, found, similarity = best.rows()
    first = question < len(some)
    assert np.array_equal(found[first].reshape(-1, 10), [ids[o] for o in order])
    assert np.array_equal(similarity[first].reshape(-1, 10), [row[o] for row, o in zip(near, order)])
    assert len(question) == 10 * len(units) and sum(entries) < 40 * len(units)


def test_texts_of_any_size_are_counted_some_letters_at_a_time(spark, monkeypatch):
    """Memory is that of some texts, not of a batch, and pieces end where words do."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)] + ["", "\u00fc\u4e2d", "a\nb"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(3_000))) for _ in range(1_500)]
    texts[3:5] = ["", None]
    texts.append(" ".join(rng.choices(words, k=1_000_000)))
    texts.append("x" * 100)
    HashEncoder(8)(["warm up"])
    tracemalloc.start()
    whole = HashEncoder(8)(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
    some = texts[:200] + ["y " * 300 + "z" * 400]
    want = HashEncoder(8)(some)
    assert np.array_equal(want[:200], whole[:200])
    for text, row in zip(some[::20], want[::20]):
        counts = np.zeros(8)
        for word in (text or "").replace("\n", " ").split(" "):
            if word:
                counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 8] += 1
        assert row == pytest.approx(counts / max(np.linalg.norm(counts), 1e-30))
    monkeypatch.setattr(encoders, "PIECE_LETTERS", 50)
    assert np.array_equal(HashEncoder(8)(some), want)
    asked = []
    monkeypatch.setattr(encoders, "TEXT_BYTES", 50)
    for part in encoders._slices(pa.array(some)):
        asked += [part.to_pylist()]
    assert sum(asked, []) == some and len(asked) > 100
    assert [len(part) for part in encoders._slices(pa.array([], pa.string()))] == [0]


def test_remembered_words_take_a_bounded_room():
    encoder = HashEncoder(8)
    for part in range(12):
        encoder([" ".join(f"{part}-{i}-{'x' * 100}" for i in range(100_000))])
        assert sum(160 + 4 * len(word) for word in encoder._buckets) < 128 << 20
    assert len(encoder([])) == 0


def test_a_search_for_many_questions_holds_no_large_matrix():
    """What one task of an answering search needs besides its vectors stays small."""
    rng = np.random.default_rng(2)
    units = topk.unit_rows(rng.normal(size=(400, 64)))
    rows, ids = rng.normal(size=(10_000, 64)), np.array([f"c{i}" for i in range(10_000)], object)
    tracemalloc.start()
    best = topk.TopK(len(units), 5)
    topk.score_blocks(best, rows, ids, units)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(best.rows()[0]) == 2_000 and peak < 48 << 20
