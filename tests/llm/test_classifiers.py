"""Classifiers on held-out rows and on made-up cases, and the pipeline against its parts."""

import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import decontam, quality, queries, simhash, toxicity

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LEARN_DIR = os.environ.get("TEST_LEARN_DIR", "/root/testdata/sf0.01")


def auc(scores, marks):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    marks = np.array(marks, bool)
    n = marks.sum()
    return (ranks[marks].sum() - n * (n + 1) / 2) / (n * (~marks).sum())


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_toxicity_on_the_held_out_fold(spark):
    labels = {r.doc_id: r.toxic for r in queries.table(spark, LEARN_DIR, "labels").collect()}
    rows = queries.op1_toxicity(spark, LEARN_DIR).collect()
    assert all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    told = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(*zip(*told)) > 0.9


def plain_toxicity(model, text):
    """The score from the weights, word by word, without the operator's own helpers."""
    found = set()
    for word in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode()):
        marked = b"^" + word + b"$"
        pieces = {marked} | {marked[:n] for n in (4, 5, 6, 7)}
        pieces |= {marked[i : i + n] for n in (5, 6) for i in range(len(marked) - n + 1)}
        found |= {zlib.crc32(p) % (1 << 20) for p in pieces}
    total = model.bias + sum(model.table.get(f, 0.0) for f in found)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def test_toxicity_query_against_plain_scoring(spark):
    docs, labels = (queries.table(spark, SF_DIR, n) for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in queries.op1_toxicity(spark, SF_DIR).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(rows) == set(texts) and len(model.table) > 0
    for i, text in texts.items():
        assert rows[i].score == pytest.approx(plain_toxicity(model, text), abs=1e-9)
    long = "Some words and MORE words. " * 40_000
    odd = spark.createDataFrame([(1, long), (1, long), (1, "x"), (2, None)], "doc_id long, text string")
    scores = [r.score for r in toxicity.scored(odd, model).collect()]
    assert scores == pytest.approx([plain_toxicity(model, t) for t in (long, long, "x", None)])


def test_the_risk_is_as_low_as_a_grid_finds():
    """One feature and a bias: no point of a fine grid has a lower non-negative risk."""
    draw = np.random.default_rng(4)
    truth = draw.random(1500) < 0.25
    confirmed = truth & (draw.random(1500) < 0.5)
    has = np.where(truth, draw.random(1500) < 0.8, draw.random(1500) < 0.1)
    rows = [np.array([3] if h else [], np.int64) for h in has]
    prior = 0.2
    fitted = toxicity.fit_nnpu(rows, confirmed, prior, width=8, rounds=2000, rate=0.02, ridge=0.0,
                               sparsity=0.0)
    assert fitted.features.tolist() == [3]

    def risk(weight, bias):
        score = weight * has + bias
        loss_p, loss_n = np.logaddexp(0, -score), np.logaddexp(0, score)
        negative = loss_n[~confirmed].mean() - prior * loss_n[confirmed].mean()
        return prior * loss_p[confirmed].mean() + max(0.0, negative)

    grid = min(risk(w, b) for w in np.linspace(-8, 12, 161) for b in np.linspace(-8, 4, 97))
    assert risk(fitted.weights[0], fitted.bias) <= grid + 0.005


def plain_quality(model, text):
    pieces = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n+", text or "")
    values = {}
    if pieces:
        n, room = len(pieces), quality.WIDTH - 64
        for p in pieces:
            kind = "a" if p.isalpha() else "0" if p.isdigit() else "/" if p.isspace() else "#"
            for name in (p.lower(), f"shape {kind}{min(len(p), 9)}"):
                f = 64 + zlib.crc32(name.encode()) % room
                values[f] = values.get(f, 0) + 1
        values = {f: math.log1p(100 * c / n) for f, c in values.items()}
        marks = sum(not p.isalnum() and not p.isspace() for p in pieces)
        for f in (min(7, n.bit_length() // 2), 8 + min(7, int(16 * marks / n)),
                  16 + min(7, int(8 * len(set(pieces)) / n)),
                  24 + min(7, int(64 * text.count("\n") / n))):
            values[f] = 1.0
    place = sum(model.weights.get(f, 0.0) * v for f, v in values.items())
    above = [1 / (1 + math.exp(-max(-30, min(30, place - t)))) for t in model.thresholds]
    expected = model.grades[0] + sum(
        (b - a) * x for a, b, x in zip(model.grades, model.grades[1:], above))
    return place, expected, above[-1]


def test_quality_query_against_plain_scoring(spark):
    docs, labels = (queries.table(spark, SF_DIR, n) for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in queries.op7_quality(spark, SF_DIR).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(rows) == set(texts) and len(model.grades) == 2
    for i, text in texts.items():
        found = rows[i].score, rows[i].expected_grade, rows[i].tail_probability
        assert found == pytest.approx(plain_quality(model, text), abs=1e-9)
    long = "Some words, and 12 more.\n" * 40_000
    odd = spark.createDataFrame([(1, long), (1, long), (1, "x"), (2, None)], "doc_id long, text string")
    scores = [r.score for r in quality.rated(odd, model).collect()]
    assert scores == pytest.approx([plain_quality(model, t)[0] for t in (long, long, "x", None)])


def test_ordinal_fit_against_a_slow_optimiser():
    """The penalised likelihood is as high as coordinate descent by small steps makes it."""
    draw = np.random.default_rng(11)
    x = draw.normal(size=(800, 2))
    grades = np.digitize(x @ [1.5, -0.7] + draw.logistic(size=800), [-0.5, 1.0]).astype(float)
    rows = [(np.array([70, 90]), v) for v in x]
    model = quality.fit_ordinal(rows, grades, rounds=1500, ridge=1e-3)

    def loss(w, cuts):
        above = 1 / (1 + np.exp(-((x @ w)[:, None] - cuts)))
        full = np.concatenate([np.ones((800, 1)), above, np.zeros((800, 1))], axis=1)
        at = np.arange(800), grades.astype(int)
        chance = np.maximum(full[at] - full[at[0], at[1] + 1], 1e-12)
        return -np.log(chance).mean() + 0.5e-3 * (w @ w)

    best, step = np.array([0.0, 0.0, -0.5, 0.5]), 0.5
    while step > 1e-4:
        moved = False
        for i in range(4):
            for sign in (1, -1):
                trial = best.copy()
                trial[i] += sign * step
                if trial[2] < trial[3] and loss(trial[:2], trial[2:]) < loss(best[:2], best[2:]):
                    best, moved = trial, True
        step = step if moved else step / 2
    weights = np.array([model.weights.get(70, 0.0), model.weights.get(90, 0.0)])
    assert loss(weights, model.thresholds) <= loss(best[:2], best[2:]) + 1e-3
    assert weights == pytest.approx(best[:2], abs=0.05)


def test_positive_unlabelled_risk_finds_the_positives():
    draw = np.random.default_rng(0)
    truth = draw.random(3000) < 0.2
    rows = [np.unique(np.r_[draw.integers(10, 200, 20), [1] if t else [2]]) for t in truth]
    confirmed = truth & (draw.random(3000) < 0.5)
    model = toxicity.fit_nnpu(rows, confirmed, 0.2, width=256)
    table = dict(zip(model.features.tolist(), model.weights.tolist()))
    score = np.array([sum(table.get(int(f), 0.0) for f in r) + model.bias for r in rows])
    assert auc(score, truth) > 0.98


def test_nothing_is_learnt_from_held_out_labels(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    labels = queries.table(spark, SF_DIR, "labels")
    changed = labels.selectExpr(
        "doc_id", "quality", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    one, two = toxicity.train(docs, labels), toxicity.train(docs, changed)
    assert one.table == two.table and one.bias == two.bias


def test_toxicity_without_examples(spark):
    docs = spark.createDataFrame([(1, "a b", 2.0), (None, None, 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, toxic int, quality int")
    rows = toxicity.scored(docs, toxicity.train(docs, none)).collect()
    assert [(r.score, r.predicted) for r in rows] == [(0.0, 0)] * 2
    empty = docs.where("false")
    assert toxicity.scored(empty, toxicity.train(empty, none)).collect() == []
    rows = quality.rated(docs, quality.train(docs, none.where("false"))).collect()
    assert [(r.expected_grade, r.selected) for r in rows] == [(0.0, False)] * 2


def test_quality_on_the_held_out_fold(spark):
    labels = {r.doc_id: r.quality for r in queries.table(spark, LEARN_DIR, "labels").collect()}
    rows = queries.op7_quality(spark, LEARN_DIR).collect()
    told = [(r.expected_grade, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(*zip(*told)) > 0.9
    assert all(r.selected == (r.tail_probability >= 0.5) for r in rows)


def test_ordered_grades():
    draw = np.random.default_rng(2)
    line = draw.normal(size=3000)
    grades = np.digitize(line + 0.3 * draw.normal(size=3000), [-1, 0.2, 1]).astype(float)
    rows = [(np.array([7]), np.array([x])) for x in line]
    model = quality.fit_ordinal(rows, grades, rounds=400)
    assert (np.diff(model.thresholds) > 0).all() and model.grades == [0, 1, 2, 3]
    weight = model.weights[7]
    above = 1 / (1 + np.exp(-(weight * line[:, None] - model.thresholds)))
    assert np.corrcoef(above.sum(axis=1), grades)[0, 1] > 0.9
    for k in range(3):
        assert above[:, k].mean() == pytest.approx((grades > k).mean(), abs=0.03)


def test_chances_do_not_depend_on_the_sample(spark):
    """Mean chances match the shares of the labels whether few or all ratings are drawn."""
    draw = np.random.default_rng(6)
    grades = draw.choice(3, 6000, p=[0.1, 0.6, 0.3])
    rows = [(i, " ".join(draw.choice(["good", "bad"], 6, p=[0.2 + 0.3 * g, 0.8 - 0.3 * g])), int(g))
            for i, g in enumerate(grades.tolist())]
    made = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    for bound in (300, 6000):
        model = quality.train(made, made, bound, bound)
        for grade in (1, 2):
            found = np.mean([model.score(t, grade)[2] for _, t, _ in rows])
            assert found == pytest.approx((grades >= grade).mean(), abs=0.05)


def test_pipeline_against_its_parts(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    labels = queries.table(spark, SF_DIR, "labels")
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    model = toxicity.train(docs, labels)
    left = {r.doc_id: r.text for r in docs.collect() if model.score(r.text) < toxicity.CUT}
    groups = {}
    prints = {i: simhash.simhash(t) & (2**64 - 1) for i, t in left.items()}
    for i in sorted(prints):
        near = [g for g, members in groups.items()
                if any((prints[i] ^ prints[m]).bit_count() <= 2 for m in members)]
        members = [i] + [m for g in near for m in groups.pop(g)]
        groups[min(members)] = members
    items = [(r.item_id, r.text) for r in queries.table(spark, SF_DIR, "benchmark").collect()]
    index = decontam.ItemIndex(items)
    clean = {i for i in groups if not index.find(left[i])}
    ids = [r.doc_id for r in found]
    assert len(ids) == len(set(ids)) and set(ids) <= clean
    assert set(docs.columns) <= set(found[0].asDict()) and all(r.copies in (1, 2) for r in found)
    sizes = sum(len(left[i].split()) for i in clean)
    assert sum(len(left[r.doc_id].split()) * r.copies for r in found) == pytest.approx(1.5 * sizes, rel=0.05)


def test_stages_keep_the_columns(spark):
    """Columns whose names the stages use themselves stay as they are, the last adds copies."""
    names = ["score", "fp", "u", "key", "k_id", "k_text", "_gl_id", "row", "first", "gone", "met"]
    docs = queries.table(spark, SF_DIR, "documents").select(
        "*", *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        wanted = docs.columns + (["copies"] if name == "mixing" else [])
        found = stage(spark, docs, SF_DIR)
        assert found.columns == wanted
        assert found.where(" OR ".join(f"{n} <> '{n}'" for n in names)).isEmpty()
        empty = stage(spark, docs.where("false"), SF_DIR)
        assert empty.columns == wanted and empty.collect() == []
