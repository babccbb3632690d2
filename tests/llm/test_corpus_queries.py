"""Queries over whole tables against brute force: near-duplicates, search, mixing, contamination."""

import itertools
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import components, decontam, mixing, queries, simhash, topk

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, source string, lang string, n_chars long, fp string, copies int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "en", 1, "f", 3) for r in rows], DOCS)


def table(spark, name):
    return queries.table(spark, SF_DIR, name).collect()


# Near-duplicates


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, radius):
    """Least place each fingerprint reaches."""
    values = np.array(prints, np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    label = np.arange(len(values))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def check_groups(rows, texts):
    """rows by doc_id; ids are the places of the texts."""
    prints = [slow_fingerprint(t) for t in texts]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in rows] == slow_groups(prints, 2).tolist()


def test_near_duplicates_of_the_table(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents")}
    rows = sorted(queries.op10_near_duplicates(spark, SF_DIR).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(texts) == list(range(len(texts)))
    check_groups(rows, [texts[r.doc_id] for r in rows])


def test_near_duplicates_of_short_texts(spark):
    draw = random.Random(2)
    texts = [None, "", " \n", "a", "A", "a b", "a  b\tc"]
    texts += [" ".join(draw.choice("abc") for _ in range(draw.randint(1, 4))) for _ in range(150)]
    rows = simhash.near_duplicates(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    check_groups(sorted(rows, key=lambda r: r.doc_id), texts)


def as_long(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("segments", [1, 2, 4, 8])
def test_links_join_what_is_near(spark, segments):
    draw = random.Random(segments)
    centres = [draw.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    values = set(centres)
    for _ in range(400):
        value = draw.choice(centres)
        for _ in range(draw.randint(1, 4)):
            value ^= 1 << draw.randrange(64)
        values.add(value)
    values = sorted(values, key=as_long)
    frame = spark.createDataFrame([(as_long(v),) for v in values], "fp long")
    found = components.components(
        simhash.fingerprint_links(frame, 2, tile_rows=16, segments=segments)).collect()
    label = {r.node: r.component for r in found}
    wanted = [as_long(values[i]) for i in slow_groups(values, 2)]
    assert [label.get(as_long(v), as_long(v)) for v in values] == wanted


def test_components_of_chains(spark):
    draw = random.Random(9)
    nodes = list(range(300))
    draw.shuffle(nodes)
    edges = [(a, b) for part in (nodes[:200], nodes[200:299]) for a, b in itertools.pairwise(part)]
    frame = spark.createDataFrame([e if draw.random() < 0.5 else e[::-1] for e in edges], "u long, v long")
    found = {r.node: r.component for r in components.components(frame).collect()}
    wanted = {n: min(part) for part in (nodes[:200], nodes[200:299]) for n in part}
    assert found == wanted


def test_one_document_of_each_group_stays(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(5, long, "a"), (3, long, "b"), (3, long, "b"), (None, long, None), (9, "other text here now", "a"),
            (None, None, "a"), (4, "", "b")]
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [
        (3, long), (4, ""), (9, "other text here now")]


def test_no_documents(spark):
    none = docs(spark, [])
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.drop_near_duplicates(none).collect() == []
    assert mixing.mix(none).collect() == []
    assert mixing.take_mix(none).collect() == []


def test_hot_groups_and_clashing_names(spark):
    """Large groups of copies, hubs of links and columns that operators use themselves."""
    draw = random.Random(4)
    words = [f"w{draw.randrange(4000)}" for _ in range(3000)]
    texts = [" ".join(words)] * 2500
    texts += [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(0, 3000, 300)]
    texts += ["", " ", "one two", "One  two", "two one", "x" * 50_000]
    rows = [(i, t, "s", 1, "k", 2, 3.0) for i, t in [*enumerate(texts), *[(7, texts[7])] * 3]]
    frame = spark.createDataFrame(
        rows, "doc_id long, text string, source string, copies int, key string, row long, u double")
    prints = [simhash.simhash(t) & (2**64 - 1) for t in texts]
    wanted = slow_groups(sorted(set(prints)), 2)
    group = dict(zip(sorted(set(prints)), wanted))
    first = {}
    for i, fp in enumerate(prints):
        first.setdefault(group[fp], i)
    left = simhash.drop_near_duplicates(frame)
    assert left.columns == frame.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(first.values())
    taken = mixing.take_mix(frame)
    assert sorted(taken.columns) == sorted(frame.columns)
    found = {r.doc_id: r.copies for r in taken.collect()}
    sizes = {r.doc_id: r.taken // max(r["size"], 1) for r in
             mixing.mix(frame).where("taken > 0 AND doc_id <> 7").collect()}
    assert {i: n for i, n in found.items() if i != 7} == sizes
    assert taken.count() == len(found)


# Exact search


def test_repeated_query_rows_ask_once(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(30)] + [(3, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(3, [3.0, 3.0]), (3, [1.0, 1.0]), (3, [3.0, 3.0])], vectors.schema)
    once = spark.createDataFrame([(3, [1.0, 1.0])], vectors.schema)
    found = topk.exact_topk(vectors, asked, 4).orderBy("rank").collect()
    assert found == topk.exact_topk(vectors, once, 4).orderBy("rank").collect()
    assert [r["rank"] for r in found] == [1, 2, 3, 4] and len({r.vec_id for r in found}) == 4


def slow_topk(vectors, queries_, k):
    found = []
    for q, x in queries_:
        scores = [(-int(np.dot(x, y)), i) for i, y in vectors if i != q and len(x) == len(y)]
        found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(found)


def whole(vector):
    return [int(np.floor(np.float64(x) * 1024)) for x in vector]


def test_search_of_the_table(spark):
    rows = [(r.vec_id, whole(r.embedding)) for r in table(spark, "embeddings")]
    found = sorted(map(tuple, queries.op6_exact_topk(spark, SF_DIR).collect()))
    assert found == slow_topk(rows, [r for r in rows if r[0] % 100 == 0], 10)


@pytest.mark.parametrize("block_bytes, slices", [(1 << 20, 4), (400, 3), (1 << 20, 1)])
def test_search_of_odd_vectors(spark, block_bytes, slices):
    draw = random.Random(4)
    plain = [(i, [draw.choice([-1.5, 0.25, 0.0, 1.0, -0.001]) for _ in range(5)]) for i in range(120)]
    plain += [(200 + i, [0.5] * 5) for i in range(40)] + [(300, [1.0, 2.0]), (301, [3.0, -1.0])]
    plain += [(400, []), (401, [1e30] * 5)]
    odd = [(500, None), (501, [float("nan")] * 5), (502, [None] * 5), (None, [1.0] * 5),
           (503, [float("inf")] * 5)]
    frame = spark.createDataFrame([(i, v, 0, 1.0) for i, v in plain + odd],
                                  "vec_id long, embedding array<double>, rank int, score double")
    asked = [0, 7, 200, 300, 400, 500, 501]
    found = topk.exact_topk(frame, frame.where(F.col("vec_id").isin(asked)), 4,
                            slices=slices, block_bytes=block_bytes).collect()
    rows = [(i, whole(v)) for i, v in plain]
    wanted = [
        (q, r, i, max(-(2**63), min(2**63 - 1, s)))
        for q, r, i, s in slow_topk([(i, np.array(v, object)) for i, v in rows],
                                    [(i, np.array(v, object)) for i, v in rows if i in asked], 4)
    ]
    assert sorted(map(tuple, found)) == wanted


def test_search_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.exact_topk(none, none).collect() == []


# Mixing


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = {}
    while True:
        free = [s for s in names if s not in target]
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}


def check_mix(rows, documents):
    size = {i: len((t or "").encode().split()) for i, t, _ in documents}
    source = {i: s for i, _, s in documents}
    totals = Counter()
    for i in size:
        totals[source[i]] += size[i]
    targets = slow_targets(totals)
    taken = defaultdict(int)
    assert sorted(r.doc_id for r in rows) == sorted(size)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == totals[source[r.doc_id]]
        assert r.target == pytest.approx(targets[source[r.doc_id]], rel=1e-9, abs=1e-6)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[source[r.doc_id]] += r.taken
    return {s: (taken[s], targets[s]) for s in totals}


def test_mix_of_the_table(spark):
    documents = [(r.doc_id, r.text, r.source) for r in table(spark, "documents")]
    s_of = {i: s for i, _, s in documents}
    rows = queries.op8_source_mix(spark, SF_DIR).collect()
    for source, (taken, target) in check_mix(rows, documents).items():
        sizes = [r["size"] for r in rows if s_of[r.doc_id] == source]
        passes = int(target // sum(sizes)) * sum(sizes)
        sums = {passes}
        for size in sizes:
            sums |= {s + size for s in sums}
        assert abs(taken - target) <= min(abs(s - target) for s in sums) + 1
    again = queries.op8_source_mix(spark, SF_DIR).repartition(3).collect()
    assert sorted(rows, key=repr) == sorted(again, key=repr)


def test_mix_with_a_hot_length_and_odd_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED_ROWS", 16)
    documents = [(i, "w " * 7, "hot") for i in range(900)]
    documents += [(1000 + i, "v " * (i % 40), f"s{i % 5}") for i in range(400)]
    documents += [(2000, None, None), (2001, "one two", None), (2002, "", "empty"), (2003, "x", "\U0001f600"),
                  (2004, "y", "￮")]
    rows = mixing.mix(docs(spark, documents)).collect()
    for source, (taken, target) in check_mix(rows, documents).items():
        assert abs(taken - target) <= (7 if source == "hot" else max(2, 0.02 * target))
    taken = mixing.take_mix(docs(spark, documents)).collect()
    assert sum(len((r.text or "").split()) * r.copies for r in taken) == sum(r.taken for r in rows)


def test_lengths_fill_the_budget():
    draw = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(draw.integers(1, 60, draw.integers(1, 8)))
        counts = draw.integers(1, 6, len(lengths))
        budget = int(draw.integers(0, (lengths * counts).sum() + 1))
        chosen = mixing._fill(lengths, counts, budget)
        assert (chosen <= counts).all() and (chosen >= 0).all()
        sums = {0}
        for size, n in zip(lengths.tolist(), counts.tolist()):
            sums = {s + size * m for s in sums for m in range(n + 1)}
        assert abs((chosen * lengths).sum() - budget) == min(abs(s - budget) for s in sums)
    lengths, counts = np.arange(1, 3000), np.full(2999, 400)
    fitted = mixing.fit_lengths(lengths, counts, 777_777_777)
    assert (fitted * lengths).sum() == 777_777_777 and (fitted <= counts).all()


def test_few_long_documents_are_fitted():
    def taken(sizes, budget):
        lengths, counts = np.unique(sizes, return_counts=True)
        chosen = mixing.fit_lengths(lengths, counts, budget)
        assert (chosen >= 0).all() and (chosen <= counts).all()
        return int((chosen * lengths).sum())

    assert taken([200_000], 150_000) == 200_000
    assert taken([20_000], 15_000) == 20_000
    assert taken([200_000], 90_000) == 0
    assert taken([200_000, 200_000], 350_000) == 400_000
    assert taken([100_000] * 3 + [150_000] * 2, 300_000) == 300_000
    assert taken([3_000_000_000, 5_000_000_000], 4_900_000_000) == 5_000_000_000
    draw = np.random.default_rng(3)
    for _ in range(60):
        sizes = draw.integers(131_072, 900_000, draw.integers(1, 10)).tolist()
        sizes += draw.choice(sizes, draw.integers(0, 3)).tolist()
        budget = int(draw.integers(1, sum(sizes)))
        sums = {0}
        for size in sizes:
            sums |= {s + size for s in sums}
        assert abs(taken(sizes, budget) - budget) == min(abs(s - budget) for s in sums)
    sizes = draw.integers(131_072, 900_000, 3000)
    budget = int(sizes.sum()) * 3 // 7
    assert abs(taken(sizes, budget) - budget) <= 100


def test_mix_takes_a_long_document(spark):
    long = "w " * 200_000
    rows = mixing.mix(docs(spark, [(0, long, "a"), (1, "v " * 1_000_000, "b")]), weights=(1.0, 9.0),
                      share=1.25).collect()
    target = {r.doc_id: r.target for r in rows}
    assert target[0] == pytest.approx(150_000)
    assert {r.doc_id: r.taken for r in rows} == {0: 200_000, 1: 1_000_000}


# Contamination


def slow_contaminations(documents, items):
    def runs(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    found = []
    for item, text in items:
        words = decontam.lowered_words(text)
        n = min(5, len(words))
        wanted = runs(words, n) if n else set()
        for doc, body in documents if wanted else []:
            shared = len(wanted & runs(decontam.lowered_words(body), n))
            if shared >= 0.8 * len(wanted) - 1e-9:
                found.append((doc, item, shared, len(wanted)))
    return sorted(found)


def test_contamination_of_the_table(spark):
    documents = [(r.doc_id, r.text) for r in table(spark, "documents")]
    items = [(r.item_id, r.text) for r in table(spark, "benchmark")]
    rows = queries.op9_contamination(spark, SF_DIR).collect()
    found = sorted((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in rows)
    assert found == slow_contaminations(documents, items)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination_of_odd_texts(spark, block_bytes):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 30)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "..."), (93, "w1"), (94, "W2 w3"), (95, items[0][1])]
    documents = [(100, None), (101, ""), (102, "w1"), (103, "x W2, w3 y")]
    for i in range(60):
        own = draw.choice(items[:25])[1].split()
        for _ in range(draw.randint(0, 3)):
            own[draw.randrange(len(own))] = "other"
        before = draw.choices(words, k=draw.randint(0, 400))
        documents.append((i, " ".join(before + own + draw.choices(words, k=3))))
    tests = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    frame = docs(spark, [(*d, "s") for d in documents])
    rows = decontam.contaminations(frame, tests, block_bytes=block_bytes).collect()
    found = sorted((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in rows)
    wanted = slow_contaminations(documents, items)
    assert found == wanted
    clean = decontam.drop_contaminated(frame, tests, block_bytes=block_bytes)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in documents} - {w[0] for w in wanted}


def test_contamination_without_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    frame = docs(spark, [(1, "a b c", "s")])
    assert decontam.contaminations(frame, none).collect() == []
    assert decontam.drop_contaminated(frame, none).count() == 1
