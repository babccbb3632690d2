import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.operators import config, promotion, rotation, sessions
from gleanery.operators.running import Fold, hot_keys, prefix_scan, ranged, running
from gleanery.plans import promotion as jobs
from gleanery.sources import tables
from tests.conftest import values

T0 = dt.datetime(2026, 1, 1)
FIRST_CONFIG = {"config_version": 1, "updated_by": "setup", "generation_model_name": "gen",
                "embedding_model_name": "emb", "embedding_model_path": "models/emb",
                "embedding_dimension": 384}


def terms(spark, rows):
    return tables.local_rows(spark, rows, schemas.SEARCH_TERMS)


def test_next_term_order(spark):
    df = terms(spark, [
        ("recent", True, T0, 3, None), ("old", True, T0 - dt.timedelta(9), 1, None),
        ("never", True, None, 0, None), ("paused", False, None, 0, None),
        ("unset", None, None, 0, None)])
    assert [r["term"] for r in rotation.next_terms(df, 9).collect()] == ["never", "old", "recent"]
    assert rotation.next_term(df) == {"term": "never", "last_searched_through": None}
    with pytest.raises(ValueError):
        rotation.next_term(df.where("term = 'paused'"))


def test_windows(spark):
    through = [None, dt.date(2020, 1, 31), dt.date(2026, 1, 15), dt.date(2026, 1, 31)]
    df = terms(spark, [(str(i), True, None, 0, d) for i, d in enumerate(through)])
    got = rotation.backfill_window(df, F.lit("2026-01-31").cast("date"), 30)
    assert values(got, "term", "mindate", "maxdate", "maxdate_iso", "caught_up") == [
        ("0", "2020/01/01", "2020/01/31", "2020-01-31", False),
        ("1", "2020/01/31", "2020/03/01", "2020-03-01", False),
        ("2", "2026/01/15", "2026/01/31", "2026-01-31", True),
        ("3", "2026/01/31", "2026/01/31", "2026-01-31", True)]


def test_rotation_visits_every_active_term(spark):
    state = terms(spark, [(f"t{i}", i != 2, None, 0, None) for i in range(5)])
    seen = []
    for n in range(4):
        seen.append(rotation.next_term(state)["term"])
        runs = spark.createDataFrame(
            [(seen[-1], T0 + dt.timedelta(n), dt.date(2020, 1, 1 + n))],
            "term string, run_at timestamp, searched_through date")
        state = spark.createDataFrame(rotation.mark_runs(state, runs).collect(), state.schema)
    assert sorted(seen) == ["t0", "t1", "t3", "t4"]
    assert values(state, "term", "run_count") == [
        ("t0", 1), ("t1", 1), ("t2", 0), ("t3", 1), ("t4", 1)]


def test_date_bounds(spark):
    df = spark.createDataFrame(
        [(d, dt.datetime(2020, 1, d, 23, 59)) for d in [1, 2, 3]], "k int, ts timestamp_ntz")
    bound = lambda a, b: [k for (k,) in values(
        rotation.within_dates(df, "ts", a, b, "2020-01-02"), "k")]
    assert bound("2020/01/02", "2020/01/03") == [2, 3]
    assert bound("2020-01-02", None) == [2]
    assert bound(None, "2020/01/01") == [1]
    assert bound(None, None) == [1, 2, 3]


def history(spark):
    first = [1, T0, "initial_setup", "g1", "e1", "p1", 384]
    return tables.local_rows(spark, [first], schemas.PRODUCTION_CONFIG)


def test_config_versions_and_rollback(spark):
    h = history(spark)
    stamp = F.lit(T0)
    for updates in [{"embedding_model_name": "e2", "embedding_dimension": 768},
                    {"generation_model_name": "g2"}]:
        h = h.unionByName(config.next_version(h, updates, "test", stamp))
    assert values(config.latest(h), "config_version", *schemas.CONFIG_FIELDS) == [
        (3, "g2", "e2", "p1", 768)]
    h = h.unionByName(config.rollback_to(h, 1, stamp))
    assert values(config.latest(h), "config_version", "updated_by", *schemas.CONFIG_FIELDS) == [
        (4, "rollback_to_v1", "g1", "e1", "p1", 384)]
    assert h.count() == 4
    with pytest.raises(ValueError):
        config.rollback_to(h, 99)
    with pytest.raises(ValueError):
        config.next_version(h, {"nope": 1}, "test")


def test_running_equals_plain_windows_under_skew(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{i % 101}"), i,
             rng.choice([None, None, f"v{i}"]), rng.choice([None, i])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t int, a string, b int")
    hot = hot_keys(df, ["k"], hot_rows=60)
    assert {k for (k,) in values(hot, "k")} >= {"hot", None}
    assert hot.count() < df.select("k").distinct().count()
    w = Window.partitionBy("k").orderBy("t")
    plain = df.select(
        "k", "t", F.last("a", True).over(w).alias("a"), F.last("b", True).over(w).alias("b"),
        F.row_number().over(w).cast("long").alias("n"))
    expected = values(plain, "k", "t", "a", "b", "n")
    for sliced in [hot, hot.limit(0)]:
        got = running(df, ["k"], ["t"], number="n", carry=["a", "b"], hot=sliced, hot_rows=60)
        assert values(got, "k", "t", "a", "b", "n") == expected


def test_prefix_scan_of_one_key_stays_below_the_stated_rows(spark):
    rng = random.Random(8)
    rows = [("k", f"same beginning {i:05}", rng.choice([None, rng.randrange(-99, 99)]))
            for i in range(6000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, place string, v long")
    folds = {how: Fold(F.col("v"), how) for how in ("sum", "min", "max", "xor", "last")}
    placed = ranged(df, ["k"], ["place"], hot_rows=800)
    sizes = placed.groupBy("_part").count()
    assert sizes.agg(F.max("count")).head()[0] <= 800 and sizes.count() >= 8
    got = prefix_scan(df, ["k"], ["place"], folds, hot_rows=800)
    want, state = {}, dict.fromkeys(folds)
    join = {"sum": int.__add__, "min": min, "max": max, "xor": int.__xor__, "last": lambda a, b: b}
    for _, place, v in sorted(rows, key=lambda r: r[1]):
        if v is not None:
            state = {h: v if s is None else join[h](s, v) for h, s in state.items()}
        want[place] = tuple(state[h] for h in folds)
    assert {r["place"]: tuple(r[h] for h in folds) for r in got.collect()} == want


def test_prefix_scan_of_nothing_and_of_null_places(spark):
    df = spark.createDataFrame([], "k string, t int")
    assert running(df, ["k"], ["t"], number="n").collect() == []
    rows = spark.createDataFrame([(None, 2), (None, None), ("a", 1)], "k string, t int")
    for hot_rows in (1, 100):
        got = running(rows, ["k"], ["t"], number="n", hot_rows=hot_rows)
        assert values(got, "k", "t", "n") == sorted(
            [(None, None, 1), (None, 2, 2), ("a", 1, 1)], key=repr)


def test_best_candidate_of_recent_results(spark):
    rows = [(f"m{m}", 0.9 if (b, m) == (0, 0) else 0.1 * m, T0 + dt.timedelta(b))
            for b in range(5) for m in range(3)]
    df = spark.createDataFrame(rows, "model string, score double, evaluated_at timestamp")
    recent = promotion.recent_results(df)
    assert recent.count() == 10
    assert values(promotion.best_candidate(recent, "score"), "model", "score") == [("m2", 0.2)]
    assert promotion.latest_batch(df).count() == 3
    assert promotion.best_candidate(df.limit(0), "score").count() == 0


def test_the_whole_newest_batch_competes(spark, database):
    results, configs = f"{database}.results", f"{database}.config"
    jobs.seed_config(spark, configs, FIRST_CONFIG)
    rows = [(f"m{m:02}", "p", 8, 10, 0.3 if m < 11 else 0.8, 0.4, 0.6, 0.4, T0) for m in range(12)]
    rows += [("late", "p", 8, 10, float("nan"), 0.4, 0.6, 0.4, T0),
             ("earlier", "p", 8, 10, 0.9, 0.4, 0.6, 0.4, T0 - dt.timedelta(1))]
    tables.overwrite(tables.local_rows(spark, rows, schemas.EMBEDDING_RESULTS), results)
    assert jobs.promote_embedding(spark, results, configs, 0.5) == ("promoted", 0.8)
    assert config.latest(spark.table(configs)).head()["embedding_model_name"] == "m11"


def test_promotion_is_strict(spark):
    best = spark.createDataFrame([("s1", "m", 0.5), ("s2", "m", 0.6), ("s4", "m", 0.1)],
                                 "slot string, model string, score double")
    current = spark.createDataFrame([("s1", "c", 0.5), ("s2", "c", 0.5), ("s3", "c", 0.5)],
                                    "slot string, current_model string, current_score double")
    got = promotion.promotion_decisions(best, current, "score", ["slot"])
    assert values(got, "slot", "decision", "model", "score") == [
        ("s1", "no_action", "c", 0.5), ("s2", "promoted", "m", 0.6),
        ("s3", "no_action", "c", 0.5), ("s4", "promoted", "m", 0.1)]


def test_promotion_job(spark, database):
    results, configs = f"{database}.results", f"{database}.config"
    assert jobs.seed_config(spark, configs, FIRST_CONFIG)
    assert not jobs.seed_config(spark, configs, FIRST_CONFIG)
    tables.ensure_table(spark, results, schemas.EMBEDDING_RESULTS)
    assert jobs.promote_embedding(spark, results, configs, 0.0) == ("no_action", 0.0)
    tables.append(tables.local_rows(
        spark, [("m2", "path2", 768, 10, 0.5, 0.4, 0.6, 0.45, T0)],
        schemas.EMBEDDING_RESULTS), results)
    assert jobs.promote_embedding(spark, results, configs, 0.5) == ("no_action", 0.5)
    assert jobs.promote_embedding(spark, results, configs, 0.4) == ("promoted", 0.5)
    latest = config.latest(spark.table(configs)).head()
    assert (latest["config_version"], latest["embedding_model_name"],
            latest["embedding_dimension"], latest["generation_model_name"]) == (
        2, "m2", 768, FIRST_CONFIG["generation_model_name"])
    assert jobs.rollback(spark, configs, 1) == 3
    assert config.latest(spark.table(configs)).head()["embedding_dimension"] == 384


def test_sessions(spark):
    df = spark.createDataFrame([("s", t) for t in range(8)] + [("r", 0)],
                               "session_id string, turn_number int")
    last = sessions.last_turns(df, 5)
    assert values(last, "session_id", "turn_number") == [("r", 0)] + [
        ("s", t) for t in range(3, 8)]
    states = spark.createDataFrame([("s", "a", 1, 1), ("s", "b", 2, 1), ("s", "c", 2, 2)],
                                   "id string, st string, up int, tie int")
    assert values(sessions.latest_state(states, "id", "st", "up", "tie"), "id", "st", "up") == [
        ("s", "c", 2)]
