"""Registered queries: rotation, configuration, promotion and sessions."""

from pyspark.sql import functions as F

from gleanery.operators import config, promotion, rotation, sessions
from gleanery.queries.common import table
from gleanery.queries.keys import TERMS_SQL
from gleanery.schemas import CONFIG_FIELDS

TODAY = "2001-07-01"
RUN_AT = "2001-07-01 06:00:00"
INCREMENT_DAYS = 90


def _terms(spark, sf):
    """Customers as search terms; their urgent orders are the runs that set the watermark."""
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))
    runs = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(urgent).alias("last_run_at"),
        F.count("o_orderkey").cast("int").alias("run_count"),
    )
    return table(spark, sf, "customer").join(runs, "c_custkey", "left").select(
        F.col("c_name").alias("term"),
        (F.col("c_acctbal") > 0).alias("active"),
        "last_run_at",
        F.coalesce("run_count", F.lit(0)).alias("run_count"),
        F.col("last_run_at").cast("date").alias("last_searched_through"),
    )


def _hour(ts):
    """Date and hour as text: ordered like the time stamp, whatever the session's time zone."""
    return F.substring(F.col(ts).cast("string"), 1, 13)


def _today():
    return F.lit(TODAY).cast("date")


def _run_at():
    return F.lit(RUN_AT).cast("timestamp_ntz")


def next_terms(spark, sf):
    return rotation.next_terms(_terms(spark, sf), 10).select("term", "last_searched_through")


def backfill_window(spark, sf):
    windows = rotation.backfill_window(_terms(spark, sf), _today(), INCREMENT_DAYS, "2000-01-01")
    return windows.select("term", "mindate", "maxdate", "maxdate_iso", "caught_up")


def rotation_plan(spark, sf):
    return rotation.rotation_plan(_terms(spark, sf), _today(), _run_at(), INCREMENT_DAYS, 10)


def watermark_advance(spark, sf):
    return rotation.advance_watermarks(_terms(spark, sf), _today(), _run_at(), INCREMENT_DAYS)


def date_bounded_scan(spark, sf):
    """Only the lower bound is given; the upper one defaults to today."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return rotation.within_dates(orders, "o_orderdate", "2001/01/01", None, TODAY)


def _updates(spark, sf):
    """Events as sparse updates of a user's configuration: each type sets one field."""
    kind, props = F.col("event_type"), F.col("props")
    return table(spark, sf, "events").select(
        "user_id", "ts", "event_id",
        F.when(kind == "signup", props).alias("generation_model_name"),
        F.when(kind == "purchase", props).alias("embedding_model_name"),
        F.when(kind == "view", props).alias("embedding_model_path"),
        F.when(kind == "click", F.floor("value").cast("int")).alias("embedding_dimension"),
    )


def _history(spark, sf):
    return config.carry_forward(_updates(spark, sf), ["user_id"], ["ts", "event_id"])


def config_carry_forward(spark, sf):
    return _history(spark, sf).select("user_id", "config_version", "event_id", *CONFIG_FIELDS)


def config_latest(spark, sf):
    versions = table(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("config_version"), "event_type", "value"
    )
    return config.latest(versions, ["user_id"])


def config_rollback(spark, sf):
    requests = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("user_id"), (F.col("s_nationkey") * 5 + 1).alias("to_version")
    )
    return config.rollbacks(_history(spark, sf), requests, ["user_id"])


def _results(spark, sf):
    return table(spark, sf, "events").select(
        "user_id",
        F.col("event_type").alias("model"),
        F.col("value").alias("score"),
        F.col("ts").alias("evaluated_at"),
        "event_id",
    )


def recent_results(spark, sf):
    """The ten newest results of every user, a report."""
    recent = promotion.recent_results(_results(spark, sf), slot=["user_id"], tie="event_id")
    return recent.select("user_id", "model", "score", "event_id")


def best_candidate(spark, sf):
    """Results of one day form a batch; the best of the newest one, over all users."""
    batches = _results(spark, sf).withColumn("evaluated_at", F.date_trunc("day", "evaluated_at"))
    best = promotion.best_candidate(promotion.latest_batch(batches), "score", tie="event_id")
    return best.select("user_id", "model", "score", "event_id")


def best_of_batch(spark, sf):
    """Results of one user and hour form a batch; best of each user's newest batch."""
    batches = _results(spark, sf).withColumn("evaluated_at", _hour("evaluated_at"))
    newest = promotion.latest_batch(batches, ["user_id"])
    best = promotion.best_candidate(newest, "score", ["user_id"], tie="event_id")
    return best.select("user_id", "model", "score", "event_id")


def promotion_decision(spark, sf):
    """The best of each user's newest batch (an hour) against the score in force."""
    batches = _results(spark, sf).withColumn("evaluated_at", _hour("evaluated_at"))
    newest = promotion.latest_batch(batches, ["user_id"])
    best = promotion.best_candidate(newest, "score", ["user_id"], tie="event_id")
    current = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("current_model"),
        (F.col("c_acctbal") / 50).alias("current_score"),
    )
    return promotion.promotion_decisions(best, current, "score", ["user_id"])


def last_n_turns(spark, sf):
    return sessions.last_turns(
        table(spark, sf, "conversations"), session="conv_id", turn="turn"
    )


def latest_state(spark, sf):
    return sessions.latest_state(
        table(spark, sf, "events"), "user_id", "props", "ts", "event_id"
    )


QUERIES = {
    "next_terms": next_terms,
    "backfill_window": backfill_window,
    "rotation_plan": rotation_plan,
    "watermark_advance": watermark_advance,
    "date_bounded_scan": date_bounded_scan,
    "config_carry_forward": config_carry_forward,
    "config_latest": config_latest,
    "config_rollback": config_rollback,
    "recent_results": recent_results,
    "best_candidate": best_candidate,
    "best_of_batch": best_of_batch,
    "promotion_decision": promotion_decision,
    "last_n_turns": last_n_turns,
    "latest_state": latest_state,
}

_NEXT_SQL = f"""
WITH {TERMS_SQL},
picked AS (
  SELECT * FROM terms WHERE active ORDER BY last_run_at ASC NULLS FIRST, term LIMIT 10
)"""


def _high(start: str) -> str:
    return f"""least(CAST(coalesce(last_searched_through, DATE '{start}')
                       + INTERVAL {INCREMENT_DAYS} DAY AS DATE), DATE '{TODAY}')"""


_HISTORY_SQL = """
history AS (
  SELECT user_id, event_id,
         CAST(row_number() OVER w AS INTEGER) AS config_version,
         last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER w
           AS generation_model_name,
         last_value(CASE WHEN event_type = 'purchase' THEN props END IGNORE NULLS) OVER w
           AS embedding_model_name,
         last_value(CASE WHEN event_type = 'view' THEN props END IGNORE NULLS) OVER w
           AS embedding_model_path,
         last_value(CASE WHEN event_type = 'click' THEN CAST(floor(value) AS INTEGER) END
                    IGNORE NULLS) OVER w AS embedding_dimension
  FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""

_BEST_SQL = """
best AS (
  SELECT user_id, model, score FROM (
    SELECT e.user_id, event_type AS model, value AS score,
           row_number() OVER (PARTITION BY e.user_id ORDER BY value DESC, event_id) AS best
    FROM events e JOIN (
      SELECT user_id, date_trunc('hour', max(ts)) AS newest FROM events GROUP BY user_id
    ) n ON e.user_id = n.user_id AND date_trunc('hour', e.ts) = n.newest
  ) WHERE best = 1
)"""

ORACLES = {
    "next_terms": f"{_NEXT_SQL} SELECT term, last_searched_through FROM picked",
    "backfill_window": f"""
        WITH {TERMS_SQL}
        SELECT term,
               strftime(coalesce(last_searched_through, DATE '2000-01-01'), '%Y/%m/%d') AS mindate,
               strftime({_high('2000-01-01')}, '%Y/%m/%d') AS maxdate,
               strftime({_high('2000-01-01')}, '%Y-%m-%d') AS maxdate_iso,
               {_high('2000-01-01')} >= DATE '{TODAY}' AS caught_up
        FROM terms""",
    "rotation_plan": f"""
        {_NEXT_SQL}
        SELECT term,
               strftime(coalesce(last_searched_through, DATE '2020-01-01'), '%Y/%m/%d') AS mindate,
               strftime({_high('2020-01-01')}, '%Y/%m/%d') AS maxdate,
               {_high('2020-01-01')} >= DATE '{TODAY}' AS caught_up,
               TIMESTAMP '{RUN_AT}' AS last_run_at, run_count + 1 AS run_count,
               {_high('2020-01-01')} AS last_searched_through
        FROM picked""",
    "watermark_advance": f"""
        WITH {TERMS_SQL}
        SELECT term, active,
               CASE WHEN active THEN TIMESTAMP '{RUN_AT}' ELSE last_run_at END AS last_run_at,
               CASE WHEN active THEN run_count + 1 ELSE run_count END AS run_count,
               CASE WHEN active THEN {_high('2020-01-01')} ELSE last_searched_through END
                 AS last_searched_through
        FROM terms""",
    "date_bounded_scan": f"""
        SELECT o_orderkey, o_orderdate FROM orders
        WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-01-01' AND DATE '{TODAY}'""",
    "config_carry_forward": f"""
        WITH {_HISTORY_SQL}
        SELECT user_id, config_version, event_id, generation_model_name, embedding_model_name,
               embedding_model_path, embedding_dimension FROM history""",
    "config_latest": """
        SELECT user_id, event_id AS config_version, event_type, value FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place
          FROM events
        ) WHERE place = 1""",
    "config_rollback": f"""
        WITH {_HISTORY_SQL},
        requests AS (SELECT s_suppkey AS user_id, s_nationkey * 5 + 1 AS to_version FROM supplier),
        newest AS (SELECT user_id, max(config_version) AS version FROM history GROUP BY user_id)
        SELECT r.user_id, n.version + 1 AS config_version,
               'rollback_to_v' || r.to_version AS updated_by,
               h.user_id IS NOT NULL AS found, h.generation_model_name, h.embedding_model_name,
               h.embedding_model_path, h.embedding_dimension
        FROM requests r JOIN newest n ON r.user_id = n.user_id
        LEFT JOIN history h ON h.user_id = r.user_id AND h.config_version = r.to_version""",
    "recent_results": """
        SELECT user_id, event_type AS model, value AS score, event_id FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place
          FROM events
        ) WHERE place <= 10""",
    "best_candidate": """
        SELECT user_id, event_type AS model, value AS score, event_id FROM events
        WHERE date_trunc('day', ts) = (SELECT date_trunc('day', max(ts)) FROM events)
        ORDER BY value DESC, event_id LIMIT 1""",
    "best_of_batch": """
        SELECT user_id, event_type AS model, value AS score, event_id FROM (
          SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY value DESC, event_id)
                   AS place
          FROM events e JOIN (
            SELECT user_id, date_trunc('hour', max(ts)) AS newest FROM events GROUP BY user_id
          ) n ON e.user_id = n.user_id AND date_trunc('hour', e.ts) = n.newest
        ) WHERE place = 1""",
    "promotion_decision": f"""
        WITH {_BEST_SQL}
        SELECT coalesce(c_custkey, user_id) AS user_id,
               CASE WHEN score > coalesce(c_acctbal / 50, 0) THEN 'promoted' ELSE 'no_action' END
                 AS decision,
               CASE WHEN score > coalesce(c_acctbal / 50, 0) THEN model ELSE c_mktsegment END
                 AS model,
               CASE WHEN score > coalesce(c_acctbal / 50, 0) THEN score
                    ELSE coalesce(c_acctbal / 50, 0) END AS score
        FROM customer FULL JOIN best ON c_custkey = user_id""",
    "last_n_turns": """
        SELECT conv_id, turn, role, text FROM (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
          FROM conversations
        ) WHERE back <= 5""",
    "latest_state": """
        SELECT user_id, props, ts FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)
                   AS place
          FROM events
        ) WHERE place = 1""",
}
