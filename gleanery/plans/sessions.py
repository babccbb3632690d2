"""Jobs on the chat tables: record turns, read back a session's context, keep its state."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import fixed_values as fixed
from gleanery import schemas
from gleanery.operators import sessions
from gleanery.sources import tables


def record_turns(
    spark: SparkSession, turns: DataFrame, name: str, at: Column | None = None
) -> None:
    """Append turns (all columns of the history but ``created_at``)."""
    tables.ensure_table(spark, name, schemas.CONVERSATION_HISTORY)
    stamp = F.current_timestamp() if at is None else at
    tables.append(turns.withColumn("created_at", stamp), name)


def recent_turns(
    spark: SparkSession, name: str, session_id: str, n: int = fixed.PROMPT_HISTORY_TURNS
) -> DataFrame:
    """The last n turns of one session; the filter reaches the scan."""
    own = tables.scan(spark, name).where(F.col("session_id") == session_id)
    return sessions.last_turns(own, n)


def save_states(
    spark: SparkSession, states: DataFrame, name: str, at: Column | None = None
) -> None:
    """Append states ``(session_id, state_json)``; the newest of a session is in force.

    A session keeps the creation time of its first state.
    """
    tables.ensure_table(spark, name, schemas.SESSION_STATES)
    stamp = F.current_timestamp() if at is None else at
    first = tables.scan(spark, name).groupBy("session_id").agg(
        F.min("created_at").alias("created_at"))
    rows = states.select("session_id", "state_json").join(first, "session_id", "left")
    tables.append(
        rows.withColumns({"created_at": F.coalesce("created_at", stamp), "updated_at": stamp}), name
    )


def current_states(spark: SparkSession, name: str) -> DataFrame:
    """``(session_id, state_json, updated_at)`` in force."""
    return sessions.latest_state(
        tables.scan(spark, name), "session_id", "state_json", "updated_at", "state_json"
    )
