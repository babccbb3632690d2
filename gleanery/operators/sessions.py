"""Chat sessions: recent turns and latest state."""

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery import fixed_values as fixed


def last_turns(
    history: DataFrame,
    n: int = fixed.PROMPT_HISTORY_TURNS,
    session: str = "session_id",
    turn: str = "turn_number",
) -> DataFrame:
    """The last n turns of every session; each task sends at most n rows per session."""
    newest = Window.partitionBy(session).orderBy(F.desc(turn))
    return (
        history.withColumn("_back", F.row_number().over(newest))
        .where(F.col("_back") <= n)
        .drop("_back")
    )


def latest_state(
    states: DataFrame, session: str, state: str, updated: str, tie: str
) -> DataFrame:
    """State of the newest row per session, one aggregation with partial results per task."""
    newest = F.struct(updated, tie)
    return states.groupBy(session).agg(
        F.max_by(state, newest).alias(state), F.max(updated).alias(updated)
    )
