"""Judge replies to scores, averages and a composite."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import fixed_values as fixed


def read_scores(reply: Column) -> Column:
    """Struct of the criteria as a reply states them; null unless it is one whole JSON object."""
    fields = ", ".join(f"{c} double" for c in fixed.CRITERIA)
    whole = F.when(F.trim(reply).rlike(r"^\{[^{}]*\}$"), F.trim(reply))
    return F.from_json(whole, fields)


def judge_scores(replies: DataFrame, by: str = "model", reply: str = "reply") -> DataFrame:
    """Average per criterion over the non-null scores, and the mean of those averages.

    A score that is no number from 1 to 5 is null. A model without any readable score has
    null averages and a composite of 0. Every reply is parsed once: the parsed struct is a
    generated row, which no later expression takes apart again.
    """
    read = replies.select(by, F.explode(F.array(read_scores(F.col(reply)))).alias("s"))
    averages = read.groupBy(by).agg(
        *[F.avg(F.when(F.col(f"s.{c}").between(1, 5), F.col(f"s.{c}"))).alias(f"avg_{c}")
          for c in fixed.CRITERIA]
    )
    return averages.withColumn("composite_score", composite([f"avg_{c}" for c in fixed.CRITERIA]))


def composite(columns: list[str]) -> Column:
    total, present = F.lit(0.0), F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
        present = present + F.col(c).isNotNull().cast("int")
    return F.coalesce(F.try_divide(total, present), F.lit(0.0))
