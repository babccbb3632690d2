"""Incremental, de-duplicated ingest of article records."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import session
from gleanery.operators.keys import new_per_key, unseen_wide
from gleanery.sources import tables
from gleanery.sources.articles import article_key, parse_articles

META_COLUMNS = ["title", "authors", "journal", "year", "mesh_terms", "doi"]


def search_report(
    searched: DataFrame, registry: DataFrame, key: str, cap: int | None = None
) -> DataFrame:
    """One row: ids searched, ids not registered yet, and whether the search was cut off at
    ``cap``, the most that one request could return (never without one)."""
    times = searched.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    known = registry.select(key).distinct().withColumn("known", F.lit(True))
    total = F.coalesce(F.sum("times"), F.lit(0))
    return times.join(known, key, "left").agg(
        total.alias("searched"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("times"))), F.lit(0)).alias("new"),
        (F.lit(False) if cap is None else total >= cap).alias("truncated"),
    )


def new_articles(articles: DataFrame, registry: DataFrame, key: str = "pmid") -> DataFrame:
    """Parsed articles the registry lacks, one per key; rows without a key are unreadable,
    :func:`unreadable` has those."""
    return new_per_key(registry, articles, key, [F.xxhash64(*articles.columns)])


def unreadable(articles: DataFrame, key: str = "pmid") -> DataFrame:
    """Parsed rows without a key: their XML could not be read."""
    return articles.where(F.col(key).isNull())


def new_records(raw: DataFrame, xml: str, registry: DataFrame, key: str = "pmid") -> DataFrame:
    """Raw records whose key the registry lacks, found before the costly parse.

    Only the key is taken from the XML here. Records without one pass on, so that the parse
    reports them as unreadable.
    """
    keyed = raw.withColumn(key, article_key(F.col(xml)))
    return unseen_wide(keyed, registry, key).drop(key)


@dataclass(frozen=True)
class IngestTables:
    meta: str
    abstracts: str
    registry: str
    rejects: str | None = None


def ingest_records(
    spark: SparkSession, raw: DataFrame, xml: str, names: IngestTables, key: str = "pmid"
) -> int:
    """:func:`ingest` of raw records; known ones are left out before they are parsed.

    Unreadable records are appended to the ``rejects`` table, if one is named.
    """
    fresh = new_records(raw, xml, tables.scan(spark, names.registry), key)
    parsed = parse_articles(fresh, xml, xml)
    if names.rejects:
        tables.ensure_table(spark, names.rejects, fresh.select(xml).schema)
        tables.append(unreadable(parsed, key).select(xml), names.rejects)
    return ingest(spark, parsed.drop(xml), names, key)


def ingest(spark: SparkSession, articles: DataFrame, names: IngestTables, key: str = "pmid") -> int:
    """Merge new articles into the three tables; returns the number of new keys.

    The parsed rows are checkpointed once and written three times. The registry comes
    last: after a failure in between, the next run finds the keys still unregistered
    and the merges add only what is missing.
    """
    session.shared_root(spark)
    fresh = new_articles(articles, tables.scan(spark, names.registry), key).checkpoint()
    parts = {
        names.meta: fresh.select(key, *META_COLUMNS),
        names.abstracts: fresh.select(key, "abstract"),
        names.registry: fresh.select(key),
    }
    for name, rows in parts.items():
        target = tables.scan(spark, name)
        tables.append(new_per_key(target, rows, key), name)
    return fresh.count()
