"""Key-based table operators: anti-joins, merges, updates and snapshot differences."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import session
from gleanery.functions.vectors import has_dimension
from gleanery.sources import tables


# Keys of one join side are broadcast up to this many, counted before.
BROADCAST_KEYS = 1_000_000


def unseen(searched: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Rows whose key the registry lacks. Repeated rows survive; null keys are never seen.

    Few searched rows against a large registry: the registry is read in place and cut to
    the searched keys first, so it is not shuffled. Otherwise the registry's keys are
    partly de-duplicated before the exchange, so a key held by many registry rows (all
    chunks of a document) travels once per task. Tables bucketed on the key are joined
    without any shuffle.
    """
    known = registry.select(key)
    if tables.would_broadcast(searched) and not tables.would_broadcast(known):
        known = known.join(searched.select(key), key, "left_semi")
    return searched.join(known.distinct(), key, "left_anti")


def unseen_wide(
    rows: DataFrame, registry: DataFrame, key: str, co_bucketed: bool = False
) -> DataFrame:
    """:func:`unseen` for rows with a large payload, which should not be shuffled.

    Unless one side is small or both are bucketed alike, the new keys are found by a join
    of the key columns alone and counted. If they are few, as in an incremental run, they
    are broadcast to the scan of the rows; else the rows are joined directly.
    """
    known = registry.select(key)
    if co_bucketed or tables.would_broadcast(known) or tables.would_broadcast(rows):
        return unseen(rows, registry, key)
    session.shared_root(rows.sparkSession)
    new = rows.select(key).join(known.distinct(), key, "left_anti").distinct()
    wanted = new.withColumnRenamed(key, "_new").checkpoint()
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, F.col(key).eqNullSafe(F.col("_new")), "left_semi")


def broadcast_if_few(keys: DataFrame) -> DataFrame:
    """The keys, marked for broadcast when there are few; they should be checkpointed."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``.

    Spark limits each key to one row per task before the exchange, so a hot key costs
    one row per task, not its whole group.
    """
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def new_per_key(
    target: DataFrame, source: DataFrame, key: str, order: Sequence[Column] | None = None
) -> DataFrame:
    """Source rows with a key the target lacks, one per key; rows without a key are left out.

    Repeated keys are reduced before the join, so a hot key reaches its task as one
    row per task of the scan, and the join reuses the exchange of that step.
    """
    keyed = source.where(F.col(key).isNotNull())
    once = first_per_key(keyed, [key], order or [F.col(c).asc() for c in source.columns])
    return unseen(once, target, key).select(*source.columns)


def absent_rows(
    target: DataFrame, source: DataFrame, key: str, order: Sequence[Column] | None = None
) -> DataFrame:
    """Source rows an insert-only merge adds: the new rows, one per key.

    Rows without a key are rejected, :func:`keyless` has them: a null matches nothing, so
    they would come in again with every run.
    """
    return new_per_key(target, source, key, order)


def keyless(source: DataFrame, key: str) -> DataFrame:
    """Rows that a merge or a snapshot rejects, as they have no key."""
    return source.where(F.col(key).isNull())


def merge_insert_only(
    target: DataFrame, source: DataFrame, key: str, order: Sequence[Column] | None = None
) -> DataFrame:
    """Target after the merge: existing rows stay as they are, new keys come in once."""
    return target.unionByName(absent_rows(target, source, key, order))


def union_keys(*tables: DataFrame, key: str) -> DataFrame:
    """Distinct keys over all tables: the registry after new ids were recorded."""
    keys = tables[0].select(key)
    for table in tables[1:]:
        keys = keys.unionByName(table.select(key))
    return keys.distinct()


def seed_if_empty(table: DataFrame, defaults: DataFrame) -> DataFrame:
    """The table, or the defaults when it holds no row.

    The emptiness test is an uncorrelated subquery that reads at most one row.
    """
    has_rows = table.limit(1).exists()
    return table.unionByName(defaults.where(~has_rows))


def keyed_update(
    table: DataFrame, updates: DataFrame, keys: Sequence[str], assign: dict[str, Column]
) -> DataFrame:
    """Rows with a matching update get the assigned columns; others pass unchanged.

    ``updates`` holds one row per key (aggregate it first) and is reachable in
    ``assign`` as ``u.<column>``, the table as ``t.<column>``.
    """
    t = table.alias("t")
    u = updates.withColumn("_hit", F.lit(True)).alias("u")
    same = [F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys]
    condition = same[0]
    for term in same[1:]:
        condition = condition & term
    columns = [
        F.when(F.col("u._hit"), assign[c]).otherwise(F.col(f"t.{c}")).alias(c)
        if c in assign
        else F.col(f"t.{c}")
        for c in table.columns
    ]
    return t.join(u, condition, "left").select(*columns)


def set_flag(table: DataFrame, keys: DataFrame, key: str, flag: str, value: bool) -> DataFrame:
    """Set a boolean column for the listed keys, keeping every row."""
    return keyed_update(table, keys.select(key).distinct(), [key], {flag: F.lit(value)})


def content_hash(df: DataFrame, key: str) -> DataFrame:
    """Key and a 64-bit digest of all other columns.

    Rows are hashed where they are read, so payloads (texts, vectors) are not joined.
    """
    return with_digest(df, key).select(key, F.col("_digest").alias("digest"))


def with_digest(df: DataFrame, key: str) -> DataFrame:
    """The rows with a 64-bit ``_digest`` of all columns but the key.

    The hash function passes over nulls, so null flags are hashed along; structs, maps and
    nested arrays are hashed as JSON that spells nulls out.
    """
    parts = []
    for field in sorted(df.schema, key=lambda f: f.name):
        if field.name == key:
            continue
        value, kind = F.col(field.name), field.dataType
        inner = kind.elementType if isinstance(kind, T.ArrayType) else None
        if isinstance(inner or kind, (T.StructType, T.MapType, T.ArrayType)):
            parts.append(F.to_json(F.struct(value), {"ignoreNullFields": "false"}))
            continue
        parts += [value, value.isNull()]
        if inner is not None:
            parts.append(F.transform(field.name, lambda x: x.isNull()))
    return df.withColumn("_digest", F.xxhash64(*parts))


def snapshot_keys(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: the digest of the row that stands for it, the least, and how many rows
    have the key. Rows without a key are left out."""
    return content_hash(rows, key).where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min("digest").alias("digest"), F.count(F.lit(1)).alias("rows"))


def rejected_rows(source: DataFrame, key: str) -> DataFrame:
    """One row: how many source rows have no key, and how many repeat one (``repeated``)."""
    keyed = F.col(key).isNotNull()
    times = source.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return times.agg(
        F.coalesce(F.sum(F.when(~keyed, F.col("rows"))), F.lit(0)).alias("keyless"),
        F.coalesce(F.sum(F.when(keyed, F.col("rows") - 1)), F.lit(0)).alias("repeated"))


def snapshot_diff(index: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Changes that bring ``index`` to ``source``: key and ``change`` (insert, update, delete).

    Source rows without a key are rejected, and of rows that share a key the one with the
    least digest counts (:func:`rejected_rows` counts both), so a second run after the
    changes finds none. A key that the index repeats is an update.
    """
    old = snapshot_keys(index.select(*source.columns), key).select(
        F.col(key), F.col("digest").alias("old_digest"), F.col("rows").alias("old_rows")
    )
    new = snapshot_keys(source, key).select(F.col(key), F.col("digest").alias("new_digest"))
    change = (
        F.when(F.col("old_digest").isNull(), "insert")
        .when(F.col("new_digest").isNull(), "delete")
        .when((F.col("old_digest") != F.col("new_digest")) | (F.col("old_rows") > 1), "update")
    )
    return (
        old.join(new, key, "full_outer")
        .select(key, change.alias("change"))
        .where(F.col("change").isNotNull())
    )


def apply_changes(
    index: DataFrame, source: DataFrame, changes: DataFrame, key: str
) -> DataFrame:
    """Index after the changes; payloads are fetched for changed keys only.

    The changed keys are written to the shared folder and counted: few ones are
    broadcast, so neither table is shuffled for them. Index rows without a key go.
    """
    session.shared_root(changes.sparkSession)
    changes = changes.checkpoint()
    changed = broadcast_if_few(changes.select(key))
    written = broadcast_if_few(changes.where(F.col("change") != "delete").select(key))
    kept = index.where(F.col(key).isNotNull()).join(changed, key, "left_anti")
    fresh = with_digest(source.join(written, key, "left_semi").select(*index.columns), key)
    once = first_per_key(fresh, [key], [F.asc("_digest")]).drop("_digest")
    return kept.unionByName(once)


def split_by_dimension(
    df: DataFrame, vector: str, dimension: int
) -> tuple[DataFrame, DataFrame]:
    """Rows that fit an index of the dimension, and the rejected rest."""
    fits = has_dimension(F.col(vector), dimension)
    return df.where(fits), df.where(~fits)
