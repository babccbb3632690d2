"""Prefix trie of conversations that share their first turns, by whole-sequence collapse.

Identical rebuilt conversations become one weighted sequence with the list of the ids that
end there. Sequences that are proper prefixes of others are dropped by an anti-join, which
leaves the trie's leaves; only their prefixes are spelled out. Every node belongs to the
smallest leaf below it, so what ends or stands at a node is counted on one leaf only, summed
up along that leaf and then, by node, over all leaves.

A prefix is known by its length and 128 bits, the exclusive-or of hashes of its turns and
their places (each turn by its SHA-256), so prefixes come from a scan, never from a list of
turns in one row, and no text is shuffled.

Rows without a conversation id belong to none and are left out; a null role or text is
empty; turns are ordered by turn (nulls first), then role, then text; repeated rows count as
often as they stand there. An empty table has no node, not even a root. Remainders are those
of SQL: an id below 0 starts from the conversation at its multiple of ``group`` towards 0.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import attach, kept
from gleanery.operators.running import HOT_ROWS, Fold, hot_keys, prefix_scan

GROUP = 100
HEADS = 6
NODE = ["depth", "a", "b"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """``c, turn, role, tie, turn_hash, chars``: what the order and the trie need of each row.

    ``tie`` is the text of rows that share conversation, turn and role, and null elsewhere,
    so that texts are shuffled only where they decide an order.
    """
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("c"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).where("c IS NOT NULL")
    place = ["c", "turn", "role"]
    shared = kept(rows.groupBy(*place).count().where("count > 1").drop("count"))
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    columns = [*place, "tie", F.unhex(F.sha2(content, 256)).alias("turn_hash"),
               F.length("text").cast("long").alias("chars")]
    if shared.isEmpty():
        return rows.withColumn("tie", F.lit(None).cast("string")).select(*columns)
    tied = shared.select(*[F.col(p).alias(f"_{p}") for p in place])
    same = F.col("c").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_turn")) & (
        F.col("role") == F.col("_role"))
    return rows.join(tied, same, "left").withColumn(
        "tie", F.when(F.col("_role").isNotNull(), F.col("text"))).select(*columns)


def rebuilt(turns: DataFrame, hot: DataFrame, hot_rows: int = HOT_ROWS,
            group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """``c, depth, len, turn_hash, chars`` of the rebuilt conversations, with a row of depth 0.

    Conversation c starts with the first h turns of the one at the group's start, h being the
    CRC-32 of its id modulo ``heads``, and goes on with its own from the h-th on.
    """
    numbered = kept(prefix_scan(
        turns, ["c"], ["turn", "role", "tie"], {"n": Fold(F.lit(1).cast("long"), "sum")}, hot,
        hot_rows,
    ).select("c", "n", "turn_hash", "chars"))
    sizes = numbered.groupBy("c").agg(F.max("n").alias("own"))
    first = numbered.where((F.col("c") % group == 0) & (F.col("n") < heads))
    starts = first.groupBy(F.col("c").alias("start")).agg(
        F.array_sort(F.collect_list(F.struct("n", "turn_hash", "chars"))).alias("head"))
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % heads).cast("int")
    convs = kept(
        sizes.withColumns({"start": F.col("c") - F.col("c") % group, "h": h})
        .join(starts, "start", "left")
        .withColumn("head", F.when(F.col("head").isNotNull(), F.slice("head", 1, F.col("h"))))
        .withColumn("k", F.when(F.col("head").isNull(), 0).otherwise(F.size("head")))
        .withColumn("len", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
        .select("c", "h", "head", F.col("k").cast("long").alias("k"),
                F.col("len").cast("long").alias("len"))
    )
    roots = convs.select("c", F.lit(0).cast("long").alias("depth"), "len",
                         F.lit(None).cast("binary").alias("turn_hash"),
                         F.lit(0).cast("long").alias("chars"))
    lent = convs.select("c", "len", F.explode("head").alias("t")).select(
        "c", F.col("t.n").alias("depth"), "len", "t.turn_hash", "t.chars")
    own = attach(numbered, convs.select("c", "h", "k", "len"), ["c"]).where("n > h").select(
        "c", (F.col("n") - F.col("h") + F.col("k")).alias("depth"), "len", "turn_hash", "chars")
    return roots.unionByName(lent).unionByName(own)


def _place_hash(seed: int) -> Column:
    return F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(
        F.xxhash64(F.lit(seed), "depth", "turn_hash"))


def prefixes(turns: DataFrame, hot: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``c, depth, len`` and the prefix: ``a, b``, its parent's ``pa, pb``, the code points of
    its last turn (``chars``) and of all its turns (``cum``)."""
    rows = rebuilt(turns, hot, hot_rows).withColumns({"ha": _place_hash(1), "hb": _place_hash(2)})
    folds = {"a": Fold(F.col("ha"), "xor"), "b": Fold(F.col("hb"), "xor"),
             "cum": Fold(F.col("chars"), "sum")}
    return prefix_scan(rows.drop("turn_hash"), ["c"], ["depth"], folds, hot, hot_rows).select(
        "c", "depth", "len", "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("pa"),
        F.col("b").bitwiseXOR(F.col("hb")).alias("pb"), "chars", "cum")


def _key(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids that end at one node, as one decimal list each; the rows are sorted."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = _key(batch), batch.column(3).to_pylist()
        change = np.any([k[1:] != k[:-1] for k in key], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        ends = np.concatenate([starts[1:], [len(ids)]])
        lists = [",".join(map(str, ids[s:e])) for s, e in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(k[starts]) for k in key], pa.array([ids[s] for s in starts], pa.int64()),
             pa.array(lists, pa.string())],
            names=[*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's list from its pieces in order; one piece at a time."""
    node, state = None, None

    def row(done):
        return pa.RecordBatch.from_arrays(
            [*[pa.array([k[i] for k, _ in done], pa.int64()) for i in range(3)],
             pa.array([s.hexdigest() for _, s in done], pa.string())],
            names=[*NODE, "ends_sha256"])

    for batch in batches:
        done = []
        for *key, ids in zip(*[k.tolist() for k in _key(batch)], batch.column(4).to_pylist()):
            if key == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((node, state))
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield row(done)
    if node is not None:
        yield row([(node, state)])


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256`` from rows ``depth, a, b, c``.

    Ids are sorted by range partitions and travel on as lists, so even the ids of a very
    common conversation reach the task that hashes them as few rows, read one by one.
    """
    kinds = "depth long, a long, b long"
    pieces = (
        ends.select(*NODE, "c").repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c")
        .mapInArrow(_pieces, f"{kinds}, first long, ids string")
    )
    return (
        pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
        .mapInArrow(_digests, f"{kinds}, ends_sha256 string")
    )


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Conversations of more than ``hot_rows`` rows are scanned by range partitions.
    """
    turns = kept(ordered_turns(conversations, conv_id))
    hot = hot_keys(turns, ["c"], hot_rows)
    spelled = kept(prefixes(turns, hot, hot_rows))

    ends = spelled.where("depth = len")
    sequences = kept(ends.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("weight"), F.min("c").alias("least"), F.max("cum").alias("cum")))
    once = spelled.join(sequences.select(F.col("least").alias("c")), "c", "left_semi")
    proper = once.where("depth < len").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select(F.col("least").alias("c"))
    paths = kept(spelled.join(leaves, "c", "left_semi"))

    owned = (
        paths.groupBy(*NODE)
        .agg(F.count(F.lit(1)).alias("n_leaves"), F.min("c").alias("c"),
             F.max("chars").alias("own"))
        .join(sequences, NODE, "left")
        .select("c", "depth", "n_leaves", "own", "weight", "least",
                (F.col("weight") * F.col("cum")).alias("reach"))
    )
    upwards = paths.join(owned, ["c", "depth"], "left").withColumn("up", -F.col("depth"))
    summed = prefix_scan(upwards, ["c"], ["up"], {
        **{name: Fold(F.col(name), "sum") for name in ("weight", "reach", "own")},
        "least": Fold(F.col("least"), "min"),
    }, hot, hot_rows)
    nodes = kept(
        summed.groupBy(*NODE, "pa", "pb").agg(
            F.sum("weight").alias("n_convs"), F.min("least").alias("conv_id"),
            F.max("n_leaves").alias("n_leaves"),
            (F.sum("reach") - F.sum("own")
             - F.sum("weight") * F.max(F.col("cum") - F.col("chars"))).alias("saved_tokens"))
        .withColumn("above", F.col("depth") - 1)
    )
    children = nodes.where("depth > 0").groupBy(
        F.col("above").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("depth").alias("above"), F.col("a").alias("pa"),
                           F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return (
        attach(nodes, parents, ["above", "pa", "pb"])
        .join(children, NODE, "left").join(end_digests(ends), NODE, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs",
                F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
                "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    )
