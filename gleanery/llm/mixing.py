"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target; whole passes over the source come first. For what is left,
documents are counted by their exact length, a proportional number of each length is
taken, and bounded-knapsack dynamic programming picks the lengths that fill the rest.
Documents of a length are then chosen by a seeded hash. Texts are read once for their
lengths; everything else moves narrow rows.
"""

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import kept, row_key, unused
from gleanery.operators.keys import broadcast_if_few

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = 17
KNAPSACK_BUDGET = 1 << 16  # words left to the dynamic programme
SUMS = 1 << 16  # sums of long documents that are told apart
RANKED_ROWS = 512  # rows of one length that are ranked together
_WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column | str) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _ranked_sources(sizes: DataFrame) -> DataFrame:
    """``source, source_size, place``: sources by code point from 0, null last.

    The order is a range partitioning, each part numbered by itself.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = kept(
        totals.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    )
    counts = sorted((r[0], r[1]) for r in dealt.groupBy("part").count().collect())
    offsets = itertools.accumulate((c for _, c in counts), initial=0)
    before = F.create_map(*[
        F.lit(x) for (part, _), offset in zip(counts, offsets) for x in (part, offset)
    ]) if counts else F.lit(None)
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    place = inside - 1 + (before[F.col("part")] if counts else F.lit(0))
    return dealt.select("source", "source_size", place.alias("place"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """``source, source_size, target`` (double) from rows of ``source, size``.

    Weights repeat over the sources in order and part ``share`` of all sizes. A target
    stops at ``most`` times its source's size; the excess is shared again by weight
    until no target is above. Only sums leave the executors.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = kept(_ranked_sources(sizes).withColumn(
        "weight", F.get(cycle, (F.col("place") % len(weights)).cast("int"))))
    rate = 0.0
    limit = F.col("source_size") * most
    while True:
        open_ = F.col("weight") * rate <= limit
        sums = ranked.agg(
            F.sum("source_size"), F.sum(F.when(~open_, limit)), F.sum(F.when(open_, F.col("weight"))),
        ).first()
        left = share * (sums[0] or 0) - (sums[1] or 0.0)
        if not sums[2]:
            break
        if left / sums[2] <= rate:
            break
        rate = left / sums[2]
    return ranked.select(
        "source", "source_size",
        F.least(F.col("weight") * rate, limit.cast("double")).alias("target"),
    )


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED,
                knapsack: int = KNAPSACK_BUDGET) -> np.ndarray:
    """How many documents of each length to take, their sum the budget or as near as can be.

    A proportional part of every count comes first, then single documents of lengths in a
    seeded order until the dynamic programme can hold the rest, then its best fill. Where
    that misses the budget, as with few or long documents, sums of all of them are tried.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((taken * lengths).sum())
    for i in np.random.default_rng(seed).permutation(len(lengths)):
        if left <= knapsack:
            break
        size = int(lengths[i])
        more = min(int(counts[i] - taken[i]), max(0, math.ceil((left - knapsack) / size)),
                   left // size, 1 + int(counts[i]) // 8)
        taken[i] += more
        left -= more * size
    while left > knapsack:  # long documents are spread over what the first turn left
        fits = np.flatnonzero((counts > taken) & (lengths <= left))
        if not len(fits):
            break
        i = fits[np.argmax(lengths[fits])]
        more = min(int(counts[i] - taken[i]), left // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    if left <= knapsack:
        more = _fill(lengths, counts - taken, left)
        taken = taken + more
        left -= int((more * lengths).sum())
    return _closer(lengths, counts, budget, taken, left)


def _closer(lengths: np.ndarray, counts: np.ndarray, budget: int, taken: np.ndarray,
            left: int) -> np.ndarray:
    """``taken``, ``left`` words below the budget, or counts whose sum is closer to it.

    Sums are built up from long documents to short ones. All of them are kept up to
    ``SUMS``, beyond that one in each cell of a width that doubles as needed, so the sums
    are true ones of any size and few documents are fitted exactly.
    """
    step = int(np.gcd.reduce(lengths[counts > 0]))
    least = min(budget % step, -budget % step)  # no sum is closer
    best, node = left, -1
    if abs(best) <= least:
        return taken
    values, items_of, parents = [0], [-1], [-1]
    sums, nodes, width = np.zeros(1, np.int64), np.zeros(1, np.int64), 1
    items = []
    for i in np.argsort(-lengths, kind="stable"):
        size, many = int(lengths[i]), 1
        most = min(int(counts[i]), (budget + abs(best)) // size)
        while most > 0 and abs(best) > least:
            many = min(many, most)
            more = sums + size * many
            fits = more <= budget + abs(best)
            more, before = more[fits], nodes[fits]
            fresh = ~np.isin(more // width, sums // width)
            # The closest one counts even if another sum stands for its cell.
            if len(more):
                at = int(np.argmin(np.abs(more - budget)))
                fresh[at] |= abs(int(more[at]) - budget) < abs(best)
            more, before = more[fresh], before[fresh]
            if len(more):
                first = len(values)
                values += more.tolist()
                items_of += [len(items)] * len(more)
                parents += before.tolist()
                at = int(np.argmin(np.abs(more - budget)))
                gap = budget - int(more[at])
                if abs(gap) < abs(best) or abs(gap) == abs(best) and gap > best:
                    best, node = gap, first + at
                sums = np.concatenate([sums, more])
                nodes = np.concatenate([nodes, np.arange(first, len(values))])
                order = np.argsort(sums, kind="stable")
                sums, nodes = sums[order], nodes[order]
                while len(sums) > SUMS:
                    width *= 2
                    _, one = np.unique(sums // width, return_index=True)
                    sums, nodes = sums[one], nodes[one]
            items.append((i, many))
            most -= many
            many *= 2
    if node < 0:
        return taken
    chosen = np.zeros(len(lengths), np.int64)
    while node:
        i, many = items[items_of[node]]
        chosen[i] += many
        node = parents[node]
    return chosen


def _fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the counts whose sum comes closest to the budget, from below if two
    are as close."""
    chosen, total = _knapsack(lengths, counts, budget, budget)
    if total < budget:
        over, more = _knapsack(lengths, counts, 2 * budget - total - 1, budget)
        if more > total:
            return over
    return chosen


def _knapsack(lengths: np.ndarray, counts: np.ndarray, room: int,
              budget: int) -> tuple[np.ndarray, int]:
    """Counts and their sum: the one closest to ``budget`` of those up to ``room``."""
    chosen = np.zeros(len(lengths), np.int64)
    if room <= 0:
        return chosen, 0
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    by = np.full(room + 1, -1, np.int32)
    items = []
    for i in np.flatnonzero((counts > 0) & (lengths <= room)):
        size, many = int(lengths[i]), 1
        most = min(int(counts[i]), room // size)
        while most and not reached[budget]:
            many = min(many, most)
            step = size * many
            fresh = np.flatnonzero(reached[: room + 1 - step] & ~reached[step:]) + step
            reached[fresh] = True
            by[fresh] = len(items)
            items.append((i, many, step))
            most -= many
            many *= 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    total = at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, many, step = items[by[at]]
        chosen[i] += many
        at -= step
    return chosen, total


def _quotas(sizes: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """``source, size, n, passes, quota``: whole passes and documents taken once more."""
    counted = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    budgets = targets.select(
        F.col("source").alias("of"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("long").alias("passes"),
    ).withColumn(
        "budget",
        F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"),
    )
    rows = counted.join(budgets, F.col("source").eqNullSafe(F.col("of"))).drop("of")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ignore_index=True)
        real = (part["size"] > 0).to_numpy()
        quota = np.zeros(len(part), np.int64)
        quota[real] = fit_lengths(part["size"].to_numpy()[real], part["n"].to_numpy()[real],
                                  int(part["budget"].iloc[0]), seed)
        part["quota"] = quota
        return part

    return rows.groupBy("source").applyInPandas(
        fit, "source string, size long, n long, source_size long, target double, passes long, "
        "budget long, quota long")


def mixed(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
          most: float = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id, text_hash, row, size, source_size, target, taken`` of rows that hold
    ``doc_id, source, size, text_hash, row``. Every row is kept; ``taken`` is 0, or the size
    once or more."""
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 33)
    rows = rows.withColumn("key", key)
    targets = kept(source_targets(rows, weights, share, most))
    quotas = kept(
        _quotas(rows, targets, seed)
        .withColumn("parts", F.ceil(F.col("n") / RANKED_ROWS).cast("long"))
        .withColumnsRenamed({"source": "of", "size": "length"})
    )
    met = (rows.source.eqNullSafe(quotas.of)) & (rows.size == quotas.length)
    placed = kept(
        rows.join(quotas, met).drop("of", "length", "budget")
        .withColumn("part", F.shiftright(F.col("key") * F.col("parts"), 31))
    )
    # Rows of a length are ranked within a slice of the hash range. Slices wholly below the
    # quota or above it follow from counts.
    slices = placed.where("quota > 0 AND quota < n").groupBy("source", "size", "part").agg(
        F.count("*").alias("m"))
    up_to = Window.partitionBy("source", "size").orderBy("part")
    slices = slices.withColumn("before", F.sum("m").over(up_to) - F.col("m")).select(
        F.col("source").alias("s_source"), F.col("size").alias("s_size"),
        F.col("part").alias("s_part"), "before")
    chosen = placed.where("quota > 0 AND quota < n").join(
        slices,
        F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size"))
        & (F.col("part") == F.col("s_part")),
    )
    inside = Window.partitionBy("source", "size", "part").orderBy("key", "doc_id", "text_hash")
    partly = chosen.withColumn(
        "more", (F.row_number().over(inside) + F.col("before") <= F.col("quota")).cast("long"))
    plainly = placed.where("NOT (quota > 0 AND quota < n)").withColumn(
        "more", (F.col("quota") > 0).cast("long"))
    columns = ["doc_id", "text_hash", "row", "size", "source_size", "target",
               (F.col("size") * (F.col("passes") + F.col("more"))).alias("taken")]
    return partly.select(*columns).union(plainly.select(*columns))


def _narrow(docs: DataFrame, doc_id: str, text: str, source: str,
            row: Column | None = None) -> DataFrame:
    return kept(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        words(text).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
        (F.lit(None).cast("string") if row is None else row).alias("row"),
    ))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document.

    A null source is a source of its own, the last. The same rows and seed give the same
    result; rows alike in id, source and text are interchangeable.
    """
    rows = _narrow(docs, doc_id, text, source)
    return mixed(rows, weights, share, most, seed).drop("text_hash", "row")


def take_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
             seed: int = SEED) -> DataFrame:
    """The documents the mix takes, with all columns and ``copies``, how often; a column
    ``copies`` of the caller's is replaced.

    Rows alike in id and text come out as one, with their copies added. Decisions on few
    rows are broadcast, so texts are not shuffled; many are joined.
    """
    rows = _narrow(docs, doc_id, text, source, row_key(doc_id, text))
    decided = kept(
        mixed(rows, weights, share, most, seed).where("taken > 0")
        .groupBy("row")
        .agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias("copies"))
    )
    wide = docs.drop("copies")
    key, met = unused(wide, "row", "met")
    decided = decided.withColumnRenamed("row", met)
    joined = wide.withColumn(key, row_key(doc_id, text)).join(
        broadcast_if_few(decided), F.col(key) == F.col(met))
    repeated = kept(rows.groupBy("row").count().where("count > 1").select(
        F.col("row").alias(met)))
    if not repeated.isEmpty():
        again = broadcast_if_few(repeated)
        alike = joined.drop(met).join(again, F.col(key) == F.col(met), "left_semi")
        joined = joined.drop(met).join(again, F.col(key) == F.col(met), "left_anti").unionByName(
            alike.dropDuplicates([key]))
    return joined.select(*wide.columns, "copies")
