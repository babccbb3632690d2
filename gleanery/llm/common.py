"""Word splitting, training folds and small Spark helpers shared by the operators."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.running import same_keys
from gleanery.session import shared_root

# ASCII letters in lower case, ASCII digits and all bytes of non-ASCII characters stay;
# every other byte becomes a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits (lower-cased) and non-ASCII characters, as UTF-8."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


class BoundedCache(dict):
    """``make(key)`` by key; emptied when it holds ``limit`` entries, so memory is bounded."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make = make
        self.limit = limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that nothing is learnt from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once to the folder that all executors share."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def share_below(total: int, bound: int, *seeded: Column) -> Column:
    """Condition that keeps about ``bound`` of ``total`` rows, by a hash of the columns."""
    share = 1.0 if total <= bound else bound / total
    edge = math.floor(share * 2**31)
    return F.shiftrightunsigned(F.xxhash64(*seeded), 33) < F.lit(edge)



def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before each as it takes to be no column's."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def row_key(doc_id: str, text: str) -> Column:
    """One string for a row's id, which may be null, and the hash of its text."""
    identity = F.when(F.col(doc_id).isNull(), "").otherwise(
        F.concat(F.lit("="), F.col(doc_id).cast("string")))
    return F.concat(F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"), identity)


HOT_ROWS = 2_000
BROADCAST_KEYS = 20_000


def attach(rows: DataFrame, lookup: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS,
           broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` (one row per key) that no hot key slows down.

    The keys of more than ``hot_rows`` rows, or the ``broadcast_keys`` largest of them, are
    looked up in place, by a broadcast of their lookup rows; all other rows are joined by
    key. Beyond that many hot keys one is left with less than a ``broadcast_keys``-th of the
    rows. ``rows`` is read twice and should be kept, its keys may be null.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = kept(counts.where(F.col("_rows") > hot_rows))
    found = hot.count()
    if not found:
        return rows.join(lookup, keys, "left")
    if found > broadcast_keys:
        hot = kept(hot.orderBy(F.desc("_rows"), *keys).limit(broadcast_keys))
    few = F.broadcast(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    same = same_keys(keys, "_hot_")
    wanted = F.broadcast(lookup.join(few, same, "left_semi"))
    there = rows.join(few, same, "left_semi").join(wanted, keys, "left")
    return rows.join(few, same, "left_anti").join(lookup, keys, "left").unionByName(there)
