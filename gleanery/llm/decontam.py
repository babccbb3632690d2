"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of word shingles. An item's signature is its
``m`` least shingle hashes, with ``m`` one more than the shingles it may lack, so every
text that contains it has at least one of them: no contained item is missed. A document
looks up its own hashes below each partition's largest signature value, skips
partitions of items too large for it, and hits are verified on the shingles themselves.
Banded signatures of whole documents are not used: a short item inside a long document
has a Jaccard similarity near zero, and no useful number of bands would find it.
"""

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import BoundedCache, kept, plain_words

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
BLOCK_BYTES = 32 << 20  # item text held by a task at a time
_SIEVE_BITS = 20
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
     0xFF51AFD7ED558CCD], np.uint64
)


def lowered_words(text: str | None) -> list[bytes]:
    """Words in lower case: letters and digits; ASCII marks and white space part them."""
    return plain_words(text.lower()) if text else []


def shingles(words: list[bytes], size: int) -> set[bytes]:
    """All runs of ``size`` words."""
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def _hashes(numbers: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` words, from the words' own hashes."""
    count = len(numbers) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    mixed = np.full(count, np.uint64(size))
    for k in range(size):
        mixed ^= numbers[k : k + count] * _MULTIPLIERS[k]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MULTIPLIERS[(k + 1) % size]
    return mixed ^ (mixed >> np.uint64(32))


class ItemIndex:
    """Signatures of benchmark items by partition."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = CONTAINMENT):
        self.known = BoundedCache(xxhash.xxh64_intdigest)
        self.threshold = threshold
        self.items = []  # (id, shingle size, shingles)
        parts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = lowered_words(text)
            size = min(SHINGLE_WORDS, len(words))
            if not size:
                continue
            numbers = self.numbers(words)
            signature = np.unique(_hashes(numbers, size))
            total = len(shingles(words, size))
            lacking = total - self.needed(total)
            place = len(self.items)
            self.items.append((item_id, size, shingles(words, size)))
            rows = parts.setdefault((size, total.bit_length()), [])
            rows += [(int(h), place) for h in signature[: lacking + 1]]
        self.sieves: dict[int, np.ndarray] = {}
        self.parts: dict[int, list] = {}
        for (size, bits), rows in sorted(parts.items()):
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            places = np.array([r[1] for r in rows], np.int64)
            sieve = self.sieves.setdefault(size, np.zeros(1 << _SIEVE_BITS, bool))
            sieve[hashes >> np.uint64(64 - _SIEVE_BITS)] = True
            least = self.needed(1 << (bits - 1))
            self.parts.setdefault(size, []).append((least, hashes[-1], hashes, places))

    def needed(self, total: int) -> int:
        return max(1, math.ceil(self.threshold * total - 1e-9))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, shingles found, shingles of the item) of every contained item."""
        words = lowered_words(text)
        numbers = self.numbers(words)
        candidates = set()
        for size, sieve in self.sieves.items():
            own = _hashes(numbers, size)
            own = own[sieve[own >> np.uint64(64 - _SIEVE_BITS)]]
            for least, cutoff, hashes, places in self.parts[size] if len(own) else ():
                if len(words) - size + 1 < least:
                    continue
                low = np.unique(own[own <= cutoff])
                begin = np.searchsorted(hashes, low, "left")
                end = np.searchsorted(hashes, low, "right")
                for b, e in zip(begin[end > begin], end[end > begin]):
                    candidates.update(places[b:e].tolist())
        found, by_size = [], {}
        for place in sorted(candidates):
            item_id, size, wanted = self.items[place]
            if size not in by_size:
                by_size[size] = shingles(words, size)
            shared = len(wanted & by_size[size])
            if shared >= self.needed(len(wanted)):
                found.append((item_id, shared, len(wanted)))
        return found


FOUND = "array<struct<item_id:bigint,shared:bigint,item_shingles:bigint>>"
_FOUND_ARROW = pa.list_(
    pa.struct([("item_id", pa.int64()), ("shared", pa.int64()), ("item_shingles", pa.int64())])
)
_indexes: dict[str, ItemIndex] = {}


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text",
                block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of a bounded size, read one block after the other."""
    narrow = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"))
    total = narrow.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    count = max(1, math.ceil(total / block_bytes))
    for b in range(count):
        part = narrow
        if count > 1:
            part = narrow.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == b)
        rows = part.toArrow()
        yield list(zip(rows["i"].to_pylist(), rows["t"].to_pylist()))


def contained(docs: DataFrame, block: list[tuple[int, str]], text: str, threshold: float) -> Column:
    """Column of the block's items that each text contains."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    key = uuid.uuid4().hex  # names the index in Python workers, which serve many tasks

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        from gleanery.llm.decontam import _indexes

        if key not in _indexes:
            if len(_indexes) >= 4:
                _indexes.clear()
            _indexes[key] = ItemIndex(shared.value, threshold)
        index = _indexes[key]
        rows = [
            [dict(zip(("item_id", "shared", "item_shingles"), f)) for f in index.find(t.as_py())]
            for t in texts
        ]
        return pa.array(rows, _FOUND_ARROW)

    return find(text)


def contaminations(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT,
                   doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, shared, item_shingles, containment`` of every document and item
    of which the document holds ``threshold`` of the five-word shingles or more.

    A shorter item is one shingle of all its words; items without words are in no
    document. Repeated documents and items give repeated rows. Documents are not
    shuffled; items come in blocks, and with several the pairs of each are written.
    """
    results = []
    for block in item_blocks(items, item_id, item_text, block_bytes):
        pairs = (
            docs.select(F.col(doc_id).alias("doc_id"),
                        contained(docs, block, text, threshold).alias("found"))
            .select("doc_id", F.explode("found").alias("found"))
            .select("doc_id", "found.*",
                    (F.col("found.shared") / F.col("found.item_shingles")).alias("containment"))
        )
        results.append(pairs)
        if len(results) > 1:
            results = [kept(r) for r in results]
    whole = results[0]
    for part in results[1:]:
        whole = whole.union(part)
    return whole


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT,
                      text: str = "text", item_id: str = "item_id", item_text: str = "text",
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    for block in item_blocks(items, item_id, item_text, block_bytes):
        docs = docs.where(F.size(contained(docs, block, text, threshold)) == 0)
    return docs
