"""Token counts of a byte-pair vocabulary by rank-synchronous merging of numpy arrays.

Texts are cut where no merge can reach across, the distinct pieces ("pre-tokens") of a
batch lie one after another in flat arrays, and every round merges, in all sequences at
once, the places of each sequence's lowest-rank pair. Only counts of surviving symbols
leave the arrays. Counts of pre-tokens seen before come from a bounded cache.
"""

import heapq
import itertools
import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.llm.common import BoundedCache

SPACE = "▁"
NO_RANK = np.iinfo(np.int32).max
ROUNDS = 400  # afterwards the few sequences left are merged one pair at a time
BATCH_CHARS = 1 << 21
KNOWN_PIECES = 500_000
KNOWN_CHARS = 64
_NORMAL = 1  # piece type of ordinary pieces


class PieceMerges:
    """The merges of a sentencepiece BPE model with byte fallback and no normalisation."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback
                or spec.precompiled_charsmap or spec.remove_extra_whitespaces):
            raise ValueError("expected a BPE model with byte fallback that keeps texts as they are")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        pieces = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece goes on after the end of a word")
        if any(ch not in pieces for p in pieces for ch in p):
            raise ValueError("a piece holds a character that is no piece")
        ids = {p: i for i, p in enumerate(pieces)}
        ranks = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.width = len(pieces) + 1  # the last id stands for characters that are no piece
        self.chars = {p: i for p, i in ids.items() if len(p) == 1}
        rows = [
            (ids[p[:k]] * self.width + ids[p[k:]], ranks[score], ids[p])
            for p, score in pieces.items() for k in range(1, len(p))
            if p[:k] in ids and p[k:] in ids
        ]
        rows.sort()
        self.merges = {key: (rank, new) for key, rank, new in rows}
        self._index(rows)
        self.symbols = np.full(0x110000, self.width - 1, np.int32)
        for ch, i in self.chars.items():
            self.symbols[ord(ch)] = i
        # Marks that no piece joins to letters end a sequence too: fewer distinct ones. Most
        # texts hold ASCII ones only, for which a small character class does.
        apart = self._apart(pieces)
        self.rare = frozenset(ch for ch in apart if not ch.isascii())
        self.common_split = self._splitter(apart - self.rare)
        self.full_split = self._splitter(apart)

    @staticmethod
    def _splitter(apart) -> re.Pattern:
        if not apart:
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        marks = re.escape("".join(sorted(apart)))
        return re.compile(f"{SPACE}*[^{SPACE}{marks}]+|{SPACE}*[{marks}]+|{SPACE}+")

    @staticmethod
    def _apart(pieces) -> set[str]:
        """Marks and digits that stand in no piece beside a letter or other mark left out."""
        apart = {ch for p in pieces for ch in p if not ch.isalpha() and ch != SPACE}
        apart |= set(string.whitespace)
        while True:
            mixed = {
                ch for p in pieces if len(p) > 1
                for inner in [set(p.lstrip(SPACE))] if inner & apart and inner - apart
                for ch in inner & apart
            }
            if not mixed:
                return apart
            apart -= mixed

    def _index(self, rows: list[tuple[int, int, int]]) -> None:
        """Open addressing: the slots of the pairs' keys, ranks and merged ids."""
        self.bits = 64 - max(12, (len(rows) * 4).bit_length())
        size = 1 << (64 - self.bits)
        self.keys = np.full(size, -1, np.int64)
        self.slot_rank = np.full(size, NO_RANK, np.int32)
        self.slot_id = np.full(size, -1, np.int32)
        keys = np.array([r[0] for r in rows], np.int64)
        for slot, (key, rank, new) in zip(self._slots(keys).tolist(), rows):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % size
            self.keys[slot], self.slot_rank[slot], self.slot_id[slot] = key, rank, new

    def _slots(self, key: np.ndarray) -> np.ndarray:
        spread = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(self.bits)).astype(np.int64)

    def pre_tokens(self, text: str) -> list[str]:
        if not text:
            return []
        split = self.common_split if self.rare.isdisjoint(text) else self.full_split
        return split.findall(self.prefix + text.replace(" ", SPACE))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what two neighbours merge into; NO_RANK if they do not."""
        key = left.astype(np.int64) * self.width + right
        slot = self._slots(key)
        held = self.keys[slot]
        probe = np.flatnonzero((held != key) & (held >= 0))
        while len(probe):
            slot[probe] = (slot[probe] + 1) % len(self.keys)
            held = self.keys[slot[probe]]
            probe = probe[(held != key[probe]) & (held >= 0)]
        hit = self.keys[slot] == key
        return np.where(hit, self.slot_rank[slot], NO_RANK), np.where(hit, self.slot_id[slot], -1)

    def count(self, sequences: list[str]) -> np.ndarray:
        """Tokens of every sequence."""
        unknown = self.width - 1
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        text = "".join(sequences)
        symbol = self.symbols[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(sequences)), lengths)
        counts = lengths.copy()
        strange = np.flatnonzero(symbol == unknown)
        if len(strange):  # such a character gives one token per byte and merges with nothing
            more = np.array([len(text[i].encode()) - 1 for i in strange], np.int64)
            np.add.at(counts, owner[strange], more)
        rank, merged = self._pairs(symbol, owner)
        for _ in range(ROUNDS):
            live = self._unfinished(rank, owner, len(sequences))
            if not len(live):
                return counts
            keep = np.flatnonzero(live[owner])
            symbol, owner = symbol[keep], owner[keep]
            rank, merged = rank[keep], merged[keep]
            symbol, owner, rank, merged, gone = self._round(symbol, owner, rank, merged)
            np.subtract.at(counts, gone, 1)
        for s in np.unique(owner[rank < NO_RANK]):
            own = symbol[owner == s]
            counts[s] -= len(own) - self._one_by_one(own.tolist())
        return counts

    def _pairs(self, symbol, owner):
        rank = np.full(len(symbol), NO_RANK, np.int32)
        merged = np.full(len(symbol), -1, np.int32)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside], merged[inside] = self.lookup(symbol[inside], symbol[inside + 1])
        return rank, merged

    @staticmethod
    def _unfinished(rank, owner, n):
        live = np.zeros(n, bool)
        live[owner[rank < NO_RANK]] = True
        return live if live.any() else np.empty(0, bool)

    def _round(self, symbol, owner, rank, merged):
        """Merges every sequence's lowest-rank pair, from the left, at all its places.

        Places of a sequence come up to and with the first one whose merge makes a pair
        of the same or a lower rank; that pair is due before the places after it.
        """
        n = len(symbol)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, n]))
        due = (rank == least) & (rank < NO_RANK)
        # Of places that overlap, every second one of a run is taken, from its left end.
        at = np.flatnonzero(due)
        run_start = np.r_[True, np.diff(at) > 1] if len(at) else np.empty(0, bool)
        index = np.arange(len(at))
        since = index - np.maximum.accumulate(np.where(run_start, index, 0))
        at = at[since % 2 == 0]
        new = merged[at]
        # Neighbours at the time of the merge: on the left what an adjacent place became.
        before, after = at - 1, at + 2
        has_before = (before >= 0) & (owner[np.maximum(before, 0)] == owner[at])
        has_after = (after < n) & (owner[np.minimum(after, n - 1)] == owner[at])
        left = symbol[np.maximum(before, 0)]
        touching = np.r_[False, at[1:] == at[:-1] + 2] if len(at) else np.empty(0, bool)
        left = np.where(touching, np.r_[np.int32(0), new[:-1]], left)
        left_rank = np.where(has_before, self.lookup(left, new)[0], NO_RANK)
        right_rank = np.where(has_after, self.lookup(new, symbol[np.minimum(after, n - 1)])[0],
                              NO_RANK)
        early = np.minimum(left_rank, right_rank) <= least[at]
        own = owner[at]
        group = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        seen = np.cumsum(early) - early  # early ones before this place, in all sequences
        base = np.repeat(seen[group], np.diff(np.r_[group, len(at)]))
        take = seen == base
        at, new = at[take], new[take]
        symbol = symbol.copy()
        symbol[at] = new
        gone = owner[at]
        stay = np.ones(n, bool)
        stay[at + 1] = False
        place = np.cumsum(stay) - 1
        symbol, owner, rank, merged = symbol[stay], owner[stay], rank[stay], merged[stay]
        touched = np.concatenate([place[at], place[at][place[at] > 0] - 1])
        inside = touched[(touched + 1 < len(symbol))]
        inside = inside[owner[inside] == owner[inside + 1]]
        rank[touched], merged[touched] = NO_RANK, -1
        rank[inside], merged[inside] = self.lookup(symbol[inside], symbol[inside + 1])
        return symbol, owner, rank, merged, gone

    def _one_by_one(self, symbols: list[int]) -> int:
        """Symbols left of one sequence, by a heap of (rank, place)."""
        n = len(symbols)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i):
            j = following[i]
            if j < n and (hit := self.merges.get(symbols[i] * self.width + symbols[j])):
                heapq.heappush(heap, (hit[0], i, j, symbols[i], symbols[j], hit[1]))

        for i in range(n - 1):
            offer(i)
        left = n
        while heap:
            _, i, j, a, b, new = heapq.heappop(heap)
            if symbols[i] != a or following[i] != j or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, -1
            following[i] = following[j]
            if following[i] < n:
                previous[following[i]] = i
            left -= 1
            offer(i)
            if previous[i] >= 0:
                offer(previous[i])
        return left


def counted(merges: PieceMerges, texts: list[str | None], known: dict) -> list[int]:
    """Tokens of every text; ``known`` maps pre-tokens to their counts and is added to."""
    split = [merges.pre_tokens(t or "") for t in texts]
    fresh = list(set(itertools.chain.from_iterable(split)).difference(known))
    at = 0
    while at < len(fresh):
        size, end = 0, at
        while end < len(fresh) and (end == at or size + len(fresh[end]) <= BATCH_CHARS):
            size += len(fresh[end])
            end += 1
        known.update(zip(fresh[at:end], merges.count(fresh[at:end]).tolist()))
        at = end
    totals = [sum(map(known.__getitem__, parts)) for parts in split]
    if len(known) > KNOWN_PIECES:
        known.clear()
    else:
        for p in fresh:
            if len(p) > KNOWN_CHARS:
                del known[p]
    return totals


_loaded: BoundedCache = BoundedCache(lambda path: (PieceMerges(path), {}), limit=4)


def token_counter(model: str | Callable[[], str]) -> Callable[[Column | str], Column]:
    """Column function: tokens of a text. ``model`` is the file's path on every executor,
    or a function that gives it there."""

    @F.arrow_udf("long")
    def tokens(text: pa.Array) -> pa.Array:
        merges, known = _loaded[model if isinstance(model, str) else model()]
        totals = []
        for at in range(0, len(text), 512):
            totals += counted(merges, text.slice(at, 512).to_pylist(), known)
        return pa.array(totals, pa.int64())

    return tokens


def token_counts(docs, model: str | Callable[[], str], limit: int = 4096,
                 doc_id: str = "doc_id", text: str = "text"):
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document.

    Counts are those of the model's own library without begin and end tokens. A null or
    empty text has no tokens; nothing is cut off.
    """
    counts = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_counter(model)(text).alias("n_tokens"),
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
