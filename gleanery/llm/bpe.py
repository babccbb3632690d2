"""BPE encoding and decoding that encodes chunks shared across documents once.

Texts are cut where a rolling hash of the last characters says so, so that equal passages
fall into equal chunks wherever they stand. Chunks that occur more than once are encoded once
each and looked up; all others are encoded where they are read. Chunks are encoded as texts
of their own, which is wrong around a cut that lies in a word, a contraction or a special
token. So every join is encoded again, from a word before the cut to a word after it, wider
and wider until those two outer words come out as the chunks have them. From there on both
sides are right: the splitter looks at nothing before a word, two characters after it, and a
special token's length beyond, and the first window is wider than that on both sides.

Ids and tokens equal the library's for a file of the kind it is written for: lower-cased
text, words of letters, single digits and other characters, byte-level BPE with word ends
and no decoder. Other files are refused. A null text is empty and has no tokens. Repeated
rows and ids stay as they are; a text without any cut is one chunk, however long.
"""

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import attach, kept

WINDOW = 24  # code points the rolling hash looks at
SELECTIVITY = 10  # a cut at one of 2 ** SELECTIVITY places
SHORTEST = 256
EDGE = 12  # words at a chunk's start that stay apart
RIM = 160  # code points at its end whose words do
WORDS_KEPT = 160_000  # words whose tokens a task remembers
SHARED_BYTES = 64 << 20  # of encoded chunks that are broadcast; beyond it they are joined
BATCH_CHARS = 8 << 20  # of results that a task hands on at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPREAD = np.uint64(0xD6E8FEB86659FD93)

# The shape of the files this module is written for (fixed values).
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts(text: str) -> list[int]:
    """Places where chunks after the first begin. They depend on the characters around them,
    and on the cut before only where two lie closer than the shortest chunk."""
    if len(text) < SHORTEST + WINDOW:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    up, down = _powers(len(codes))
    mixed = codes.astype(np.uint64) * _SPREAD
    mixed ^= mixed >> np.uint64(29)
    total = np.cumsum(mixed * up[: len(codes)])
    rolling = (total[WINDOW:] - total[:-WINDOW]) * down[WINDOW : len(codes)] * _SPREAD
    found = np.flatnonzero(rolling >> np.uint64(64 - SELECTIVITY) == 0) + WINDOW + 1
    found = found[found < len(codes)]
    found = found[_begins_afresh(codes[found])]
    places, at = [], 0
    while True:
        i = np.searchsorted(found, at + SHORTEST)
        if i == len(found):
            return places
        at = int(found[i])
        places.append(at)


def _begins_afresh(codes: np.ndarray) -> np.ndarray:
    """Characters that never combine with those before them."""
    return (codes < 0x300) | ((codes >= 0x3400) & (codes < 0xA000))


_power_cache: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_power_cache[0]) < n:
        size = 1 << (n - 1).bit_length()
        _power_cache[:] = [
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))])
            for b in (_BASE, _BASE_INVERSE)
        ]
    return _power_cache


def chunks(text: str) -> list[str]:
    places = cuts(text)
    return [text[a:b] for a, b in zip([0, *places], [*places, len(text)])]


def chunk_hash(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Coder:
    """Words of a text and their tokens. An item is ``(start, ids, tokens, single)``: ids and
    tokens are joined by spaces, and ``single`` is false for many words in one item."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers") or []
        if (
            [p["type"] for p in split] != ["Split", "ByteLevel"] or split[1]["use_regex"]
            or spec["normalizer"] != {"type": "Sequence", "normalizers": NORMALIZERS}
            or split[0]["pattern"] != {"Regex": WORDS}
            or spec["model"]["type"] != "BPE" or spec["model"]["dropout"]
            or spec["decoder"] or spec["post_processor"]
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]
                   for t in spec["added_tokens"])
        ):
            raise ValueError(f"{path} is not of the kind this operator encodes")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.margin = max(map(len, self.special), default=0) + 3
        size = self.tokenizer.get_vocab_size()
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.numbers = [str(i) for i in range(size)]
        self.words: dict[str, tuple[str, str]] = {}
        # Latin letters need no library to be split: nothing composes, one character each.
        low = [chr(c) for c in range(0x180)]
        space = [c for c in low if self.tokenizer.normalizer.normalize_str(c) == " "]
        letters = [c for c in low if unicodedata.category(c)[0] == "L"]
        digits = [c for c in low if unicodedata.category(c)[0] == "N"]
        space, letters, digits = (re.escape("".join(s)) for s in (space, letters, digits))
        self.latin = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+")
        self.not_latin = re.compile("[^\x00-\u012f\u0131-\u017f]")
        self.space = re.compile(f"[{space}]")
        # Their bytes in the alphabet of byte-level models.
        self.alphabet = {
            ord(c): "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c))
            for c in low
        }

    def joined(self, ids: list[int]) -> tuple[str, str]:
        return (" ".join([self.numbers[i] for i in ids]), " ".join([self.tokens[i] for i in ids]))

    def _learn(self, words: list[str]) -> None:
        """Tokens of Latin words not met lately."""
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        for word in {w for w in words if w not in self.words}:
            code = self.tokenizer.model.tokenize(word.translate(self.alphabet))
            self.words[word] = self.joined([t.id for t in code])

    def items(self, text: str, at: int = 0) -> list[tuple]:
        """The text's words with their starts, counted from ``at``; the inner ones of a long
        text are one item."""
        if self.not_latin.search(text) or any(s in text for s in self.special):
            return self._from_library(text, at)
        low = text.lower()
        words = self.latin.findall(low)
        self._learn(words)
        known = self.words
        rim = self.space.search(low, len(low) - RIM) if len(low) > 3 * RIM else None
        if rim:
            first = [m.start() for m in islice(self.latin.finditer(low), EDGE + 1)]
            last = [m.start() for m in self.latin.finditer(low, rim.start())]
            if EDGE + len(last) < len(words):
                ids, tokens = zip(*[known[w] for w in words[EDGE : len(words) - len(last)]])
                return [
                    *[(at + s, *known[w], True) for s, w in zip(first[:EDGE], words)],
                    (at + first[EDGE], " ".join(ids), " ".join(tokens), False),
                    *[(at + s, *known[w], True) for s, w in zip(last, words[len(words) - len(last):])],
                ]
        return [(at + m.start(), *known[w], True) for m, w in zip(self.latin.finditer(low), words)]

    def spelled(self, text: str, at: int) -> list[tuple]:
        """Every word of a text that is one item of many words."""
        half = self.space.search(text, len(text) // 2)
        if not half:
            return self._from_library(text, at)
        return [*self.items(text[: half.start()], at),
                *self.items(text[half.start() :], at + half.start())]

    def _from_library(self, text: str, at: int) -> list[tuple]:
        code = self.tokenizer.encode(text, add_special_tokens=False)
        found: list[list] = []
        ids, starts = code.ids, [a for a, _ in code.offsets]
        for _, places in groupby(range(len(ids)), code.word_ids.__getitem__):
            places = list(places)
            start = starts[places[0]]
            if found and start <= found[-1][0]:  # several words of one character
                found[-1][1] += [ids[p] for p in places]
            else:
                found.append([start, [ids[p] for p in places]])
        return [(at + start, *self.joined(word), True) for start, word in found]


@cache
def coder(path: str) -> Coder:
    return Coder(path)


def _spelled(coder: Coder, text: str, items: list[tuple], i: int, end: int) -> None:
    """Replaces an item of many words by those words."""
    stop = items[i + 1][0] if i + 1 < len(items) else end
    items[i : i + 1] = coder.spelled(text[items[i][0] : stop], items[i][0])


def _afresh(text: str, item: tuple) -> bool:
    code = ord(text[item[0]])
    return code < 0x300 or 0x3400 <= code < 0xA000


def join_chunk(coder: Coder, text: str, left: list[tuple], right: list[tuple], cut: int,
               end: int) -> None:
    """Extends ``left``, the items of ``text[:cut]``, by those of ``text[cut:end]``, which are
    given in ``right`` as encoded apart, so that they are the items of ``text[:end]``."""
    reach = coder.margin
    while True:
        # The last word that begins far enough before the cut, and the first after it.
        lo = len(left) - 1
        while lo >= 0:
            if not left[lo][3]:
                _spelled(coder, text, left, lo, cut)
                lo = len(left) - 1
            elif left[lo][0] <= cut - reach and _afresh(text, left[lo]):
                break
            else:
                lo -= 1
        hi = 0
        while hi < len(right) - 1:
            if not right[hi][3]:
                _spelled(coder, text, right, hi, end)
            elif (right[hi][0] >= cut + reach and _afresh(text, right[hi])
                  and _afresh(text, right[hi + 1])):
                break
            else:
                hi += 1
        inner = hi < len(right) - 1
        begin = left[lo][0] if lo >= 0 else 0
        stop = right[hi + 1][0] if inner else end
        window = coder.items(text[begin:stop], begin)
        same_left = lo < 0 or (bool(window) and window[0] == left[lo])
        same_right = not inner or (bool(window) and window[-1] == right[hi])
        if same_left and same_right:
            left[max(lo, 0):] = window
            if inner:
                left += right[hi + 1 :]
            return
        reach *= 2


def whole_items(coder: Coder, text: str, known: Callable[[bytes], list[tuple] | None]
                ) -> list[tuple]:
    """Items of a text from its chunks; ``known`` gives those of a shared chunk by its hash,
    with starts counted from the chunk's own."""
    places = [*cuts(text), len(text)]
    items, cut = [], 0
    for end in places:
        chunk = text[cut:end]
        shared = known(chunk_hash(chunk))
        part = (coder.items(chunk, cut) if shared is None
                else [(cut + s, *rest) for s, *rest in shared])
        if cut:
            join_chunk(coder, text, items, part, cut, end)
        else:
            items = part
        cut = end
    return items


def encoded(coder: Coder, text: str | None, known=lambda _: None) -> tuple[str, str]:
    """Ids in decimal and the decoded text. The files have no decoder: decoding puts a space
    between tokens."""
    items = whole_items(coder, text or "", known)
    return " ".join([i[1] for i in items]), " ".join([i[2] for i in items])


def pack(coder: Coder, chunk: str) -> tuple[bytes, bytes, bytes]:
    """Starts, token counts and ids of a chunk's items; a count below 0 is that of many words."""
    items = coder.items(chunk)
    ids = [np.array(i[1].split(" "), np.uint32) for i in items]
    counts = [len(x) if i[3] else -len(x) for x, i in zip(ids, items)]
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    small = np.uint16 if len(coder.tokens) <= 1 << 16 else np.uint32
    return (np.array([i[0] for i in items], np.int32).tobytes(),
            np.array(counts, np.int32).tobytes(), flat.astype(small).tobytes())


def unpack(coder: Coder, starts: bytes, counts: bytes, ids: bytes) -> list[tuple]:
    small = np.uint16 if len(coder.tokens) <= 1 << 16 else np.uint32
    flat, at, items = np.frombuffer(ids, small).tolist(), 0, []
    for start, n in zip(np.frombuffer(starts, np.int32).tolist(),
                        np.frombuffer(counts, np.int32).tolist()):
        items.append((start, *coder.joined(flat[at : at + abs(n)]), n > 0))
        at += abs(n)
    return items


PACKED = "hash binary, starts binary, counts binary, ids binary"


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, str]]:
    """Row numbers and texts, one at a time."""
    values = batch.column(column)
    for i in range(len(values)):
        yield i, values[i].as_py() or ""


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[bytes, list[int]] = {}
        for _, text in _texts(batch, 0):
            for chunk in chunks(text):
                found.setdefault(chunk_hash(chunk), [len(chunk), 0])[1] += 1
        size, n = zip(*found.values()) if found else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(size, pa.int64()),
             pa.array(n, pa.int64())], names=["hash", "size", "n"])


def _head(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(h[:8] for h in hashes), np.uint64)


def _texts_of(wanted, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and text of the chunks whose hashes begin like wanted ones (None: of all), each
    once in a batch."""
    heads = wanted.value if wanted is not None else None
    for batch in batches:
        found = {chunk_hash(c): c for _, text in _texts(batch, 0) for c in chunks(text)}
        if heads is not None and found:
            keys = _head(list(found))
            at = np.minimum(np.searchsorted(heads, keys), len(heads) - 1)
            found = {h: c for (h, c), hit in zip(found.items(), heads[at] == keys) if hit}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.large_string())
             .cast(pa.string())], names=["hash", "chunk"])


def _pack_chunks(path, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = coder(path())
    for batch in batches:
        packed = [pack(code, text) for _, text in _texts(batch, 1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array([p[i] for p in packed], pa.binary()) for i in range(3)]],
            names=["hash", "starts", "counts", "ids"])


def shared_chunks(docs: DataFrame, path: Callable[[], str], text: str = "text",
                  shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """``hash, starts, counts, ids`` of every chunk that occurs more than once, encoded once."""
    texts = docs.select(text)
    counted = texts.mapInArrow(_count_chunks, "hash binary, size long, n long")
    often = kept(counted.groupBy("hash").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
                 .where("n > 1").select("hash", "size"))
    found = often.agg(F.count("*").alias("n"), F.sum("size").alias("size")).head()
    if found["n"] * 8 <= shared_bytes:
        heads = np.sort(_head(often.select("hash").toArrow()["hash"].to_pylist()))
        wanted = docs.sparkSession.sparkContext.broadcast(heads) if found["n"] else None
        rows = texts.mapInArrow(lambda b: _texts_of(wanted, b), "hash binary, chunk string")
        rows = rows if found["n"] else rows.limit(0)
    else:
        rows = texts.mapInArrow(lambda b: _texts_of(None, b), "hash binary, chunk string")
        rows = rows.join(often.select("hash"), "hash", "left_semi")
    tasks = max(1, (found["size"] or 0) >> 21)  # some 2 MB of text each
    once = rows.groupBy("hash").agg(F.first("chunk").alias("chunk")).repartition(tasks, "hash")
    return kept(once.mapInArrow(lambda b: _pack_chunks(path, b), PACKED))


def _encode(path, lookup, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and decoded texts; ``lookup(batch, row)`` gives a row's way to shared chunks."""
    code = coder(path())
    for batch in batches:
        rows, size = [], 0
        for i, text in _texts(batch, 1):
            rows.append((i, *encoded(code, text, lookup(code, batch, i))))
            size += len(rows[-1][1]) + len(rows[-1][2])
            if size > BATCH_CHARS:
                yield _coded_batch(batch, rows)
                rows, size = [], 0
        if rows:
            yield _coded_batch(batch, rows)


def _coded_batch(batch: pa.RecordBatch, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    count = [ids.count(" ") + 1 if ids else 0 for _, ids, _ in rows]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array([r[0] for r in rows])), pa.array(count, pa.int64()),
         pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
        names=["doc_id", "n_tokens", "ids", "decoded"])


def _in_table(table):
    """Shared chunks from a broadcast table; unpacked ones are remembered by the task."""
    places: dict[bytes, int] = {}
    unpacked: dict[bytes, list[tuple]] = {}

    def known(code: Coder, hash: bytes) -> list[tuple] | None:
        if not places:
            places.update((h, i) for i, h in enumerate(table.value["hash"].to_pylist()))
        if hash in unpacked:
            return unpacked[hash]
        if hash not in places:
            return None
        row = table.value.slice(places[hash], 1)
        if len(unpacked) > 500:
            unpacked.clear()
        unpacked[hash] = unpack(code, *[row[c][0].as_py() for c in ("starts", "counts", "ids")])
        return unpacked[hash]

    return lambda code, batch, i: lambda hash: known(code, hash)


def _in_row(code: Coder, batch: pa.RecordBatch, i: int):
    """Shared chunks that a join has put into the row itself."""
    given = {c["hash"]: c for c in batch.column(2)[i].as_py() or ()}

    def known(hash: bytes) -> list[tuple] | None:
        c = given.get(hash)
        return c and unpack(code, c["starts"], c["counts"], c["ids"])

    return known


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0)
        uses = {(keys[i].as_py(), chunk_hash(c)) for i, t in _texts(batch, 1) for c in chunks(t)}
        key, hash = zip(*uses) if uses else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.binary()), pa.array(hash, pa.binary())], names=["key", "hash"])


def encode_texts(docs: DataFrame, path: Callable[[], str], doc_id: str = "doc_id",
                 text: str = "text", shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids`` (decimal, joined by spaces; see
    :func:`token_ids`) and ``decoded``.

    ``path`` names the tokenizer file on the machine that asks. The encoded shared chunks are
    measured: up to ``shared_bytes`` they are broadcast and the documents are read in place;
    beyond it each text is sent, once per distinct text, the chunks it uses, by joins that
    split hot chunks and hot texts.
    """
    packed = shared_chunks(docs, path, text, shared_bytes)
    size = packed.agg(F.sum(sum(F.octet_length(c) for c in ("hash", "starts", "counts", "ids"))))
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids string, decoded string"
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if (size.head()[0] or 0) <= shared_bytes:
        table = docs.sparkSession.sparkContext.broadcast(packed.toArrow().combine_chunks())
        return own.mapInArrow(lambda b: _encode(path, _in_table(table), b), schema)
    keyed = own.withColumn("key", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    uses = kept(
        keyed.select("key", "text").mapInArrow(_uses, "key binary, hash binary").distinct()
        .join(packed.select("hash"), "hash", "left_semi"))
    sent = attach(uses, packed, ["hash"]).groupBy("key").agg(
        F.collect_list(F.struct("hash", "starts", "counts", "ids")).alias("known"))
    return attach(keyed, kept(sent), ["key"]).select("doc_id", "text", "known").mapInArrow(
        lambda b: _encode(path, _in_row, b), schema)


def token_ids(ids: Column) -> Column:
    """An array of ids from their decimal text."""
    return F.when(ids == "", F.array().cast("array<int>")).otherwise(
        F.split(ids, " ").cast("array<int>"))
