"""Text encoders: the pluggable interface and a deterministic offline default."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An encoder turns a list of texts into a (len(texts), dimension) float array.
Encoder = Callable[[list[str]], np.ndarray]
# A factory is shipped to the workers and called once per task, so a model loads once there.
EncoderFactory = Callable[[], Encoder]

VOCABULARY_ENTRIES = 1_000_000
# What remembered words may take in all, at WORD_BYTES a word besides its letters.
VOCABULARY_BYTES, WORD_BYTES = 32 << 20, 160
ENCODER_ROWS = 1024
TEXT_BYTES = 1 << 22  # of texts that leave Arrow at a time, or one text
PIECE_LETTERS = 1 << 21  # of text that is cut into words at a time, or one word


@dataclass(frozen=True)
class Candidate:
    """An embedding model under evaluation."""

    name: str
    path: str
    dimension: int
    factory: EncoderFactory = field(compare=False)


class HashEncoder:
    """Bag of words hashed into ``dimension`` counts, scaled to unit length.

    A word's bucket is the number in the first eight hex digits of its MD5,
    modulo the dimension. Words are separated by blanks and line feeds.
    """

    def __init__(self, dimension: int):
        self.dimension = dimension
        # The empty word, found between two blanks, has no bucket.
        self._buckets: dict[str, int] = {"": -1}
        self._bytes = 0

    def _hashed(self, words: list[str]) -> np.ndarray:
        known = self._buckets
        if len(known) >= VOCABULARY_ENTRIES or self._bytes >= VOCABULARY_BYTES:
            known = self._buckets = {"": -1}
            self._bytes = 0
        for word in words:
            if word not in known:
                self._bytes += WORD_BYTES + 4 * len(word)
                digest = md5(word.encode("utf-8"), usedforsecurity=False).digest()
                known[word] = int.from_bytes(digest[:4], "big") % self.dimension
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Words are counted some letters of text at a time, so memory is bounded."""
        counts = np.zeros(len(texts) * self.dimension)
        for first, pieces in _pieces(texts):
            self._count(counts[first * self.dimension :], pieces)
        return unit_rows(counts.reshape(len(texts), self.dimension))

    def _count(self, counts: np.ndarray, texts: list[str]) -> None:
        """Words are cut and numbered by Arrow; only distinct words are hashed."""
        lines = pc.fill_null(pa.array(texts, pa.large_string()), "")
        words = pc.split_pattern(pc.replace_substring(lines, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        column = self._hashed(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        row = pc.list_parent_indices(words).to_numpy()
        cells = (row * self.dimension + column)[column >= 0]
        counts[: len(texts) * self.dimension] += np.bincount(
            cells, minlength=len(texts) * self.dimension)


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in turn, some at a time, with the number of the first; a long text comes alone and
    in pieces that end where a word does."""
    first, some, letters = 0, [], 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if some and letters + size > PIECE_LETTERS:
            yield first, some
            first, some, letters = i, [], 0
        if size <= PIECE_LETTERS:
            some.append(text)
            letters += size
            continue
        at = 0
        while at < size:
            end = at + PIECE_LETTERS
            if end < size:
                ends = text.find(" ", end), text.find("\n", end)
                end = min((e for e in ends if e >= 0), default=size)
            yield i, [text[at:end]]
            at = end
        first = i + 1
    if some:
        yield first, some


@dataclass(frozen=True)
class HashEncoderFactory:
    dimension: int

    def __call__(self) -> Encoder:
        return HashEncoder(self.dimension)


def hash_candidate(name: str, dimension: int) -> Candidate:
    return Candidate(name, f"hash://{dimension}", dimension, HashEncoderFactory(dimension))


@dataclass(frozen=True)
class CheckedFactory:
    """An encoder that gets ``ENCODER_ROWS`` texts at a time, must keep to its width and give
    finite numbers."""

    candidate: Candidate

    def __call__(self) -> Encoder:
        encoder, name, width = self.candidate.factory(), self.candidate.name, self.candidate.dimension

        def encode(texts: list[str]) -> np.ndarray:
            parts = [np.empty((0, width), np.float32)]
            for at in range(0, len(texts), ENCODER_ROWS):
                some = texts[at : at + ENCODER_ROWS]
                vectors = np.asarray(encoder(some), dtype=np.float32)
                if vectors.shape != (len(some), width):
                    raise ValueError(f"{name} gave {vectors.shape}, not {width} wide")
                if not np.isfinite(vectors).all():
                    raise ValueError(f"{name} gave a component that is not finite")
                parts.append(vectors)
            return np.concatenate(parts)

        return encode


def checked(candidate: Candidate) -> EncoderFactory:
    return CheckedFactory(candidate)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    lengths[lengths == 0] = 1.0
    return matrix / lengths[:, None]


def list_column(matrix: np.ndarray) -> pa.Array:
    """Matrix rows as a list column."""
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1)))


def embed(factory: EncoderFactory) -> Callable[[Column], Column]:
    """Arrow UDF ``string -> array<float>`` that builds the encoder once per task."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = factory()
        for texts in batches:
            parts = [
                np.asarray(encoder(some.to_pylist()), dtype=np.float32) for some in _slices(texts)
            ]
            yield list_column(parts[0] if len(parts) == 1 else np.concatenate(parts))

    return encode


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts of some ``TEXT_BYTES`` at a time, a longer one alone; no texts are one slice."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts) or at == 0:
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + TEXT_BYTES, side="right")))
        yield texts.slice(at, end - at)
        at = end
