"""Recursive text splitting for use inside Arrow UDFs."""

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import fixed_values as fixed


def _cut_before(text: str, separator: str) -> list[str]:
    """Pieces of ``text``, each later piece starting with the separator it was cut at."""
    head, *rest = text.split(separator)
    return ([head] if head else []) + [separator + piece for piece in rest]


class RecursiveSplitter:
    """Chunks of at most ``size`` characters that keep natural boundaries where they can.

    The first separator present in the text cuts it. Short pieces are packed
    greedily, carrying up to ``overlap`` characters of whole pieces into the next
    chunk; a piece that is too long goes to the following separators. The empty
    separator stands for a plain character window.
    """

    def __init__(
        self,
        size: int = fixed.CHUNK_SIZE,
        overlap: int = fixed.CHUNK_OVERLAP,
        separators: list[str] | None = None,
    ):
        if not 0 <= overlap < size:
            raise ValueError("overlap must be at least 0 and less than size")
        self.size = size
        self.overlap = overlap
        self.separators = list(fixed.SEPARATORS if separators is None else separators)

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        trimmed = (chunk.strip() for chunk in self._chunks(text, 0))
        return [chunk for chunk in trimmed if chunk]

    def _chunks(self, text: str, level: int) -> Iterator[str]:
        while level < len(self.separators) and self.separators[level] not in text:
            level += 1
        if level == len(self.separators):
            yield text
            return
        separator = self.separators[level]
        if separator == "":
            yield from self._windows(text)
            return
        short: list[str] = []
        for piece in _cut_before(text, separator):
            if len(piece) < self.size:
                short.append(piece)
                continue
            yield from self._packed(short)
            short = []
            yield from self._chunks(piece, level + 1)
        yield from self._packed(short)

    def _windows(self, text: str) -> Iterator[str]:
        step = self.size - self.overlap
        yield text[: self.size]
        for start in range(step, len(text) - self.overlap, step):
            yield text[start : start + self.size]

    def _packed(self, pieces: list[str]) -> Iterator[str]:
        window: deque[str] = deque()
        width = 0
        for piece in pieces:
            if window and width + len(piece) > self.size:
                yield "".join(window)
                while window and (width > self.overlap or width + len(piece) > self.size):
                    width -= len(window.popleft())
            window.append(piece)
            width += len(piece)
        if window:
            yield "".join(window)


def recursive_chunks(
    size: int = fixed.CHUNK_SIZE,
    overlap: int = fixed.CHUNK_OVERLAP,
    separators: list[str] | None = None,
) -> Callable[[Column], Column]:
    """Arrow UDF ``string -> array<string>``; null and '' give an empty array."""
    splitter = RecursiveSplitter(size, overlap, separators)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([splitter.split(text) for text in texts.to_pylist()], pa.list_(pa.string()))

    return split
