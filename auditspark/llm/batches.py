"""Array helpers for work on whole batches of texts inside a task.

A batch is an Arrow string column. Its bytes stay in one array; words, lines and windows of words are arrays of places
in it, so that no Python object is made per word. Pieces of a batch hold about ``PIECE`` bytes, or one longer text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: bytes of text that the arrays of one piece are made for
PIECE = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: bytes of words ``[^\x20\x09-\x0D]+``
WORD = ~WHITE
#: bytes to themselves, but A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that go to Python workers by rows and by bytes, as texts differ much in length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, PIECE) + 1, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * PIECE:
            _powers[base] = have
    return have


class Piece(NamedTuple):
    """Texts ``first`` and following of a batch: their bytes, and where each begins (one more than texts)."""

    first: int
    data: np.ndarray
    at: np.ndarray

    @property
    def n(self) -> int:
        return len(self.at) - 1

    def spans(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text number of each longest run of bytes for which ``table`` holds."""
        inside = table[self.data]
        begin, last = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = self.at[1:] > self.at[:-1]
        edge = self.at[:-1][filled]
        begin[edge] = inside[edge]
        edge = self.at[1:][filled] - 1
        last[edge] = inside[edge]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(last) + 1, self.text_of(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text number of each \\n-split line, empty ones included; an empty text has one empty line."""
        breaks = np.flatnonzero(self.data == 0x0A)
        of = self.text_of(breaks)
        starts = np.concatenate([self.at[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.at[1:]])
        text = np.concatenate([np.arange(self.n), of])
        order = np.lexsort((starts, text))
        end_order = np.lexsort((ends, np.concatenate([of, np.arange(self.n)])))
        return starts[order], ends[end_order], text[order]

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, places, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span's bytes."""
        size = len(self.data)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, size)[:size], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _power(_BASE_INVERSE, size)[starts])

    def counts(self, marks: np.ndarray) -> np.ndarray:
        """Per text, how many bytes are marked."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def lowered(self) -> Piece:
        return self._replace(data=LOWER[self.data])


def pieces(column: pa.Array | pa.ChunkedArray) -> Iterator[Piece]:
    """The texts of a column in order; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1
        end = min(max(end, first + 1), n)
        yield Piece(first, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first])
        first = end


def windows(hashes: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """For each word, a hash of the ``width`` words from it on; windows that leave the text are of no meaning."""
    out = hashes.copy()
    for step in range(1, width):
        out[:len(out) - step] = mix(out[:len(out) - step] * np.uint64(0xD1342543DE82EF95)) + hashes[step:]
    return mix(out)


def rolled(hashes: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """For each word, a hash of the ``width`` words from it on, by sums of powers of an odd ``base``.

    Windows that leave the text are of no meaning, and those that leave the array are 0.
    """
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    if n >= width:
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _power(base, n)[:n], out=sums[1:])
        out[:n - width + 1] = mix((sums[width:] - sums[:-width]) * _power(pow(base, -1, 1 << 64), n)[:n - width + 1])
    return out


def whole_windows(text: np.ndarray, width: int) -> np.ndarray:
    """The words from which ``width`` words of the same text stand."""
    n = len(text) - width + 1
    return np.flatnonzero(text[:n] == text[width - 1:]) if n > 0 else np.zeros(0, np.int64)


def in_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """Apply ``work`` to each Arrow batch of each partition."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                done = work(batch)
                if done is not None and done.num_rows:
                    yield done

    return df.mapInArrow(run, schema)
