"""Text columns of Arrow batches as flat byte arrays, and hashes of their words, for operators that work in numpy.

All functions are vectorised over many texts at once. A batch is cut into pieces of a few megabytes so that the temporary
arrays stay small; a single text longer than that is a piece of its own, so memory is bounded by the longest text.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2_000_000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the texts in them; null counts as empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    starts = starts.astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[starts[0]: starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, starts - starts[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices whose texts have about ``limit`` bytes."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
    first = 0
    while first < batch.num_rows:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    forward, backward = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
    forward[0] = backward[0] = 1
    return np.cumprod(forward), np.cumprod(backward)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    forward, backward = _powers(1 << max(12, int(size).bit_length()))
    return forward[:size], backward[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_classes(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the byte values inside any of the inclusive ranges."""
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first: last + 1] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of many texts: ``hash`` per word, byte range ``start``/``end`` of each, and ``of`` (text of each word).

    ``first`` has n + 1 entries: text i owns the words first[i] to first[i + 1]. A-Z count as a-z. A word is a maximal run of
    bytes for which ``inside`` is true; the classes used here hold either all or no byte of every non-ASCII character, so
    byte runs and character runs agree.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, inside: np.ndarray):
        low = LOWER[data]
        mask = inside[low]
        before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
        before[1:], after[:-1] = mask[:-1], mask[1:]
        texts = starts[:-1][np.diff(starts) > 0]
        before[texts] = False
        after[(starts[1:] - 1)[np.diff(starts) > 0]] = False
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        self.first = np.searchsorted(self.start, starts)
        self.of = np.repeat(np.arange(len(starts) - 1), np.diff(self.first))
        forward, backward = powers(len(low) + 1)
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * forward[:-1], out=sums[1:])
        plain = (sums[self.end] - sums[self.start]) * backward[self.start]
        self.hash = mix(plain + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words that begin at each word; entries near the end of a text run over it, see ``whole``."""
        count = len(self.hash)
        out = np.zeros(count, np.uint64)
        for k in range(size):
            if k < count:
                out[: count - k] = out[: count - k] * np.uint64(0xC6A4A7935BD1E995) + self.hash[k:]
        return mix(out)

    def whole(self, size: int) -> np.ndarray:
        """True where ``size`` words from here still belong to the same text."""
        return np.arange(len(self.hash)) + size <= np.repeat(self.first[1:], np.diff(self.first))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` consecutive values from each index on (shorter at the end), by doubling."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out
