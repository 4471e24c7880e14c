"""Words and their hashes, for whole Arrow batches at once.

Texts are looked at as UTF-8 bytes: the string column's own buffer, in pieces of a bounded size, so that
NumPy's inner loops do the work and a Python worker holds little. Nothing is cut: a text longer than a
piece makes a piece of its own.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

PIECE_BYTES = 1 << 20
BATCH_BYTES = "4m"

#: Bytes that belong to words where only white space separates.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes that belong to words where punctuation separates as well; all bytes of non-ASCII characters do.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, unless the session does: the usual bound is on rows, and documents can be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def tidied(run) -> _Tidied:
    """A function of Arrow batches that gives back its memory at its end: workers live on between tasks."""
    return _Tidied(run)


class _Tidied:
    """See ``tidied``; an object, so that what is shipped is the function alone."""

    def __init__(self, run):
        self.run = run

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from self.run(batches)
        self.run = None
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with every output bit depending on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes padded by 8, offsets of the rows in them). A null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    offs = np.frombuffer(raw[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null's bytes, if any, are not its text
        kept = np.where(np.asarray(column.is_valid()), np.diff(offs), 0)
        if (kept != np.diff(offs)).any():
            yield from pieces(column.fill_null(""), limit)
            return
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        buf = np.zeros(int(offs[end] - offs[row]) + 8, np.uint8)
        buf[:-8] = data[offs[row] : offs[end]]
        yield row, end, buf, offs[row : end + 1] - offs[row]
        row = end


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the byte spans of the words, and for each row the index of its first word."""
    size = int(offsets[-1])
    inside = table[buf[:size]]
    first = np.zeros(size + 1, dtype=bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~first[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by eight bytes at a time. ``buf`` is padded by 8 bytes."""
    length = (ends - starts).astype(np.int64)
    h = length.astype(np.uint64) * _C1
    if not len(starts):
        return h
    eights = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    active, j = np.arange(len(starts)), 0
    while len(active):
        left = length[active] - 8 * j
        part = eights[starts[active] + 8 * j] & _MASKS[np.minimum(left, 8)]
        h[active] = mix(h[active] ^ part)
        active, j = active[left > 8], j + 1
    return mix(h + _C1)


def window_hashes(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every run of ``width`` words within a row."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if width <= 4:
        out = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            out = mix(out + h[j : n - width + 1 + j] + _C1)
    else:  # polynomial in an odd base, so that it can be divided by a power of the base
        base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
        up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
        out = mix((total[width:] - total[:-width]) * down[: n - width + 1])
    row_end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n - width + 1) + width <= row_end[: n - width + 1])
    return at, out[at]


def rows_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row to which each word index belongs."""
    return np.searchsorted(first, at, side="right") - 1
