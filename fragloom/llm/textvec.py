"""UTF-8 text columns as numpy arrays: words, distinct words and sums for each row without a loop over all words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are worked on at once; a longer row is a slice of its own.
SLICE_BYTES = 2 << 20
_BASE = U(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes of non-ASCII characters.
PUNCT = np.ones(256, bool)
PUNCT[128:] = False
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    PUNCT[ord(_a) : ord(_b) + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (in a new array)."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after another, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if offsets is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `most` bytes of text, never inside a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of many rows: starts and ends in buf, the row of each, and the first word of each row (rows + 1)."""

    def __init__(self, column: pa.Array, breaks: np.ndarray = SPACE, lower: bool = True):
        raw, self.offsets = utf8(column)
        self.raw = raw
        self.buf = LOWER[raw] if lower else raw
        inside = ~breaks[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all words one after another, and where each begins (words + 1)."""
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[self.starts] = 1
        inside[self.ends] -= 1
        return self.buf[np.cumsum(inside, dtype=np.int8)[:-1] > 0], np.append(0, np.cumsum(self.ends - self.starts))

    def distinct(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, and the number of each word's: their bytes are compared, so no two words are taken for one."""
        return distinct_spans(*self.joined())

    def hashes(self) -> np.ndarray:
        return span_hashes(*self.joined())


def distinct_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values of data[offsets[i]:offsets[i + 1]] in order of their first places, and the number of each span's."""
    offsets = np.ascontiguousarray(offsets, np.int64)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return spans.dictionary, spans.indices.to_numpy(zero_copy_only=False)


#: Primes and bases of the polynomials that hash spans; bases' powers are made as long spans ask for them.
_FIELDS = ((2_147_483_647, 1_493_877_001), (2_147_483_629, 1_072_064_893))
_powers = [np.ones(1, U) for _ in _FIELDS]


def span_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[offsets[i]:offsets[i + 1]]: values of its polynomial in two prime fields (spans of no byte are alike)."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), U)
    if not len(full):
        return out
    at = offsets[:-1][full]
    place = np.arange(len(data)) - np.repeat(at, sizes[full])
    digits = data.astype(U) + U(1)
    for k, (prime, base) in enumerate(_FIELDS):
        while len(_powers[k]) <= int(sizes.max()):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * U(pow(base, len(_powers[k]), prime)) % U(prime)])
        out[full] = out[full] << U(31) | np.add.reduceat(digits * _powers[k][place], at) % U(prime)
    return mix(out)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; each row's own sum, so that long batches lose no digits."""
    n = len(first) - 1
    out = np.zeros(n, np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of `width` words in a row: hash, row, place of its first word in the row. Rows with fewer words have none."""
    n = len(words)
    if n < width:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n - width + 1, U)
    for i in range(width):
        h = h * _BASE + words[i : n - width + 1 + i]
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    whole = row[: n - width + 1] == row[width - 1 :]
    return mix(h[whole]), row[: n - width + 1][whole], place[: n - width + 1][whole]


def planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then second bytes, and so on: high bytes of small numbers are runs of zeros, which shuffles compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplaned(blob: bytes, kind, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def release() -> None:
    """Gives freed memory back: a worker lives on between stages, and what it keeps counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)
