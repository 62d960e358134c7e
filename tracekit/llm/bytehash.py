"""Words and hashes of UTF-8 texts, computed over Arrow's byte buffers with numpy.

A batch of texts is one byte array with offsets; words, word pairs and substrings get 64-bit hashes
from prefix sums, so there is no Python loop over characters or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Longest stretch that one prefix sum covers, and longest string whose hash comes from one: over long regular strings such sums collide.
STRETCH, LONG = 1 << 17, 512
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of a well-known generator)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(of: int) -> np.ndarray:
    out = np.full(STRETCH + 1, of, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


POWER, UNPOWER = _powers(BASE), _powers(INVERSE)
VALUE = mixed(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
#: The same with A-Z taken as a-z.
FOLDED = VALUE.copy()
FOLDED[0x41:0x5B] = VALUE[0x61:0x7B]
#: Words of letters, digits and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Words of everything but ASCII white space.
SOLID = np.ones(256, dtype=bool)
SOLID[0x09:0x0E] = SOLID[0x20] = False


def whole(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and the offsets of each (one more at the end), not copied. Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 21, rows: int = (1 << 16) - 1) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``most`` bytes of text (a longer text stands alone) and ``rows`` rows at most: rows, bytes, offsets. Null counts as empty."""
    data, offsets = whole(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < offsets.size - 1:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1))
        yield slice(lo, hi), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each text (one more at the end)."""
    inside = kind[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    at = edge[edge < data.size]
    begins[at] = inside[at]
    at = edge[edge > 0] - 1
    stops[at] = inside[at]
    begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return begins, stops, np.searchsorted(begins, offsets)


def hashes(data: np.ndarray, begins: np.ndarray, stops: np.ndarray, value: np.ndarray = VALUE) -> np.ndarray:
    """64-bit hashes of data[begins[i]:stops[i]]; begins rise. Strings of over ``LONG`` bytes are hashed one by one."""
    out = np.empty(begins.size, dtype=U)
    long = stops - begins > LONG
    for i in np.flatnonzero(long).tolist():
        piece = data[int(begins[i]) : int(stops[i])].tobytes()
        out[i] = xxhash.xxh64_intdigest(piece.lower() if value is FOLDED else piece)
    if long.any():
        out[~long] = _sums(data, begins[~long], stops[~long], value)
        return out
    return _sums(data, begins, stops, value)


def _sums(data: np.ndarray, begins: np.ndarray, stops: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hashes of strings of at most ``LONG`` bytes from prefix sums over stretches."""
    out = np.empty(begins.size, dtype=U)
    i = 0
    while i < begins.size:
        first = int(begins[i])
        j = int(np.searchsorted(begins, first + STRETCH - LONG, side="right"))
        last = int(stops[i:j].max())
        sums = np.zeros(last - first + 1, dtype=U)
        np.cumsum(value[data[first:last]] * POWER[: last - first], out=sums[1:])
        b, e = begins[i:j] - first, stops[i:j] - first
        out[i:j] = mixed((sums[e] - sums[b]) * UNPOWER[b] + (e - b).astype(U))
        i = j
    return out


def hash_of(word: bytes, value: np.ndarray = FOLDED) -> int:
    """The hash that ``hashes`` gives to one string."""
    data = np.frombuffer(word, dtype=np.uint8)
    return int(hashes(data, np.array([0]), np.array([data.size]), value)[0])


def pairs(h: np.ndarray, firsts: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of each text, and where each text's begin. A text with fewer words, but not none, has its whole sequence."""
    count = np.diff(firsts)
    n = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    out_firsts = np.concatenate([[0], np.cumsum(n)])
    full = np.zeros(max(0, h.size - width + 1), dtype=U)
    for k in range(width):
        full = full * U(0xD6E8FEB86659FD93) + h[k : k + full.size]
    full = mixed(full)
    at = np.repeat(firsts[:-1] - out_firsts[:-1], n) + np.arange(out_firsts[-1])
    out = np.zeros(at.size, dtype=U)
    short = np.repeat((count < width) & (count > 0), n)
    out[~short] = full[at[~short]]
    for d in np.flatnonzero((count < width) & (count > 0)):
        x = np.zeros(1, dtype=U)
        for k in range(firsts[d], firsts[d + 1]):
            x = x * U(0xD6E8FEB86659FD93) + h[k]
        out[out_firsts[d]] = mixed(x + U(int(count[d])))[0]
    return out, out_firsts
