"""Text as numpy code-point arrays, so that work on characters and words runs without per-row string calls.

A ``Text`` holds the rows of an Arrow string array as one ``uint32`` array with row
offsets.  Spans of it (words, lines, sentences) are named by 64-bit hashes taken from
a prefix sum: with ``P[i]`` the sum of ``cp[j] * r**j`` for j < i (mod 2**64), a span's
value is ``(P[end] - P[start]) * r**-start``, whatever its place.  Hashing all words of
a batch costs a few array passes.

Nulls are rows of no characters; ``Text.valid`` tells them from empty texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

R = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
#: Classes of characters.
SPACE, LETTER, DIGIT, PUNCT, HAN, KANA, BREAK = range(7)
#: Bytes of text handled at a time; a longer row is a slice of its own.
SLICE_BYTES = 1 << 20


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point.  Combining marks count as letters, so words of Indic scripts stay whole."""
    out = np.full(0x110000, PUNCT, np.uint8)
    for c in range(0x30000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "L" or kind in ("Mn", "Mc"):
            out[c] = LETTER
        elif kind == "Nd":
            out[c] = DIGIT
        elif ch.isspace() or kind == "Zs":
            out[c] = SPACE
    out[0x0A] = out[0x0D] = out[0x2028] = out[0x2029] = BREAK
    for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x30000)):
        out[a:b] = HAN
    out[0x3005] = HAN
    for a, b in ((0x3041, 0x30FB), (0x30FC, 0x3100), (0x31F0, 0x3200), (0xFF66, 0xFFA0)):
        out[a:b] = KANA
    return out


@lru_cache(1)
def lower_table() -> np.ndarray:
    """Lower case by code point, where that is one character."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in (*range(0xD800), *range(0xE000, 0x1F000)):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**j and r**-j for j < n, kept and extended as needed."""
    have = len(_pow[0])
    if have < n:
        n = max(n, SLICE_BYTES + 1)
        for k, r in enumerate((R, pow(R, -1, 1 << 64))):
            a = np.full(n, r, np.uint64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


class Spans:
    """Prefix sums over one code-point array, for hashes of its spans."""

    def __init__(self, cp: np.ndarray):
        power, self.inverse = powers(len(cp) + 1)
        self.prefix = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * power[: len(cp)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_of(text: str) -> int:
    """The hash that ``Spans`` gives a span with this text."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(Spans(cp).of(np.array([0]), np.array([len(cp)]))[0])


class Text:
    """Rows of text as one code-point array ``cp``; row i is ``cp[rows[i]:rows[i + 1]]``."""

    def __init__(self, array: pa.Array):
        array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
        n = len(array)
        self.valid = np.asarray(array.is_valid()) if n else np.zeros(0, bool)
        if array.null_count:
            array = array.fill_null("")
        _, offsets, data = array.buffers()
        at = np.frombuffer(offsets, np.int64, n + 1, array.offset * 8) if n else np.zeros(1, np.int64)
        raw = bytes(memoryview(data)[at[0] : at[-1]]) if n and data is not None else b""
        self.raw, self.at = raw, at - at[0]
        self.cp = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        if len(self.cp) == len(raw):
            self.rows = self.at
        else:
            lead = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=lead[1:])
            self.rows = lead[self.at]

    def __len__(self) -> int:
        return len(self.rows) - 1

    def row_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, place, "right") - 1

    def string(self, start: int, end: int) -> str:
        return self.cp[start:end].tobytes().decode("utf-32-le", "replace")


def to_array(cp: np.ndarray, rows: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The Arrow string array of a code-point array with row offsets."""
    raw = cp.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")
    size = np.ones(len(cp), np.int64)
    for limit in (0x80, 0x800, 0x10000):
        size += cp >= limit
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    offsets = pa.py_buffer(at[rows].astype(np.int64).tobytes())
    mask = None if valid is None else pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(pa.large_string(), len(rows) - 1, [mask, offsets, pa.py_buffer(raw)])


def slices(array: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Pieces of an Arrow string array of about ``size`` bytes with their first row."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    if isinstance(array, pa.ChunkedArray):  # an empty one stays chunked in some versions
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_string())
    array = array.cast(pa.large_string())
    n = len(array)
    if not n:
        return
    at = np.frombuffer(array.buffers()[1], np.int64, n + 1, array.offset * 8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, array.slice(i, min(j, n) - i)
        i = min(j, n)


def runs(kind: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one class within a row."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    inner = rows[(rows > 0) & (rows < n)]
    cut[inner] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    return start, end
