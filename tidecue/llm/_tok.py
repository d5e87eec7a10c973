"""Vectorised word tokenising and hashing over Arrow string buffers.

Texts of one Arrow batch are handled in chunks of a few MB, straight from Arrow's byte buffer: no Python string
is made for a word. Words are runs of bytes outside ``\\x20\\x09-\\x0D``, which in UTF-8 are the same words as
on characters. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK, BLOCK = 1 << 20, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE2 = np.uint64(0xD6E8FEB86659FD93 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_IN_WORD = np.array([chr(x).isalnum() or x >= 128 for x in range(256)])
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h = h ^ (h >> np.uint64(27))
    h = h * _M2
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; tables of up to two chunks are kept."""
    size = 1 << max(10, (n - 1).bit_length())
    key = int(base)
    if key in _tables and len(_tables[key][0]) >= size:
        return _tables[key]
    tables = []
    for b in (base, np.uint64(pow(int(base), -1, 1 << 64))):
        t = np.full(size, b, dtype=np.uint64)
        t[0] = 1
        tables.append(np.multiply.accumulate(t))
    if size <= 2 * CHUNK:
        _tables[key] = (tables[0], tables[1])
    return tables[0], tables[1]


@dataclass
class Chunk:
    """Rows lo..hi of a batch: their bytes, byte offsets, words (start, end) and each row's first word."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, second: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``second`` gives an independent one."""
        base, out, lo = _BASE2 if second else _BASE, np.zeros(len(self.starts), np.uint64), 0
        # blocks of whole words of about BLOCK bytes, which stay in the processor's cache
        while lo < len(out):
            at = int(self.starts[lo])
            hi = max(lo + 1, int(np.searchsorted(self.ends, at + BLOCK, side="right")))
            b = self.data[at : int(self.ends[hi - 1])]
            up, down = _powers(base, len(b) + 1)
            sums = np.zeros(len(b) + 1, dtype=np.uint64)
            weighed = b.astype(np.uint64)
            weighed += np.uint64(1)
            weighed *= up[: len(b)]
            np.cumsum(weighed, out=sums[1:])
            starts, ends = self.starts[lo:hi] - at, self.ends[lo:hi] - at
            out[lo:hi] = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
            lo = hi
        return out


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets), nulls as empty."""
    arr = batch.column(batch.schema.get_field_index(name))
    if arr.null_count:
        arr = arr.fill_null("")
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1] if offs and len(arr) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(batch: pa.RecordBatch, name: str = "text", lower: bool = False, size: int = CHUNK, letters: bool = False, inside: np.ndarray | None = None) -> Iterator[Chunk]:
    """Chunks of about ``size`` bytes (a longer single text makes a longer chunk). With ``letters``, words are runs of
    ASCII letters and digits and of bytes beyond ASCII; with ``inside``, of the bytes for which it is true."""
    data, offsets = column(batch, name)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        b, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if lower:
            b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
        word = inside[b] if inside is not None else _IN_WORD[b] if letters else ~((b == 32) | ((b >= 9) & (b <= 13)))
        before = np.zeros(len(b), dtype=bool)
        before[1:] = word[:-1]
        inner = offs[:-1][offs[:-1] < len(b)]
        before[inner] = False
        starts = np.flatnonzero(word & ~before)
        after = np.zeros(len(b), dtype=bool)
        after[:-1] = word[1:]
        after[inner[inner > 0] - 1] = False
        ends = np.flatnonzero(word & ~after) + 1
        yield Chunk(lo, hi, b, offs, starts, ends, np.searchsorted(starts, offs))
        lo = hi


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (row borders are the caller's)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += h[j : j + n]
    return mix(out)


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binary(parts: list[bytes | None]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
