"""Vectorised words and hashes over Arrow text columns.

A batch of texts is one byte buffer with offsets, so words are found and hashed for many
documents by a few NumPy passes; no word becomes a Python object.  A word's hash is a
polynomial over a table of random 64-bit values, finished by an avalanche step; n-gram hashes
combine the hashes of their words in order.  All hashes are fixed by ``SEED``: a task that is
run again gives the same values on any machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEED = 20240131
#: Bytes of text that are handled at once (a longer document is handled alone).
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(SEED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _is_space() -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[[0x20, *range(0x09, 0x0E)]] = False
    return out


def _is_alnum() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[ord("0") : ord("9") + 1] = out[ord("a") : ord("z") + 1] = out[ord("A") : ord("Z") + 1] = True
    out[128:] = True
    return out


#: Byte classes of words: everything but ASCII white space; ASCII letters and digits with all bytes from 0x80.
NOT_SPACE, ALNUM = _is_space(), _is_alnum()
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a text column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows that hold about ``most`` bytes."""
    data, at = buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk: hashes, first bytes, ends, and the number of words before each row (n + 1)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64)
    inside = kind[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True  # a word ends where its row ends
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if not len(first):
        return np.zeros(0, np.uint64), first, end, np.zeros(len(at), np.int64)
    length = end - first
    total = int(length.sum())
    place = np.arange(total, dtype=np.int64)
    begin = np.cumsum(length) - length
    place -= np.repeat(begin, length)
    power = np.multiply.accumulate(np.full(int(length.max()), _BASE))
    value = (_LOWER if lower else _BYTE)[data[inside]] * power[place]
    hashed = mix(np.add.reduceat(value, begin))
    return hashed, first, end, np.searchsorted(first, at).astype(np.int64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on (len(h) - n + 1 of them, over row ends too)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    if n <= 8:
        out = h[: len(h) - n + 1] * _PLACE[0]
        for k in range(1, n):
            out = out + h[k : len(h) - n + 1 + k] * _PLACE[k]
        return mix(out)
    # doubling: a window is its first and its last 2^k words, which overlap
    size, cur = 1, h
    while size * 2 <= n:
        cur = mix(cur[: len(cur) - size] * _PLACE[0] + cur[size:] * _PLACE[1])
        size *= 2
    shift = n - size
    return cur if not shift else mix(cur[: len(cur) - shift] * _PLACE[2] + cur[shift:] * _PLACE[3])


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a whole sequence of word hashes."""
    k = np.arange(1, len(h) + 1, dtype=np.uint64)
    return int(mix(np.array([np.sum(mix(h + k * _PLACE[5])) + np.uint64(len(h))], np.uint64))[0])


def signed(x: np.ndarray) -> pa.Array:
    """As Spark's long."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
