"""Words of Arrow string columns as numpy arrays, without a Python object per word.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``.  UTF-8 never uses those bytes inside a longer
character, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 17

#: Bytes of text handled at a time; a longer text is handled alone.
CHUNK = 3 << 19


@lru_cache(maxsize=16)
def _table(base: int) -> np.ndarray:
    out = np.full(_SEGMENT, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64.  What is kept does not grow with ``n``: longer ranges are a table's products."""
    low = _table(base)
    if n <= len(low):
        return low[:n]
    return np.multiply.outer(powers(pow(base, len(low), 2**64), -(-n // len(low))), low).reshape(-1)[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def text_chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; null is the empty text."""
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        base = 0
        if len(part) == 0:
            continue
        part = part.cast(pa.large_string()) if not pa.types.is_large_string(part.type) else part
        if part.null_count:
            part = part.fill_null("")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        while base < len(part):
            end = max(base + 1, int(np.searchsorted(offsets, offsets[base] + limit, "right")) - 1)
            end = min(end, len(part))
            yield base, end, data[offsets[base] : offsets[end]], offsets[base : end + 1] - offsets[base]
            base = end


def split(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text (and the end) the number of words before it.

    breaks: further positions at which a word ends and the next begins."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if breaks is not None:
        cut[breaks] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans ascend and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    base = (_BASE + 2 * seed * 0x632BE59BD9B4E019) % 2**64
    inverse = pow(base, -1, 2**64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _SEGMENT, "right")))
        hi = int(ends[j - 1])
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[data[lo:hi]] * powers(base, hi - lo), out=total[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[b] - total[a]) * powers(inverse, hi - lo)[a]
        i = j
    return mix(out ^ np.uint64(seed))


def head8(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span as a number, zero-filled."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    every = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = np.minimum(ends - starts, 8).astype(np.uint64)
    return every[starts] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * size))


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its distinct word, and for each distinct word an index of one occurrence.

    Equal hashes are held against length, head and a second hash's seed: a collision only costs another try."""
    for seed in range(8):
        codes, keys = pd.factorize(hash_spans(data, starts, ends, seed))
        first = np.empty(len(keys), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        size, head = ends - starts, head8(data, starts, ends)
        if (size[first][codes] == size).all() and (head[first][codes] == head).all():
            return codes, first
    raise RuntimeError("words can't be told apart by eight hashes")


def gather_spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start .. start+length-1 of every span, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def texts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow string column."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    body = np.ascontiguousarray(data[gather_spans(starts, lengths)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(body))


def rolling(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A hash of each run of ``k`` consecutive word hashes (none if there are fewer)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    base = (0xD1342543DE82EF95 + 2 * seed * 0xA24BAED4963EE407) % 2**64 | 1
    out, have = words, 1
    for bit in bin(k)[3:]:  # runs of 2 * have from two of have, and one word more where k's next bit is set
        out = out[: len(out) - have] * np.uint64(pow(base, have, 2**64)) + out[have:]
        have *= 2
        if bit == "1":
            out = out[:-1] * np.uint64(base) + words[have:]
            have += 1
    return mix(out)
