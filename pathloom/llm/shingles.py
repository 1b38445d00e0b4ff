"""Word-shingle sets of whole texts, in numpy over Arrow buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z in
lower case; a shingle is five consecutive words, as a 64-bit hash. A text with
one to four words has the whole sequence as its one shingle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

SIZE = 5
U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_STEP = U(_rng.integers(1 << 62, 1 << 63)) | U(1)
_BACK = U(pow(int(_STEP), -1, 1 << 64))
_ROLE = _rng.integers(1 << 62, 1 << 63, 8, dtype=np.uint64) | U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (shift and multiply rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    forth, back = np.full(size, _STEP), np.full(size, _BACK)
    forth[0] = back[0] = 1
    return np.cumprod(forth, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words of every row."""
    n, rows = len(raw), len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, ~inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, ~inside[1:]
    first = np.flatnonzero(inside & (before | edge[:-1]))
    last = np.flatnonzero(inside & (after | edge[1:])) + 1
    forth, back = _powers(1 << max(16, int(n).bit_length()))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * forth[:n], out=total[1:])
    words = mix((total[last] - total[first]) * back[first] + (last - first).astype(np.uint64) * _ROLE[7])
    return words, np.diff(np.searchsorted(first, offsets))


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the rows' offsets in them."""
    words, count = word_hashes(*text_bytes(column))
    start = np.concatenate([[0], np.cumsum(count)])
    shingles = np.where(count >= SIZE, count - SIZE + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(shingles)])
    at = np.arange(out[-1]) + np.repeat(start[:-1] - out[:-1], shingles)
    length = np.repeat(np.minimum(count, SIZE), shingles)
    h = length.astype(np.uint64) * _ROLE[6]
    for k in range(SIZE):
        has = length > k
        if has.all():
            h += words[at + k] * _ROLE[k]
        else:
            h[has] += words[at[has] + k] * _ROLE[k]
    h = mix(h)
    for a, b in zip(out[:-1].tolist(), out[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    new[out[:-1][shingles > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[out]


def set_keys(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, whatever its order."""
    keys = []
    size = np.diff(offsets).astype(np.uint64)
    for salt in (_ROLE[2], _ROLE[3]):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ salt))])
        keys.append(mix(total[offsets[1:]] - total[offsets[:-1]] + size * salt))
    return keys[0], keys[1]
