"""Word shingle sets of whole batches of texts as sorted arrays of hashes."""

from __future__ import annotations

import numpy as np

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Powers of the base up and down, for texts worked on together; longer ones get longer tables.
_TABLES: list[np.ndarray] = []


def mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * _MIX1
    v = (v ^ (v >> np.uint64(27))) * _MIX2
    return v ^ (v >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        down = pow(int(_BASE), -1, 1 << 64)
        _TABLES[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, "u8")]) for b in (int(_BASE), down)]
    return _TABLES[0], _TABLES[1]


def shingles(texts: list[bytes], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-word shingles of each text, sorted by row and hash.

    Words are what ASCII white space parts, A-Z in lower case. A text of fewer
    than n words, but any, has its whole sequence as its one shingle. The hash has 64 bits
    and depends on the words and their number.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", "u1")
    lens = np.fromiter((len(t) + 1 for t in texts), "i8", len(texts))
    space = _SPACE[raw]
    edge = np.diff(np.r_[True, space].view("i1"))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, "u8")
    np.cumsum((_LOWER[raw].astype("u8") + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    words = mix((sums[end] - sums[start]) * down[start] + (end - start).astype("u8"))
    row = np.searchsorted(np.cumsum(lens), start, side="right")
    count = np.bincount(row, minlength=len(texts))
    first = np.cumsum(count) - count
    left = count[row] - (np.arange(len(row)) - first[row])
    value = np.zeros(len(words), "u8")
    for k in range(n):
        value[: len(words) - k] = value[: len(words) - k] * _BASE + words[k:]
    full = left >= n
    owner, found = row[full], mix(value[full] + np.uint64(n))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = []
        for r in short:
            v = 0
            for w in words[first[r] : first[r] + count[r]].tolist():
                v = (v * int(_BASE) + w) % (1 << 64)
            own.append((v + int(count[r])) % (1 << 64))
        owner, found = np.r_[owner, short], np.r_[found, mix(np.array(own, "u8"))]
    order = np.argsort(found, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    owner, found = owner[order], found[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])]
    return owner[new], found[new]
