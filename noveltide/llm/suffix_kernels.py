"""Array code of the repeated-string search: anchors, shard transforms, and their merge."""

from __future__ import annotations

import numpy as np

#: A repeated string has this many bytes at least.
SPAN = 200
#: Anchors are hashes of this many bytes.
GRAM = 32
#: Bytes of a symbol of the transforms, and how many whole symbols lie in any string of SPAN bytes.
SYMBOL = 16
DEPTH = SPAN // SYMBOL - 1
#: Bytes of a window besides DEPTH whole symbols; some lie before them, the others after.
REST = SPAN - SYMBOL * DEPTH
_POS_BITS = 22
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base & (2**64 - 1), "u8")])


_UP = _powers(_BASE, CHUNK + 2 * SPAN)
_DOWN = _powers(pow(_BASE, -1, 2**64), CHUNK + 2 * SPAN)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each GRAM bytes of x."""
    sums = np.zeros(len(x) + 1, "u8")
    np.cumsum(x.astype("u8") * _UP[: len(x)], out=sums[1:])
    n = len(x) - GRAM + 1
    g = (sums[GRAM:] - sums[:n]) * _DOWN[:n]
    g ^= g >> np.uint64(31)
    g *= _MIX1
    g ^= g >> np.uint64(29)
    g *= _MIX2
    g ^= g >> np.uint64(32)
    return g


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values."""
    step = 1
    while 2 * step <= w:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    return np.minimum(v[: len(v) - (w - step)], v[w - step :]) if w > step else v


def runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows of SPAN bytes that share an anchor: start, number of windows, the anchor's offset in the run, its hash.

    A window's anchor is the place in it where the hash of GRAM bytes is
    smallest (on 42 bits; the leftmost of equals). It depends on the window's own
    bytes alone, so equal windows have equal anchors at equal offsets. Every window is
    in one run; a run's bytes are those from its start to SPAN - 1 after its last window's start.
    A text is worked on in chunks, and chunks don't cut runs of copies apart: a run that a chunk ends
    is continued by the next one.
    """
    n = len(text) - SPAN + 1
    if n <= 0:
        z = np.zeros(0, "i8")
        return z, z, z, z.astype("u8")
    places, hashes = [], []
    mask = np.uint64((1 << _POS_BITS) - 1)
    for at in range(0, n, CHUNK):
        x = text[at : min(len(text), at + CHUNK + SPAN - 1)]
        g = gram_hashes(x)
        packed = (g & ~mask) | np.arange(len(g), dtype="u8")
        low = sliding_min(packed, SPAN - GRAM + 1) & mask
        places.append(low.astype("i8") + at)
        hashes.append(g[low.astype("i8")])
    place, h = np.concatenate(places), np.concatenate(hashes)
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[start, n])
    return start, count, place[start] - start, h[start]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of a shard by prefix doubling; its terminators are distinct symbols, so all suffixes differ."""
    n = len(symbols)
    rank = symbols.astype("i8")
    h = 1
    while True:
        second = np.zeros(n, "i8")
        second[: n - h] = rank[h:] + 1
        key = rank * (int(second.max(initial=0)) + 1) + second if n > h else rank
        order = np.argsort(key, kind="stable")
        new = np.empty(n, "i8")
        ordered = key[order]
        ids = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        new[order] = ids
        if ids[-1] == n - 1 or h >= n:
            return order
        rank, h = new, 2 * h


def stable_argsort(v: np.ndarray) -> np.ndarray:
    """Radix sort in 16-bit digits of non-negative integers under 2**32."""
    order = np.argsort((v & 0xFFFF).astype("u2"), kind="stable")
    high = (v >> 16).astype("u2")
    if high.any():
        order = order[np.argsort(high[order], kind="stable")]
    return order


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave shard transforms by refinement: which shard each merged row comes from, and its common prefix with the row before.

    `transforms` are the shards' Burrows-Wheeler transforms over one ordered
    alphabet. After h rounds the interleave sorts all suffixes by their first h
    symbols: a round takes the rows' symbols in the present order and sorts
    the rows by them, stably, which is the order of the suffixes that begin one symbol earlier.
    Shards are never sorted again. Rows that a round parts share less than h + 1 symbols,
    and rows once parted stay so at their place, which gives the common prefixes, up to `depth`.
    """
    symbols = np.concatenate(transforms)
    z = np.repeat(np.arange(len(transforms), dtype="u2"), [len(t) for t in transforms])
    block = np.zeros(len(z), "i8")
    lcp = np.full(len(z), depth, "i4")
    for h in range(depth):
        # The k-th row of a shard holds the k-th symbol of its transform.
        c = np.empty_like(symbols)
        c[np.argsort(z, kind="stable")] = symbols
        order = stable_argsort(c)
        z, c, block = z[order], c[order], block[order]
        parted = np.r_[True, (c[1:] != c[:-1]) | (block[1:] != block[:-1])]
        lcp[parted & (lcp == depth)] = h
        block = np.cumsum(parted)
    return z, lcp


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of several 64-bit columns."""
    out = np.zeros(len(columns[0]), "u8")
    for c in columns:
        out = (out ^ c) * _MIX1
        out ^= out >> np.uint64(29)
        out *= _MIX2
        out ^= out >> np.uint64(32)
    return out


def classes(columns: list[np.ndarray]) -> np.ndarray:
    """Numbers from 0 that are equal where all columns are.

    Rows are sorted by a hash and neighbours compared in full; if rows that differ have
    one hash, the columns themselves are sorted.
    """
    key = mixed(columns)
    order = np.argsort(key)
    differ = np.zeros(max(len(order) - 1, 0), bool)
    for c in columns:
        c = c[order]
        differ |= c[1:] != c[:-1]
    key = key[order]
    if (differ & (key[1:] == key[:-1])).any():
        order = np.lexsort(columns)
        differ = np.zeros(len(order) - 1, bool)
        for c in columns:
            c = c[order]
            differ |= c[1:] != c[:-1]
    out = np.empty(len(order), "i8")
    out[order] = np.cumsum(np.r_[0, differ]) if len(order) else 0
    return out


def repeated_windows(strings: list[bytes], anchors: np.ndarray, weights: np.ndarray, shard_symbols: int = 1 << 15) -> list[np.ndarray]:
    """For each string, which of its windows of SPAN bytes occur twice or more in all, a string counting `weights` times.

    Strings are cut into symbols of SYMBOL bytes on a grid through their
    anchors, so equal windows have equal grids. Shards of strings are transformed and the
    transforms merged; rows that share DEPTH symbols form a class. A window is some class's
    whole symbols with l bytes before and REST - l after them, and these are compared within the class.
    """
    lengths = np.fromiter(map(len, strings), "i8", len(strings))
    pad = b"\xff" * SYMBOL
    text = np.frombuffer(pad + b"".join(s + pad for s in strings) + pad, "u1")
    base = np.cumsum(lengths + SYMBOL) - lengths
    head = anchors % SYMBOL
    blocks = (lengths - head) // SYMBOL
    first = np.cumsum(blocks + 1) - (blocks + 1)
    total = int((blocks + 1).sum())
    owner = np.repeat(np.arange(len(strings)), blocks + 1)
    within = np.arange(total) - first[owner]
    at = base[owner] + head[owner] + SYMBOL * within
    is_end = within == blocks[owner]
    eights = np.lib.stride_tricks.sliding_window_view(text, 8)

    def word(place: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on, as a little-endian number."""
        return np.ascontiguousarray(eights[np.minimum(place, len(eights) - 1)]).view("u8").ravel()

    inner = at[~is_end]
    symbols = np.empty(total, "i8")
    symbols[is_end] = np.arange(len(strings))
    symbols[~is_end] = classes([word(inner + k) for k in range(0, SYMBOL, 8)]) + len(strings)

    cuts, size = [0], 0
    for i, b in enumerate((blocks + 1).tolist()):
        if size and size + b > shard_symbols:
            cuts.append(i)
            size = 0
        size += b
    cuts.append(len(strings))
    transforms, arrays = [], []
    edge = np.r_[first, total]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = edge[a], edge[b]
        own = symbols[lo:hi]
        order = suffix_order(own)
        transforms.append(own[order - 1])
        arrays.append(order + lo)
    z, lcp = merge(transforms, DEPTH)
    row = np.empty(total, "i8")
    row[np.argsort(z, kind="stable")] = np.concatenate(arrays)

    klass = np.cumsum(lcp < DEPTH)
    usable = within[row] + DEPTH <= blocks[owner[row]]
    row, klass = row[usable], klass[usable]
    mass = np.bincount(klass, weights[owner[row]])
    several = mass[klass] >= 2
    row, klass = row[several], klass[several]
    room = np.maximum(lengths - SPAN + 1, 0)
    place = np.cumsum(room) - room
    flat = np.zeros(int(room.sum()), bool)
    if len(row):
        own = owner[row]
        f = at[row] - base[own]
        before = [word(at[row] - k) for k in range(SYMBOL, 0, -8)]
        after = [word(at[row] + SYMBOL * DEPTH + k) for k in range(0, REST, 8)]
        for l in range(SYMBOL):
            p = f - l
            ok = np.flatnonzero((p >= 0) & (p + SPAN <= lengths[own]))
            if not len(ok):
                continue
            # Little endian: a word's last bytes are its high ones.
            parts = [klass[ok].view("u8")]
            for k, w in enumerate(before):
                if (n := min(8, l - (SYMBOL - 8 * (k + 1)))) > 0:
                    parts.append(w[ok] & np.uint64((2**64 - 1) ^ ((1 << (8 * (8 - n))) - 1)))
            for k, w in enumerate(after):
                if (n := min(8, REST - l - 8 * k)) > 0:
                    parts.append(w[ok] & np.uint64((1 << (8 * n)) - 1))
            same = classes(parts)
            hit = ok[np.bincount(same, weights[own[ok]])[same] >= 2]
            flat[place[own[hit]] + p[hit]] = True
    return [flat[a : a + n] for a, n in zip(place.tolist(), room.tolist(), strict=True)]
