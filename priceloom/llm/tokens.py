"""Texts as arrays of hashed words, many texts at a time in numpy."""

from __future__ import annotations

import numpy as np

# Places of a word within a text are bits of one integer up to this many words.
BIT_WORDS = 1 << 14
_held: dict[str, object] = {}
# The primes of XXH64.
X1, X2, X3, X4, X5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def remembered(owner: str, make):
    """What a Python worker remembers for ``owner``; another operator's memory goes when the owner changes."""
    if owner not in _held:
        _held.clear()
        _held[owner] = make()
    return _held[owner]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= C2
    x ^= x >> np.uint64(27)
    x *= C3
    x ^= x >> np.uint64(31)
    return x


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _xxh64(raw: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """XXH64 of the words of one length below 32 that start at ``starts``; eight bytes more must follow the last one."""
    def lanes(at: int, kind) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.ndarray((len(raw) - width + 1,), kind, raw, strides=(1,))[starts + at].astype(np.uint64)

    h, at = np.full(len(starts), X5 + np.uint64(length)), 0
    for at in range(0, length - 7, 8):
        h = _rotated(h ^ (_rotated(lanes(at, "<u8") * X2, 31) * X1), 27) * X1 + X4
    at = length & ~7
    if length & 4:
        h = _rotated(h ^ (lanes(at, "<u4") * X1), 23) * X2 + X3
        at += 4
    for at in range(at, length):
        h = _rotated(h ^ (lanes(at, np.uint8) * X5), 11) * X1
    h = (h ^ (h >> np.uint64(33))) * X2
    h = (h ^ (h >> np.uint64(29))) * X3
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes (XXH64) of the words of all texts, one after another, and the number of words of each.

    Words are runs of anything but ASCII white space, with A-Z in lower case. Words of one length are hashed together,
    nothing is remembered of them.
    """
    import xxhash

    _held.clear()
    raw = b"\n".join([b"", *texts, bytes(8)]).lower()
    # the zeros at the end are no word
    inside = ~_SPACE[np.frombuffer(raw, np.uint8, len(raw) - 8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(starts, ends + 1), prepend=0)
    flat = np.empty(len(starts), dtype=np.uint64)
    kind = np.minimum(lengths, 32).astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    bounds = np.searchsorted(kind[order], np.arange(34))
    for length in range(1, 32):
        some = order[bounds[length]:bounds[length + 1]]
        if len(some):
            flat[some] = _xxh64(raw, starts[some], length)
    for i in order[bounds[32]:].tolist():
        flat[i] = xxhash.xxh64_intdigest(raw[starts[i]:starts[i] + lengths[i]])
    return flat, counts


def together(texts: list[bytes], limit: int):
    """Slices of ``texts`` of about ``limit`` bytes each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place; the last k - 1 places see fewer words of the next text and are not valid there."""
    out = np.zeros(len(words), dtype=np.uint64)
    for o in range(k):
        shifted = np.zeros(len(words), dtype=np.uint64)
        shifted[: len(words) - o] = words[o:] if o else words
        out = out * C1 + mix(shifted + np.uint64(o + 1))
    return mix(out)


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Word edit distance by banded alignment, or ``limit + 1`` if it is larger.

    Texts of at most ``BIT_WORDS`` words are aligned in a band of ``limit`` on either side, a column at a time as bits.
    For longer ones the band starts narrow and widens fourfold until the distance fits in it; in a band
    the furthest place on every diagonal is kept per number of errors.
    """
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    start = int(np.argmax(a[: min(n, m)] != b[: min(n, m)])) if min(n, m) else 0
    if min(n, m) and start == 0 and a[0] == b[0]:
        start = min(n, m)
    a, b = a[start:], b[start:]
    n, m = len(a), len(b)
    if not n or not m:
        return min(max(n, m), limit + 1)
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(ub, ua), len(ub) - 1)
    shared = np.minimum(ca, np.where(ub[at] == ua, cb[at], 0)).sum()
    if max(n, m) - shared > limit:  # too few common words for any alignment
        return limit + 1
    if max(n, m) <= BIT_WORDS:
        return _band_bits(a, b, limit)
    band = max(8, abs(n - m))
    while True:
        band = min(band, limit)
        d = _banded(a, b, band)
        if d <= band or band == limit:
            return min(d, limit + 1)
        band *= 4


def _band_bits(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance inside the band: differences of neighbouring cells of a column are bits of two integers (Myers, Hyyrö).

    Bit t of column j stands for row j - band + t. The band slides down a row per column, and the score
    is followed along the diagonal that ends in the last cell, on which it never falls.
    """
    if len(a) < len(b):
        a, b = b, a
    band = min(limit, len(a))
    ahead = len(a) - len(b)
    rows: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        rows[w] = rows.get(w, 0) | 1 << i
    mask = (1 << 2 * band + 1) - 1
    goal = 1 << band + ahead
    up, down, score = mask >> band << band, 0, ahead  # rows above the first have no differences
    for j, w in enumerate(b.tolist()):
        same = rows.get(w, 0)
        same = (same >> j - band if j > band else same << band - j) & mask
        level = ((((same & up) + up) ^ up) | same | down) & mask
        right = down | (mask ^ (level | up))
        left = level & up
        if not level & goal:
            score += 1
            if score > limit:
                return limit + 1
        level >>= 1
        up, down = left | (mask ^ (level | right)), level & right
    return score


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    n, m = len(a), len(b)
    k = np.arange(-band, band + 1)
    table = _runs(a, b, band) if (2 * band + 1) * (n + 1) <= 1 << 23 else None
    far = np.full(2 * band + 3, -(1 << 40), dtype=np.int64)  # furthest place of a on each diagonal, with a margin
    goal = m - n + band + 1
    for errors in range(band + 1):
        if errors == 0:
            far[band + 1] = 0
        else:
            step = np.maximum(far[1:-1] + 1, np.maximum(far[:-2], far[2:] + 1))
            far[1:-1] = step
        # no further than the ends of both texts
        here = np.minimum(far[1:-1], np.minimum(n, m - k))
        here = np.where((here < 0) | (here + k < 0), -(1 << 40), here)
        live = np.nonzero(here >= 0)[0]
        if table is not None:
            here[live] = table[live, here[live]]
        else:
            i = here[live]
            moving = np.arange(len(live))
            while len(moving):
                x, y = i[moving], i[moving] + k[live[moving]]
                inside = (x < n) & (y < m)
                moving, x, y = moving[inside], x[inside], y[inside]
                moving = moving[a[x] == b[y]]
                i[moving] += 1
            here[live] = i
        far[1:-1] = here
        if far[goal] >= n:
            return errors
    return band + 1


def _runs(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """For every diagonal and place of a, the place where the run of equal words from there ends."""
    n, m = len(a), len(b)
    j = np.arange(n)[None, :] + np.arange(-band, band + 1)[:, None]
    valid = (j >= 0) & (j < m)
    equal = np.zeros(j.shape, dtype=bool)
    np.equal(np.broadcast_to(a, j.shape), b[np.clip(j, 0, m - 1)], out=equal)
    stops = np.where(equal & valid, n, np.arange(n)[None, :])
    out = np.empty((len(j), n + 1), dtype=np.int64)
    out[:, n] = n
    out[:, :n] = np.minimum.accumulate(stops[:, ::-1], axis=1)[:, ::-1]
    return out
