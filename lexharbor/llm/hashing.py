"""Vectorised fingerprints of words and word shingles for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
#: A random value for each byte, and the odd base of the polynomial.
BYTES = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
_STEPS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are hashed at a time.
PIECE = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i below n or more."""
    size = max(PIECE, 1 << (n - 1).bit_length()) + 1
    if size not in _POWERS:
        out = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        if size > PIECE + 1:
            return out[0], out[1]
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def prefix_hash(a: np.ndarray) -> np.ndarray:
    """Prefix sums of ``BYTES[a[i]] * BASE**i``; the hash of a[i:j] is ``(c[j] - c[i]) * BASE**-i``."""
    c = np.empty(len(a) + 1, dtype=np.uint64)
    c[0] = 0
    np.cumsum(BYTES[a] * powers(len(a))[0][: len(a)], out=c[1:])
    return c


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a text, in pieces that end at white space."""
    a = np.frombuffer(text, dtype=np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(a):
        size = PIECE
        while True:
            piece = a[at : at + size]
            space = _SPACE[piece]
            if at + size >= len(a):
                break
            cut = np.flatnonzero(space)
            if len(cut):
                piece, space = piece[: cut[-1] + 1], space[: cut[-1] + 1]
                break
            size *= 2
        edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        lo, hi = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        c = prefix_hash(piece)
        hashes.append(mix((c[hi] - c[lo]) * powers(len(piece))[1][lo]))
        starts.append(lo + at)
        at += len(piece)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def blocks(texts: list[bytes], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``limit`` bytes together, or of one longer text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if texts:
        yield lo, len(texts)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and fingerprints of the distinct k-word shingles, sorted within each text.

    A-Z count as a-z. A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    values, counts = [], []
    for lo, hi in blocks(texts):
        joined = b"\n".join(texts[lo:hi]).lower()
        h, start = _words(joined)
        n = hi - lo
        at = np.zeros(n, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts[lo : hi - 1]], out=at[1:])
        doc = np.searchsorted(at, start, "right") - 1
        words = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(words)))[:n]
        parts, owners = [], []
        m = len(h) - k + 1
        if m > 0:
            s = np.zeros(m, dtype=np.uint64)
            for j in range(k):
                s += h[j : j + m] * _STEPS[j]
            whole = doc[:m] == doc[k - 1 :]
            parts.append(mix(s[whole]))
            owners.append(doc[:m][whole])
        for c in range(1, k):
            short = np.flatnonzero(words == c)
            if len(short):
                s = np.full(len(short), c, dtype=np.uint64) * _STEPS[-1]
                for j in range(c):
                    s += h[first[short] + j] * _STEPS[j]
                parts.append(mix(s))
                owners.append(short)
        if parts:
            s, d = np.concatenate(parts), np.concatenate(owners)
            order = np.lexsort((s, d))
            s, d = s[order], d[order]
            new = np.ones(len(s), dtype=bool)
            new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            values.append(s[new])
            counts.append(np.bincount(d[new], minlength=n))
        else:
            counts.append(np.zeros(n, dtype=np.int64))
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, dtype=np.int64)
    return offsets.astype(np.int64), np.concatenate(values) if values else np.empty(0, np.uint64)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
