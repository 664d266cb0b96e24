"""Words of texts as arrays of 64-bit fingerprints, without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Fingerprints are polynomials over bytes (of words) or words
(of windows) modulo 2^64 with random byte values, mixed at the end; they do not depend on process or machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]
_OTHER = np.random.Generator(np.random.PCG64(20250607)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: Of the first fingerprints, and of others that are independent of them.
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95, "byte2": 0xA0761D6478BD642F, "word2": 0xE7037ED1A0B428DB}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}
PART_BYTES = 1 << 18


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2^64."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        both = []
        for base in (_BASES[kind], pow(_BASES[kind], -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[kind] = have = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xCF1BBCDCB7A56463)
    h ^= h >> U(32)
    return h


def _part(texts: list[bytes], values: np.ndarray, base: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    pow_, inv = powers(base, len(buf))
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values[buf] * pow_, out=total[1:])
    h = mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
    first = np.concatenate(([0], np.cumsum(sizes)))
    return h, np.searchsorted(starts, first), starts, ends


def word_prints(texts: list[bytes], lower: bool = False, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of the texts in order, and for each text the index of its first word (one entry more at the end).

    lower: A-Z count as a-z. other: the independent fingerprints. Empty texts have no words.
    """
    values, base = (_OTHER, "byte2") if other else (_LOWER if lower else _VALUE, "byte")
    prints, bounds, done, at = [], [np.zeros(1, np.int64)], 0, 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < PART_BYTES):
            size += len(texts[to])
            to += 1
        h, first, _, _ = _part(texts[at:to], values, base)
        prints.append(h)
        bounds.append(first[1:] + done)
        done, at = done + len(h), to
    return np.concatenate(prints) if prints else np.zeros(0, np.uint64), np.concatenate(bounds)


def windows(prints: np.ndarray, bounds: np.ndarray, k: int, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of the k words that start at each position, and whether they lie within one text."""
    n = len(prints)
    fits = np.zeros(n, bool)
    if n < k:
        return np.zeros(n, np.uint64), fits
    pow_, inv = powers("word2" if other else "word", n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(prints * pow_, out=total[1:])
    out = np.zeros(n, np.uint64)
    out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * inv[: n - k + 1])
    fits[: n - k + 1] = True
    for j in range(1, k):  # the last k-1 starts of each text don't fit
        at = bounds[1:] - j
        fits[at[at >= bounds[:-1]]] = False
    return out, fits


def parts_of(texts: list[bytes], most: int) -> Iterator[slice]:
    """Slices of the texts of about `most` bytes; a longer text is a slice of its own."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < most):
            size += len(texts[to])
            to += 1
        yield slice(at, to)
        at = to


def utf8(texts) -> list[bytes]:
    """Texts as UTF-8; None is the empty text."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
