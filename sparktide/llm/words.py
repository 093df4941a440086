"""Hashes of words and word shingles for whole blocks of texts, with numpy only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: UTF-8 bytes of one block; the arrays of a block take about 30 times as much.
BLOCK_BYTES = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_M = np.uint64(0xBF58476D1CE4E5B9)
#: Two polynomials modulo the prime 2^31 - 1; powers of two as modulus would hash Thue-Morse words alike for every base.
_PRIME = np.uint64((1 << 31) - 1)
_BASES = (1_150_943_041, 736_338_717)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = []  # for each base its powers, then those of its inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * _M
    x = (x ^ (x >> np.uint64(27))) * _P
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits modulo the prime."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    x = (x & _PRIME) + (x >> np.uint64(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size, tables = max(n, BLOCK_BYTES + BLOCK_BYTES // 2), []
        for base in (x for b in _BASES for x in (b, pow(b, -1, int(_PRIME)))):
            table, step = np.ones(1, np.uint64), base
            while len(table) < size:
                table = np.concatenate((table, _reduced(table * np.uint64(step))))
                step = step * step % int(_PRIME)
            tables.append(table[:size].astype(np.uint32))
        _powers[:] = tables
    return _powers


def _hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62 bits, spread over 64, for the bytes of each span ``begin:end``, wherever it stands."""
    up_a, down_a, up_b, down_b = _power_tables(len(data) + 1)
    out = np.zeros(len(begin), np.uint64)
    raw = data.astype(np.uint64) + np.uint64(1)
    for up, down in ((up_a, down_a), (up_b, down_b)):
        sums = np.zeros(len(data) + 1, np.uint64)
        terms = raw * up[: len(data)]  # under 2^40, so that the sums of 2^24 of them fit
        np.cumsum(terms if len(data) < 1 << 24 else _reduced(terms), out=sums[1:])
        out = out << np.uint64(31) | _reduced(_reduced(sums[end] - sums[begin]) * down[begin])
    return mix(out)


def span_hashes(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The hash of the bytes between each two neighbouring cuts."""
    return _hashed(data, cuts[:-1], cuts[1:])


class Words:
    """The words of a block: ``hash`` per word, ``first[i]:first[i + 1]`` the words of text ``i``."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        joined = b"\n" + b"\n".join(raw) + b"\n"
        self.data = np.frombuffer(joined, np.uint8)
        inside = _WORD[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        self.hash = _hashed(self.data, self.start, self.end)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        self.text_at = 1 + np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.text_at)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, Words]]:
    """Blocks of whole texts of about BLOCK_BYTES each, with the index of the first text of each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK_BYTES:
            yield begin, Words(texts[begin : i + 1])
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, Words(texts[begin:])


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` neighbouring words (across texts too: mask those)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = out * _Q + h[j : len(h) - n + 1 + j]
    return mix(out)


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word shingles; a shorter text has one shingle of all its words, one without words none."""
    every = runs(w.hash, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        elif b > a:
            out.append(runs(w.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
