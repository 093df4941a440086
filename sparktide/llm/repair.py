"""Re-Pair grammars over token ids: frequent pairs become nonterminals; rules with their expansion lengths allow decoding from any place.

One grammar covers one segment of a shard. Each round counts all pairs of neighbouring symbols, ranks those whose count
comes near the most frequent one's, and replaces every occurrence that no better pair overlaps; rounds go on until no
pair is frequent enough to be worth a rule. A rule's symbols are always older than the rule.
"""

from __future__ import annotations

import struct

import numpy as np

#: Tokens of a segment at most, and the occurrences a pair needs to become a rule (a rule takes 12 bytes, an occurrence saves two or more).
SEGMENT_TOKENS, LEAST_USES = 1 << 20, 16
_MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIII")
_SLOT_BITS = 18
#: A round takes pairs down to this part of the most frequent one's count; grammars end after three rounds that replace less than this share, or when the rounds do.
STEP, LEAST_GAIN = 64, 0.01
_FACTORS = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1) for k in range(24)]


def _selected(rank: np.ndarray) -> np.ndarray:
    """Where pairs are replaced: at positions of a rank (0: none) that no overlapping position beats; in a run of one pair (``aaaa``) at every second one."""
    n = len(rank)
    wanted = rank > 0
    same = np.flatnonzero((rank[1:] == rank[:-1]) & wanted[1:])
    wanted[1:] &= rank[1:] > rank[:-1]
    wanted[:-1] &= rank[:-1] >= rank[1:]
    if len(same):  # only runs are looked at one position after the other
        begins = same[np.concatenate(([True], same[1:] != same[:-1] + 1))]
        ends = same[np.concatenate((same[1:] != same[:-1] + 1, [True]))] + 1
        late = (begins > 0) & (rank[begins - 1] > rank[begins])  # what stands before the run is better and takes its first symbol
        sizes = ends - begins + 1
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(begins, sizes) + place
        place -= np.repeat(late, sizes)
        beaten = np.concatenate((rank[1:], [0]))[at] > rank[at]
        wanted[at] = (place >= 0) & (place % 2 == 0) & ~beaten
    return np.flatnonzero(wanted)


def compress(ids: np.ndarray, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``(symbols, left, right, base)``: symbol ``base + k`` stands for rule ``k``, which is ``left[k] right[k]``; smaller ones are ids.

    Pairs are counted by slots of a hash; a slot speaks for one of its pairs, whose uses are counted exactly before it
    becomes a rule. Each round has another hash, so that pairs which shared a slot are told apart in a later one.
    """
    s = ids.astype(np.uint32)
    base = int(s.max()) + 1 if len(s) else 0
    left, right = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    top, wasted = base, 0
    speaks = np.zeros(1 << _SLOT_BITS, np.uint64)
    rank_of = np.zeros(1 << _SLOT_BITS, np.int32)
    for factor in _FACTORS:
        if len(s) < 2:
            break
        key = s[:-1].astype(np.uint64) << np.uint64(32) | s[1:]
        slot = (key * factor >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        count = np.bincount(slot, minlength=1 << _SLOT_BITS)
        most = int(count.max())
        if most < least:
            break
        frequent = np.flatnonzero(count >= max(least, most // STEP))
        frequent = frequent[np.argsort(count[frequent], kind="stable")]  # the best last
        rank_of[:] = 0
        rank_of[frequent] = np.arange(1, len(frequent) + 1)
        rank = rank_of[slot]
        near = np.flatnonzero(rank)
        speaks[slot[near]] = key[near]
        rank[near[speaks[slot[near]] != key[near]]] = 0
        at = _selected(rank)
        uses = np.bincount(rank[at], minlength=len(frequent) + 1)
        good = uses >= least
        at = at[good[rank[at]]]
        wasted = wasted + 1 if len(at) < len(s) * LEAST_GAIN else 0
        if not len(at):
            if wasted > 2:
                break
            continue
        number = (np.cumsum(good) - 1 + top).astype(np.uint32)
        pairs = speaks[frequent[good[1:]]]
        left.append((pairs >> np.uint64(32)).astype(np.uint32))
        right.append((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        top += int(good.sum())
        s[at] = number[rank[at]]
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        s = s[stay]
        if wasted > 2:
            break
    return s.astype(np.int64), np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64), base


def rule_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for; rules are in the order of their making, in waves that only use older ones."""
    out = np.zeros(len(left), np.int64)
    size = lambda x: np.where(x < base, 1, out[np.maximum(x - base, 0)]) if len(out) else np.ones(len(x), np.int64)
    done = 0
    while done < len(left):
        ends = np.maximum(left[done:], right[done:]) >= base + done
        stop = done + (int(np.argmax(ends)) if ends.any() else len(ends))
        out[done:stop] = size(left[done:stop]) + size(right[done:stop])
        done = stop
    return out


def pack(ids: np.ndarray, least: int = LEAST_USES) -> bytes:
    """A segment in the file format: header (magic, base, rules, symbols, ids, bits of a symbol, as unsigned 32-bit little-endian numbers), then left, right and expansion length of each rule (the same), then the symbols: their low 16 bits, then one plane of bits for each further bit."""
    s, left, right, base = compress(ids, least)
    bits = max(16, int(base + len(left)).bit_length())
    parts = [_HEAD.pack(_MAGIC, base, len(left), len(s), len(ids), bits)]
    parts += [x.astype("<u4").tobytes() for x in (left, right, rule_lengths(left, right, base))]
    parts.append((s & 0xFFFF).astype("<u2").tobytes())
    parts += [np.packbits((s >> b & 1).astype(np.uint8)).tobytes() for b in range(16, bits)]
    return b"".join(parts)


class Segment:
    """A packed segment, opened: decodes any span of its ids from the symbols that cover it."""

    def __init__(self, data: bytes):
        magic, self.base, n_rules, n, self.n_ids, bits = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a segment of this format")
        at = _HEAD.size
        rules = np.frombuffer(data, "<u4", 3 * n_rules, at).reshape(3, n_rules).astype(np.int64)
        self.left, self.right, self.length = rules
        at += 12 * n_rules
        self.symbols = np.frombuffer(data, "<u2", n, at).astype(np.int64)
        at += 2 * n
        for b in range(16, bits):
            self.symbols |= np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(np.int64) << b
            at += -(-n // 8)
        self.ends = np.cumsum(self._sizes(self.symbols))
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def _sizes(self, s: np.ndarray) -> np.ndarray:
        return np.where(s < self.base, 1, self.length[np.maximum(s - self.base, 0)]) if len(self.length) else np.ones(len(s), np.int64)

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids ``begin:end`` as unsigned 32-bit numbers; only symbols that reach into the span are expanded."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = np.searchsorted(self.ends, begin, "right"), np.searchsorted(self.ends, end - 1, "right") + 1
        skipped = begin - (int(self.ends[first - 1]) if first else 0)
        s = self.symbols[first:last]
        if len(s) > len(self.left):  # a long span: every rule is expanded once, and symbols are replaced by what they stand for
            begins, flat = self._expanded()
            sizes = np.diff(self.ends[first:last], prepend=self.ends[first - 1] if first else 0)
            move = np.where(s < self.base, s, begins[np.maximum(s - self.base, 0)] + self.base if len(begins) else 0) - (np.cumsum(sizes) - sizes)
            at = np.repeat(move, sizes) + np.arange(int(sizes.sum()))
            s = np.where(at < self.base, at, flat[np.maximum(at - self.base, 0)] if len(flat) else 0)
        else:
            s = self._expand(s)
        return s[skipped : skipped + end - begin].astype(np.uint32)

    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each rule's ids begin, and the ids of all rules one after the other."""
        if self._table is None:
            self._table = np.cumsum(self.length) - self.length, self._expand(np.arange(self.base, self.base + len(self.left)))
        return self._table

    def _expand(self, s: np.ndarray) -> np.ndarray:
        while len(s) and (is_rule := s >= self.base).any():
            at = np.arange(len(s)) + np.cumsum(is_rule) - is_rule
            out = np.empty(len(s) + int(is_rule.sum()), np.int64)
            out[at] = s
            rules = s[is_rule] - self.base
            out[at[is_rule]], out[at[is_rule] + 1] = self.left[rules], self.right[rules]
            s = out
        return s
