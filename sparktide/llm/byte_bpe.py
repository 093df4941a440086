"""Byte-level BPE: encoding and decoding with vectorised pre-tokenisation.

Texts become arrays of code points, these become classes, and each class is a transition function of a small automaton. The
functions form a finite monoid, so the state before every code point comes from an associative scan over whole blocks, and
boundaries are a lookup. No regular expression sees the texts. The slices between boundaries are looked up in a bounded
cache of merged pieces; byte offsets of the tokens are kept.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced
from .words import span_hashes

#: Code points of one block, code points that get their classes at a time, and pieces of one of the two generations of a worker's cache.
BLOCK_CHARS = 1 << 18
CLASSED_POINTS = 1 << 14
CACHE_PIECES = 150_000
#: The code points with the property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a contraction.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

#: Classes of code points.
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
#: Symbols of the automaton: letter, number, other, apostrophe before a contraction of one or two letters, blank before
#: something else than white space, another white space there, white space before more of it or the end.
_L, _N, _O, _A1, _A2, _P, _V, _W = range(8)
#: States: nothing open, or a piece of letters, numbers, others, one blank, white space, or a contraction that lacks one or two letters.
_S0, _SL, _SN, _SO, _SP, _SW, _C1, _C2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at this symbol."""
    if symbol == _L:
        if state == _C2:
            return _C1, False
        if state == _C1:
            return _S0, False
        return _SL, state not in (_SL, _SP)
    if symbol == _N:
        return _SN, state not in (_SN, _SP)
    if symbol in (_O, _A1, _A2):
        if state in (_SO, _SP):
            return _SO, False
        return {_O: _SO, _A1: _C1, _A2: _C2}[symbol], True
    if symbol == _P:
        return _SP, True
    if symbol == _V:
        return _S0, True
    return _SW, state != _SW


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The function of each symbol (8 more: the same at the start of a text), compositions, states from nothing open, and begins by state and symbol."""
    functions: list[tuple[int, ...]] = []
    for symbol in range(16):
        functions.append(tuple(_step(s if symbol < 8 else _S0, symbol % 8)[0] for s in range(8)))
    index: dict[tuple[int, ...], int] = {}
    for f in functions:
        index.setdefault(f, len(index))
    of_symbol = np.array([index[f] for f in functions], np.uint8)
    known = list(index)
    grew = True
    while grew:
        grew = False
        for f in list(known):
            for g in functions:
                h = tuple(g[s] for s in f)
                if h not in index:
                    index[h] = len(index)
                    known.append(h)
                    grew = True
    assert len(known) <= 16  # so that two of them fit a byte
    table = np.zeros(256, np.uint8)
    for f in known:
        for g in known:
            table[index[f] << 4 | index[g]] = index[tuple(g[s] for s in f)]
    from_start = np.array([f[_S0] for f in known], np.uint8)
    begins = np.array([x >= 8 or _step(s, x)[1] for s in range(8) for x in range(16)], bool)
    return of_symbol, table, from_start, begins


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, by the Unicode version of the tiktoken library where that is installed."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds = {"L": _LETTER, "N": _NUMBER}
    try:
        import tiktoken

        of = {kind: tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}) for name, kind in kinds.items()}
    except ImportError:
        of = {}
    for begin in range(0, len(out), CLASSED_POINTS):
        every = [c for c in range(begin, min(begin + CLASSED_POINTS, len(out))) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, every))
        for kind, one in of.items():
            out[np.frombuffer(one.decode(one.encode_ordinary(text)).encode("utf-32-le"), np.uint32)] = kind
        if not of:
            out[every] = [kinds.get(unicodedata.category(c)[0], _OTHER) for c in text]
    out[WHITE_SPACE] = _SPACE
    return out


def _scan(f: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Compositions of the functions up to and with each position: an associative scan, in rows first and then over the rows' ends."""
    n = len(f)
    width = max(1, int(n**0.5))
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint8)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for j in range(1, width):
        grid[j] = table.take(grid[j - 1] << 4 | grid[j])
    ends = grid[-1].tolist()
    flat, before = table.tolist(), ends[:1]
    for f in ends[1:]:
        before.append(flat[before[-1] << 4 | f])
    if rows > 1:
        grid[:, 1:] = table.take(np.array(before[:-1], np.uint8) << 4 | grid[:, 1:])
    return grid.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of several texts that stand one after the other; text_starts: where the texts that aren't empty do."""
    of_symbol, table, from_start, begins = _automaton()
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    last = first[1:]
    following = np.full(n, _SPACE, np.uint8)
    following[:-1] = kind[1:]
    space_next = last | (following == _SPACE)
    symbol = np.array([_O, _L, _N, _W], np.uint8)[kind]
    blank = (kind == _SPACE) & ~space_next
    symbol[blank] = np.where(points[blank] == 32, _P, _V)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        padded = np.concatenate((points[:], [0, 0])).astype(np.int64)
        one, two = padded[quotes + 1].copy(), padded[quotes + 2].copy()
        one[last[quotes]] = 0
        after = np.minimum(quotes + 1, n - 1)
        two[last[quotes] | last[after]] = 0
        short = np.isin(one, [ord(c) for c in CONTRACTIONS if len(c) == 1])
        pairs = np.isin(one * 4096 + two, [ord(c[0]) * 4096 + ord(c[1]) for c in CONTRACTIONS if len(c) == 2])
        symbol[quotes[short]] = _A1
        symbol[quotes[pairs]] = _A2
    symbol[text_starts] += 8
    states = from_start[_scan(of_symbol[symbol], table)]
    prior = np.zeros(n, np.uint8)
    prior[1:] = states[:-1]
    return np.flatnonzero(begins.take(prior << 4 | symbol))


class ByteBpe:
    """A vocabulary of ranks with its cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        top = max(self.ranks.values()) + 1
        self.token_bytes: list[bytes] = [b""] * top
        for token, i in self.ranks.items():
            self.token_bytes[i] = token
        self.token_size = np.array([len(t) for t in self.token_bytes], np.int64)
        self._begin()
        self.older, self.older_flat, self.older_at = self.known, self.flat, self.at

    def _begin(self) -> None:
        self.known: dict[bytes, int] = {}
        self.fresh: list[int] = []
        self.fresh_sizes: list[int] = []
        self.flat = np.zeros(0, np.uint16 if len(self.token_bytes) <= 1 << 16 else np.uint32)
        self.at = np.zeros(1, np.int64)

    def _empty(self) -> None:
        """Begin a new generation of the cache; pieces of the last one come over as they are seen again."""
        self.older, self.older_flat, self.older_at = self.known, self.flat, self.at
        self._begin()

    def merge(self, piece: bytes) -> list[int]:
        """Pair merging: the neighbours of least rank first, leftmost on ties."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 200:
            return self._merge_long(piece)
        get, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
        while pairs:
            least = min(pairs)
            if least == 1 << 30:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap, for pieces where a search through all pairs would take too long."""
        import heapq

        n, get = len(piece), self.ranks.get
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, size = heapq.heappop(heap)
            j = right[i]
            if part[i] is None or j >= n or len(part[i]) + len(part[j]) != size or get(part[i] + part[j]) != rank:
                continue
            part[i] += part[j]
            part[j] = None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
                if (r := get(part[i] + part[right[i]])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[right[i]])))
            if left[i] >= 0:
                k = left[i]
                if (r := get(part[k] + part[i])) is not None:
                    heapq.heappush(heap, (r, k, len(part[k]) + len(part[i])))
        return [self.ranks[p] for p in part if p is not None]

    def _number_of(self, piece: bytes) -> int:
        got = self.known.get(piece)
        if got is None:
            before = self.older.get(piece)
            ids = self.merge(piece) if before is None else self.older_flat[self.older_at[before] : self.older_at[before + 1]].tolist()
            got = self.known[piece] = len(self.known)
            self.fresh += ids
            self.fresh_sizes.append(len(ids))
        return got

    def _settle(self) -> None:
        """Append what is new to the arrays of the cache."""
        if self.fresh_sizes:
            self.flat = np.concatenate((self.flat, np.array(self.fresh, self.flat.dtype)))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(self.fresh_sizes)))
            self.fresh, self.fresh_sizes = [], []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where the ids of each text begin (one more: the end)."""
        data = "".join(texts).encode("utf-32-le", "replace" if any(map(_has_surrogate, texts)) else "strict")
        points = np.frombuffer(data, np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text_at = np.concatenate(([0], np.cumsum(sizes)))
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = piece_starts(points, text_at[:-1][sizes > 0])
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        raw = "".join(texts).encode("utf-8", "replace")
        cuts = byte_at[np.append(starts, len(points))]
        octets = np.frombuffer(raw, np.uint8)
        kinds, example, number = np.unique(span_hashes(octets, cuts), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_PIECES:
            self._empty()
        look = self._number_of
        known = np.array([look(raw[a:b]) for a, b in zip(cuts[example].tolist(), cuts[example + 1].tolist())], np.int64)
        odd = np.flatnonzero(_unlike(octets, cuts, example[number]))
        number = known[number]
        for k in odd.tolist():
            number[k] = look(raw[cuts[k] : cuts[k + 1]])
        self._settle()
        begin, size = self.at[number], self.at[number + 1] - self.at[number]
        upto = np.concatenate(([0], np.cumsum(size)))
        index = np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)
        ids = self.flat[index].astype(np.uint32)
        return ids, upto[np.searchsorted(starts, text_at)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


def _unlike(octets: np.ndarray, cuts: np.ndarray, example: np.ndarray) -> np.ndarray:
    """For each piece whether its bytes differ from those of its example, a piece of the same hash."""
    size = np.diff(cuts)
    out = size != size[example]
    at = np.repeat(cuts[example] - cuts[:-1], size)
    at += np.arange(cuts[0], cuts[-1])
    differ = octets != octets.take(at, mode="clip")
    out |= np.logical_or.reduceat(differ, cuts[:-1] - cuts[0])
    return out


def _has_surrogate(text: str) -> bool:
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return True
    return False


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def _text_blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _made(offsets: bool) -> list[str]:
    return ["ids", "n_tokens", *["token_ends"] * offsets]


def _coded_type(kept: DataFrame, offsets: bool) -> T.StructType:
    return T.StructType([*kept.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), *[T.StructField("token_ends", T.BinaryType())] * offsets])


def _encoding(ranks_path: str, text_col: str, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(ranks_path)
        for batch in sliced(batches, text_col):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            ids, counts, ends = [], [], []
            for block in _text_blocks(texts):
                got, at = bpe.encode(block)
                upto = np.concatenate(([0], np.cumsum(bpe.token_size[got]))) if offsets else None
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    ids.append(got[a:b].astype("<u4").tobytes())
                    counts.append(b - a)
                    if offsets:
                        ends.append((upto[a + 1 : b + 1] - upto[a]).astype("<u4").tobytes())
            more = [pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), *[pa.array(ends, pa.binary())] * offsets]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *_made(offsets)])

    return run


def _decoding(ranks_path: str, ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(ranks_path)
        for batch in sliced(batches, ids_col):
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            out = [None if x is None else bpe.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, ranks_path: str, *, text_col: str = "text", offsets: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``ids`` (binary: little-endian unsigned 32-bit token ids), ``n_tokens`` and, if asked, ``token_ends`` (binary: little-endian unsigned 32-bit byte offsets where the tokens end).

    Null and empty texts have no tokens. Rows are independent: copies and ties are no special case, an empty table gives an
    empty one. Columns of ``docs`` of the same names are replaced. A task holds one Arrow batch and one block of about
    BLOCK_CHARS code points.
    """
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in _made(offsets)))
    return kept.mapInArrow(_encoding(ranks_path, text_col, offsets), _coded_type(kept, offsets))


def decode(encoded: DataFrame, ranks_path: str, *, ids_col: str = "ids") -> DataFrame:
    """Every row of ``encoded`` with ``decoded`` (binary): the bytes of its ids. Null ids: null. A column ``decoded`` is replaced."""
    kept = encoded.select(*(F.col(f"`{c}`") for c in encoded.columns if c != "decoded"))
    return kept.mapInArrow(_decoding(ranks_path, ids_col), T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))


def encode_and_decode(docs: DataFrame, ranks_path: str, *, text_col: str = "text", offsets: bool = True) -> DataFrame:
    """Every row of ``docs`` without its text, with what ``encode`` and then ``decode`` of its ids add.

    Both run in one Python worker. As two steps they take two workers for each task, and an executor keeps all of them, with
    their vocabularies and caches, for its later stages.
    """
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (*_made(offsets), "decoded")))
    names = [*(c for c in kept.columns if c != text_col), *_made(offsets)]
    coded, decoded = _encoding(ranks_path, text_col, offsets), _decoding(ranks_path, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoded(batch.select(names) for batch in coded(batches))

    fields = [f for f in _coded_type(kept, offsets).fields if f.name != text_col]
    return kept.mapInArrow(run, T.StructType([*fields, T.StructField("decoded", T.BinaryType())]))
