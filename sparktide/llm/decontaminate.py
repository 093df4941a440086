"""Benchmark decontamination: CGK random walks map the edit distance of word sequences to Hamming distance, repeated sampling of coordinates proposes windows near an item, exact edit distances verify them.

A walk reads a word at each step and moves on or stays by a random bit of the word and the step; the words that it reads are
the embedding. Walks from all positions of a text run together: two that meet stay together, so that few are left soon.
The sampled coordinates of every window of an item's size are looked up in the tables of the items' own walks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, sliced, stored
from .words import Words, blocks, mix

#: Word edits allowed, as a share of an item's words, and words that within them stay whole somewhere at least.
EDIT_SHARE, WHOLE_WORDS = 0.2, 3
#: Random walks, repetitions of sampling on each, and coordinates of a repetition.
WALKS, REPEATS, SAMPLED = 3, 6, 3
#: Words of a window at most, and the ratio of neighbouring sizes. An item is looked for by windows of the greatest size that it has room for: at its beginning, one after the other, and at its end.
WINDOW_MOST, SIZE_RATIO = 24, 1.5
#: Items of one pass over the documents; their index (about 4 kB an item) goes to every task. More items take more passes.
ITEMS_A_PASS = 5000
#: Words of a block that are walked at a time, candidates that are expanded at a time, and words of these that are compared at a time.
WALKED_WORDS, CANDIDATES, COMPARED_WORDS = 1 << 18, 1 << 16, 1 << 20

#: Blank words between texts and between items.
_GAP = 16
_ODD = np.uint32(0x9E3779B1)
_PAIRS = 1 << 22


def allowed_edits(m: int, share: float = EDIT_SHARE) -> int:
    """Edits allowed for an item of ``m`` words: so few that a run of WHOLE_WORDS must survive; -1 for items too short to tell."""
    e = int(share * m)
    while e >= 0 and -(-(m - e) // (e + 1)) < WHOLE_WORDS:
        e -= 1
    return e


@lru_cache(maxsize=1)
def window_sizes() -> tuple[int, ...]:
    """Sizes of windows, from WHOLE_WORDS to WINDOW_MOST; an item takes the greatest that isn't over its own size."""
    sizes = [WHOLE_WORDS]
    while sizes[-1] < WINDOW_MOST:
        sizes.append(min(WINDOW_MOST, max(sizes[-1] + 1, int(sizes[-1] * SIZE_RATIO))))
    return tuple(sizes)


@lru_cache(maxsize=1)
def sampled_steps() -> dict[tuple[int, int, int], tuple[int, ...]]:
    """The sampled coordinates of each (size, walk, repetition): one from each third of the steps in which a walk crosses most of a window, even ones where there are any, so that fewer are read."""
    rng = np.random.default_rng(20240607)
    out = {}
    for size in window_sizes():
        cuts = [round(1.5 * size * k / SAMPLED) for k in range(SAMPLED + 1)]
        for walk in range(WALKS):
            for r in range(REPEATS):
                out[size, walk, r] = tuple(int(rng.choice([j for j in range(a, b) if j % 2 == 0] or [a])) for a, b in zip(cuts, cuts[1:]))
    return out


def embeddings(symbols: np.ndarray, moves: np.ndarray, steps: set[int]) -> dict[int, np.ndarray]:
    """What the walk from each position of ``symbols`` reads at each of ``steps``; ``moves[step]`` tells for each symbol whether it moves on."""
    most = max(steps) + 1
    heads, group, out = np.arange(len(symbols), dtype=np.int32), None, {}
    symbols = np.concatenate((symbols, np.zeros(most, symbols.dtype)))
    for j in range(most):
        read = symbols.take(heads)
        if j in steps:
            out[j] = read if group is None else read.take(group)
        heads += moves[j].take(read)
        if j % 3 == 2:
            new = np.append(True, heads[1:] != heads[:-1])
            heads, number = heads[new], np.cumsum(new, dtype=np.int32) - 1
            group = number if group is None else number.take(group)
    return out


def infix_distance(masks: dict[int, int], m: int, words: list[int]) -> int:
    """Least edit distance between a pattern of ``m`` words, given as bit masks, and any run of ``words``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for word in words:
        equal = masks.get(word, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus, minus = down | (full & ~(across | up)), up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            best = min(best, score)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
    return best


class Items:
    """The index of some benchmark items: their words, the tables of their sampled walks, and masks for verification."""

    def __init__(self, ids: list, texts: list[str | None], share: float = EDIT_SHARE):
        w = Words(texts)
        self.ids, words, edits = [], [], []
        for i, item in enumerate(ids):
            h = w.hash[w.first[i] : w.first[i + 1]]
            if (e := allowed_edits(len(h), share)) >= 0:
                self.ids.append(item)
                words.append(h)
                edits.append(e)
        self.moved: dict[int, np.ndarray] = {}
        self.size, self.edit = np.array([len(h) for h in words], np.int64), np.array(edits, np.int64)
        if not len(self.size):
            return
        self.vocabulary = np.unique(np.concatenate(words))
        own = [np.searchsorted(self.vocabulary, h).astype(np.uint32) + 1 for h in words]
        begin = np.concatenate(([0], np.cumsum(self.size + WINDOW_MOST)))
        symbols = np.zeros(begin[-1], np.uint32)
        for a, x in zip(begin.tolist(), own):
            symbols[a : a + len(x)] = x
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for i, m in enumerate(self.size.tolist()):
            size = max(x for x in window_sizes() if x <= m)
            for at in {*range(0, m - size + 1, size), m - size}:
                pieces.setdefault(size, []).append((begin[i] + at, i, at))
        self.tables: dict[tuple[int, int, int], tuple[np.ndarray, ...]] = {}
        for walk in range(WALKS):
            read = embeddings(symbols, self._moves(walk), self._steps(walk, pieces))
            for size, held in pieces.items():
                start, item, at = np.array(held, np.int64).T
                for r in range(REPEATS):
                    key = self._keys(read, size, walk, r)[start]
                    order = np.argsort(key, kind="stable")
                    maybe = np.zeros(1 << 16, bool)
                    maybe[key >> np.uint32(16)] = True
                    self.tables[size, walk, r] = maybe, key[order], item[order], at[order]
        self.sizes = sorted(pieces)
        self.held = np.zeros(_PAIRS, bool)  # pairs of item and word
        self.held[self._pair(np.repeat(np.arange(len(own)), self.size), np.concatenate(own))] = True
        self.masks: list[dict[int, int]] = []
        for x in own:
            mask: dict[int, int] = {}
            for k, word in enumerate(x.tolist()):
                mask[word] = mask.get(word, 0) | 1 << k
            self.masks.append(mask)

    def _moves(self, walk: int) -> np.ndarray:
        if walk not in self.moved:
            seeds = np.random.default_rng(77 + walk).integers(0, 1 << 63, int(1.5 * WINDOW_MOST) + 1, dtype=np.uint64)
            known = np.append(np.uint64(0), self.vocabulary)
            self.moved[walk] = np.stack([(mix(known ^ x) >> np.uint64(63)).astype(np.int8) for x in seeds])
        return self.moved[walk]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"moved": {}}  # made again from its seeds where it's needed

    @staticmethod
    def _steps(walk: int, sizes) -> set[int]:
        return {j for (size, w, _), steps in sampled_steps().items() if w == walk and size in sizes for j in steps}

    @staticmethod
    def _keys(read: dict[int, np.ndarray], size: int, walk: int, r: int) -> np.ndarray:
        key = np.uint32(size)
        for j in sampled_steps()[size, walk, r]:
            key = (key ^ read[j]) * _ODD
            key ^= key >> np.uint32(15)
        return key * _ODD

    @staticmethod
    def _pair(item: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (mix(item.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)) & np.uint64(_PAIRS - 1)).astype(np.int64)

    def _proposed(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Positions that meet an entry of a table, each with the range of entries and the number of the table."""
        hits, tables = [], []
        for walk in range(WALKS):
            read = embeddings(symbols, self._moves(walk), self._steps(walk, self.sizes))
            for size in self.sizes:
                for r in range(REPEATS):
                    maybe, keys, item, at = self.tables[size, walk, r]
                    key = self._keys(read, size, walk, r)
                    where = np.flatnonzero(maybe[key >> np.uint32(16)])
                    low, high = (np.searchsorted(keys, key[where], side) for side in ("left", "right"))
                    met = high > low
                    if met.any():
                        hits.append((where[met], np.full(met.sum(), len(tables)), low[met], high[met] - low[met]))
                        tables.append((item, at))
        if not hits:
            return *(np.zeros(0, np.int64),) * 3, []
        where, table, low, many = (np.concatenate(x) for x in zip(*hits))
        order = np.argsort(where, kind="stable")
        flat, base = [np.concatenate(x) for x in zip(*tables)], np.cumsum([0] + [len(x) for x, _ in tables])
        return where[order], (low + base[table])[order], many[order], flat

    def find(self, w: Words) -> list[tuple[int, int, int]]:
        """``(text, item, edits)`` for the texts of a block: windows near an item, the least edits for each pair."""
        at = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
        word = np.where(self.vocabulary[at] == w.hash, at + 1, 0).astype(np.uint32)
        text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        symbols = np.zeros(len(word) + _GAP * len(w.first) + WINDOW_MOST, np.uint32)
        symbols[np.arange(len(word)) + _GAP * text] = word
        best: dict[tuple[int, int], int] = {}
        gaps = w.first[1:] + _GAP * np.arange(len(w.first) - 1)  # where the gap after each text begins
        for c in range(0, len(symbols), WALKED_WORDS):
            where, low, many, flat = self._proposed(symbols[c : c + WALKED_WORDS + 2 * WINDOW_MOST])
            upto, begin = np.cumsum(many), 0
            while begin < len(where):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + CANDIDATES, "right")))
                n = many[begin:end]
                entry = np.repeat(low[begin:end] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                position, item = np.repeat(c + where[begin:end], n), flat[0][entry]
                t = np.minimum(np.searchsorted(gaps, position, "right"), len(gaps) - 1)
                start = position - _GAP * t - flat[1][entry]
                _, first = np.unique(item * np.int64(2 * len(symbols)) + start + len(symbols), return_index=True)
                self._verify(w, word, item[first], start[first], t[first], best)
                begin = end
        return [(t, i, d) for (t, i), d in best.items()]

    def _verify(self, w: Words, word: np.ndarray, item: np.ndarray, start: np.ndarray, text: np.ndarray, best: dict[tuple[int, int], int]) -> None:
        """Edit distances around candidates, those of one item and text that overlap as one region. A region with too few of the item's words is passed over."""
        m, e = self.size[item], self.edit[item]
        a, b = np.maximum(w.first[text], start - e), np.minimum(w.first[text + 1], start + m + e)
        fits = b - a >= m - e
        item, text, a, b = item[fits], text[fits], a[fits], b[fits]
        keep, ends, k = [], np.cumsum(b - a), 0
        while k < len(item):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + COMPARED_WORDS, "right")))
            n = b[k:stop] - a[k:stop]
            begins = np.concatenate(([0], np.cumsum(n)[:-1]))
            index = np.repeat(a[k:stop] - begins, n) + np.arange(n.sum())
            shared = np.add.reduceat(self.held[self._pair(np.repeat(item[k:stop], n), word[index])] & (word[index] > 0), begins)
            keep.append(k + np.flatnonzero(shared >= self.size[item[k:stop]] - self.edit[item[k:stop]]))
            k = stop
        keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        order = keep[np.lexsort((a[keep], text[keep], item[keep]))]
        run: tuple[int, int, int, int] | None = None
        for i, t, x, y in [*zip(item[order].tolist(), text[order].tolist(), a[order].tolist(), b[order].tolist()), (-1, -1, 0, 0)]:
            if run and (i, t) == run[:2] and x <= run[3]:
                run = i, t, run[2], max(run[3], y)
                continue
            if run and best.get((run[1], run[0]), 1) > 0:
                d = infix_distance(self.masks[run[0]], int(self.size[run[0]]), word[run[2] : run[3]].tolist())
                if d <= self.edit[run[0]] and d < best.get((run[1], run[0]), 1 << 30):
                    best[run[1], run[0]] = d
            run = i, t, x, y


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", share: float = EDIT_SHARE, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """Every row of ``docs`` with ``leaks``: an array of (item_id, edits), items in order, empty if none.

    An item leaks into a text if some run of the text's words lies within ``share`` of the item's words in word edits. Words
    are runs of letters and digits in lower case. Repeated samples of the CGK walks of every window of an item's size propose
    which windows are verified; one near an item is missed if no sample agrees.

    Null and empty texts have no leaks, nor do null or shorter items than three words. Repeated items are reported each,
    repeated rows and ties are treated alike. Very long texts are searched whole, as one block of their own. Empty tables: no
    rows, or no leaks. A column ``leaks`` of ``docs`` is replaced. There is no shuffle, so no key can be hot; texts that meet
    many items are expanded a bounded number of candidates at a time; items beyond ``items_a_pass`` take further passes, each
    with an index of bounded size.
    """
    spark = docs.sparkSession
    items = benchmark.select(column(benchmark, item_id_col).alias("id"), column(benchmark, item_text_col).alias("text")).where(F.col("text").isNotNull())
    id_type = items.schema["id"].dataType
    leak = T.ArrayType(T.StructType([T.StructField("item_id", id_type), T.StructField("edits", T.IntegerType())]))
    out = docs.select(*(column(docs, c) for c in docs.columns if c != "leaks"))
    passes = max(1, -(-items.count() // items_a_pass))
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("text", "id"), F.lit(passes)) == k)
        rows = part.collect()  # about items_a_pass rows
        index = Items([r["id"] for r in rows], [r["text"] for r in rows], share)
        before = out.withColumnRenamed("leaks", "__leaks") if k else out
        schema = T.StructType([*before.schema.fields, T.StructField("leaks", leak)])
        out = before.mapInArrow(_leaks(index, text_col, schema), schema)
        if k:
            out = out.withColumn("leaks", F.concat("__leaks", "leaks")).drop("__leaks")
        if passes > 1:
            out = stored(out, "leaks")
    return out.withColumn("leaks", F.sort_array("leaks"))


def _leaks(index: Items, text_col: str, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type

    leak = to_arrow_type(schema["leaks"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            if len(index.size):
                for begin, w in blocks(batch.column(batch.schema.get_field_index(text_col)).to_pylist()):
                    for t, i, d in index.find(w):
                        found[begin + t].append({"item_id": index.ids[i], "edits": d})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, leak)], names=[*batch.schema.names, "leaks"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` into which no item of ``benchmark`` leaks."""
    return find_leaks(docs, benchmark, **options).where(F.size("leaks") == 0).drop("leaks")
