"""Collocations by streams of counts: each order's phrases counted once, merged in prefix order for left and right-extension counts and in suffix order for right and left-extension counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, stored
from .units import as_bytes, coded, groups, spans, text_bytes
from .words import mix

#: Words of a phrase at most, its least occurrences, phrases of a language in the report; an extension with at least 80 of 100 occurrences absorbs its phrase.
MAX_WORDS, LEAST_COUNT, LIMIT, ABSORBS = 4, 30, 2000, (80, 100)
SCALE = 2_000_000
#: Bits of the filter that keeps phrases of rare parts from being counted: 16 for each frequent part, at most so many (16 MB).
MOST_BITS = 1 << 27
_BITMAP = 1 << 15
_BLANKS, _STOPS = b" \t", b".,;:!?\n\v\f\r"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KINDS = bytes(0 if c in _BLANKS else 2 if c in _STOPS else 1 for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


class _Group:
    """The words of a group of texts: exact codes, languages, and which words follow one another within a piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        data, offsets = text_bytes(texts)
        raw = data.tobytes().translate(_FOLD)
        kinds = np.frombuffer(raw.translate(_KINDS), np.uint8)
        begin, end = spans(kinds == 1, None, offsets)
        codes, self.words = coded(raw.translate(None, _BLANKS + _STOPS), end - begin)
        self.codes = codes.astype(np.int64)
        sizes = np.diff(np.searchsorted(begin, offsets))
        text_of, stops = np.repeat(np.arange(len(texts)), sizes), np.cumsum(kinds == 2, dtype=np.int32)
        self.follows = (text_of[1:] == text_of[:-1]) & (stops[begin[1:]] == stops[begin[:-1]])
        named = langs.dictionary_encode()
        self.langs, self.lang = named.dictionary, named.indices.to_numpy()[text_of].astype(np.int64)

    def hashes(self, order: int) -> np.ndarray:
        """A hash of language and ``order`` words for each word that they begin at; across pieces too: see ``whole``."""
        crc = lambda a: np.fromiter(map(zlib.crc32, as_bytes(a.cast(pa.binary()))), np.uint64, len(a))
        n = max(0, len(self.codes) - order + 1)
        word = crc(self.words)[self.codes]
        h = crc(self.langs)[self.lang[:n]]
        for j in range(order):
            h = mix(h * _P + word[j : j + n])
        return h

    def whole(self, order: int) -> np.ndarray:
        """Whether ``order`` words that begin at a word lie in one piece."""
        n = max(0, len(self.codes) - order + 1)
        out = np.ones(n, bool)
        for j in range(order - 1):
            out &= self.follows[j : j + n]
        return out

    def counted(self, at: np.ndarray, order: int) -> pa.RecordBatch:
        """``(lang, phrase, n)`` of the phrases of ``order`` words that begin at ``at``, told apart by codes."""
        key = self.lang[at] * len(self.words) + self.codes[at]
        for j in range(1, order):
            key = np.unique(key, return_inverse=True)[1] * len(self.words) + self.codes[at + j]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        some = at[first]
        words = [self.words.take(pa.array(self.codes[some + j])) for j in range(order)]
        phrase = (pc.binary_join_element_wise(*words, b" ") if order > 1 else words[0]).cast(pa.string())
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[some])), phrase, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in groups(batches, "text"):
        group = _Group(batch.column("lang"), batch.column("text"))
        yield group.counted(np.arange(len(group.codes)), 1)
        total = np.bincount(group.lang, minlength=len(group.langs))
        yield pa.RecordBatch.from_arrays([group.langs, pa.nulls(len(total), pa.string()), pa.array(total, pa.int64())], names=["lang", "phrase", "n"])


def _longer(order: int, bits):
    """Phrases of ``order`` words both of whose parts one word shorter may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in groups(batches, "text"):
            group = _Group(batch.column("lang"), batch.column("text"))
            bit = group.hashes(order - 1) % np.uint64(8 * len(table))
            frequent = (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & group.whole(order - 1)
            both = frequent[:-1] & frequent[1:] & group.follows[: max(0, len(frequent) - 1)]
            yield group.counted(np.flatnonzero(both), order)

    return run


def _bits_of(order: int, n_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "phrase"):
            group = _Group(batch.column("lang"), batch.column("phrase"))
            yield pa.RecordBatch.from_arrays([pa.array(group.hashes(order)[group.whole(order)] % np.uint64(n_bits), pa.int64())], names=["bit"])

    return run


def _filter_of(counts: DataFrame, order: int):
    """A broadcast bitmap of the hashes of all phrases in ``counts``: bounded in size, whatever their number; more phrases only let more candidates through."""
    n_bits, wanted = _BITMAP, 16 * counts.count()
    while n_bits < min(MOST_BITS, wanted):
        n_bits *= 2
    bits = counts.select("lang", "phrase").mapInArrow(_bits_of(order, n_bits), "bit long")
    parts = bits.groupBy((F.col("bit") / _BITMAP).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % _BITMAP).alias("bits"))
    table = np.zeros(n_bits // 8, np.uint8)
    for row in parts.collect():  # at most MOST_BITS / _BITMAP rows
        table[row["part"] * _BITMAP // 8 :][: _BITMAP // 8] = np.frombuffer(row["bits"], np.uint8)
    return counts.sparkSession.sparkContext.broadcast(table)


def phrase_counts(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, n)`` of all phrases of up to ``max_words`` words with at least ``least`` occurrences, overlaps included, and ``(lang, n)``: all word occurrences.

    Texts are lower-cased in A-Z only and cut at ``.,;:!?`` and line ends into pieces, and those at blanks and tabs into words.
    A phrase is as rare as its rarest part, so each order is counted, in a pass of its own, where both parts of one word less
    may be frequent: a bitmap of bounded size tells, whose false hits cost counting but change no count. Tasks count their
    groups of texts by exact codes before anything is shuffled.
    """
    texts = docs.select(F.coalesce(column(docs, lang_col), F.lit("und")).alias("lang"), F.coalesce(column(docs, text_col), F.lit("")).alias("text"))
    summed = lambda rows: rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    schema = "lang string, phrase string, n long"
    words = stored(summed(texts.mapInArrow(_words, schema)).where((F.col("n") >= least) | F.col("phrase").isNull()), "counts-1")
    totals, of_order = words.where("phrase is null").select("lang", "n"), words.where("phrase is not null")
    every = of_order
    for order in range(2, max_words + 1):
        bits = _filter_of(of_order, order - 1)
        of_order = stored(summed(texts.mapInArrow(_longer(order, bits), schema)).where(F.col("n") >= least), f"counts-{order}")
        bits.destroy()
        every = every.unionByName(of_order)
    return every, totals


class _Open:
    """A phrase of the stream whose longer phrases may still follow."""

    __slots__ = ("ext", "lang", "parts", "row", "size")

    def __init__(self, lang, size, row, parts):
        self.lang, self.size, self.row, self.parts, self.ext = lang, size, row, parts, 0


def _merged(rows: Iterator[tuple]) -> Iterator[_Open]:
    """The streams of all orders merged in lockstep: rows ``(lang, size, n, ...)`` in order of their words, each after the phrases that it begins with.

    Yields every row once with the counts of those phrases, shortest first, and the greatest count of the phrases that are one
    word longer. All beginnings of a frequent phrase are frequent, so those still open are exactly its beginnings, and
    nothing is looked up.
    """
    held: list[_Open] = []
    for row in rows:
        lang, size, n = row[:3]
        while held and (held[-1].size >= size or held[-1].lang != lang):
            yield held.pop()
        if len(held) != size - 1:
            raise ValueError("a phrase is counted without its beginning")
        if held:
            held[-1].ext = max(held[-1].ext, n)
        held.append(_Open(lang, size, row, [h.row[2] for h in held]))
    yield from reversed(held)


def _streamed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


_CHUNK = 1 << 12


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for x in _merged(_streamed(batches, ["lang", "size", "n", "phrase"])):
        out.append((*x.row, x.parts, x.ext))
        if len(out) == _CHUNK:
            yield _prefix_batch(out)
            out = []
    if out:
        yield _prefix_batch(out)


def _prefix_batch(rows: list[tuple]) -> pa.RecordBatch:
    lang, size, n, phrase, left, ext = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(n, pa.int64()), pa.array(phrase, pa.string()), pa.array(left, pa.list_(pa.int64())), pa.array(ext, pa.int64())], names=["lang", "size", "n", "phrase", "left", "ext"])


def _suffixes(limit: int):
    """Scores of the candidates that no extension absorbs, and of those the first ``limit`` of each language in this task."""

    def first(found: list[tuple]) -> list[tuple]:
        return sorted(found)[:limit]

    def batch(lang: str, found: list[tuple]) -> pa.RecordBatch:
        score, a, phrase, left, right = zip(*first(found))
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array([p.decode() for p in phrase], pa.string()), long([-x for x in a]), long(left), long(right), long([-x for x in score])], names=["lang", "phrase", "a", "l", "r", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, found = None, []
        for x in _merged(_streamed(batches, ["lang", "size", "n", "phrase", "left", "ext"])):
            _, size, a, phrase, left, ext = x.row
            if size == 1 or ABSORBS[1] * max(ext, x.ext) >= ABSORBS[0] * a:
                continue
            if found and x.lang != lang:
                yield batch(lang, found)
                found = []
            lang = x.lang
            # the cut after k words parts the phrase into a beginning of k words and an end of size - k
            score, k = min((SCALE * a // (left[k - 1] + x.parts[size - k - 1]), k) for k in range(1, size))
            found.append((-score, -a, phrase.encode(), left[k - 1], x.parts[size - k - 1]))
            if len(found) > 4 * limit + 1000:
                found = first(found)
        if found:
            yield batch(lang, found)

    return run


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS, least: int = LEAST_COUNT, limit: int = LIMIT) -> DataFrame:
    """The first ``limit`` phrases of each language by score: ``(lang, rank, phrase, a, l, r, n, score)``.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut (ties to the first cut), ``n`` all words
    of the language; the score is floor(2000000 a / (l + r)). A phrase goes if a phrase of one word more has at least 80 of 100 of its
    occurrences: one that is longer still is never more frequent. Ties: greater ``a``, then the phrase in byte order. The
    counts are dealt by ranges of the first word and sorted in prefix order, merged, then dealt by ranges of the last word and
    sorted in suffix order, and merged again; each merge holds one open phrase for each order. Arithmetic is exact.

    Null texts are empty; a null language is ``und``. Repeated rows count as often as they stand there. Very long texts are
    read whole. Empty table: no rows. Other columns play no part, whatever their names.
    """
    counts, totals = phrase_counts(docs, lang_col=lang_col, text_col=text_col, max_words=max_words, least=least)
    words = F.split("phrase", " ")
    stream = counts.select("lang", F.size(words).alias("size"), "n", "phrase", words.alias("words"))
    forward = stream.repartitionByRange("lang", F.col("words")[0]).sortWithinPartitions("lang", "words")
    forward = forward.select("lang", "size", "n", "phrase").mapInArrow(_prefixes, "lang string, size int, n long, phrase string, left array<long>, ext long")
    forward = stored(forward, "prefix-order").withColumn("words", F.reverse(words))
    backward = forward.repartitionByRange("lang", F.col("words")[0]).sortWithinPartitions("lang", "words").drop("words")
    scored = backward.mapInArrow(_suffixes(limit), "lang string, phrase string, a long, l long, r long, score long")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(64))], ["lang"]):  # a language of most rows is cut down in 64 tasks before one ranks the rest
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)
    return scored.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
