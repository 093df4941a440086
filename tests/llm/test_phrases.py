"""Collocations against brute force over all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparktide.llm import phrases


def expected(rows, least, limit, max_words=4):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and b >= least and 100 * b >= 80 * a and inside(q) for q, b in f.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:limit], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def texts(seed, n, vocabulary):
    rng = random.Random(seed)
    fixed = ["new york city", "in the end of", "a b c d e f", "x x x x x x", "Größe ändern", "\x01 odd \x7f"]
    stops = [".", ",", "\n", " \t ", "  ", "?!", " "]
    return ["".join(rng.choice([rng.choice(vocabulary), rng.choice(fixed)]) + rng.choice(stops) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("least,limit,max_words", [(3, 1000, 4), (5, 20, 4), (2, 50, 3), (4, 10_000, 5)])
def test_collocations_are_those_of_brute_force(spark, least, limit, max_words):
    rng = random.Random(least)
    rows = [(rng.choice(["en", "en", "en", "de", None, ""]), t) for t in texts(least, 120, ["the", "The", "of", "cat", "Àé", "日本", "dog's"])]
    rows += [("en", None), (None, ""), ("en", rows[0][1]), ("en", rows[0][1]), ("de", "the cat " * 2000), ("fr", "one word")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, n long").repartition(4)
    assert got(phrases.collocations(docs, least=least, limit=limit, max_words=max_words)) == expected(rows, least, limit, max_words)


def test_a_full_filter_changes_no_count(spark, monkeypatch):
    rows = [("en", t) for t in texts(9, 100, ["a", "b", "c", "the", "of"])]
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(phrases._Group, "hashes", lambda self, order: np.zeros(max(0, len(self.codes) - order + 1), np.uint64))
    assert got(phrases.collocations(docs, least=3)) == expected(rows, 3, 2000)


def test_filter_holds_every_frequent_phrase(spark):
    said = [f"w{i} v{i % 7}" for i in range(5000)]
    counts = spark.createDataFrame([("en", p, 30) for p in said], "lang string, phrase string, n long")
    table = phrases._filter_of(counts, 2).value
    group = phrases._Group(pa.array(["en"] * len(said)), pa.array(said))
    bit = (group.hashes(2)[group.whole(2)] % np.uint64(8 * len(table))).astype(np.int64)
    assert len(bit) == len(said) and all(table[b // 8] >> (b % 8) & 1 for b in bit) and np.unpackbits(table).sum() == len(set(bit.tolist()))


def test_counts_beyond_64_bits_in_products():
    row = ("en", 1, 9 * 10**18, "a", [], 0)
    rows = [pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "size": [1, 2, 1], "n": [9 * 10**18, 8 * 10**18, row[2]], "phrase": ["b", "a b", "c"], "left": [[], [9 * 10**18], []], "ext": [0, 0, 0]})]
    (out,) = list(phrases._suffixes(5)(iter(rows)))
    assert out.to_pylist() == [{"lang": "en", "phrase": "a b", "a": 8 * 10**18, "l": 9 * 10**18, "r": 9 * 10**18, "score": 2_000_000 * 8 // 18}]


def test_no_texts(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, " \t.")], "lang string, text string")).count() == 0
