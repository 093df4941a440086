"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from sparktide.llm import spelling


def edit_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts_of(rows, one_in=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def expected(n):
    out = {}
    for w in n:
        near = [v for v in n if edit_one(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] < 5 * n[w]:
            best = None
        out[w] = (best, len(near))
    rows = set()
    for w, (form, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n[w], k, n[form] if form else None))
    return rows


def got(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("letters,parts", [("ab", 3), ("abcde", 8), ("abcdefghijklmnopqrstuvwxyzßé÷", 8), ("aé", 5)])
def test_near_words_are_those_of_brute_force(spark, letters, parts):
    rng = random.Random(len(letters) + parts)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(150)}
    for w in list(words)[:80]:  # words of one edit, which random ones seldom are
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :] or "x", w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]}
    n = {w: rng.choice([5, 6, 30, 31, 200, 1000, 5000]) for w in words}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(spelling.variants(table, parts=parts)) == expected(n)


def test_chains_of_forms_lead_to_the_last(spark):
    n = {"a" * k + "bbbbbb": 5 * 6**k for k in range(9)}
    rows = got(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert rows == expected(n) and {r[2] for r in rows} == {"a" * 8 + "bbbbbb"}


def test_texts_of_all_kinds(spark):
    rng = random.Random(4)
    vocabulary = ["retion", "Retions", "rétion", "reunion", "unions", "ÀÉÎÕÜÿ", "aaaaaa", "straße", "x÷y×zz", "short"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(60)) + ".") for i in range(60)]
    rows += [(7, None), (8, ""), (None, "retion retion retion"), (9, "retion " * 3000), (9, "retion " * 3000), (10, "q" * 200_000), (10, "日retion日retion1unions_unions")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n long")
    n = counts_of(rows)
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == n and any(len(w) == 5 for w in {"short"})
    assert got(spelling.spelling_variants(docs)) == expected(n)
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs, one_in=None).collect()} == counts_of(rows, None)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_no_table_is_broadcast(spark):
    rng = random.Random(5)
    n = {"".join(rng.choice("abc") for _ in range(7)): rng.choice([5, 6, 40, 250, 2000]) for _ in range(120)}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")  # any broadcast fails
    try:
        assert got(spelling.variants(table)) == expected(n)
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", before)
