"""Token files: ids as the library gives them, grammars that decode from any place, order and starts over all rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparktide.llm import repair, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = [*"abAZ'.,;:!?<|>\n\t ́éḁ̇̀İΣß  ½日가s-t\"", "<|endoftext|>", "'s", "'ll", "word ", "\r\n", "🎉"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_units_encode_as_the_library_does(library):
    texts = [*random_texts(6000), "", None, " ", "x" * 3000, " " * 100_000, "a.b" * 5000, "\n" * 1_000_000]
    ids, n = token_files.encode_group(pa.array(texts), PATH, 1)
    ends = np.cumsum(n)
    for text, end, size in zip(texts, ends.tolist(), n.tolist()):
        assert ids[end - size : end].tolist() == ids_of(library, text), text


@pytest.mark.parametrize("kinds", [1, 2, 3, 10, 5000])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 100, 20_000])
def test_grammar_round_trip(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = rng.zipf(1.3, n).clip(1, kinds) if kinds > 3 else rng.integers(0, kinds, n)
    data = repair.pack(ids, 2)
    segment = repair.Segment(data)
    assert segment.n_ids == n and segment.ids().tolist() == ids.tolist()
    assert segment.length.tolist() == [len(segment._expand(np.array([segment.base + k]))) for k in range(len(segment.length))]
    for _ in range(50):
        a, b = sorted(rng.integers(0, n + 1, 2))
        assert segment.ids(a, b).tolist() == ids[a:b].tolist()


def test_grammar_replaces_frequent_pairs():
    phrase = list(range(100, 120))
    data = repair.pack(np.array(phrase * 500))
    assert len(repair.Segment(data).symbols) < 600 and len(data) < 4000
    assert len(repair.Segment(repair.pack(np.zeros(1 << 16, int))).symbols) < 64


def test_files_hold_every_document_in_order(spark, library, tmp_path):
    texts = [*random_texts(300, 2), None, "", "same text", "same text", "a word " * 30_000]
    rows = [(i * 7 % 311, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "clash"), (5, "another text of id 5", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, segments string").repartition(5)
    token_files.write_token_files(docs, str(tmp_path / "f"), PATH, block_tokens=2000)
    got = token_files.read_documents(spark, str(tmp_path / "f")).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in got] == [False] + [True] * (len(rows) - 1)
    assert [r["doc_id"] for r in got[1:]] == sorted(r["doc_id"] for r in got[1:])
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(ids_of(library, t))
    at = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        want[r["doc_id"]].remove(ids)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(r["ids"]))
        at += len(ids)
    assert not any(want.values())


def test_spans_are_decoded_alone(spark, library, tmp_path):
    texts = {1: "some words of one text", 2: "a word and more " * 3000, 3: None, 4: "x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    token_files.write_token_files(docs, str(tmp_path / "f"), PATH, block_tokens=100)
    wanted = [(1, 0, None), (1, 2, 4), (2, 5000, 5003), (2, -5, 3), (2, 11990, 99999), (3, 0, None), (4, 7, 3), (9, 0, 5), (None, 0, 1)]
    got = token_files.read_spans(spark, str(tmp_path / "f"), spark.createDataFrame(wanted, "doc_id long, begin long, end long")).collect()
    assert len(got) == len(wanted)
    for r in got:
        if r["doc_id"] not in texts:
            assert r["ids"] is None
            continue
        ids = ids_of(library, texts[r["doc_id"]])
        begin = max(r["begin"], 0)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[begin : len(ids) if r["end"] is None else max(begin, r["end"])]


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(docs, str(tmp_path / "f"), PATH)
    assert token_files.read_documents(spark, str(tmp_path / "f")).count() == 0


def test_a_long_text_takes_several_segments(spark, library, tmp_path):
    text = " ".join(str(i) for i in range(250_000))
    docs = spark.createDataFrame([(1, text), (2, "after")], "doc_id long, text string")
    token_files.write_token_files(docs, str(tmp_path / "f"), PATH)
    a, b = sorted(token_files.read_documents(spark, str(tmp_path / "f")).collect(), key=lambda r: r["doc_id"])
    ids = ids_of(library, text)
    assert len(ids) > repair.SEGMENT_TOKENS and np.frombuffer(a["ids"], "<u4").tolist() == ids and b["start"] == len(ids)
    spans = spark.createDataFrame([(1, repair.SEGMENT_TOKENS - 3, repair.SEGMENT_TOKENS + 4), (2, 0, None)], "doc_id long, begin long, end long")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read_spans(spark, str(tmp_path / "f"), spans).collect()}
    assert got == {1: ids[repair.SEGMENT_TOKENS - 3 : repair.SEGMENT_TOKENS + 4], 2: ids_of(library, "after")}
