"""Token counts by digest cache: normalised content and tokenizer version are digested, joined to stored counts; only distinct misses are encoded, and appended."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh_path, sliced, stored

CACHE_SCHEMA = "content_sha256 binary, tokenizer_sha256 string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_of_letter() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabularies of byte-level BPE, by its published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _as_ranks(path: str):
    """A tiktoken encoding for a byte-level BPE file whose ids follow its merges, or None for any other file."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, split = held["model"], held.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
        return None
    if held.get("normalizer") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return None
    special = {x["content"]: x["id"] for x in held["added_tokens"] if x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"])}
    if len(special) != len(held["added_tokens"]):
        return None
    letters = _byte_of_letter()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made) or len(made) + 256 != len(ranks):
        return None
    return tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts: without begin, end or added tokens, special strings inside texts as the file's library takes them by default.

    ``.json`` files are read as the tokenizers library does; those of plain byte-level BPE run in tiktoken, which gives the
    same ids several times faster, but for the texts whose blanks overflow its pattern's stack; the library counts those.
    ``.tiktoken`` files hold ranks, ``.model`` files go to sentencepiece.
    """
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        plain = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(plain.encode_ordinary(t)) for t in texts]
    fast = _as_ranks(path)
    if fast is None:
        return lambda texts: [len(x) for x in _library(path).encode_batch(texts, add_special_tokens=False)]

    def count(text: str) -> int:
        try:
            return len(fast.encode(text, allowed_special="all"))
        except ValueError:  # its pattern's stack is full: a run of some hundred thousand blanks or line ends
            return len(_library(path).encode(text, add_special_tokens=False))

    return lambda texts: list(map(count, texts))


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return whole


def _encode_misses(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in sliced(batches, "content"):
            n = count(batch.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content_sha256"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["content_sha256", "tokenizer_sha256", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", cache_path: str | None = None, limit: int = 512) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    The content is normalised as far as no count can change: null becomes the empty text, all else stays. The cache is a
    Parquet folder ``(content_sha256, tokenizer_sha256, n_tokens)`` that only grows: counts of another tokenizer file never
    match, and a second run over the same texts encodes nothing. Without ``cache_path`` a new cache starts in the shared
    folder. Map-side aggregation leaves one text for each digest and task before the shuffle, so a group of copies of any
    size costs one encoding; the join back is split where a digest is hot. Texts of any length are encoded whole, one at a time.

    Null and empty texts: 0 bytes, 0 tokens. Repeated rows: each keeps its row. Empty table: no rows. Columns of ``docs``
    named like the three results are replaced; all others are kept.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    cache_path = cache_path or fresh_path(spark, "token-counts")
    text = F.coalesce(column(docs, text_col), F.lit(""))
    content = docs.select(F.unhex(F.sha2(text, 256)).alias("content_sha256"), text.alias("content"))
    texts = content.groupBy("content_sha256").agg(F.any_value("content").alias("content"))
    if _exists(spark, cache_path):
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_sha256") == version)
        texts = texts.join(known.select("content_sha256"), "content_sha256", "left_anti")
    texts.mapInArrow(_encode_misses(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_sha256") == version)
    counts = counts.groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens"))  # two runs at once may both append a digest
    counts = stored(counts, "counts-by-digest")  # so that nothing but the exchanges lies under the join, and adaptive execution can split a digest that many rows share
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    keyed = docs.select(*(column(docs, c) for c in kept), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("__digest"))
    out = keyed.join(counts.withColumnRenamed("content_sha256", "__digest"), "__digest", "left").drop("__digest")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
