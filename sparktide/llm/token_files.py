"""Token ids in compressed files: texts are encoded, ordered by id, packed as Re-Pair grammars shard by shard, and read back whole or span by span."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import column
from .repair import SEGMENT_TOKENS, Segment, pack
from .units import groups, unit_codes

#: Units whose ids a worker remembers (twice as many at most), and the bytes of a unit from which on it isn't remembered.
REMEMBERED, LONG_UNIT = 1 << 18, 48
#: Words of one pattern match each, in which neither normalisation nor the table of letters depends on a version: Latin letters, or ASCII signs.
_ONE_WORD = re.compile(r"(?:[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+|[!-/:-@\[-`{-~]+)\Z").match


class UnitEncoder:
    """Ids of units by the tokenizers library, each distinct unit of a group of texts once; the last units are remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.known: list[tuple[dict[bytes, int], np.ndarray]] = [({}, np.zeros(0, np.uint32)), ({}, np.zeros(0, np.uint32))]

    def ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(flat, begin, size)``: unit ``i`` has the ids ``flat[begin[i]:begin[i] + size[i]]``."""
        (young, ids), (old, old_ids) = self.known
        at = np.fromiter((young.get(u, -1) for u in units), np.int64, len(units))
        other = np.flatnonzero(at < 0)
        from_old = np.fromiter((old.get(units[i], -1) for i in other.tolist()), np.int64, len(other))
        begin, size = at >> 8, at & 255
        new = other[from_old < 0]
        made, made_begin, made_size = self._encode([units[i] for i in new.tolist()])
        begin[new], size[new] = len(ids) + made_begin, made_size
        kept = other[from_old >= 0]
        kept_begin, kept_size = from_old[from_old >= 0] >> 8, from_old[from_old >= 0] & 255
        begin[kept], size[kept] = len(ids) + len(made) + np.cumsum(kept_size) - kept_size, kept_size
        flat = np.concatenate((ids, made, gathered(old_ids, kept_begin, kept_size)))
        young.update((units[i], b << 8 | n) for i, b, n in zip(other.tolist(), begin[other].tolist(), size[other].tolist()) if len(units[i]) < LONG_UNIT and n < 256)
        self.known[0] = (young, flat)
        if len(young) > REMEMBERED or len(flat) > 16 * REMEMBERED:
            self.known = [({}, np.zeros(0, np.uint32)), self.known[0]]
        return flat, begin, size

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(flat, begin, size)`` by the library. Units of one word are encoded many at a time, with a blank between them, and told apart by the ids that close a word."""
        texts = [u.decode() for u in units]
        words = np.array([bool(_ONE_WORD(t)) for t in texts], bool) & self.closes.any()
        flat, begin, size, at = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 0
        rest = [np.flatnonzero(~words)]
        for some in np.array_split(np.flatnonzero(words), -(-int(words.sum()) // 512) or 1):
            if len(some):
                got = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in some.tolist()])], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.closes[got]) + 1
                if len(ends) == len(some) and ends[-1] == len(got):
                    size[some] = np.diff(ends, prepend=0)
                    begin[some] = at + ends - size[some]
                    flat.append(got)
                    at += len(got)
                else:  # a vocabulary whose words close otherwise
                    rest.append(some)
        rest = np.concatenate(rest).tolist()
        for a in range(0, len(rest), 512):
            for i, e in zip(rest[a : a + 512], self.tokenizer.encode_batch_fast([texts[i] for i in rest[a : a + 512]], add_special_tokens=False)):
                got = np.array(e.ids, np.uint32)
                begin[i], size[i] = at, len(got)
                flat.append(got)
                at += len(got)
        return np.concatenate(flat), begin, size


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``flat[begin:begin + size]`` one after the other."""
    done = np.cumsum(size)
    return flat[np.repeat(begin - (done - size), size) + np.arange(int(done[-1]) if len(done) else 0)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def encode_group(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each text's followed by ``end_id``, and the number of ids of each text with it."""
    codes, units, first = unit_codes(texts)
    flat, begin, size = _encoder(path).ids(units)
    # an end stands after the last unit of each text, as one more unit of one id
    flat, begin, size = np.append(flat, np.uint32(end_id)), np.append(begin, len(flat)), np.append(size, 1)
    order = np.insert(codes.astype(np.int64), first[1:], len(units))
    ends = np.cumsum(size[order])[first[1:] + np.arange(len(first) - 1)]
    return gathered(flat, begin[order], size[order]), np.diff(ends, prepend=0)


def _blocks(path: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        held_ids: list[pa.Array] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            ids, n = np.concatenate(held), np.concatenate(counts)
            segments = [pack(ids[a : a + SEGMENT_TOKENS]) for a in range(0, len(ids), SEGMENT_TOKENS)]
            names = pa.concat_arrays(held_ids)
            one = lambda x, kind=None: pa.array([x], kind)
            row = [one(shard, pa.int32()), one(block, pa.int32()), one(start, pa.int64()), one(len(ids), pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), one(n.tolist(), pa.list_(pa.int64())), one(segments, pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(row, names=["shard", "block", "start_in_shard", "n_ids", "doc_ids", "n_tokens", "segments"])

        size = 0
        for batch in groups(batches, "text"):
            ids, n = encode_group(batch.column("text"), path, end_id)
            held_ids.append(batch.column("id"))
            held.append(ids)
            counts.append(n)
            size += len(ids)
            if size >= block_tokens:
                yield closed()
                block, start, size = block + 1, start + size, 0
                held_ids, held, counts = [], [], []
        if held:
            yield closed()
        pa.default_memory_pool().release_unused()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every whole text, append ``end_id``, and write the ids in ascending order of ``id_col`` to ``path``.

    The files are Parquet, a row for each block: its shard (a range of ids), its place in it, how many ids of the shard
    stand before it, the documents' ids and numbers of tokens, and its ids as Re-Pair segments (see ``repair.pack``).
    Rows are dealt by ranges of (id, hash of the text, row), so a range never ends up in one task because an id repeats, and
    each task packs its range as it comes, a block at a time. Special strings inside texts are taken as the library does.

    Null texts are empty and have the end id only. Null ids come first; rows of one id are ordered by a hash of their text;
    repeated rows all stay. Very long texts are encoded whole and take several segments of one block. Empty table: no rows.
    Other columns are left out, whatever their names.
    """
    rows = docs.select(column(docs, id_col).alias("id"), F.coalesce(column(docs, text_col), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    id_type = rows.schema["id"].dataType
    schema = StructType.fromDDL("shard int, block int, start_in_shard long, n_ids long")
    schema = StructType([*schema.fields, StructField("doc_ids", ArrayType(id_type)), StructField("n_tokens", ArrayType(LongType())), *StructType.fromDDL("segments array<binary>").fields])
    dealt.mapInArrow(_blocks(tokenizer_path, end_id, block_tokens), schema).write.parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """How many ids stand before each shard: one row a shard, from the blocks' numbers alone."""
    shards = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return shards.select("shard", F.coalesce(before, F.lit(0)).cast("long").alias("shard_start"))


def _ids_of(segments: list[bytes]) -> np.ndarray:
    return np.concatenate([Segment(s).ids() for s in segments])


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                segments, counts = batch.column("segments")[k].as_py(), batch.column("n_tokens")[k].values.to_numpy()
                raw = _ids_of(segments).astype("<u4").tobytes()
                ends = 4 * np.cumsum(counts)
                parts = [memoryview(raw)[b - 4 * n : b] for b, n in zip(ends.tolist(), counts.tolist())]
                n = len(parts)
                out = [pa.array([batch.column("shard")[k].as_py()] * n, pa.int32()), batch.column("doc_ids")[k].values, pa.array(batch.column("start_in_shard")[k].as_py() + np.cumsum(counts) - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["shard", "id", "in_shard", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array([bytes(p) for p in parts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def read_documents(spark: SparkSession, path: str, *, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """From files that ``write_token_files`` has written, a row for each document: ``id_col``, ``start`` (ids of all documents before it), ``n_tokens`` (with the end id), ``ids_crc32`` and ``ids`` (binary: little-endian unsigned 32-bit numbers)."""
    blocks = spark.read.parquet(path)
    id_type = blocks.schema["doc_ids"].dataType.elementType
    schema = StructType([*StructType.fromDDL("shard int").fields, StructField("id", id_type), *StructType.fromDDL("in_shard long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids).fields])
    read = blocks.select("shard", "start_in_shard", "doc_ids", "n_tokens", "segments").mapInArrow(_documents(with_ids), schema)
    placed = read.join(shard_starts(spark, path), "shard")
    return placed.select(F.col("id").alias(id_col), (F.col("shard_start") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, opened = None, {}
    for batch in batches:
        out = []
        for k, row in enumerate(batch.select(["shard", "block", "first", "n"]).to_pylist()):
            if key != (row["shard"], row["block"]):
                key, opened = (row["shard"], row["block"]), {}
            parts, at, end = [], row["first"], row["first"] + row["n"]
            while at < end:
                s = at // SEGMENT_TOKENS
                if s not in opened:
                    opened[s] = Segment(batch.column("segments")[k].values[s].as_py())
                stop = min(end, (s + 1) * SEGMENT_TOKENS)
                parts.append(opened[s].ids(at - s * SEGMENT_TOKENS, stop - s * SEGMENT_TOKENS))
                at = stop
            out.append(np.concatenate(parts).astype("<u4").tobytes() if parts else b"")
        yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(out, pa.binary())], names=["__row", "ids"])


def read_spans(spark: SparkSession, path: str, wanted: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``ids`` of the tokens ``begin:end`` of wanted documents: every row of ``wanted (id_col, begin, end)`` with the binary ``ids``.

    Only the segments that hold a wanted token are opened, and in them only the symbols over it are expanded. Spans are cut
    to their document, an unknown or null id gives null ids, ``end`` null means the document's end; an id that several
    documents have gives a row for each. Columns of ``wanted`` are kept but for one named ``ids``.
    """
    blocks = spark.read.parquet(path)
    index = blocks.select("shard", "block", F.arrays_zip("doc_ids", "n_tokens").alias("d"))
    index = index.select("shard", "block", F.col("d.n_tokens").alias("sizes"), F.posexplode("d").alias("__at", "__doc"))
    # a document's first token in its block is the sum of the sizes before it
    before = F.sum(F.col("__doc.n_tokens")).over(Window.partitionBy("shard", "block").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    index = index.select("shard", "block", F.col("__doc.doc_ids").alias("__id"), F.coalesce(before, F.lit(0)).alias("__begin"), F.col("__doc.n_tokens").alias("__n"))
    kept = [c for c in wanted.columns if c != "ids"]
    rows = wanted.select(F.struct(*(column(wanted, c) for c in kept)).alias("__row"))
    found = rows.join(index, F.col(f"__row.`{id_col}`") == F.col("__id"), "left")
    first = F.least(F.greatest(F.col("__row.begin"), F.lit(0)), F.col("__n"))
    last = F.least(F.greatest(F.coalesce(F.col("__row.end"), F.col("__n")), first), F.col("__n"))
    found = found.select("__row", "shard", "block", (F.col("__begin") + first).alias("first"), (last - first).alias("n"))
    hits = found.where("shard is not null").join(blocks.select("shard", "block", "segments"), ["shard", "block"])
    schema = StructType([hits.schema["__row"], *StructType.fromDDL("ids binary").fields])
    got = hits.select("__row", "shard", "block", "first", "n", "segments").mapInArrow(_spans, schema)
    missing = found.where("shard is null").select("__row", F.lit(None).cast("binary").alias("ids"))
    return got.unionByName(missing).select("__row.*", "ids")
