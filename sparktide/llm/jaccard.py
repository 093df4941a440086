"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same shingles are one node. Bands of MinHash values put nodes into buckets; a star around each bucket's least
node links candidates without listing pairs, and the components of the stars hold every pair that shares a bucket. A small
component is compared as a whole; a large one bucket by bucket, each pair in the first bucket that it shares, unless its buckets
are so full that comparing all of it once takes less. Either way pairs are compared block by block: MinHash values a few at a
time, a pair is dropped as soon as the posterior probability that it reaches the threshold falls below the tolerance, and the
rest are verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, sliced, stored
from .components import components
from .words import blocks, mix, shingle_sets

#: Words of a shingle and the similarity from which on two texts are linked.
WORDS, THRESHOLD = 5, 0.8
#: MinHash values of a band and bands: a pair at 0.8 shares a bucket with probability 1 - (1 - 0.8^6)^32 = 0.99994.
ROWS, BANDS = 6, 32
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-4
#: Nodes and shingles of one block at most, as far as hashing deals evenly.
BLOCK_NODES, BLOCK_SHINGLES = 512, 250_000

_K = ROWS * BANDS


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * _K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:_K] | np.uint64(1), seeds[_K:]


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingle hashes."""
    factor, mask = _permutations()
    least = np.full(_K, ~np.uint64(0), np.uint64)
    for i in range(0, len(shingles), 256):
        part = shingles[i : i + 256, None]
        np.minimum(least, ((part ^ mask) * factor).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """One hash for each band, in which the band's number is mixed."""
    grid = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for j in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
    return h.view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


@lru_cache(maxsize=8)
def least_agreement(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each multiple of STEP the least number of equal values for which P(similarity >= threshold) >= tolerance, by a uniform prior.

    The posterior of m equal values among n is Beta(m + 1, n - m + 1); its upper tail is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(STEP, _K + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _nodes_of(words: int):
    """The distinct shingle sets of a slice of rows: key, size, band hashes, and the rows that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            own: dict[bytes, list[int]] = {}
            sizes, bands = [], []
            for begin, w in blocks(batch.column("text").to_pylist()):
                for k, s in enumerate(shingle_sets(w, words)):
                    key = set_key(s)
                    if key not in own:
                        own[key] = []
                        sizes.append(len(s))
                        bands.append(band_hashes(signature(s)) if len(s) else np.zeros(0, np.int64))
                    own[key].append(begin + k)
            ends = np.cumsum([0, *map(len, own.values())], dtype=np.int32)
            rows = pa.ListArray.from_arrays(pa.array(ends), batch.column("row").take(pa.array([i for x in own.values() for i in x], pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), rows], names=["key", "n", "bands", "rows"])

    return run


def _sets_of(words: int):
    """Shingle sets with their MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = {set_key(s): s for _, w in blocks(batch.column("text").to_pylist()) for s in shingle_sets(w, words)}
            arrays = [list(sets), [s.astype("<u8").tobytes() for s in sets.values()], [signature(s).astype("<u4").tobytes() for s in sets.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in arrays], names=["key", "shingles", "values"])

    return run


def _links_in_block(keys: list[bytes], left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], sig: np.ndarray, copies: np.ndarray, bucket: int | None, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Documents linked to each node by the pairs between ``left`` and ``right`` (node numbers), and the least key's node of its links' components. With ``bucket``, only pairs of which it is the first common bucket."""
    m = len(keys)
    size = np.array([len(s) for s in sets], np.int64)
    links, root = np.zeros(m, np.int64), list(range(m))
    bands = None if bucket is None else np.stack([band_hashes(v) for v in sig])

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    needed = least_agreement(threshold, tolerance)
    for x in left.tolist():
        ys = right[right > x] if left is right else right
        ys = ys[(size[ys] >= threshold * size[x]) & (size[x] >= threshold * size[ys])]
        if bands is not None and len(ys):
            first = (bands[ys] == bands[x]).argmax(axis=1)
            ys = ys[bands[x, first] == bucket]
        equal = np.zeros(len(ys), np.int32)
        for k, least in enumerate(needed):
            if not len(ys):
                break
            part = slice(k * STEP, (k + 1) * STEP)
            equal += (sig[ys, part] == sig[x, part]).sum(axis=1, dtype=np.int32)
            alive = equal >= least
            ys, equal = ys[alive], equal[alive]
        if not len(ys):
            continue
        own, many = sets[x], np.concatenate([sets[y] for y in ys.tolist()])
        at = np.minimum(np.searchsorted(own, many), len(own) - 1)
        starts = np.concatenate(([0], np.cumsum(size[ys])[:-1]))
        shared = np.add.reduceat((own[at] == many).astype(np.int64), starts)
        ys = ys[shared / (size[x] + size[ys] - shared) >= threshold]
        links[x] += copies[ys].sum()
        links[ys] += copies[x]
        for y in ys.tolist():
            a, b = find(x), find(y)
            if a != b:
                if keys[b] < keys[a]:
                    a, b = b, a
                root[b] = a
    return links, np.array([find(i) for i in range(m)])


def _block_links(threshold: float, tolerance: float):
    """Links of the nodes of each group and pair of blocks that a task was dealt."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[bytes, int, bytes, bool]] = []
        for (_, i, j), part in pdf.groupby(["group", "i", "j"], sort=False):
            part = part.drop_duplicates("key").sort_values("key")
            keys, bucket = part["key"].tolist(), part["bucket"].iloc[0]
            sets = [np.frombuffer(s, "<u8").astype(np.uint64) for s in part["shingles"]]
            sig = np.stack([np.frombuffer(s, "<u4") for s in part["values"]])
            copies, blk = part["copies"].to_numpy(np.int64), part["block"].to_numpy()
            left = np.flatnonzero(blk == i)
            bucket = None if pd.isna(bucket) else int(bucket)
            links, root = _links_in_block(keys, left, left if i == j else np.flatnonzero(blk == j), sets, sig, copies, bucket, threshold, tolerance)
            whole = bucket is None and bool(part["single"].iloc[0])
            out += [(keys[x], int(links[x]), keys[root[x]], whole) for x in np.flatnonzero(links).tolist()]
        return pd.DataFrame(out, columns=["key", "links", "root", "whole"])

    return run


def _classified(given: DataFrame, words: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """From ``given (row, text)``: ``(key, rows)`` with the rows of each slice that share a shingle set, and ``(key, label, first, n_links)`` for each set."""
    row_type = given.schema["row"].dataType.simpleString()
    rows = stored(given.mapInArrow(_nodes_of(words), f"key binary, n long, bands array<long>, rows array<{row_type}>"), "shingled")
    first = F.array_min(F.transform("rows", lambda x: x["id"]))
    nodes = rows.groupBy("key").agg(F.sum(F.size("rows")).alias("copies"), F.min(first).alias("first"), F.max("n").alias("n"), F.any_value("bands").alias("bands"))
    nodes = stored(nodes, "nodes")

    banded = nodes.select("key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("key").alias("hub"), F.count("*").alias("b")).where(F.col("b") > 1)
    buckets = stored(banded.join(buckets, "band"), "buckets")
    near = components(buckets.where(F.col("hub") != F.col("key")).select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct())
    near = stored(nodes.drop("bands").join(near, nodes["key"] == near["node"]).select("key", "copies", "first", "n", F.col("label").alias("comp")), "candidates")

    # how each component is compared: all of it once, or bucket by bucket
    sizes = near.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    sizes = stored(sizes.withColumn("parts", _parts("m", "total")), "component-sizes")
    split = stored(near.join(sizes.where("parts > 1"), "comp").select("key", "comp", "copies", "n", "m"), "large-components")
    dealt = near.join(sizes.where("parts = 1").select("comp", "parts"), "comp").select("key", "copies", "n", F.col("comp").alias("group"), F.lit(None).cast("long").alias("bucket"), "parts")
    if not split.isEmpty():
        inside = stored(split.join(buckets.select("key", "band", "b"), "key"), "large-buckets")
        work = inside.groupBy("comp").agg(F.sum(F.col("b").cast("double")).alias("work"), F.max("m").alias("m"))  # a bucket of b nodes comes b times
        by_bucket = stored(work.where(F.col("work") < F.col("m") * F.col("m") / 4).select("comp"), "by-bucket")
        whole = split.join(by_bucket, "comp", "left_anti").join(sizes.select("comp", "parts"), "comp").select("key", "copies", "n", F.col("comp").alias("group"), F.lit(None).cast("long").alias("bucket"), "parts")
        few = inside.join(by_bucket, "comp", "left_semi")
        of_bucket = few.groupBy("band").agg(_parts(F.count("*"), F.sum("n")).alias("parts")).withColumnRenamed("band", "of")
        few = few.join(of_bucket, F.col("band") == F.col("of")).select("key", "copies", "n", F.col("band").cast("string").cast("binary").alias("group"), F.col("band").alias("bucket"), "parts")
        dealt = dealt.unionByName(whole).unionByName(few)
    dealt = stored(dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")), "dealt")
    whole = dealt.where("parts = 1").agg(F.count("*").alias("m"), F.sum("n").alias("n")).first()
    packs = max(1, -(-int(whole["m"] or 0) // (2 * BLOCK_NODES)), -(-int(whole["n"] or 0) // (2 * BLOCK_SHINGLES)))

    texts = given.join(near.select(F.col("first").alias("__first")).distinct(), F.col("row.id").eqNullSafe(F.col("__first")), "left_semi")
    sets = texts.select("text").mapInArrow(_sets_of(words), "key binary, shingles binary, values binary")
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "single": F.col("parts") == 1})
    pack = F.when(F.col("single"), F.pmod(F.xxhash64("group"), F.lit(packs))).otherwise(F.xxhash64("group", "i", "j"))
    pairs = sets.join(pairs, "key").select(pack.alias("pack"), "single", "group", "bucket", "i", "j", "block", "key", "copies", "shingles", "values")
    found = stored(pairs.groupBy("single", "pack").applyInPandas(_block_links(threshold, tolerance), "key binary, links long, root binary, whole boolean"), "links")

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = found.where(~F.col("whole")).select(F.col("key").alias("a"), F.col("root").alias("b"))
    labels = found.where("whole").select(F.col("key").alias("node"), F.col("root").alias("label"))
    if not joined.isEmpty():
        labels = labels.unionByName(components(joined.distinct()))
    out = nodes.select("key", "copies", "first").join(labels, F.col("key") == F.col("node"), "left").join(links.withColumnRenamed("key", "lkey"), F.col("key") == F.col("lkey"), "left")
    out = out.select("key", "first", F.coalesce("label", "key").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("key", "rows"), stored(out, "classes")


def _parts(m, total) -> Column:
    """Blocks of a group of so many nodes and shingles."""
    m, total = (F.col(x) if isinstance(x, str) else x for x in (m, total))
    return F.ceil(F.greatest(m / BLOCK_NODES, total / BLOCK_SHINGLES)).cast("int")


def similar_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row of ``docs``: its id, ``class_id`` and ``n_links``.

    Two rows are linked if the Jaccard similarity of their sets of ``words``-word shingles is at least ``threshold``; a text
    of fewer words has one shingle of them all. ``class_id`` is the least id of all rows that links connect; ``n_links`` the
    number of other rows linked to this one, copies included. Words are runs of letters and digits in lower case.

    Null, empty and wordless texts are equal to each other and to nothing else. Repeated rows are copies, and ties can't
    arise. Null ids take part; a class of null ids only has a null class_id. Very long texts are shingled whole, in a block of
    their own. Empty table: no rows. Other columns of ``docs`` aren't read.

    Copies are never paired: they count as weights of their node, and tasks fold them before every shuffle. Pairs are made
    only inside Python blocks of bounded size and never emitted: a block gives one row for each of its nodes. No partner or
    candidate is capped.
    """
    given = docs.select(F.struct(column(docs, id_col).alias("id")).alias("row"), column(docs, text_col).alias("text"))
    rows, classes = _classified(given, words, threshold, tolerance)
    least = classes.groupBy("label").agg(F.min("first").alias("class_id"))
    of_node = stored(classes.join(least, "label").select("key", "class_id", "n_links"), "class-ids")
    out = rows.join(of_node, "key").select(F.explode("rows").alias("row"), "class_id", "n_links")
    return out.select(F.col("row.id").alias(id_col), "class_id", "n_links")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` with one document left of each class: the one of least id, null ids last; of several texts under that id the one of least hash.

    Rows of equal id and text count as one document. Rows are told apart by id and text, so that a null or repeated id takes no
    other document with it.
    """
    text = column(docs, text_col)
    mark = {"__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit(1), text)}
    given = docs.select(F.struct(column(docs, id_col).alias("id"), mark["__t1"].alias("t1"), mark["__t2"].alias("t2")).alias("row"), text.alias("text"))
    rows, classes = _classified(given, words, threshold, tolerance)
    each = stored(rows.join(classes.select("key", "label"), "key").select(F.explode("rows").alias("row"), "label"), "rows-of-classes")
    order = F.struct(F.col("row.id").isNull(), F.col("row.id"), F.col("row.t1"), F.col("row.t2"))
    best = each.groupBy("label").agg(F.min_by("row", order).alias("best"), F.count("*").alias("n")).where("n > 1")
    gone = each.join(stored(best.select(F.col("label").alias("of"), "best"), "kept-rows"), F.col("label") == F.col("of")).where(~F.col("row").eqNullSafe(F.col("best")))
    gone = gone.select(F.col("row.id").alias("__gone"), F.col("row.t1").alias("__g1"), F.col("row.t2").alias("__g2")).distinct()
    keyed = docs.withColumns(mark)
    kept = keyed.join(gone, column(keyed, id_col).eqNullSafe(F.col("__gone")) & (F.col("__t1") == F.col("__g1")) & (F.col("__t2") == F.col("__g2")), "left_anti")
    if not each.groupBy("row").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, "__t1", "__t2"])
    return kept.drop("__t1", "__t2")
