"""Approximate nearest neighbours by stable projections: a kd-tree holds low-dimensional projections, and neighbours that it yields are verified until a chi-square test stops the search.

The upper levels of the tree are fitted on a bounded sample and deal all rows into cells; inside a cell each task builds the
lower levels over its rows. A query first searches its own cell, and the distance found there tells which other cells the
test still asks for: it is sent to those alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, stored

#: Dimensions of the projection (even), and the chance of a neighbour to lie within the searched radius.
PROJECTED, CONFIDENCE = 16, 0.8
#: Rows of a block and queries of a chunk (as far as hashing deals evenly), rows of a leaf at most.
BLOCK_ROWS, CHUNK_QUERIES, LEAF_ROWS = 16_384, 8_192, 128
#: Rows that the upper tree is fitted on at most, its levels at most, and vector lengths that have a tree of their own (the most frequent ones).
SAMPLE_ROWS, LEVELS, LENGTHS = 20_000, 10, 16


@lru_cache(maxsize=4)
def chi_square_quantile(p: float, m: int) -> float:
    """The ``p`` quantile of the chi-square distribution with an even number ``m`` of degrees of freedom."""

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - exp(-x / 2) * total

    low, high = 0.0, 400.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


@lru_cache(maxsize=8)
def projection(d: int, m: int = PROJECTED) -> np.ndarray:
    """Normal, that is 2-stable: projected squared distances are chi-square multiples of the true ones."""
    return np.random.default_rng(1234 + d).standard_normal((d, m))


@dataclass(frozen=True)
class Cells:
    """The upper levels of the kd-tree as arrays in heap order, and the regions of its cells."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def fit(points: np.ndarray, levels: int) -> Cells:
        """Split at medians of the widest axis."""
        axis, cut = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1)
        low, high = [np.full((2 ** (levels + 1) - 1, PROJECTED), x) for x in (-np.inf, np.inf)]
        members = [points]
        for node in range(2**levels - 1):
            own = members[node]
            axis[node] = np.ptp(own, axis=0).argmax() if len(own) else node % PROJECTED
            cut[node] = np.median(own[:, axis[node]]) if len(own) else 0.0
            right = own[:, axis[node]] > cut[node]
            members += [own[~right], own[right]]
            for child in (2 * node + 1, 2 * node + 2):
                low[child], high[child] = low[node], high[node]
            high[2 * node + 1, axis[node]] = low[2 * node + 2, axis[node]] = cut[node]
        return Cells(axis, cut, low[2**levels - 1 :], high[2**levels - 1 :])

    def of(self, points: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(len(self.low).bit_length() - 1):
            at = 2 * at + 1 + (points[rows, self.axis[at]] > self.cut[at])
        return at - len(self.axis)

    def near(self, point: np.ndarray, radius2: float) -> np.ndarray:
        """Cells whose region comes within the squared radius of a point."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= radius2)


class KdTree:
    """Leaves of a kd-tree over the projected points of a block, with their boxes."""

    def __init__(self, points: np.ndarray):
        self.leaves: list[np.ndarray] = []
        open_nodes = [np.arange(len(points))]
        while open_nodes:
            own = open_nodes.pop()
            if len(own) <= LEAF_ROWS:
                self.leaves.append(own)
                continue
            spread = np.ptp(points[own], axis=0)
            order = own[np.argsort(points[own, spread.argmax()], kind="stable")]
            open_nodes += [order[len(order) // 2 :], order[: len(order) // 2]]
        self.low = np.array([points[x].min(axis=0) for x in self.leaves])
        self.high = np.array([points[x].max(axis=0) for x in self.leaves])

    def by_distance(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves in order of the squared distance of their boxes from ``q``."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        far = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(far, kind="stable")
        return order, far[order]


class Block:
    """Some rows with their tree: searches them for one query at a time, and counts what it read."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.matrix = projection(x.shape[1])
        points = x @ self.matrix
        tree = self.tree = KdTree(points)
        order = np.concatenate(tree.leaves)
        self.ids, self.x, self.points = ids[order], x[order], points[order]
        self.end = np.cumsum([len(leaf) for leaf in tree.leaves])
        self.begin = self.end - [len(leaf) for leaf in tree.leaves]
        self.leaves_read = self.rows_verified = 0

    def search(self, q: np.ndarray, k: int, stop: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of at most ``k`` rows, no farther than ``bound``: leaves in order of distance, rows of small projected distance verified, until no leaf is left within the radius of the test."""
        p = q @ self.matrix
        best_d, best_id, kth = np.zeros(0), np.zeros(0, self.ids.dtype), bound
        leaves, far = self.tree.by_distance(p)
        at, step = 0, 1
        while at < len(leaves) and far[at] <= stop * kth * kth:
            upto = min(at + step, int(np.searchsorted(far, stop * kth * kth, "right")))
            rows = np.concatenate([np.arange(self.begin[leaf], self.end[leaf]) for leaf in leaves[at:upto].tolist()])
            self.leaves_read += upto - at
            at, step = upto, 2 * step
            if kth < np.inf:
                gap = self.points[rows] - p
                rows = rows[np.einsum("ij,ij->i", gap, gap) <= stop * kth * kth]
            self.rows_verified += len(rows)
            gap = self.x[rows] - q
            d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            near = d <= kth
            d, i = np.concatenate((best_d, d[near])), np.concatenate((best_id, self.ids[rows[near]]))
            top = np.lexsort((i, d))[:k]
            best_d, best_id = d[top], i[top]
            if len(best_d) >= k:
                kth = min(kth, best_d[-1])
        return best_id, best_d


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vec)`` of the rows that can take part: with an id, finite components without nulls, not all of them zero; equal rows once."""
    vec = column(vectors, vector_col).cast("array<double>")
    rows = vectors.select(column(vectors, id_col).alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    odd = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(~odd & F.exists("vec", lambda c: c != 0)).dropDuplicates(["id", "vec"])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(float)


def fit_cells(points: DataFrame, *, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS) -> dict[int, Cells]:
    """The upper tree of each of the LENGTHS most frequent vector lengths, fitted on ``sample_rows`` rows at most (those of least hash); of these only projections reach the driver."""
    lengths = points.groupBy("d").count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect()
    sample = points.orderBy(F.xxhash64("id", "vec"), "id").limit(sample_rows)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"d": pdf["d"], "p": [v @ projection(len(v)) for v in pdf["vec"]]})

    got = sample.select("d", "vec").mapInPandas(project, "d int, p array<double>").toPandas().sort_values("d")
    out = {}
    for d, n in ((r["d"], r["count"]) for r in lengths):
        own = got.loc[got["d"] == d, "p"].to_list()
        levels = min(LEVELS, max(0, (n // block_rows).bit_length()), max(0, (len(own) // 16).bit_length() - 1))
        if levels:
            order = np.array(own)
            out[d] = Cells.fit(order[np.lexsort(order.T)], levels)
    return out


def _placed(df: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """``df`` (with vec and d) and the cell that each row lies in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int32)
            for d, rows in pdf.groupby("d").indices.items():
                if d in cells:
                    cell[rows] = cells[d].of(_matrix(pdf["vec"].iloc[rows]) @ projection(d))
            yield pdf.assign(cell=cell)

    return df.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", cell int")


def _searched(points: DataFrame, asked: DataFrame, k: int, confidence: float, block_rows: int, chunk_queries: int) -> DataFrame:
    """``(rep, id, score)``: what each query of ``asked (rep, vec, d, cell, bound)`` finds in the rows of its cell. Both sides are dealt in blocks of bounded size; each chunk of a cell's queries meets each block of its rows."""
    groups = ["d", "cell"]
    parts = points.groupBy(*groups).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    chunks = asked.groupBy(*groups).agg(F.ceil(F.count("*") / chunk_queries).cast("int").alias("chunks"))
    sizes = stored(parts.join(chunks, groups), "cells")  # small enough for a broadcast unless lengths of vectors abound; Spark looks at its size
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = points.join(sizes, groups).select("d", "cell", "id", "vec", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), every("chunks").alias("chunk"))
    right = asked.join(sizes, groups).select("d", "cell", "rep", "vec", "bound", F.pmod(F.xxhash64("rep"), "chunks").cast("int").alias("chunk"), every("parts").alias("part"))
    stop = chi_square_quantile(confidence, PROJECTED)

    def search(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(rows) and len(own):
            rows, own = rows.sort_values("id"), own.sort_values("rep")
            block = Block(rows["id"].to_numpy(np.int64), _matrix(rows["vec"]))
            for rep, q, bound in zip(own["rep"].tolist(), _matrix(own["vec"]), own["bound"].tolist()):
                i, d = block.search(q, k, stop, bound)
                found.append((np.full(len(i), rep), i, d))
        return pd.DataFrame({name: np.concatenate([f[n] for f in found]) for n, name in enumerate(("rep", "id", "score"))})

    keys = ["d", "cell", "part", "chunk"]
    out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "rep long, id long, score double")
    return _best(out, "rep", "id", k)


def _best(df: DataFrame, of: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows of least score of each ``of`` with their rank; tasks keep no more than that before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(of).orderBy("score", tie))).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, confidence: float = CONFIDENCE, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` its ``k`` nearest rows of ``vectors`` by Euclidean distance in double precision, its own id aside, nearest first, ties to the smaller id.

    Rows are projected to PROJECTED dimensions and dealt into the cells of a kd-tree. A query searches its own cell first,
    then those other cells whose region lies within the radius that its k-th distance and the chi-square quantile of
    ``confidence`` give. Within a cell it takes leaves in order of their distance, verifies on the original vectors the rows
    that project into the radius, and stops when no leaf is left within it: a neighbour nearer than the k-th found lies
    behind the rows seen with probability 1 - ``confidence`` at most. Every row is indexed; only copies of a vector beyond the
    k + 1 of least id, which no query could return, are left out. Equal queries are searched once.

    Rows without id, with a null vector, null or non-finite components or only zeros take no part. Vectors of different
    length never meet. Fewer candidates than ``k``: all of them. Repeated rows of one id count once where they are equal.
    Empty tables: no rows. Other columns aren't read.
    """
    fewest = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    points = usable(vectors, id_col, vector_col).withColumn("n", fewest).where(F.col("n") <= k + 1).select("id", "vec", F.size("vec").alias("d"))
    points = stored(points, "points")
    cells = fit_cells(points, block_rows=block_rows)
    points = stored(_placed(points, cells), "placed") if cells else points.withColumn("cell", F.lit(0))

    given = stored(usable(queries, id_col, vector_col), "queries")
    reps = stored(given.groupBy("vec").agg(F.min("id").alias("rep")), "distinct-queries")
    asked = _placed(reps.select("rep", "vec", F.size("vec").alias("d")), cells) if cells else reps.select("rep", "vec", F.size("vec").alias("d"), F.lit(0).alias("cell"))
    asked = stored(asked.withColumn("bound", F.lit(float("inf"))), "asked")
    options = (k + 1, confidence, block_rows, chunk_queries)
    found = stored(_searched(points, asked, *options), "own-cell")
    if cells:
        reached = found.groupBy("rep").agg(F.max("score").alias("far"), F.count("*").alias("n"))
        reached = asked.drop("bound").join(reached.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r"), "left").drop("r")
        reached = reached.withColumn("bound", F.when(F.col("n") > k, F.col("far")).otherwise(float("inf"))).drop("far", "n")
        more = stored(_searched(points, stored(_routed(reached, cells, chi_square_quantile(confidence, PROJECTED)), "routed"), *options), "other-cells")
        found = _best(found.drop("rank").unionByName(more.drop("rank")), "rep", "id", k + 1)
    # the queries of one vector, however many, share a handful of answers
    of_query = stored(given.join(reps.withColumnRenamed("vec", "v"), F.col("vec") == F.col("v")).select(F.col("id").alias("query_id"), "rep"), "query-ids")
    each = of_query.join(stored(found.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near")), "found"), "rep")
    each = each.select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    return each.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def _routed(asked: DataFrame, cells: dict[int, Cells], stop: float) -> DataFrame:
    """A row for each other cell that a query must still search."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            to = []
            for d, v, home, bound in zip(pdf["d"], pdf["vec"], pdf["cell"], pdf["bound"]):
                near = cells[d].near(v @ projection(d), stop * bound * bound) if d in cells else np.zeros(0, np.int64)
                to.append(near[near != home].astype(np.int32))
            yield pdf.assign(to=to)

    wide = asked.select("rep", "vec", "d", "cell", "bound").mapInPandas(run, "rep long, vec array<double>, d int, cell int, bound double, to array<int>")
    return wide.select("rep", "vec", "d", F.explode("to").alias("cell"), "bound")
