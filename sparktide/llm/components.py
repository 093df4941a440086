"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for all nodes of ``edges (a, b)``: the label is the least node of the component.

    Each round maps a node to the least of its neighbours, follows that map twice more, so that chains shrink by a factor,
    and contracts the edges; the maps are composed at the end. Every round is written to the shared folder; the driver only
    learns whether edges are left.
    """
    left = stored(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not maps or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
        further = to.select(F.col("node").alias("of"), F.col("label").alias("next"))
        for _ in range(2):
            to = to.join(further, F.col("label") == F.col("of")).select("node", F.col("next").alias("label"))
        to = stored(to, "labels")
        maps.append(to)
        ends = [to.select(F.col("node").alias(n), F.col("label").alias(label)) for n, label in (("na", "la"), ("nb", "lb"))]
        moved = left.join(ends[0], F.col("a") == F.col("na")).join(ends[1], F.col("b") == F.col("nb")).where(F.col("la") != F.col("lb"))
        left = stored(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
    out = maps[0]
    for to in maps[1:]:
        following = to.select(F.col("node").alias("of"), F.col("label").alias("next"))
        out = out.join(following, F.col("label") == F.col("of"), "left").select("node", F.coalesce("next", "label").alias("label"))
    return stored(out, "components") if len(maps) > 1 else out
