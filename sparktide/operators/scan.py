"""Segmented scans: windows over long series cut into chunks, so that no key's series has to fit one task.

A series is counted in cells of some days first. Cells are joined into chunks of about as many rows, and the cells at a
chunk's end, with as many rows as a frame looks back, also go to the next chunk as its halo. Windows then run over (key, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a cell, and rows of a chunk at least but for the last one.
CELL_DAYS, CHUNK_ROWS = 64, 4096


def _cell(at: str, cell_days: int) -> Column:
    return F.floor(F.col(at) / cell_days).cast("int")


def cells(rows: DataFrame, key: str, at: str, cell_days: int = CELL_DAYS) -> DataFrame:
    """``(key, cell, n, before, total)``: rows of each cell of a series, rows before it, and rows of the whole series. The windows see cells only."""
    counted = rows.groupBy(key, _cell(at, cell_days).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    before = F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumns({"before": F.coalesce(before, F.lit(0)), "total": F.sum("n").over(w)})


def chunked(rows: DataFrame, key: str, at: str, halo: int, *, cell_days: int = CELL_DAYS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows`` with ``__chunk``, ``__before`` (rows of the series before the row's cell) and ``__halo``: whether the row only stands before its chunk for others to look back at.

    ``rows`` has at most one row for each key and number of day ``at``. Each chunk has the last ``halo`` rows before it, and
    more where a cell holds more, or all there are. ``halo`` is at most ``chunk_rows`` less a cell, so that a chunk is
    the halo of the next one only. Null keys are a series of their own; rows without ``at`` go.
    """
    if halo + cell_days > chunk_rows:
        raise ValueError("a chunk must hold the halo of the next one")
    rows = rows.where(F.col(at).isNotNull())
    of = cells(rows, key, at, cell_days).withColumn("__chunk", F.floor(F.col("before") / chunk_rows).cast("int"))
    ends = F.max(F.col("before") + F.col("n")).over(Window.partitionBy(key, "__chunk"))
    last = F.col("ends") - F.col("before") - F.col("n") < halo
    of = of.withColumn("ends", ends).select(
        F.col(key).alias("__key"), F.col("cell").alias("__cell"), F.col("before").alias("__before"),
        F.when(last & (F.col("ends") < F.col("total")), F.array(F.struct("__chunk", F.lit(False).alias("__halo")), F.struct((F.col("__chunk") + 1).alias("__chunk"), F.lit(True).alias("__halo"))))
        .otherwise(F.array(F.struct("__chunk", F.lit(False).alias("__halo")))).alias("__to"),
    )
    placed = rows.join(of, F.col(key).eqNullSafe(F.col("__key")) & (_cell(at, cell_days) == F.col("__cell")))
    return placed.select(*rows.columns, "__before", F.explode("__to").alias("__t")).select(*rows.columns, "__before", "__t.*")


def tail(rows: DataFrame, key: str, at: str, least: int, *, cell_days: int = CELL_DAYS) -> DataFrame:
    """The last ``least`` rows of each series, or all there are, and what else is in their cells, with ``__total``: rows of the whole series."""
    rows = rows.where(F.col(at).isNotNull())
    of = cells(rows, key, at, cell_days).where(F.col("total") - F.col("before") - F.col("n") < least)
    of = of.select(F.col(key).alias("__key"), F.col("cell").alias("__cell"), F.col("total").alias("__total"))
    return rows.join(of, F.col(key).eqNullSafe(F.col("__key")) & (_cell(at, cell_days) == F.col("__cell"))).drop("__key", "__cell")


def last_before(probes: DataFrame, quotes: DataFrame, key: str, at: str, value: list[str], *, cell_days: int = CELL_DAYS) -> DataFrame:
    """Every probe with ``quote``: the struct ``value`` of the last quote of its key at or before its ``at``, null where there is none.

    Each cell of a key takes the last quote of its earlier cells along, so that a task sees one cell: as-of by a union and a
    window over (key, cell), with the carried quote first. The carried quotes are found over cells alone. Of several quotes
    of one ``at`` any may answer. Probes keep their columns; null keys meet null keys, probes without ``at`` get null.
    """
    quote = F.struct(*value)
    q = quotes.where(F.col(at).isNotNull()).select(F.col(key), F.col(at), _cell(at, cell_days).alias("__cell"), quote.alias("quote"))
    kind = q.schema["quote"].dataType
    p = probes.withColumn("__cell", _cell(at, cell_days))
    ends = q.groupBy(key, "__cell").agg(F.max_by("quote", at).alias("quote"))
    asked = p.select(key, "__cell").where("__cell is not null").distinct().withColumn("quote", F.lit(None).cast(kind))
    earlier = Window.partitionBy(key).orderBy("__cell").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__asks", F.lit(False)).unionByName(asked.withColumn("__asks", F.lit(True)))
    carried = carried.withColumn("quote", F.last("quote", ignorenulls=True).over(earlier)).where(F.col("__asks") & F.col("quote").isNotNull()).drop("__asks")
    side = lambda df, n: df.withColumn("__side", F.lit(n))
    first = side(carried.withColumn(at, F.lit(None).cast(q.schema[at].dataType)), 0)
    both = side(p.withColumn("quote", F.lit(None).cast(kind)), 2).unionByName(side(q, 1), allowMissingColumns=True).unionByName(first, allowMissingColumns=True)
    w = Window.partitionBy(key, "__cell").orderBy(F.col(at).asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("quote", F.when(F.col("__cell").isNotNull(), F.last("quote", ignorenulls=True).over(w)))
    return both.where(F.col("__side") == 2).drop("__side", "__cell")
