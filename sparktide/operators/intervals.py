"""Interval joins: points in intervals, and intervals that overlap, by equal bins on levels of length instead of comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one bin on the side of the points from which on the bin is dealt to several tasks, and such shares at most.
HOT_ROWS, MOST_SHARES = 100_000, 256


def _level(low: str, high: str, width: float) -> Column:
    """The least k with ``width * 2^k`` at least the interval's length, 0 for short ones."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((F.col(high) - F.col(low)) / F.lit(width), F.lit(1.0))))).cast("int")


def _bin(value: Column, level: Column, width: float) -> Column:
    return F.floor(value / (F.lit(width) * F.pow(F.lit(2.0), level))).cast("long")


def usual_length(intervals: DataFrame, low: str, high: str) -> float:
    """The median length of the intervals that have one, which makes the narrowest bins; 1 where there is none."""
    length = F.col(high) - F.col(low)
    (median,) = intervals.where(length > 0).agg(F.percentile_approx(length.cast("double"), 0.5, 1000)).first()
    return float(median or 1.0)


def points_in(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, *, key: list[str] = (), width: float | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every point with every interval of its ``key`` for which ``low <= at < high``: the columns of both, the key's once.

    An interval lies in the two or three bins of its level that it touches, whose width is between its length and twice that, or the
    narrowest; a point looks into one bin of each level that occurs. So a long interval isn't repeated over short bins, and the
    work is points times levels. Points of a bin with more than ``hot_rows`` of them are dealt to shares, to each of which the bin's
    intervals go. ``at``, ``low`` and ``high`` are numbers; nulls, empty and reversed intervals meet nothing; null keys meet
    null keys; repeated rows meet each on their own. Names of the two sides must differ but for the key's.
    """
    key = list(key)
    known = intervals.where(F.col(high) > F.col(low))
    width = usual_length(known, low, high) if width is None else width
    level = _level(low, high, width)
    placed = known.withColumn("__level", level).withColumn("__bin", F.explode(F.sequence(_bin(F.col(low), F.col("__level"), width), _bin(F.col(high), F.col("__level"), width))))
    levels = known.select(level.alias("__level")).distinct()  # a level for each power of two between the shortest and the longest
    asked = points.where(F.col(at).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("__bin", _bin(F.col(at), F.col("__level"), width))
    where = ["__level", "__bin", *key]
    hot = asked.groupBy(*where).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    hot = hot.select(*(F.col(c).alias(f"__of_{c}") for c in where), F.least(F.ceil(F.col("__n") / hot_rows), F.lit(MOST_SHARES)).cast("int").alias("__shares"))
    same = lambda df: [df[c].eqNullSafe(F.col(f"__of_{c}")) for c in where]
    drop = [f"__of_{c}" for c in where]
    asked = asked.join(hot, same(asked), "left").withColumn("__share", F.coalesce(F.pmod(F.xxhash64(*points.columns, F.monotonically_increasing_id()), F.col("__shares")), F.lit(0)).cast("int")).drop("__shares", *drop)
    placed = placed.join(hot, same(placed), "left").withColumn("__share", F.explode(F.sequence(F.lit(0), F.coalesce("__shares", F.lit(1)) - 1))).drop("__shares", *drop)
    right = placed.select(*(F.col(c).alias(f"__r_{c}") for c in (*where, "__share")), *(c for c in intervals.columns if c not in key))
    met = asked.join(right, [*(asked[c].eqNullSafe(F.col(f"__r_{c}")) for c in key), *(asked[c] == F.col(f"__r_{c}") for c in ("__level", "__bin", "__share"))])
    met = met.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high)))
    return met.select(*points.columns, *(c for c in intervals.columns if c not in key))


def overlapping(a: DataFrame, b: DataFrame, a_low: str, a_high: str, b_low: str, b_high: str, *, key: list[str] = (), any_length: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every two intervals of one key, one of each side, that share more than an end.

    Two intervals overlap if one of them begins within the other; where both begin at once the pair is taken from the left side only. So
    it is two joins of points, each with its own levels, and no pair is found twice. Else as ``points_in``. With ``any_length`` each
    side must only begin before the other ends: empty and reversed intervals then meet the ones that they lie inside.
    """
    proper = lambda df, low, high: df if any_length else df.where(F.col(high) > F.col(low))
    left, right = proper(a, a_low, a_high), proper(b, b_low, b_high)
    begins_in_b = points_in(left, right, a_low, b_low, b_high, key=key, hot_rows=hot_rows).where(F.col(b_low) < F.col(a_high))
    begins_in_a = points_in(right, left, b_low, a_low, a_high, key=key, hot_rows=hot_rows).where((F.col(b_low) > F.col(a_low)) & (F.col(a_low) < F.col(b_high)))
    return begins_in_b.unionByName(begins_in_a)
