"""Interval joins against the comparison of all with all."""

import random

import pytest
from pyspark.sql import functions as F

from sparktide.operators import intervals


def made(spark, seed, n=300):
    rng = random.Random(seed)
    one = lambda: (lambda low: (low, low + rng.choice([-3.0, 0.0, 0.5, 3.0, 40.0, 900.0, 1e6])))(round(rng.uniform(-100, 100), 1))
    points = [(rng.choice([None, 1, 2]), rng.choice([None, round(rng.uniform(-120, 1200), 1), 7.0, 7.0]), i) for i in range(n)]
    spans = [(rng.choice([None, 1, 2]), *one(), i) for i in range(n)] + [(1, None, 5.0, -1), (1, 5.0, None, -2), (1, 0.0, 7.0, -3), (1, 7.0, 9.0, -4)]
    return spark.createDataFrame(points, "k int, at double, p int"), spark.createDataFrame(spans, "k int, low double, high double, s int")


def pairs(df):
    rows = [(r["p"], r["s"]) for r in df.select("p", "s").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("hot_rows", [10**6, 5])
@pytest.mark.parametrize("keyed", [True, False])
def test_points_in_intervals(spark, keyed, hot_rows):
    points, spans = made(spark, hot_rows)
    spans = spans if keyed else spans.drop("k")
    got = intervals.points_in(points, spans, "at", "low", "high", key=["k"] if keyed else [], hot_rows=hot_rows)
    given, among = points.collect(), spans.collect()
    want = [(p["p"], s["s"]) for p in given for s in among if None not in (p["at"], s["low"], s["high"]) and s["low"] <= p["at"] < s["high"] and (not keyed or p["k"] == s["k"])]
    assert pairs(got) == set(want) and len(want) > 500


def test_overlapping_intervals(spark):
    _, a = made(spark, 1, 120)
    _, b = made(spark, 2, 120)
    left = a.withColumnsRenamed({"low": "a_low", "high": "a_high", "s": "p"})
    got = intervals.overlapping(left, b, "a_low", "a_high", "low", "high", key=["k"])
    real = lambda r: None not in (r["low"], r["high"]) and r["high"] > r["low"]
    ours, theirs = list(filter(real, a.collect())), list(filter(real, b.collect()))
    want = {(x["s"], y["s"]) for x in ours for y in theirs if x["k"] == y["k"] and x["low"] < y["high"] and y["low"] < x["high"]}
    assert pairs(got) == want


def test_overlapping_intervals_of_any_length(spark):
    """Empty and reversed ones meet those that they lie inside, as the comparison of ends says."""
    _, a = made(spark, 4, 120)
    _, b = made(spark, 5, 120)
    left = a.withColumnsRenamed({"low": "a_low", "high": "a_high", "s": "p"})
    got = intervals.overlapping(left, b, "a_low", "a_high", "low", "high", key=["k"], any_length=True)
    known = lambda r: None not in (r["low"], r["high"])
    want = {(x["s"], y["s"]) for x in filter(known, a.collect()) for y in filter(known, b.collect()) if x["k"] == y["k"] and x["low"] < y["high"] and y["low"] < x["high"]}
    assert pairs(got) == want and any(p >= 0 for p, _ in want)


def test_a_long_interval_isnt_repeated_over_short_bins(spark):
    spans = spark.range(1000).select(F.col("id").cast("double").alias("low"), (F.col("id") + 1).cast("double").alias("high")).unionByName(spark.createDataFrame([(-1e9, 1e9)], "low double, high double"))
    points = spark.range(0, 1000, 10).select((F.col("id") + 0.5).alias("at"))
    got = intervals.points_in(points, spans, "at", "low", "high")
    assert got.count() == 200
    width = intervals.usual_length(spans, "low", "high")
    bins = spans.select(F.size(F.sequence(intervals._bin(F.col("low"), intervals._level("low", "high", width), width), intervals._bin(F.col("high"), intervals._level("low", "high", width), width))).alias("n"))
    assert width == 1.0 and bins.agg(F.max("n")).first()[0] <= 3


def test_empty_sides(spark):
    points, spans = made(spark, 3)
    for p, s in ((points.limit(0), spans), (points, spans.limit(0)), (points, spans.where("s = -1"))):
        assert intervals.points_in(p, s, "at", "low", "high", key=["k"]).count() == 0
