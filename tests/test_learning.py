"""Reliability from daily records that add up."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparktide.plans import research
from sparktide.sources.ranged import RangedTable

KIND = "analyst string, horizon string, semantics_version int, claim_kind string, predicted_direction string, realised string, correct int, predicted_probability double, brier double, on date"


def outcomes(spark, days, seed):
    rng, rows = random.Random(seed), []
    for d in days:
        for _ in range(40):
            said, was, p = rng.choice(["up", "down", None]), rng.choice(["up", "down", "flat"]), rng.choice([None, 0.5, 0.7])
            hit = int(said == was)
            rows.append((rng.choice("ab"), rng.choice(["short", "long"]), rng.choice([1, 2, 2, 2]), rng.choice(["direction", "direction", "risk"]), said, was, hit, p, None if p is None else (p - hit) ** 2, date(2024, 1, 1) + timedelta(days=d)))
    return spark.createDataFrame(rows, KIND)


def rows(df):
    return {(r["analyst"], r["horizon"]): tuple(r)[2:] for r in df.collect()}


def test_days_that_are_added_equal_all_outcomes(spark, tmp_path):
    records = RangedTable(spark, str(tmp_path / "r"), "day", most_rows=10)
    first, second = outcomes(spark, range(5), 1), outcomes(spark, range(5, 7), 2)
    research.learn(records, first, "on", 0)
    before = {e["low"]: e["at"] for e in records.manifest()}
    research.learn(records, second, "on", 1)
    after = {e["low"]: e["at"] for e in records.manifest()}
    assert sum(after.get(low) == at for low, at in before.items()) >= len(before) - 1 >= 1  # only the last range was written again
    research.learn(records, second, "on", 1)  # a batch that comes twice
    research.learn(records, second.where("on = date'2024-01-06'"), "on")  # and a day that comes again
    got, want = rows(research.performance_of(records.read())), rows(research.performance(first.unionByName(second)))
    assert got.keys() == want.keys() and len(want) == 4
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_outcomes_are_split_between_days(spark, tmp_path):
    """Outcomes all around the clock, the newest at noon: no day lies on both sides, so none is replaced by a part of it."""
    at = F.timestamp_add("HOUR", F.pmod(F.xxhash64("analyst", "horizon", "realised", "brier"), F.lit(24)).cast("int"), F.col("on").cast("timestamp"))
    all_days = outcomes(spark, range(12), 3).withColumn("at", at).where(F.col("at") <= F.lit(datetime(2024, 1, 12, 12)))
    older, newer = research.split_days(all_days, "at", 7)
    records = RangedTable(spark, str(tmp_path / "r"), "day")
    research.learn(records, older, "at")
    research.learn(records, newer, "at")
    days = lambda df: {r[0] for r in df.select(F.to_date("at")).distinct().collect()}
    assert len(days(newer)) == 7 and not days(older) & days(newer)
    got, want = rows(research.performance_of(records.read())), rows(research.performance(all_days))
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)
