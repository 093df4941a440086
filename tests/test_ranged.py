"""Tables in ranges: merges rewrite the parts they touch, and equal the merge of whole tables."""

import random

import pytest
from pyspark.sql import functions as F

from sparktide.sources import state
from sparktide.sources.ranged import RangedTable, newest_of

KIND = "k long, at long, v string"


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_a_merge_into_one_range_writes_one_part(spark, tmp_path):
    first = spark.range(2000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("at"), F.lit("old").alias("v"))
    table = RangedTable(spark, str(tmp_path / "t"), "k", most_rows=200)
    assert table.create(first) == 10
    before, snapshot = table.read(), {e["part"]: e["at"] for e in table.manifest()}
    some = spark.range(300, 320).select(F.col("id").alias("k"), F.lit(2).cast("long").alias("at"), F.lit("new").alias("v"))
    change = lambda old, new: state.upsert_replace(old, new, ["k"], [F.desc("at")])
    (part,) = table.merge(some, change)
    after = {e["part"]: e["at"] for e in table.manifest()}
    assert [p for p in after if after[p] != snapshot[p]] == [part] and len(table.vacuum_paths()) == 1
    assert rows(table.read()) == rows(change(first, some)) and before.where("v = 'new'").count() == 0  # a reader of the old epoch sees the old table
    assert table.merge(some.limit(0), change) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_of_all_kinds_equal_whole_tables(spark, tmp_path, seed):
    rng = random.Random(seed)
    change = newest_of(["k"], [F.desc_nulls_last("at"), F.desc("v")])
    make = lambda n: spark.createDataFrame([(rng.choice([None, *range(-50, 50), 10**12]), rng.choice([None, *range(9)]), rng.choice("abc")) for _ in range(n)], KIND)
    table, whole = RangedTable(spark, str(tmp_path / "t"), "k", most_rows=15), spark.createDataFrame([], KIND)
    for epoch in range(4):
        new = make(rng.choice([5, 60])).cache()
        table.merge(new, change, epoch)
        whole = change(whole, new)
        assert table.merge(make(3), change, epoch) == []  # a repeated batch
        assert rows(table.read()) == rows(whole)
    assert all(e["n"] <= 15 for e in table.manifest()) and sum(e["n"] for e in table.manifest()) == whole.count()


def test_text_ranges_deletes_and_failures(spark, tmp_path):
    table = RangedTable(spark, str(tmp_path / "t"), "v", most_rows=4)
    with pytest.raises(ValueError):
        table.read()
    table.create(spark.createDataFrame([(i, i, c) for i, c in enumerate("abcdefghijkl")], KIND))
    gone = lambda old, new: old.join(new.select("v"), "v", "left_anti")
    table.merge(spark.createDataFrame([(0, 0, "a"), (0, 0, "l")], KIND), gone)
    assert [r["v"] for r in table.read().orderBy("v").collect()] == list("bcdefghijk")
    with pytest.raises(Exception, match="no"):
        table.merge(spark.createDataFrame([(0, 0, "c")], KIND), lambda old, new: old.withColumn("v", F.raise_error(F.lit("no")).cast("string")))
    assert table.read().count() == 10
    empty = RangedTable(spark, str(tmp_path / "e"), "k")
    empty.create(spark.createDataFrame([], KIND))
    assert empty.read().count() == 0 and empty.merge(spark.createDataFrame([(None, 1, "x")], KIND), newest_of(["k"], [F.desc("at")])) == [0] and empty.read().count() == 1
