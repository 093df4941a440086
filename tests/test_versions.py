"""Results kept by digests of their input's parts."""

import pytest
from pyspark.sql import functions as F

from sparktide.operators.metrics import daily_bars, distances, latest_metrics
from sparktide.plans import market
from sparktide.sources.versions import PartedResult, files_version, part_of
from sparktide.sources.views import view

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_metrics_are_computed_again_where_prices_changed(spark, tmp_path):
    prices = view(spark, SF, "prices")
    kept = market.kept_metrics(spark, str(tmp_path / "m"), parts=8)
    seen, compute = [], kept.compute
    kept.compute = lambda x: seen.append(x["prices"].count()) or compute(x)
    whole = lambda p: rows(distances(latest_metrics(daily_bars(p))))
    present = prices.select(part_of("stock_id", 8)).distinct().count()
    assert len(kept.refresh({"prices": prices})) == present > 2 and rows(kept.read()) == whole(prices)
    assert kept.refresh({"prices": prices.repartition(3)}) == [] and len(seen) == 1  # other order, same rows
    stock = prices.select("stock_id").first()[0]
    changed = prices.withColumn("current_price", F.when(F.col("stock_id") == stock, F.col("current_price") + 1).otherwise(F.col("current_price")))
    (part,) = kept.refresh({"prices": changed})
    assert part == prices.where(F.col("stock_id") == stock).select(part_of("stock_id", 8)).first()[0]
    assert seen[-1] == changed.where(part_of("stock_id", 8) == part).count() < prices.count() / 2
    assert rows(kept.read()) == whole(changed)
    assert rows(kept.compacted(str(tmp_path / "one")).read()) == whole(changed)


def test_a_known_version_reads_nothing(spark, tmp_path):
    def never(inputs):
        raise AssertionError("read")

    source = str(tmp_path / "in")
    spark.range(20).withColumnRenamed("id", "k").write.parquet(source)
    kept = PartedResult(spark, str(tmp_path / "r"), "k", lambda x: x["t"].withColumn("v", F.col("k") * 2), parts=4)
    assert kept.refresh({"t": spark.read.parquet(source)}, files_version(spark, source)) == [0, 1, 2, 3]
    kept.compute = never
    assert kept.refresh({}, files_version(spark, source)) == []
    spark.range(20, 21).withColumnRenamed("id", "k").write.mode("append").parquet(source)
    kept.compute = lambda x: x["t"].withColumn("v", F.col("k") * 2)
    assert len(kept.refresh({"t": spark.read.parquet(source)}, files_version(spark, source))) == 1
    assert sorted(tuple(r) for r in kept.read().collect()) == [(k, 2 * k) for k in range(21)]


def test_keys_that_go_repeated_rows_and_failures(spark, tmp_path):
    make = lambda *x: {"t": spark.createDataFrame(list(x), "k long, v string")}
    kept = PartedResult(spark, str(tmp_path / "r"), "k", lambda x: x["t"].groupBy("k").agg(F.count("*").alias("n")), parts=16)
    with pytest.raises(ValueError):
        kept.read()
    kept.refresh(make((1, "a"), (2, "b"), (None, None)))
    assert rows(kept.read()) == ["Row(k=1, n=1)", "Row(k=2, n=1)", "Row(k=None, n=1)"]
    assert len(kept.refresh(make((1, "a"), (1, "a"), (None, None)))) == 1  # a row twice is another input, a key that is gone needs no computing
    assert rows(kept.read()) == ["Row(k=1, n=2)", "Row(k=None, n=1)"]
    good, kept.compute = kept.compute, lambda x: x["t"].select("k", F.raise_error(F.lit("no")).alias("n"))
    with pytest.raises(Exception, match="no"):
        kept.refresh(make((1, "z")))
    assert rows(kept.read()) == ["Row(k=1, n=2)", "Row(k=None, n=1)"]
    kept.compute = good
    kept.refresh(make((1, "z")))
    assert rows(kept.read()) == ["Row(k=1, n=1)"]


def test_no_rows(spark, tmp_path):
    kept = PartedResult(spark, str(tmp_path / "r"), "k", lambda x: x["t"])
    assert kept.refresh({"t": spark.createDataFrame([], "k long")}) == [] and len(kept.manifest()) == 1


def test_a_part_is_written_in_few_files(spark, tmp_path):
    """Rows that come in many tasks don't leave a file of each task in each part."""
    rows = spark.range(0, 4000, 1, 40).withColumnRenamed("id", "k")
    kept = PartedResult(spark, str(tmp_path / "r"), "k", lambda x: x["t"], parts=8)
    assert kept.refresh({"t": rows}) == list(range(8)) and kept.read().count() == 4000
    assert len(list((tmp_path / "r" / "rows-0").glob("*/*.parquet"))) == 8
    kept.compacted(str(tmp_path / "one"))
    assert len(list((tmp_path / "one" / "rows-0").glob("*/*.parquet"))) == 8
