"""Segmented scans against plain windows on series of very unequal length."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparktide.operators import metrics, scan


@pytest.fixture(scope="module")
def bars(spark):
    """60 stocks of a few hundred days with gaps, a null one, and one stock with half of all rows."""
    rng, rows = random.Random(3), []
    for stock in [*range(60), None]:
        day = rng.randrange(-500, 9000)
        for _ in range(rng.choice([0, 1, 2, 21, 200, 400, 700])):
            day += rng.choice([1, 1, 1, 2, 5, 40, 400])
            rows.append((stock, day, 50 + rng.random() * 9, rng.choice([None, 0.0, 5.0, 9.0])))
    day = -20_000
    for _ in range(len(rows)):
        day += rng.choice([1, 1, 1, 3, 60])
        rows.append((1000, day, 50 + rng.random() * 9, 7.0))
    df = spark.createDataFrame(rows, "stock_id long, dn int, price double, volume double")
    return df.withColumns({"day": F.date_from_unix_date("dn"), "daily_variation": F.lit(0.5)}).repartition(6).cache()


def same(a, b, key):
    a, b = ({tuple(r[k] for k in key): r.asDict() for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys() and len(a) > 0
    for k, row in a.items():
        for name, value in row.items():
            assert b[k][name] == (pytest.approx(value, rel=1e-9, abs=1e-9) if isinstance(value, float) else value), (k, name)


def test_chunks_give_what_whole_series_give(bars):
    """The same metrics from chunks of some hundred rows as from chunks that no series fills."""
    same(metrics.metrics_history(bars, chunk_rows=430), metrics.metrics_history(bars, chunk_rows=10**9), ("stock_id", "dn"))


def test_whole_series_are_those_of_plain_windows(bars):
    w = Window.partitionBy("stock_id").orderBy("dn")
    plain = bars.select("stock_id", "dn", F.row_number().over(w).alias("n_days"), F.avg("price").over(w.rowsBetween(-199, 0)).alias("mean"), F.last("price").over(w.rangeBetween(Window.unboundedPreceding, -90)).alias("anchor"), F.max("price").over(w.rowsBetween(-364, 0)).alias("high"))
    rows = scan.chunked(bars, "stock_id", "dn", 365, chunk_rows=500)
    c = Window.partitionBy("stock_id", "__chunk").orderBy("dn")
    first = F.min("__before").over(Window.partitionBy("stock_id", "__chunk"))
    cut = rows.select("stock_id", "dn", "__halo", (first + F.row_number().over(c)).cast("int").alias("n_days"), F.avg("price").over(c.rowsBetween(-199, 0)).alias("mean"), F.last("price").over(c.rangeBetween(Window.unboundedPreceding, -90)).alias("anchor"), F.max("price").over(c.rowsBetween(-364, 0)).alias("high"))
    same(plain, cut.where("not __halo").drop("__halo"), ("stock_id", "dn"))


def test_no_chunk_holds_much_more_than_asked_for(bars):
    sizes = [r["count"] for r in scan.chunked(bars, "stock_id", "dn", 365, chunk_rows=500).groupBy("stock_id", "__chunk").count().collect()]
    assert max(sizes) <= 500 + 365 + 3 * scan.CELL_DAYS and bars.where("stock_id = 1000").count() > 4 * 500
    with pytest.raises(ValueError):
        scan.chunked(bars, "stock_id", "dn", 490, chunk_rows=500)


def test_last_days_need_the_last_rows_only(bars):
    history = metrics.metrics_history(bars, chunk_rows=10**9)
    newest = Window.partitionBy("stock_id").orderBy(F.desc("dn"))
    last = history.withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k")
    got = metrics.latest_metrics(bars)
    same(got.drop("day"), last.withColumn("day", F.col("day")).select(*[c for c in got.columns if c != "day"]), ("stock_id",))
    assert scan.tail(bars, "stock_id", "dn", 366).where("stock_id = 1000").count() <= 366 + scan.CELL_DAYS


@pytest.mark.parametrize("cell_days", [1, 7, 64, 10**6])
def test_as_of_by_cells_is_that_of_one_window(spark, bars, cell_days):
    rng = random.Random(cell_days)
    probes = [(rng.choice([None, 1000, 5000, *range(60)]), rng.choice([None, rng.randrange(-21_000, 60_000)]), k) for k in range(800)]
    probes = spark.createDataFrame(probes, "stock_id long, dn int, probe long")
    got = {r["probe"]: r["quote"] and r["quote"]["price"] for r in scan.last_before(probes, bars, "stock_id", "dn", ["price"], cell_days=cell_days).collect()}
    q = bars.select(F.col("stock_id").alias("of"), F.col("dn").alias("at"), "price")
    want = probes.join(q, F.col("stock_id").eqNullSafe(F.col("of")) & (F.col("at") <= F.col("dn")), "left").groupBy("probe").agg(F.max_by("price", "at").alias("price"))
    assert got == {r["probe"]: r["price"] for r in want.collect()} and len(got) == 800


def test_empty_tables(spark, bars):
    none = bars.limit(0)
    assert metrics.metrics_history(none).count() == 0 and metrics.latest_metrics(none).count() == 0
    assert scan.last_before(none.select("stock_id", "dn"), bars, "stock_id", "dn", ["price"]).count() == 0
    probes = bars.select("stock_id", "dn").limit(5)
    assert scan.last_before(probes, none, "stock_id", "dn", ["price"]).where("quote is null").count() == 5


def test_bars_take_the_last_value_of_each_column(spark):
    rows = [(1, "2024-01-01 10:00:00", 1, 5.0, None, 1.0), (1, "2024-01-01 10:00:00", 2, 6.0, 0.1, None), (1, "2024-01-01 09:00:00", 9, 7.0, 0.7, 9.0), (1, "2024-01-02 00:00:00", -5, None, 1.0, 1.0), (2, "1969-12-31 23:59:59", 2**62, 1.0, None, None), (2, "1969-12-31 23:59:59", -(2**62), 2.0, 3.0, None)]
    prices = spark.createDataFrame(rows, "stock_id long, at string, seq long, current_price double, daily_variation double, volume double").withColumn("observed_at", F.to_timestamp("at"))
    got = sorted((r["stock_id"], str(r["day"]), r["price"], r["daily_variation"], r["volume"]) for r in metrics.daily_bars(prices).collect())
    assert got == [(1, "2024-01-01", 6.0, 0.1, 1.0), (2, "1969-12-31", 1.0, 3.0, None)]


def test_long_frames_from_short_ones(bars):
    """Ranges and the long mean against the frames that they stand for."""
    w = Window.partitionBy("stock_id").orderBy("dn")
    frame = lambda f, n, least: F.when(F.row_number().over(w) >= least, f.over(w.rowsBetween(1 - n, 0)))
    price = {"support": (F.min("price"), 90, 20), "resistance": (F.max("price"), 90, 20), "week52_high": (F.max("price"), 365, 120), "week52_low": (F.min("price"), 365, 120), "ma200": (F.avg("price"), 200, 200)}
    plain = bars.select("stock_id", "dn", *(frame(*x).alias(name) for name, x in price.items()))
    same(plain, metrics.metrics_history(bars, chunk_rows=500), ("stock_id", "dn"))


def test_batches_of_a_task_cut_no_chunk(monkeypatch):
    """The same metrics whether a task takes its rows at once or some at a time, and no frame that goes through its rows for each row."""
    import pyarrow as pa

    rng, rows = random.Random(5), []
    for stock in (None, 1, 2, 3):
        rows += [(stock, 9000 + 2 * i, 50 + rng.random() * 9, rng.choice([None, 0.0, 5.0]), 7 if stock == 2 else 0, 0, i < 3 and stock == 2) for i in range(rng.choice([1, 150, 220]))]
    table = pa.table(dict(zip(("stock_id", "dn", "price", "volume", "__before", "__chunk", "__halo"), zip(*rows))))
    whole = pa.Table.from_batches(metrics._by_chunk(iter(table.to_batches())))
    monkeypatch.setattr(metrics, "TASK_ROWS", 40)
    assert pa.Table.from_batches(metrics._by_chunk(iter(table.to_batches(max_chunksize=17)))).equals(whole) and whole.num_rows == len(rows) - sum(r[-1] for r in rows)


def test_last_days_take_one_pass_and_one_sort(bars):
    """Bars are read once, meet their stock by one exchange, and one window ranks them: no count of rows beside them, no join, no second order."""
    plan = metrics.latest_metrics(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == plan.count("Exchange hashpartitioning") == plan.count("Window [") == 1 and "Join" not in plan


def test_the_state_reads_its_bars_once(spark):
    """The metrics that the cross sections read again are a table by then."""
    from sparktide.plans import market
    from sparktide.queries_core import NOW, bars_of, stocks_of
    from sparktide.sources.views import view

    folder = "/root/testdata/sf0.001"
    state = market.market_state(bars_of(spark, folder), stocks_of(spark, folder), view(spark, folder, "news"), F.to_timestamp(F.lit(NOW)))
    assert "lineitem.parquet" not in " ".join(state.inputFiles())


def test_history_has_no_sliding_frames(bars):
    assert "specifiedwindowframe(RowFrame, -" not in metrics.metrics_history(bars)._jdf.queryExecution().optimizedPlan().toString()


def test_returns_of_bars_are_those_of_the_as_of_pass(bars):
    from sparktide.plans import market

    some = bars.where("stock_id is not null")
    days = market.calendar(some)
    same(market.bar_returns(some, days, 10), market.forward_returns(some, days, 10, some.select("stock_id", "dn")), ("stock_id", "dn"))
