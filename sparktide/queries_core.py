"""Queries over prices: bars, metrics, market state, backtest. Names begin with the inventory's ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktide.functions.columns import half_even
from sparktide.operators import metrics as M
from sparktide.operators import scoring as S
from sparktide.plans import market
from sparktide.sources.shared import fresh_path, stored
from sparktide.sources.views import view
from sparktide.sql_core import ctes

NOW = "2001-11-05"
QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, so that the order of sums doesn't show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.daily_bars(view(spark, sf_dir, "prices"))


def stocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "stocks")


def state_of(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    now = F.to_timestamp(F.lit(NOW))
    return market.market_state(bars_of(spark, sf_dir) if bars is None else bars, stocks_of(spark, sf_dir), view(spark, sf_dir, "news"), now)


def observations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.backtest(bars_of(spark, sf_dir), stocks_of(spark, sf_dir))


METRICS = ["momentum_1d", "momentum_5d", "momentum_30d", "momentum_90d", "ma20", "ma50", "ma200", "volatility_30d", "volume_anomaly", "support", "resistance", "week52_high", "week52_low"]
FAR = ["drawdown", "support_distance", "resistance_distance", "week52_high_proximity", "week52_low_proximity"]


@query(ctes("stocks", "prices") + "SELECT seq, stock_id, symbol, sector, observed_at, round(current_price, 6) AS current_price, round(daily_variation, 6) AS daily_variation, round(volume, 6) AS volume, source FROM prices JOIN stocks USING (stock_id)")
def a1_price_scan(spark, sf_dir):
    joined = view(spark, sf_dir, "prices").join(stocks_of(spark, sf_dir), "stock_id")
    return rounded(joined.select("seq", "stock_id", "symbol", "sector", "observed_at", "current_price", "daily_variation", "volume", "source"))


@query(ctes("stocks", "prices") + "SELECT symbol, seq, observed_at, round(current_price, 6) AS current_price FROM prices JOIN stocks USING (stock_id) WHERE current_price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY observed_at DESC, seq DESC) <= 180")
def a2_symbol_history(spark, sf_dir):
    w = Window.partitionBy("stock_id").orderBy(F.desc("observed_at"), F.desc("seq"))
    newest = view(spark, sf_dir, "prices").where("current_price is not null").select("stock_id", "seq", "observed_at", "current_price").withColumn("rank", F.row_number().over(w)).where("rank <= 180")
    return rounded(newest.join(stocks_of(spark, sf_dir), "stock_id").select("symbol", "seq", "observed_at", "current_price"))


@query(ctes("bars") + f"SELECT stock_id, day, {r('price', 'daily_variation', 'volume')} FROM bars")
def e1_daily_bars(spark, sf_dir):
    return rounded(bars_of(spark, sf_dir).drop("dn"))


@query(ctes("bars") + "SELECT stock_id, count(DISTINCT day) AS n_days FROM bars GROUP BY 1")
def e2_history_depth(spark, sf_dir):
    return view(spark, sf_dir, "prices").where("current_price is not null").groupBy("stock_id").agg(F.countDistinct(F.to_date("observed_at")).alias("n_days"))


@query(ctes("history") + f"SELECT stock_id, day, n_days, {r(*METRICS, *FAR)} FROM history")
def f16_point_in_time_metrics(spark, sf_dir):
    return rounded(M.distances(M.metrics_history(bars_of(spark, sf_dir))).select("stock_id", "day", "n_days", *METRICS, *FAR))


@query(ctes("latest") + f"SELECT stock_id, day, n_days, {r(*METRICS, *FAR)} FROM latest")
def f1_f10_latest_metrics(spark, sf_dir):
    return rounded(M.distances(M.latest_metrics(bars_of(spark, sf_dir))).select("stock_id", "day", "n_days", *METRICS, *FAR))


@query(ctes("strength") + f"SELECT stock_id, symbol, sector, {r('sector_strength', 'relative_performance_30d')} FROM strength")
def e3_e5_relative_strength(spark, sf_dir):
    out = M.relative_strength(M.latest_metrics(bars_of(spark, sf_dir)), stocks_of(spark, sf_dir))
    return rounded(out.select("stock_id", "symbol", "sector", "sector_strength", "relative_performance_30d"))


@query(ctes("strength") + "SELECT sector, round(avg(momentum_30d), 6) AS momentum, count(*) AS members FROM strength GROUP BY sector")
def e4_sector_table(spark, sf_dir):
    out = M.latest_metrics(bars_of(spark, sf_dir)).join(stocks_of(spark, sf_dir), "stock_id").groupBy("sector").agg(F.avg("momentum_30d").alias("momentum"), F.count("*").alias("members"))
    return rounded(out.orderBy(F.desc_nulls_last("momentum"), "sector"))


MARKET_SQL = """, m AS (SELECT round_even(100.0 * count(*) FILTER (WHERE price > ma50) / nullif(count(*) FILTER (WHERE ma50 IS NOT NULL), 0), 1) AS breadth,
 count(*) FILTER (WHERE daily_variation > 0) AS advancers, count(*) FILTER (WHERE daily_variation < 0) AS decliners, round_even(avg(momentum_30d), 2) AS m30, round_even(avg(momentum_5d), 2) AS m5, count(momentum_30d) AS known, count(*) AS n FROM latest)
SELECT *, CASE WHEN breadth IS NULL OR m30 IS NULL OR known < greatest(3, n // 5) THEN 'indéterminé' WHEN breadth >= 60 AND m30 > 1 THEN 'haussier' WHEN breadth <= 40 AND m30 < -1 THEN 'baissier' ELSE 'neutre' END AS regime FROM m"""


@query(ctes("latest").rstrip() + MARKET_SQL)
def e6_market_regime(spark, sf_dir):
    return market_row(M.latest_metrics(bars_of(spark, sf_dir)))


def market_row(latest: DataFrame) -> DataFrame:
    """Breadth, advancers, decliners, mean momentum and the regime that the rounded values give."""
    out = latest.agg(
        half_even(100 * F.count_if(F.col("price") > F.col("ma50")) / F.nullif(F.count("ma50"), F.lit(0)), 1).alias("breadth"),
        F.count_if(F.col("daily_variation") > 0).alias("advancers"), F.count_if(F.col("daily_variation") < 0).alias("decliners"),
        half_even(F.avg("momentum_30d"), 2).alias("m30"), half_even(F.avg("momentum_5d"), 2).alias("m5"), F.count("momentum_30d").alias("known"), F.count("*").alias("n"),
    )
    unknown = F.col("breadth").isNull() | F.col("m30").isNull() | (F.col("known") < F.greatest(F.lit(3), F.floor(F.col("n") / 5)))
    return out.withColumn("regime", F.when(unknown, "indéterminé").when((F.col("breadth") >= 60) & (F.col("m30") > 1), "haussier").when((F.col("breadth") <= 40) & (F.col("m30") < -1), "baissier").otherwise("neutre"))


STATE_COLS = ["short_score", "medium_score", "long_score", "short_coverage", "medium_coverage", "long_coverage", "short_confidence", "medium_confidence", "long_confidence", "risk", "buy", "avoid"]


@query(ctes("state") + f"SELECT stock_id, symbol, sector, day, {r('price', digits=4)}, {r(*STATE_COLS, digits=2)}, round(0.65 * buy + 0.35 * (100 - avoid), 4) AS watch, recommendation FROM state")
def j19_market_state(spark, sf_dir):
    return _market_columns(state_of(spark, sf_dir))


def _market_columns(state: DataFrame) -> DataFrame:
    out = state.withColumn("price", F.round("price", 4))
    return rounded(out.select("stock_id", "symbol", "sector", "day", "price", *STATE_COLS, (0.65 * F.col("buy") + 0.35 * (100 - F.col("avoid"))).alias("watch"), "recommendation"), 4)


@query(QUERIES["j19_market_state"][1])
def j19_state_kept(spark, sf_dir):
    """The market state from kept metrics: once without the last rows of some stocks, then brought up to date, which computes those stocks' parts again."""
    prices, now = view(spark, sf_dir, "prices"), F.to_timestamp(F.lit(NOW))
    kept = market.kept_metrics(spark, fresh_path(spark, "metrics"))
    kept.refresh({"prices": prices.where("stock_id % 97 <> 5 or seq % 11 <> 3")})
    kept.refresh({"prices": prices})
    state = market.state_of_metrics(kept.read(), stocks_of(spark, sf_dir), view(spark, sf_dir, "news"), now)
    return _market_columns(state)


@query(ctes("state") + "SELECT symbol, sector, buy, risk, short_confidence, recommendation FROM state WHERE buy >= 50")
def c4_opportunities(spark, sf_dir):
    return state_of(spark, sf_dir).where("buy >= 50").select("symbol", "sector", "buy", "risk", "short_confidence", "recommendation").orderBy(F.desc("buy"), "symbol")


@query(ctes("state") + "SELECT symbol, label, trend FROM (SELECT symbol, CASE recommendation WHEN 'STRONG_OPPORTUNITY' THEN 'ACHETER' WHEN 'WATCH' THEN CASE WHEN buy < 55 THEN 'NEUTRE' ELSE 'SURVEILLER' END WHEN 'AVOID' THEN 'ÉVITER' WHEN 'RISKY' THEN 'ÉVITER' ELSE 'NEUTRE' END AS label, CASE WHEN price > ma50 * 1.01 THEN 'haussier' WHEN price < ma50 * 0.99 THEN 'baissier' WHEN ma50 IS NOT NULL THEN 'neutre' END AS trend FROM state)")
def i18_i19_labels(spark, sf_dir):
    from sparktide.functions.columns import trend

    return state_of(spark, sf_dir).select("symbol", "label", trend(F.col("price"), F.col("ma50")).alias("trend"))


@query(ctes("state") + " UNION ALL ".join(f"SELECT symbol, '{h}' AS horizon, '{k}' AS component, round({h}_{k}, 4) AS value FROM state" for h in S.HORIZONS for k in S.WEIGHTS[h]))
def i10_i11_components(spark, sf_dir):
    each = [F.struct(F.lit(h).alias("horizon"), F.lit(k).alias("component"), F.round(F.col(f"{h}_{k}"), 4).alias("value")) for h in S.HORIZONS for k in S.WEIGHTS[h]]
    return state_of(spark, sf_dir).select("symbol", F.explode(F.array(*each)).alias("c")).select("symbol", "c.*")


MOVER_LISTS = (("gainers", "daily_variation DESC"), ("losers", "daily_variation ASC"), ("opportunities", "buy DESC"), ("unusual_volume", "volume_anomaly DESC"))


@query(ctes("state") + " UNION ALL ".join(f"(SELECT '{n}' AS list, symbol, row_number() OVER (ORDER BY {o}, symbol) AS rank FROM state WHERE {o.split()[0]} IS NOT NULL QUALIFY rank <= 5)" for n, o in MOVER_LISTS))
def g1_top_movers(spark, sf_dir):
    state = state_of(spark, sf_dir).select("symbol", "daily_variation", "buy", "volume_anomaly")
    out = None
    for name, order in MOVER_LISTS:
        col, way = order.split()
        key = F.desc(col) if way == "DESC" else F.asc(col)
        top = state.where(F.col(col).isNotNull()).orderBy(key, "symbol").limit(5)
        top = top.withColumns({"list": F.lit(name), "rank": F.row_number().over(Window.orderBy(key, "symbol"))}).select("list", "symbol", "rank")  # five rows
        out = top if out is None else out.unionByName(top)
    return out


@query(ctes("state") + "SELECT sector, symbol, rank FROM (SELECT sector, symbol, row_number() OVER (PARTITION BY sector ORDER BY momentum_30d DESC NULLS LAST, symbol) AS rank FROM state) WHERE rank <= 3")
def g5_top_of_sector(spark, sf_dir):
    latest = M.latest_metrics(bars_of(spark, sf_dir)).join(stocks_of(spark, sf_dir), "stock_id")
    w = Window.partitionBy("sector").orderBy(F.desc_nulls_last("momentum_30d"), "symbol")
    return latest.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("sector", "symbol", "rank")


@query(ctes("strength") + "SELECT sector, row_number() OVER (ORDER BY m DESC NULLS LAST, sector) AS rank_no, rank() OVER (ORDER BY m DESC NULLS LAST) AS rank_ties, dense_rank() OVER (ORDER BY m DESC NULLS LAST) AS rank_dense, ntile(4) OVER (ORDER BY m DESC NULLS LAST, sector) AS quarter FROM (SELECT sector, round(avg(momentum_30d), 6) AS m FROM strength GROUP BY 1)")
def f9_sector_rank(spark, sf_dir):
    sectors = e4_sector_table(spark, sf_dir)
    w = Window.orderBy(F.desc_nulls_last("momentum"), "sector")  # one row a sector
    ties = Window.orderBy(F.desc_nulls_last("momentum"))
    return sectors.select("sector", F.row_number().over(w).alias("rank_no"), F.rank().over(ties).alias("rank_ties"), F.dense_rank().over(ties).alias("rank_dense"), F.ntile(4).over(w).alias("quarter"))


@query(ctes("days") + "SELECT dn, idx FROM days WHERE idx % 20 = 0")
def f11_sampled_calendar(spark, sf_dir):
    return market.calendar(bars_of(spark, sf_dir)).where("idx % 20 = 0")


@query(ctes("bars", "days") + "SELECT b.stock_id, b.dn, round((z.price - b.price) / b.price * 100, 6) AS ret FROM (SELECT bars.*, t.dn AS target FROM bars JOIN days d USING (dn) JOIN days t ON t.idx = d.idx + 10) b ASOF JOIN bars z ON z.stock_id = b.stock_id AND b.target >= z.dn WHERE b.price <> 0")
def d6_forward_return(spark, sf_dir):
    bars = stored(bars_of(spark, sf_dir), "bars")  # read for the rows, their number and the calendar
    return rounded(market.bar_returns(bars, market.calendar(bars), 10))


@query(ctes("level") + "SELECT a.dn, round(a.level, 6) AS level, round((b.level - a.level) / nullif(a.level, 0) * 100, 6) AS bench FROM level a LEFT JOIN level b ON b.idx = a.idx + 10")
def e14_benchmark(spark, sf_dir):
    bars = bars_of(spark, sf_dir)
    level = bars.groupBy("dn").agg(F.avg("price").alias("level"))
    return rounded(level.join(market.benchmark_returns(bars, market.calendar(bars), 10), "dn", "left"))


@query(ctes("obs") + "SELECT symbol, dn, horizon, history_days, score, coverage, confidence, risk, recommendation, forward, benchmark FROM obs")
def j20_backtest(spark, sf_dir):
    return observations_of(spark, sf_dir).select("symbol", "dn", "horizon", "history_days", "score", "coverage", "confidence", "risk", "recommendation", "forward", "benchmark")


_BAND = "CASE WHEN score < 45 THEN '0-45' WHEN score < 55 THEN '45-55' WHEN score < 70 THEN '55-70' ELSE '70-100' END"
_STATS = "count(*) AS n, round(avg(net), 6) AS mean, round(median(net), 6) AS median, round(avg(excess - 1), 6) AS mean_excess, round(avg(CASE WHEN net > 1.5 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(min(net), 6) AS worst, round(max(net), 6) AS best, round(stddev_samp(net), 6) AS stdev, round(round(avg(net), 6) - 1.96 * stddev_samp(net) / sqrt(count(*)), 6) AS low, round(round(avg(net), 6) + 1.96 * stddev_samp(net) / sqrt(count(*)), 6) AS high, round(round(avg(net), 6) / nullif(stddev_samp(net), 0), 6) AS per_stdev, coalesce(round(avg(excess - 1), 6) > 0, false) AS beats_benchmark"
_NET = f"(SELECT *, forward - 1 AS net, {_BAND} AS band FROM obs)"


@query(ctes("obs") + f"SELECT horizon, band, recommendation, sector, {_STATS} FROM {_NET} GROUP BY GROUPING SETS ((horizon), (horizon, band), (horizon, recommendation), (sector))")
def e9_e10_report(spark, sf_dir):
    """Six digits, since medians of four-digit returns lie half way between two of four."""
    out = market.report(observations_of(spark, sf_dir), digits=6)
    return out.select("horizon", "band", "recommendation", "sector", "n", "hit_rate", "mean", "median", "mean_excess", "worst", "best", "stdev", "low", "high", "per_stdev", "beats_benchmark")


@query(ctes("obs") + f"SELECT horizon, n_top, n_mid, round(top_mean, 4) AS top_mean, round(mid_mean, 4) AS mid_mean FROM (SELECT horizon, count(*) FILTER (WHERE score >= 70) AS n_top, count(*) FILTER (WHERE score >= 45 AND score < 55) AS n_mid, avg(net) FILTER (WHERE score >= 70) AS top_mean, avg(net) FILTER (WHERE score >= 45 AND score < 55) AS mid_mean FROM {_NET} GROUP BY 1)")
def e11_spread(spark, sf_dir):
    out = market.spread(observations_of(spark, sf_dir))
    return out.select("horizon", F.coalesce("n_top", F.lit(0)).alias("n_top"), F.coalesce("n_mid", F.lit(0)).alias("n_mid"), "top_mean", "mid_mean")


@query(ctes("obs") + f"SELECT horizon, count(*) AS n_bands, CASE WHEN count(*) >= 3 THEN bool_and(ok) END AS monotonic FROM (SELECT horizon, band, coalesce(m >= lag(m) OVER (PARTITION BY horizon ORDER BY band), true) AS ok FROM (SELECT horizon, band, round(avg(net), 4) AS m FROM {_NET} GROUP BY 1, 2)) GROUP BY 1")
def e12_monotonic(spark, sf_dir):
    return market.monotonic(observations_of(spark, sf_dir))


@query(ctes("obs") + f"SELECT horizon, round(avg(benchmark), 3) AS hold_mean, round(avg(net) FILTER (WHERE score >= 70), 3) AS top_mean, round(avg(net), 3) AS all_mean FROM {_NET} GROUP BY 1")
def e13_benchmarks(spark, sf_dir):
    net = F.col("forward") - 1
    return observations_of(spark, sf_dir).groupBy("horizon").agg(F.round(F.avg("benchmark"), 3).alias("hold_mean"), F.round(F.avg(F.when(F.col("score") >= 70, net)), 3).alias("top_mean"), F.round(F.avg(net), 3).alias("all_mean"))


@query(ctes("obs") + "SELECT count(*) AS n, count(DISTINCT symbol) AS n_symbols, count(DISTINCT dn) AS n_dates FROM obs")
def e15_run_counts(spark, sf_dir):
    return observations_of(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("dn").alias("n_dates"))


def _ablation_sql() -> str:
    from sparktide.sql_core import score

    names = {k: f"medium_{k}" for k in S.WEIGHTS["medium"]}
    each = " UNION ALL ".join(f"SELECT stock_id, dn, '{x or 'reference'}' AS variant, {score(names, {k: w for k, w in S.WEIGHTS['medium'].items() if k != x})} AS score FROM pit" for x in ("", *S.WEIGHTS["medium"]))
    return ctes("pit", "obs", more={"v": each}) + """SELECT variant, count(*) AS n, round(avg(net), 3) AS mean, round(avg(net) FILTER (WHERE v.score >= 70) - avg(net) FILTER (WHERE v.score >= 45 AND v.score < 55), 2) AS spread
 FROM v JOIN (SELECT stock_id, dn, forward - 1 AS net FROM obs WHERE horizon = 'medium') o USING (stock_id, dn) GROUP BY 1"""


@query(_ablation_sql())
def e16_ablation(spark, sf_dir):
    out = market.ablation(bars_of(spark, sf_dir), stocks_of(spark, sf_dir))
    return out.select("variant", "n", F.round("mean", 3).alias("mean"), F.round("spread", 2).alias("spread"))
