"""Market state and walk-forward backtest as single plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktide.functions.columns import half_even
from sparktide.operators.metrics import daily_bars, distances, latest_metrics, metrics_history, relative_strength
from sparktide.operators.news import news_aggregate, recent_news
from sparktide.operators.scan import chunked, last_before
from sparktide.operators.scoring import HORIZONS, WEIGHTS, opportunity, score_all, to_horizons
from sparktide.sources.shared import stored
from sparktide.sources.versions import PARTS, PartedResult

#: Sessions after which each horizon is measured, bands of the score, and the move that counts as a hit.
SESSIONS_AHEAD = {"short": 10, "medium": 60, "long": 180}
BANDS = (("0-45", 0.0, 45.0), ("45-55", 45.0, 55.0), ("55-70", 55.0, 70.0), ("70-100", 70.0, 100.01))
HIT = 1.5


def market_state(bars: DataFrame, stocks: DataFrame, news: DataFrame | None = None, now: Column | None = None, fundamentals: DataFrame | None = None) -> DataFrame:
    """One row for each stock: metrics of its last day, scores, risk, recommendation.

    The metrics are written once, a row for each stock, since the cross sections read them twice more.
    """
    return state_of_metrics(stored(distances(latest_metrics(bars)), "metrics"), stocks, news, now, fundamentals)


def state_of_metrics(metrics: DataFrame, stocks: DataFrame, news: DataFrame | None = None, now: Column | None = None, fundamentals: DataFrame | None = None) -> DataFrame:
    """The market state from metrics that are there: what is left are cross sections, notices and scores, a row for each stock."""
    state = relative_strength(metrics, stocks)
    if news is not None:
        state = state.join(news_aggregate(recent_news(news, now), now), "stock_id", "left")
        state = state.fillna({"news_count": 0, "fresh_negative": False, "has_dividend": False, "has_results": False})
    if fundamentals is not None:
        state = state.join(fundamentals, "stock_id", "left")
    return opportunity(score_all(state.withColumn("history_days", F.col("n_days"))))


def kept_metrics(spark: SparkSession, path: str, parts: int = PARTS) -> PartedResult:
    """Metrics of each stock's last day, kept under ``path`` and computed again for the parts of stocks whose prices have changed."""
    return PartedResult(spark, path, "stock_id", lambda x: distances(latest_metrics(daily_bars(x["prices"]))), parts)


def calendar(bars: DataFrame) -> DataFrame:
    """Distinct days with their index; the ranking without a key only sees days, never rows."""
    return bars.select("dn").distinct().withColumn("idx", F.row_number().over(Window.orderBy("dn")) - 1)


def forward_returns(bars: DataFrame, days: DataFrame, sessions: int | dict[str, int], starts: DataFrame) -> DataFrame:
    """``ret`` from the last price at or before each start to the last at or before the day ``sessions`` later; no row where the window isn't closed.

    ``starts`` has stock_id and dn of a calendar day. Several horizons by name give a row each with a column ``horizon``; all
    prices come from one as-of pass. Nothing is interpolated.
    """
    ahead = sessions if isinstance(sessions, dict) else {"": sessions}
    steps = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), (F.col("idx") + n).alias("to")) for h, n in ahead.items())))
    target = days.select("dn", steps.alias("s")).join(days.select(F.col("idx").alias("to"), F.col("dn").alias("target")), F.col("s.to") == F.col("to")).select("dn", "s.horizon", "target")
    ends = target.select("dn", F.struct("horizon", "target").alias("end")).groupBy("dn").agg(F.collect_list("end").alias("ends"))  # as many as horizons
    probes = starts.select("stock_id", "dn").join(ends, "dn").select("stock_id", F.col("dn").alias("start"), F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("horizon"), F.col("dn").alias("target"))), "ends")).alias("e"))
    priced = last_before(probes.select("stock_id", "start", "e.horizon", F.col("e.target").alias("dn")), bars, "stock_id", "dn", ["price"])
    price = F.col("quote.price")
    both = priced.groupBy("stock_id", "start").agg(F.max(F.when(F.col("horizon").isNull(), price)).alias("p0"), F.collect_list(F.when(F.col("horizon").isNotNull(), F.struct("horizon", price.alias("p1")))).alias("later"))
    out = both.where(F.col("p0").isNotNull() & (F.col("p0") != 0)).select("stock_id", F.col("start").alias("dn"), "p0", F.explode("later").alias("l"))
    out = out.select("stock_id", "dn", "l.horizon", ((F.col("l.p1") - F.col("p0")) / F.col("p0") * 100).alias("ret"))
    return out if isinstance(sessions, dict) else out.drop("horizon")


def bar_returns(bars: DataFrame, days: DataFrame, sessions: int) -> DataFrame:
    """``(stock_id, dn, ret)`` from every bar to the last price at or before the day ``sessions`` later: as forward_returns gives them from the bars' own days.

    That price is the newest of the bar's stock among so many days from its own on, so a short frame finds it, in chunks that look ahead.
    """
    end = days.agg(F.max("idx").alias("end"))  # one row
    numbered = bars.select("stock_id", "dn", "price").join(days, "dn").crossJoin(F.broadcast(end))
    rows = chunked(numbered.withColumn("ahead", -F.col("idx")), "stock_id", "ahead", sessions)
    later = F.first("price").over(Window.partitionBy("stock_id", "__chunk").orderBy("ahead").rangeBetween(-sessions, 0))
    closed = rows.withColumn("later", later).where(~F.col("__halo") & (F.col("idx") + sessions <= F.col("end")) & (F.col("price") != 0))
    return closed.select("stock_id", "dn", ((F.col("later") - F.col("price")) / F.col("price") * 100).alias("ret"))


def sampled_returns(bars: DataFrame, days: DataFrame, ahead: dict[str, int], step: int) -> DataFrame:
    """``(stock_id, dn, horizon, ret)`` from every ``step``-th day: as forward_returns gives them from those days, without as-of joins.

    A bar's price holds from its day to the stock's next one, in numbers of calendar days; so which sampled starts and which
    of their targets it answers is arithmetic, and a bar emits the prices that are asked of it.
    """
    held = with_next(bars, days).select("stock_id", "idx", "next", "price")

    def answered(horizon: str | None, n: int) -> Column:
        first, last = F.greatest(F.lit(0), F.ceil((F.col("idx") - n) / step)), F.ceil((F.col("next") - n) / step) - 1
        starts = F.when(last >= first, F.transform(F.sequence(first, last), lambda k: F.struct(F.lit(horizon).cast("string").alias("horizon"), (k * step).alias("start"))))
        return F.coalesce(starts, F.array().cast("array<struct<horizon: string, start: bigint>>"))

    every = F.concat(*(answered(h, n) for h, n in {None: 0, **ahead}.items()))
    rows = held.select("stock_id", "price", F.explode(every).alias("e")).select("stock_id", "price", "e.*")
    price = lambda h: F.max(F.when(F.col("horizon").isNull() if h is None else F.col("horizon") == h, F.col("price")))
    both = rows.groupBy("stock_id", "start").agg(price(None).alias("p0"), *(price(h).alias(f"p_{h}") for h in ahead)).where("p0 <> 0")
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), ((F.col(f"p_{h}") - F.col("p0")) / F.col("p0") * 100).alias("ret")) for h in ahead)))
    out = both.select("stock_id", "start", each.alias("x")).where("x.ret is not null")
    return out.join(days.select(F.col("idx").alias("start"), "dn"), "start").select("stock_id", "dn", "x.horizon", "x.ret")


def with_next(rows: DataFrame, days: DataFrame) -> DataFrame:
    """``rows`` with ``idx``, the number of their day, and ``next``, that of the stock's next row; the last row holds to the end of the calendar. Rows that have both stay as they are."""
    if {"idx", "next"} <= set(rows.columns):
        return rows
    end = days.agg((F.max("idx") + 1).alias("end"))  # one row
    numbered = rows.join(days, "dn").crossJoin(F.broadcast(end))
    return numbered.withColumn("next", F.coalesce(F.lead("idx").over(Window.partitionBy("stock_id").orderBy("dn")), F.col("end"))).drop("end")


def benchmark_returns(bars: DataFrame, days: DataFrame, sessions: int | dict[str, int]) -> DataFrame:
    """Return of the mean of price levels over the stocks that traded each day. Several horizons by name give a row each with a column ``horizon``, from one pass."""
    ahead = sessions if isinstance(sessions, dict) else {"": sessions}
    level = bars.groupBy("dn").agg(F.avg("price").alias("level")).join(days, "dn")
    steps = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), (F.col("idx") + n).alias("to")) for h, n in ahead.items())))
    later = level.select(F.col("idx").alias("to"), F.col("level").alias("later"))
    out = level.select("dn", "level", steps.alias("s")).select("dn", "level", "s.*").join(later, "to")
    out = out.select("dn", "horizon", ((F.col("later") - F.col("level")) / F.nullif("level", F.lit(0.0)) * 100).alias("bench"))
    return out if isinstance(sessions, dict) else out.drop("horizon")


def point_in_time(bars: DataFrame, stocks: DataFrame, days: DataFrame, step: int, min_history: int) -> DataFrame:
    """Every stock's metrics as they stood on every ``step``-th day, its last own day carried on, with cross sections of that day.

    A row of the history holds until the stock's next one, so the sampled days that it answers are a sequence of numbers.
    """
    history = distances(metrics_history(with_next(bars, days)))
    first, last = F.ceil(F.col("idx") / step), F.ceil(F.col("next") / step) - 1
    names = [c for c in history.columns if c not in ("stock_id", "dn", "day", "idx", "next")]
    seen = history.where(last >= first).select("stock_id", F.explode(F.sequence(first, last)).alias("k"), *names)
    seen = seen.join(days.select((F.col("idx") / step).alias("k"), "dn").where(F.col("idx") % step == 0), "k").select("stock_id", "dn", *names)
    seen = stored(seen, "point-in-time")  # the cross sections read it again
    return relative_strength(seen, stocks, "dn").withColumn("history_days", F.col("n_days")).where(F.col("history_days") >= min_history)


def backtest(bars: DataFrame, stocks: DataFrame, *, step: int = 20, min_history: int = 60, horizons: tuple[str, ...] = HORIZONS) -> DataFrame:
    """Observations: what the scores would have said on each sampled day, and what followed. No news, no fundamentals.

    Bars, calendar, bars with the day of their next one, and sampled metrics are written once and scanned by what follows.
    """
    bars = stored(bars, "bars")
    days = stored(calendar(bars), "calendar")
    held = stored(with_next(bars, days), "held")
    ahead = {h: SESSIONS_AHEAD[h] for h in horizons}
    scored = score_all(point_in_time(held, stocks, days, step, min_history))
    said = to_horizons(scored, "stock_id", "symbol", "sector", "dn", "history_days").where(F.col("horizon").isin(*horizons))
    out = said.join(sampled_returns(held, days, ahead, step), ["stock_id", "dn", "horizon"]).join(benchmark_returns(bars, days, ahead), ["dn", "horizon"], "left")
    bench = F.coalesce("bench", F.lit(0.0))
    return out.withColumns({"forward": half_even(F.col("ret"), 4), "benchmark": half_even(bench, 4), "excess": half_even(F.col("ret") - bench, 4)}).drop("ret", "bench")


def band(score: Column) -> Column:
    return F.coalesce(*(F.when((score >= low) & (score < high), F.lit(name)) for name, low, high in BANDS))


def summary(fee_rate: float = 0.005, digits: int = 4) -> list[Column]:
    """Statistics of a group of observations, net of a round trip's fees."""
    cost = fee_rate * 200
    net = F.col("forward") - cost
    values = {"mean": F.avg(net), "median": F.median(net), "mean_excess": F.avg(F.col("excess") - cost), "hit_rate": F.avg((net > HIT).cast("double")), "worst": F.min(net), "best": F.max(net)}
    return [F.count("*").alias("n"), *(F.round(v, digits).alias(k) for k, v in values.items()), F.stddev_samp(net).alias("sd")]


def with_interval(stats: DataFrame, digits: int = 4) -> DataFrame:
    """Dispersion, return per dispersion and the normal 95 % interval of the mean; null for fewer than two rows."""
    margin = 1.96 * F.col("sd") / F.sqrt("n")
    values = {"stdev": F.col("sd"), "per_stdev": F.col("mean") / F.nullif("sd", F.lit(0.0)), "low": F.col("mean") - margin, "high": F.col("mean") + margin}
    out = stats.withColumns({k: F.round(v, digits) for k, v in values.items()})
    return out.withColumns({"significant": (F.col("low") > 0) | (F.col("high") < 0), "beats_benchmark": F.coalesce(F.col("mean_excess") > 0, F.lit(False))}).drop("sd")


def report(observations: DataFrame, fee_rate: float = 0.005, digits: int = 4) -> DataFrame:
    """Statistics by horizon, horizon and band, horizon and recommendation, and sector: one pass by grouping sets."""
    rows = observations.withColumn("band", band(F.col("score")))
    sets = [["horizon"], ["horizon", "band"], ["horizon", "recommendation"], ["sector"]]
    cols = ["horizon", "band", "recommendation", "sector"]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in cols)).agg(*summary(fee_rate, digits))
    return with_interval(grouped, digits)


def spread(observations: DataFrame, fee_rate: float = 0.005, *by: str) -> DataFrame:
    """Mean net return of scores from 70 on less that of 45 to 55, and whether their intervals are apart."""
    side = F.when(F.col("score") >= 70, "top").when((F.col("score") >= 45) & (F.col("score") < 55), "mid")
    keys = ["horizon", *by]
    stats = with_interval(observations.withColumn("side", side).where("side is not null").groupBy(*keys, "side").agg(*summary(fee_rate)))
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    out = stats.groupBy(*keys).agg(pick("top", "mean").alias("top_mean"), pick("mid", "mean").alias("mid_mean"), pick("top", "n").alias("n_top"), pick("mid", "n").alias("n_mid"), pick("top", "low").alias("top_low"), pick("mid", "high").alias("mid_high"))
    return out.withColumns({"spread": F.round(F.col("top_mean") - F.col("mid_mean"), 4), "separated": F.coalesce(F.col("top_low") > F.col("mid_high"), F.lit(False))})


def monotonic(observations: DataFrame, fee_rate: float = 0.005) -> DataFrame:
    """Whether the mean rises with the band; null for fewer than three bands."""
    means = observations.withColumn("band", band(F.col("score"))).groupBy("horizon", "band").agg(F.round(F.avg(F.col("forward") - fee_rate * 200), 4).alias("mean"))
    prior = F.lag("mean").over(Window.partitionBy("horizon").orderBy("band"))
    rises = means.withColumn("ok", prior.isNull() | (F.col("mean") >= prior)).groupBy("horizon").agg(F.count("*").alias("n_bands"), F.bool_and("ok").alias("ok"))
    return rises.select("horizon", "n_bands", F.when(F.col("n_bands") >= 3, F.col("ok")).alias("monotonic"))


def ablation(bars: DataFrame, stocks: DataFrame, *, horizon: str = "medium", step: int = 20, min_history: int = 60, fee_rate: float = 0.005) -> DataFrame:
    """Spread and mean with each component's weight left out, in one pass: the metrics, components and returns are computed once, only the weighing is repeated."""
    bars = stored(bars, "bars")
    days = stored(calendar(bars), "calendar")
    held = stored(with_next(bars, days), "held")
    scored = score_all(point_in_time(held, stocks, days, step, min_history))
    weights = WEIGHTS[horizon]
    from sparktide.functions.columns import covered_score

    own = {k: F.col(f"{horizon}_{k}") for k in weights}
    variants = []
    for left_out in ("", *weights):
        score, _ = covered_score(own, {k: w for k, w in weights.items() if k != left_out})
        variants.append(F.struct(F.lit(left_out or "reference").alias("variant"), score.alias("score")))
    each = scored.select("stock_id", "dn", F.explode(F.array(*variants)).alias("v")).select("stock_id", "dn", "v.*")
    rets = sampled_returns(held, days, {horizon: SESSIONS_AHEAD[horizon]}, step).drop("horizon")
    obs = each.join(rets, ["stock_id", "dn"]).withColumns({"forward": half_even(F.col("ret"), 4), "excess": half_even(F.col("ret"), 4), "horizon": F.lit(horizon)})
    means = obs.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg(F.col("forward") - fee_rate * 200), 4).alias("mean"))
    return means.join(spread(obs, fee_rate, "variant").select("variant", "spread", "top_mean", "separated"), "variant", "left")
