"""Queries over scores, portfolios, analysts, predictions, health and texts. Names begin with the inventory's ids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparktide.functions import columns as C
from sparktide.operators import portfolio as P
from sparktide.operators import scoring as S
from sparktide.plans import analysis as A
from sparktide.plans import health as H
from sparktide.plans import research as R
from sparktide.plans import statements as ST
from sparktide.queries_core import NOW, bars_of, observations_of, r, rounded, state_of, stocks_of
from sparktide.queries_data import latest_fundamentals
from sparktide.sources.ranged import RangedTable
from sparktide.sources.shared import fresh_path, stored
from sparktide.sources.views import table, view
from sparktide.sql_core import PARTS, clamp, ctes, decide, mean
from sparktide.streaming import jobs

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def now():
    return F.to_timestamp(F.lit(NOW))


def placed(df, name: str, *order):
    """``df`` with each row's place in the order as ``name``: ranges of the order are numbered apart, and each counts on from the rows of those before it.

    The ranges are written with their number, so that all that follows sees the same ones; only their sizes meet in one task.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    upto = F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1))
    before = ranged.groupBy(F.col("__range").alias("of")).agg(F.count("*").alias("n")).select("of", F.coalesce(upto, F.lit(0)).alias("before"))  # one row a range
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    out = ranged.withColumn("__within", within).join(F.broadcast(before), F.col("__range") == F.col("of"))
    return out.withColumn(name, F.col("before") + F.col("__within")).drop("__range", "__within", "of", "before")


def valued_of(spark, sf_dir):
    return P.value_holdings(view(spark, sf_dir, "holdings"), state_of(spark, sf_dir))


VALUED = """SELECT *, CASE WHEN price IS NOT NULL AND coalesce(net_pct <= -8 OR avoid >= 60 OR (net_pct >= 15 AND momentum_30d <= -3), false) THEN 'SELL' ELSE 'HOLD' END AS advice FROM (
 SELECT *, net / nullif(cost * 1.005, 0) * 100 AS net_pct FROM (SELECT h.stock_id, s.symbol, s.sector, quantity * buy_price AS cost, quantity * price AS value, price, avoid, risk, momentum_30d, quantity * price - quantity * buy_price - quantity * buy_price * 0.005 - quantity * price * 0.005 AS net FROM holdings h LEFT JOIN state s USING (stock_id)))"""


@query(ctes("state", "holdings") + f"SELECT symbol, {r('cost', 'value', 'net', 'net_pct')}, advice FROM ({VALUED})")
def d15_i20_holdings(spark, sf_dir):
    return rounded(valued_of(spark, sf_dir).select("symbol", "cost", "value", "net", "net_pct", "advice"))


@query(ctes("state", "holdings") + f"SELECT {r('value', 'cost', 'net', digits=4)}, n_sell, round(net / nullif(cost, 0) * 100, 4) AS net_pct FROM (SELECT sum(value) AS value, sum(cost) FILTER (WHERE value IS NOT NULL) AS cost, sum(net) AS net, count(*) FILTER (WHERE advice = 'SELL') AS n_sell FROM ({VALUED}))")
def e20_portfolio_totals(spark, sf_dir):
    return rounded(P.totals(valued_of(spark, sf_dir)), 4)


@query(ctes("state", "holdings") + f"SELECT sector, round(value, 4) AS value, n, round(value / sum(value) OVER () * 100, 4) AS share FROM (SELECT coalesce(sector, 'Inconnu') AS sector, sum(value) AS value, count(*) AS n FROM ({VALUED}) WHERE value IS NOT NULL GROUP BY 1)")
def e21_sector_concentration(spark, sf_dir):
    return rounded(P.sectors(valued_of(spark, sf_dir)), 4)


@query(ctes("state", "holdings") + f"SELECT symbol, round(value / sum(value) OVER () * 100, 4) AS weight, (net < 0)::INT + (value / sum(value) OVER () * 100 >= 25)::INT + (count(*) OVER () < 4)::INT + ((SELECT max(v) / sum(v) * 100 FROM (SELECT sum(value) AS v FROM ({VALUED}) GROUP BY sector)) >= 40)::INT AS n_flags FROM ({VALUED}) WHERE value IS NOT NULL")
def j8_position_flags(spark, sf_dir):
    return rounded(P.concentration(valued_of(spark, sf_dir)).select("symbol", "weight", F.size("flags").alias("n_flags")), 4)


@query(ctes("state", "holdings") + f"SELECT symbol, CASE WHEN advice = 'SELL' AND net_pct >= 15 THEN 'TAKE_PROFIT' WHEN advice = 'SELL' THEN 'RISKY' WHEN risk >= 70 THEN 'RISKY' ELSE 'HOLD' END AS recommendation FROM ({VALUED})")
def i16_holder_policy(spark, sf_dir):
    risk = state_of(spark, sf_dir).select("stock_id", "risk")
    held = valued_of(spark, sf_dir).join(risk, "stock_id", "left")
    return held.select("symbol", S.decide_holder(F.col("advice"), F.col("net_pct"), F.col("risk")).alias("recommendation"))


@query(ctes("state", "holdings") + f"SELECT symbol, advice, row_number() OVER (ORDER BY advice <> 'SELL', symbol) AS place FROM ({VALUED})")
def g4_sell_first(spark, sf_dir):
    v = valued_of(spark, sf_dir).select("symbol", "advice")
    return placed(v, "place", F.col("advice") != "SELL", "symbol")


@query(ctes("state", "favorites") + "SELECT s.symbol, s.buy, row_number() OVER (ORDER BY s.buy IS NULL, s.buy DESC, s.symbol) AS place FROM state s JOIN favorites f USING (stock_id)")
def g3_watchlist_order(spark, sf_dir):
    w = state_of(spark, sf_dir).join(view(spark, sf_dir, "favorites").select("stock_id"), "stock_id", "left_semi").select("symbol", "buy")
    return placed(w, "place", F.col("buy").isNull(), F.desc("buy"), "symbol")


@query(ctes("state") + "SELECT symbol, row_number() OVER (ORDER BY daily_variation DESC NULLS LAST, symbol) AS by_move, row_number() OVER (ORDER BY volume DESC NULLS LAST, symbol) AS by_volume FROM state")
def g2_null_last_sorts(spark, sf_dir):
    """The places of all stocks."""
    s = stored(state_of(spark, sf_dir).select("symbol", "daily_variation", "volume"), "state")
    place = lambda c, name: placed(s.select("symbol", c), name, F.desc_nulls_last(c), "symbol").select("symbol", name)
    return place("daily_variation", "by_move").join(place("volume", "by_volume"), "symbol")


QUERIES["g2_null_last_sorts_whole"] = QUERIES["g2_null_last_sorts"]


_HEAD = "CASE WHEN abs(daily_variation) >= 5 THEN 'move' WHEN recommendation = 'STRONG_OPPORTUNITY' THEN 'buy' WHEN volume_anomaly >= 2 THEN 'volume' WHEN support_distance BETWEEN 0 AND 3 THEN 'support' WHEN week52_high_proximity > -1 THEN 'high' WHEN buy >= 50 THEN 'score' ELSE 'quiet' END"


@query(ctes("state", "favorites") + f"SELECT s.symbol, {_HEAD} AS headline FROM state s JOIN favorites f USING (stock_id)")
def i21_watch_headline(spark, sf_dir):
    c = F.col
    head = F.when(F.abs("daily_variation") >= 5, "move").when(c("recommendation") == "STRONG_OPPORTUNITY", "buy").when(c("volume_anomaly") >= 2, "volume").when(c("support_distance").between(0, 3), "support").when(c("week52_high_proximity") > -1, "high").when(c("buy") >= 50, "score").otherwise("quiet")
    return state_of(spark, sf_dir).join(view(spark, sf_dir, "favorites").select("stock_id"), "stock_id", "left_semi").select("symbol", head.alias("headline"))


@query(ctes("bars") + "SELECT stock_id, round(avg(hit), 6) AS avg_fwd, round(avg(CASE WHEN hit > 0 THEN 1.0 WHEN hit <= 0 THEN 0.0 END), 6) AS share_up, count(hit) AS n_events, round(sqrt(avg(ret * ret)), 6) AS rms, count(*) AS n_bars FROM (SELECT stock_id, ret, CASE WHEN ret <= -3 AND fwd IS NOT NULL THEN fwd END AS hit FROM (SELECT stock_id, (price / lag(price) OVER w - 1) * 100 AS ret, (lead(price, 5) OVER w / price - 1) * 100 AS fwd FROM bars WINDOW w AS (PARTITION BY stock_id ORDER BY dn))) GROUP BY 1")
def e26_f12_event_study(spark, sf_dir):
    return rounded(R.event_study(bars_of(spark, sf_dir)))


@query(ctes("bars") + "SELECT stock_id, round(stddev_pop(ret), 6) AS realised_vol FROM (SELECT stock_id, dn, (price / lag(price) OVER (PARTITION BY stock_id ORDER BY dn) - 1) * 100 AS ret FROM bars WHERE day >= DATE '2000-01-01') GROUP BY 1 HAVING count(*) >= 3")
def f15_realised_volatility(spark, sf_dir):
    b = bars_of(spark, sf_dir).where(F.col("day") >= F.lit("2000-01-01").cast("date"))
    moves = b.withColumn("ret", (F.col("price") / F.lag("price").over(Window.partitionBy("stock_id").orderBy("dn")) - 1) * 100)
    return rounded(moves.groupBy("stock_id").agg(F.stddev_pop("ret").alias("realised_vol"), F.count("*").alias("n")).where("n >= 3").drop("n"))


@query(ctes("bars") + "SELECT stock_id, dn, round((price / lag(price) OVER (PARTITION BY stock_id ORDER BY dn) - 1) * 100, 6) AS ret FROM bars")
def f8_daily_returns(spark, sf_dir):
    return rounded(bars_of(spark, sf_dir).select("stock_id", "dn", ((F.col("price") / F.lag("price").over(Window.partitionBy("stock_id").orderBy("dn")) - 1) * 100).alias("ret")))


#: Indicators of the macro view that stand for the rates which the macro analyst reads.
MACRO = {"policy_rate": "click", "interbank_rate": "view", "inflation": "purchase", "core_inflation": "signup", "eur_rate": "error", "usd_rate": "none"}


def macro_of(spark, sf_dir):
    """One row: the latest value of each rate."""
    latest = view(spark, sf_dir, "macro").groupBy("indicator").agg(F.max_by("value", F.struct("as_of", -F.col("seq"))).alias("v"))
    return latest.agg(*(F.max(F.when(F.col("indicator") == i, F.col("v"))).cast("double").alias(c) for c, i in MACRO.items()))


def owners_of(spark, sf_dir):
    """Holders of each sector's companies: the main one, its share of what they hold together, and their number."""
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    held = rows.groupBy(F.col("n_name").alias("of_sector")).agg(F.max(F.struct(F.col("c_acctbal").cast("double").alias("v"), F.col("c_name").alias("holder"))).alias("m"), F.sum(F.col("c_acctbal").cast("double")).alias("total"), F.count("*").alias("ownership_size"))
    return held.select("of_sector", F.col("m.holder").alias("main_holder"), (F.col("m.v") / F.col("total") * 100).alias("top_pct"), "ownership_size")


def context_of(spark, sf_dir):
    """The market state with event studies, fundamentals, the market's and sectors' means, holdings, owners, macro rates and flags; written once, since analysts, radar, verdicts and scenarios all read it."""
    bars = stored(bars_of(spark, sf_dir), "bars")
    state = stored(state_of(spark, sf_dir, bars).drop("fundamental_score"), "state")
    f = latest_fundamentals(view(spark, sf_dir, "fundamentals")).select("stock_id", *(F.col(c).cast("double").alias(c) for c in ("per", "pbr", "roe_pct", "dividend_yield_pct", "payout_pct")), "per_is_derived")
    out = state.join(R.event_study(bars), "stock_id", "left").join(f, "stock_id", "left")
    ranks = state.groupBy("sector").agg(F.max("sector_strength").alias("m")).where("m is not null")
    ranks = ranks.withColumn("sector_rank", F.row_number().over(Window.orderBy(F.desc("m"), "sector"))).select(F.col("sector").alias("rank_of"), "sector_rank")  # one row a sector
    out = out.join(ranks, F.col("sector") == F.col("rank_of"), "left").drop("rank_of").join(owners_of(spark, sf_dir), F.col("sector") == F.col("of_sector"), "left").drop("of_sector")
    valued = P.value_holdings(view(spark, sf_dir, "holdings"), state)
    by = P.sectors(valued)
    book = by.agg(F.sum("n").alias("positions"), F.max("share").alias("top_share"), F.max_by("sector", F.struct("share", "sector")).alias("top_sector"), F.sum("value").alias("book"))
    market = state.agg(F.avg("momentum_5d").alias("market_5d"), F.countDistinct(F.when(F.col("sector_strength").isNotNull(), F.col("sector"))).alias("n_sectors"))
    for one_row in (market, book, macro_of(spark, sf_dir)):
        out = out.crossJoin(F.broadcast(one_row))
    own = valued.where("value is not null").select("stock_id", F.col("value").alias("own_value"))
    out = out.join(own, "stock_id", "left").withColumn("position_share", F.col("own_value") / F.col("book") * 100)
    held = view(spark, sf_dir, "holdings").select("stock_id", F.lit(True).alias("held"))
    out = stored(out.join(held, "stock_id", "left").withColumns({"held": F.coalesce("held", F.lit(False)), "has_book": F.col("positions").isNotNull(), "description": F.col("symbol")}), "context")
    flags = ST.flag_weights(ST.statements(out))
    return stored(out.join(flags, "stock_id", "left").withColumns({"flag_weight": F.coalesce("flag_weight", F.lit(0.0)), "n_flags": F.coalesce("n_flags", F.lit(0))}), "context-with-flags")


def _ctx_sql() -> str:
    study = e26_sql()
    fund = "SELECT stock_id, coalesce(o_per, d_per) AS per, pbr, roe_pct, dividend_yield_pct, payout_pct, o_per IS NULL AND d_per IS NOT NULL AS per_is_derived FROM (SELECT stock_id, last(per ORDER BY seq) FILTER (WHERE source = 'derived') AS d_per, " + ", ".join(f"last({c} ORDER BY seq) FILTER (WHERE source = 'official' AND {c} IS NOT NULL OR source = 'official') AS {'o_per' if c == 'per' else c}" for c in ("per", "pbr", "roe_pct", "dividend_yield_pct", "payout_pct")) + " FROM (SELECT *, max(fiscal_year) OVER (PARTITION BY stock_id) AS newest FROM fundamentals) WHERE fiscal_year = newest GROUP BY 1)"
    owners = "SELECT n_name AS of_sector, arg_max(c_name, struct_pack(v := CAST(c_acctbal AS DOUBLE), h := c_name)) AS main_holder, max(CAST(c_acctbal AS DOUBLE)) / sum(CAST(c_acctbal AS DOUBLE)) * 100 AS top_pct, count(*) AS ownership_size FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1"
    rates = ", ".join(f"CAST(max(value) FILTER (WHERE indicator = '{i}') AS DOUBLE) AS {c}" for c, i in MACRO.items())
    rates = f"SELECT {rates} FROM (SELECT * FROM macro QUALIFY row_number() OVER (PARTITION BY indicator ORDER BY as_of DESC, seq) = 1)"
    ranks = "SELECT sector AS rank_of, row_number() OVER (ORDER BY m DESC, sector) AS sector_rank FROM (SELECT sector, max(sector_strength) AS m FROM state GROUP BY 1) WHERE m IS NOT NULL"
    book = f"SELECT sum(n) AS positions, max(share) AS top_share, arg_max(sector, struct_pack(s := share, x := sector)) AS top_sector, sum(value) AS book FROM (SELECT sector, n, value, value / sum(value) OVER () * 100 AS share FROM (SELECT coalesce(sector, 'Inconnu') AS sector, sum(value) AS value, count(*) AS n FROM ({VALUED}) WHERE value IS NOT NULL GROUP BY 1))"
    return f"""SELECT s.*, e.avg_fwd, e.n_events, e.n_bars, f.per, f.pbr, f.roe_pct, f.dividend_yield_pct, f.payout_pct, f.per_is_derived, avg(momentum_5d) OVER () AS market_5d, h.stock_id IS NOT NULL AS held, s.symbol AS description,
 k.sector_rank, (SELECT count(DISTINCT sector) FROM state WHERE sector_strength IS NOT NULL) AS n_sectors, o.main_holder, o.top_pct, o.ownership_size, b.positions, b.top_share, b.top_sector, v.value / b.book * 100 AS position_share, r.*
 FROM state s LEFT JOIN ({study}) e USING (stock_id) LEFT JOIN ({fund}) f USING (stock_id) LEFT JOIN holdings h ON h.stock_id = s.stock_id LEFT JOIN ({ranks}) k ON k.rank_of = s.sector LEFT JOIN ({owners}) o ON o.of_sector = s.sector
 LEFT JOIN (SELECT stock_id, value FROM ({VALUED}) WHERE value IS NOT NULL) v ON v.stock_id = s.stock_id CROSS JOIN ({book}) b CROSS JOIN ({rates}) r"""


_FLAGS = "SELECT stock_id, sum(weight) AS flag_weight, count(*) FILTER (WHERE analyst = 'portfolio') AS n_flags FROM stated WHERE slot = 'risk' AND polarity = 'bearish' GROUP BY 1"


def e26_sql() -> str:
    return "SELECT stock_id, avg(hit) AS avg_fwd, count(hit) AS n_events, count(*) AS n_bars FROM (SELECT stock_id, ret, CASE WHEN ret <= -3 AND fwd IS NOT NULL THEN fwd END AS hit FROM (SELECT stock_id, (price / lag(price) OVER w - 1) * 100 AS ret, (lead(price, 5) OVER w / price - 1) * 100 AS fwd FROM bars WINDOW w AS (PARTITION BY stock_id ORDER BY dn))) GROUP BY 1"


def _lean(parts: dict[str, str], weights: dict[str, float]) -> str:
    total = sum(weights.values())
    m = mean([(parts[k], w) for k, w in weights.items()])
    cov = " + ".join(f"CASE WHEN ({parts[k]}) IS NULL THEN 0.0 ELSE CAST({w} AS DOUBLE) END" for k, w in weights.items())
    return f"round_even({clamp(f'coalesce(50 + ({m} - 50) * least(1.0, (({cov}) / {total}) / 0.8), 50.0)')}, 1)"


def _signals_sql() -> str:
    t = R.TECHNICAL_WEIGHTS
    names = {h: {k: f"{h}_{k}" for k in PARTS[h]} for h in S.HORIZONS}
    cov = " + ".join(f"CASE WHEN medium_{k} IS NULL THEN 0.0 ELSE CAST({w} AS DOUBLE) END" for k, w in t["medium"].items())
    t_conf = f"round_even({clamp(f'60 * ({cov}) + 40 * least(history_days / 90.0, 1.0)')}, 1)"
    rel5, rel30, sec = clamp("50 + (momentum_5d - market_5d) * 3"), clamp("50 + relative_performance_30d * 2.5"), clamp("50 + sector_strength * 2.5")
    present = lambda *cols: "(" + " + ".join(f"CASE WHEN ({c}) IS NULL THEN 0 ELSE 1 END" for c in cols) + ")"
    s_conf = f"round_even({clamp(f'{present(rel5, rel30, sec)} / 3.0 * 55 + least(history_days / 60.0, 1.0) * 30 + 5')}, 1)"
    mood = f"CASE WHEN news_count > 0 THEN {clamp('50 + coalesce(avg_impact, 0.0) * 35')} END"
    n_conf = f"CASE WHEN news_count > 0 THEN round_even({clamp('35 + 8 * least(news_count, 6) + CASE WHEN avg_impact IS NOT NULL THEN 10 ELSE 0 END')}, 1) ELSE 15.0 END"
    hist = clamp("50 + avg_fwd * 4")
    h_conf = "round_even(CAST(CASE WHEN n_bars < 20 THEN n_bars / 20.0 * 20 WHEN n_events > 0 THEN 20 + least(60, n_events * 12.0) ELSE least(40.0, history_days / 90.0 * 40) END AS DOUBLE), 1)"
    own = {"valorisation": clamp("50 - (per - 15) * 3"), "rentabilite": clamp("50 + (roe_pct - 10) * 2.5"), "rendement": clamp("25 + dividend_yield_pct * 10"), "actif_net": clamp("85 - (pbr - 1) * 15")}
    f_conf = f"round_even({clamp(f'20 + 12 * {present(*own.values())} - CASE WHEN per_is_derived THEN 8 ELSE 0 END')}, 1)"
    rows = [("technical", h, _lean(names[h], t[h]), t_conf) for h in S.HORIZONS]
    rows += [("market_structure", "short", _lean({"r": rel5}, {"r": 1.0}), s_conf), ("market_structure", "medium", _lean({"s": sec, "r": rel30}, {"s": 0.5, "r": 0.5}), s_conf), ("market_structure", "long", _lean({"s": sec}, {"s": 1.0}), s_conf)]
    rows += [("news", h, f"round_even(CAST({mood} AS DOUBLE), 1)" if h != "long" else f"CASE WHEN news_count > 0 THEN round_even(CAST(CASE WHEN has_dividend OR has_results THEN 65.0 ELSE 0.5 * ({mood}) + 25 END AS DOUBLE), 1) END", n_conf) for h in S.HORIZONS]
    rows += [("history", h, f"CASE WHEN n_events > 0 THEN round_even(CAST({hist if h == 'short' else f'(({hist}) + 50) / 2.0'} AS DOUBLE), 1) END", h_conf) for h in ("short", "medium")]
    rows += [("fundamental", h, f"CASE WHEN {present(*own.values())} > 0 THEN {_lean(own, R.FUNDAMENTAL_WEIGHTS)} END", f_conf) for h in ("medium", "long")]
    return " UNION ALL ".join(f"SELECT stock_id, '{a}' AS analyst, '{h}' AS horizon, CAST({x} AS DOUBLE) AS lean, CAST({k} AS DOUBLE) AS confidence FROM ctx WHERE ({x}) IS NOT NULL" for a, h, x, k in rows)


RESEARCH = ctes("state", "fundamentals", "holdings", "macro", more={"ctx0": _ctx_sql(), "stated": ST.statements_sql("ctx0"), "ctx": f"SELECT c.*, coalesce(w.flag_weight, 0.0) AS flag_weight, coalesce(w.n_flags, 0) AS n_flags FROM ctx0 c LEFT JOIN ({_FLAGS}) w USING (stock_id)", "said": _signals_sql()})


@query(RESEARCH + "SELECT stock_id, analyst, slot, code, polarity, weight, round(value, 6) AS value FROM stated")
def l1_statements(spark, sf_dir):
    """What every analyst of the registry states."""
    return rounded(ST.statements(context_of(spark, sf_dir)).drop("ord"))


@query(RESEARCH + "SELECT stock_id, \"case\", rank, analyst, code, weight FROM (SELECT *, CASE slot WHEN 'strength' THEN 'bull' WHEN 'weakness' THEN 'bear' END AS \"case\", row_number() OVER (PARTITION BY stock_id, slot ORDER BY weight DESC, ord) AS rank FROM stated WHERE slot IN ('strength', 'weakness')) WHERE rank <= 6")
def g7_cited_statements(spark, sf_dir):
    return ST.cited(ST.statements(context_of(spark, sf_dir))).select("stock_id", "case", "rank", "analyst", "code", "weight")


_RATES = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in MACRO)


@query(RESEARCH + f"SELECT stock_id, n_used, CASE WHEN n_used > 0 THEN least(100.0, 20.0 + 11.0 * n_used) ELSE 0.0 END AS confidence, inflation_says FROM (SELECT c.stock_id, {_RATES} AS n_used, (SELECT code FROM stated s WHERE s.stock_id = c.stock_id AND analyst = 'macro' AND slot <> 'observation') AS inflation_says FROM ctx c)")
def j5_macro_analyst(spark, sf_dir):
    context = context_of(spark, sf_dir)
    says = ST.statements(context, {"macro": ST.ANALYSTS["macro"]}).where("slot <> 'observation'").select("stock_id", F.col("code").alias("inflation_says"))
    return ST.macro_report(context).join(says, "stock_id", "left")


@query(RESEARCH + "SELECT stock_id, main_holder, round(top_pct, 6) AS top_pct, n_used, CASE WHEN n_used > 0 THEN least(100.0, 20.0 + 12.0 * n_used) ELSE 0.0 END AS confidence FROM (SELECT *, CASE WHEN description IS NULL THEN 0 ELSE 1 END + CASE WHEN ownership_size IS NULL THEN 0 ELSE 1 END AS n_used FROM ctx)")
def j6_company_analyst(spark, sf_dir):
    return rounded(ST.company_report(context_of(spark, sf_dir)))


@query(RESEARCH + "SELECT stock_id, analyst, horizon, lean, confidence FROM said")
def j1_j7_analyst_signals(spark, sf_dir):
    return R.signals(context_of(spark, sf_dir))


_PAIRS = """SELECT a.stock_id, a.horizon, a.analyst AS bull, b.analyst AS bear, CASE WHEN greatest(a.weight, b.weight) = 0 OR abs(a.weight - b.weight) / greatest(a.weight, b.weight) < 0.15 THEN 'unresolved' WHEN a.weight > b.weight THEN 'bull' ELSE 'bear' END AS winner
 FROM heard a JOIN heard b ON a.stock_id = b.stock_id AND a.horizon = b.horizon AND a.lean >= 58 AND b.lean <= 42"""
_HEARD = ", heard AS (SELECT *, round_even(abs(lean - 50) / 50 * confidence / 100, 4) AS weight FROM said WHERE confidence >= 20)\n"


@query(RESEARCH.rstrip() + _HEARD + _PAIRS)
def d13_j11_debate(spark, sf_dir):
    return R.debate(R.signals(context_of(spark, sf_dir))).select("stock_id", "horizon", "bull", "bear", "winner")


@query(RESEARCH.rstrip() + _HEARD + f"SELECT stock_id, horizon, count(*) AS clashes, count(*) FILTER (WHERE winner = 'bull') AS n_bull, count(*) FILTER (WHERE winner = 'bear') AS n_bear, count(*) FILTER (WHERE winner = 'unresolved') AS n_unresolved FROM ({_PAIRS}) GROUP BY 1, 2")
def e28_debate_summary(spark, sf_dir):
    return R.debate_summary(R.debate(R.signals(context_of(spark, sf_dir))))


@query(RESEARCH + "SELECT stock_id, horizon, string_agg(analyst, ',' ORDER BY analyst) FILTER (WHERE lean >= 58) AS bulls, string_agg(analyst, ',' ORDER BY analyst) FILTER (WHERE lean <= 42) AS bears FROM said GROUP BY 1, 2 HAVING count(*) FILTER (WHERE lean >= 58) > 0 AND count(*) FILTER (WHERE lean <= 42) > 0")
def e29_contradictions(spark, sf_dir):
    return R.contradictions(R.signals(context_of(spark, sf_dir)))


_DIMS = {"technique": "round_even(risk, 1)", "historique": f"round_even(CAST({clamp('100 - history_days * 1.1', 10, 90)} AS DOUBLE), 1)", "valorisation": f"round_even(CAST({clamp('(per - 15) * 3')} AS DOUBLE), 1)", "evenementiel": "CASE WHEN news_count = 0 THEN 40.0 WHEN fresh_negative OR coalesce(avg_impact, 0.0) <= -0.3 THEN 70.0 ELSE 30.0 END", "liquidite": "CASE WHEN volume IS NULL THEN 60.0 WHEN volume_anomaly < 0.5 THEN 55.0 ELSE 30.0 END", "portefeuille": f"CASE WHEN positions IS NOT NULL THEN round_even(CAST({clamp('20.0 + 20.0 * n_flags')} AS DOUBLE), 1) END"}
_RADAR = "SELECT *, round_even(" + clamp("measured + round_even(58 * (1.0 - cov), 2) + pen") + ", 1) AS overall_risk FROM (SELECT *, " + " + ".join(f"coalesce(round_even(CAST(d_{k} * {w} AS DOUBLE), 2), 0.0)" for k, w in R.RISK_WEIGHTS.items()) + " AS measured, round_even(CAST(" + " + ".join(f"CASE WHEN d_{k} IS NULL THEN 0.0 ELSE CAST({w} AS DOUBLE) END" for k, w in R.RISK_WEIGHTS.items()) + " AS DOUBLE), 3) AS cov, round_even(CAST(least(22.0, 6.0 * flag_weight) AS DOUBLE), 1) AS pen FROM (SELECT *, " + ", ".join(f"CAST({v} AS DOUBLE) AS d_{k}" for k, v in _DIMS.items()) + " FROM ctx))"


@query(RESEARCH.rstrip() + f", radar AS ({_RADAR})\nSELECT stock_id, overall_risk, cov AS risk_coverage, pen AS flag_penalty, n_flags FROM radar")
def e27_j9_risk_radar(spark, sf_dir):
    return R.risk_radar(context_of(spark, sf_dir)).select("stock_id", "overall_risk", "risk_coverage", "flag_penalty", "n_flags")


def _verdicts(spark, sf_dir):
    radar = stored(R.risk_radar(context_of(spark, sf_dir)), "radar")
    return R.verdicts(radar), radar


_VERDICT = "SELECT stock_id, horizon, score, confidence, overall_risk, " + decide("score", "overall_risk", "confidence", "overall_risk") + " AS recommendation, volatility_30d FROM (" + " UNION ALL ".join(f"SELECT stock_id, '{h}' AS horizon, {h}_score AS score, {h}_confidence AS confidence, overall_risk, volatility_30d FROM radar" for h in S.HORIZONS) + ")"


@query(RESEARCH.rstrip() + f", radar AS ({_RADAR})\nSELECT stock_id, horizon, score, confidence, recommendation FROM ({_VERDICT})")
def j10_i16_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir)[0].select("stock_id", "horizon", "score", "confidence", "recommendation")


_SCENARIOS = """SELECT stock_id, horizon, round(b0 / (b0 + b1 + b2), 2) AS p_bull, round(b1 / (b0 + b1 + b2), 2) AS p_base, round(b2 / (b0 + b1 + b2), 2) AS p_bear, move FROM (
 SELECT stock_id, horizon, move, w * r0 / (r0 + 0.9 + r2) + (1 - w) / 3 AS b0, w * 0.9 / (r0 + 0.9 + r2) + (1 - w) / 3 AS b1, w * r2 / (r0 + 0.9 + r2) + (1 - w) / 3 AS b2 FROM (
 SELECT stock_id, horizon, CAST(confidence AS DOUBLE) / 100 AS w, greatest(0.05, (score - 35) / 65) AS r0, greatest(0.05, (65 - score) / 65) * (1 + overall_risk / 100) AS r2,
 greatest(2.0, coalesce(volatility_30d, 25.0) * sqrt(CASE horizon WHEN 'short' THEN 10 WHEN 'medium' THEN 60 ELSE 180 END / 252.0)) AS move FROM (""" + _VERDICT + ")))"


@query(RESEARCH.rstrip() + f", radar AS ({_RADAR})\nSELECT stock_id, horizon, round(p_bull, 1) AS p_bull, round(p_base, 1) AS p_base, round(p_bear, 1) AS p_bear, round(move, 0) AS move FROM ({_SCENARIOS.replace(', 2) AS p_', ', 6) AS p_')})")
def i27_j12_scenarios(spark, sf_dir):
    """Probabilities to one digit here, since what they are reported to, two, differs by the order of sums; the move is rounded once."""
    rows, radar = _verdicts(spark, sf_dir)
    out = R.scenarios(rows.join(radar.select("stock_id", "volatility_30d"), "stock_id"), digits=6, move_digits=None)
    return out.select("stock_id", "horizon", *(F.round(p, 1).alias(p) for p in ("p_bull", "p_base", "p_bear")), F.round("move", 0).alias("move"))


def reports_of(spark, sf_dir):
    """Everything about a stock in one JSON document, with the digest of its verdicts."""
    context = context_of(spark, sf_dir)
    radar = stored(R.risk_radar(context), "radar")
    rows = R.verdicts(radar)
    said = R.signals(context).groupBy("stock_id").agg(F.sort_array(F.collect_list(F.struct("analyst", "horizon", "lean", "confidence"))).alias("signals"))
    ends = R.scenarios(rows.join(radar.select("stock_id", "volatility_30d"), "stock_id")).groupBy("stock_id").agg(F.sort_array(F.collect_list(F.struct("horizon", "score", "confidence", "recommendation", "p_bull", "p_base", "p_bear"))).alias("verdicts"))
    stated = ST.cited(ST.statements(context)).groupBy("stock_id").agg(F.sort_array(F.collect_list(F.struct("case", "rank", "analyst", "code", "value"))).alias("cited"))
    out = radar.select("stock_id", "symbol", "overall_risk").join(said, "stock_id", "left").join(ends, "stock_id").join(stated, "stock_id", "left")
    return out.select("stock_id", "symbol", F.to_json(F.struct("symbol", "overall_risk", "signals", "verdicts", "cited")).alias("report_json"), F.sha2(F.array_join(F.transform("verdicts", lambda v: F.concat_ws("=", v["horizon"], v["recommendation"])), ","), 256).alias("thesis_hash"))


@query(RESEARCH.rstrip() + f""", radar AS ({_RADAR})
SELECT r.stock_id, r.symbol, r.overall_risk, n_signals, v.verdicts, sha256(v.verdicts) AS thesis_hash, c.cited FROM radar r LEFT JOIN (SELECT stock_id, count(*) AS n_signals FROM said GROUP BY 1) s USING (stock_id)
 LEFT JOIN (SELECT stock_id, string_agg(horizon || '=' || recommendation, ',' ORDER BY horizon) AS verdicts FROM ({_VERDICT}) GROUP BY 1) v USING (stock_id)
 LEFT JOIN (SELECT stock_id, string_agg("case" || rank || '=' || code, ',' ORDER BY "case", rank) AS cited FROM (SELECT *, CASE slot WHEN 'strength' THEN 'bull' ELSE 'bear' END AS "case", row_number() OVER (PARTITION BY stock_id, slot ORDER BY weight DESC, ord) AS rank FROM stated WHERE slot IN ('strength', 'weakness')) WHERE rank <= 6 GROUP BY 1) c USING (stock_id)""")
def j13_full_report(spark, sf_dir):
    """The reports' documents, parsed again: risk, number of signals, verdicts and cited statements."""
    kind = "overall_risk double, signals array<struct<analyst: string>>, verdicts array<struct<horizon: string, recommendation: string>>, cited array<struct<case: string, rank: int, code: string>>"
    back = reports_of(spark, sf_dir).select("stock_id", "symbol", "thesis_hash", F.from_json("report_json", kind).alias("r"))
    listed = lambda c, f: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, f), ","))
    return back.select("stock_id", "symbol", "thesis_hash", "r.overall_risk", F.when(F.col("r.signals").isNotNull(), F.size("r.signals").cast("long")).alias("n_signals"), listed("r.verdicts", lambda v: F.concat_ws("=", v["horizon"], v["recommendation"])).alias("verdicts"), listed("r.cited", lambda x: F.concat(x["case"], x["rank"].cast("string"), F.lit("="), x["code"])).alias("cited"))


@query()
def j13_report_documents(spark, sf_dir):
    return reports_of(spark, sf_dir)


@query(ctes("state") + "SELECT symbol, best, CASE WHEN best_score - short_score >= 8 THEN best ELSE 'short' END AS fit FROM (SELECT symbol, short_score, greatest(short_score, medium_score, long_score) AS best_score, CASE WHEN short_score >= medium_score AND short_score >= long_score THEN 'short' WHEN medium_score >= long_score THEN 'medium' ELSE 'long' END AS best FROM state)")
def j14_horizon_fit(spark, sf_dir):
    s, m, lo = (F.col(f"{h}_score") for h in S.HORIZONS)
    best = F.when((s >= m) & (s >= lo), "short").when(m >= lo, "medium").otherwise("long")
    return state_of(spark, sf_dir).select("symbol", best.alias("best"), F.when(F.greatest(s, m, lo) - s >= 8, best).otherwise("short").alias("fit"))


def _composed_sql() -> str:
    def listed(h: str, test: str) -> str:
        return "coalesce(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {h}_{k} {test} THEN '{k}' END" for k in S.WEIGHTS[h]) + "], lambda x: x IS NOT NULL), ','), '')"

    def one(h: str) -> str:
        best = "CASE WHEN short_score >= medium_score AND short_score >= long_score THEN 'short' WHEN medium_score >= long_score THEN 'medium' ELSE 'long' END"
        fit = f"CASE WHEN {best} <> '{h}' AND greatest(short_score, medium_score, long_score) - {h}_score >= {A.LEAD} THEN 'better:' || {best} ELSE 'coherent' END"
        fit = f"CASE WHEN history_days < {A.LONG_DAYS} THEN 'history_short' ELSE {fit} END" if h == "long" else fit
        bounds = " ".join(f"WHEN {h}_score >= {low} THEN '{name}'" for name, low in A.OUTLOOK)
        seen = f"CASE WHEN {h}_coverage < {A.LEAST_COVERAGE} THEN 'short_of_data' {bounds} ELSE 'unfavourable' END"
        rules = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in (("risk_high", "risk >= 65"), ("avoid_high", "avoid >= 60"), ("score_strong", f"{h}_score >= 70"), ("confidence_ok", f"{h}_confidence >= 50"), ("score_watch", f"{h}_score >= 55"), ("score_weak", f"{h}_score < 45"))) + "], lambda x: x IS NOT NULL), ',')"
        holder = "CASE WHEN advice = 'SELL' AND net_pct >= 15 THEN 'TAKE_PROFIT' WHEN advice = 'SELL' THEN 'RISKY' WHEN risk >= 70 THEN 'RISKY' ELSE 'HOLD' END"
        return f"SELECT stock_id, symbol, '{h}' AS horizon, {h}_score AS score, {h}_coverage AS coverage, {h}_confidence AS confidence, CASE WHEN advice IS NOT NULL THEN {holder} ELSE {decide(f'{h}_score', 'risk', f'{h}_confidence', 'avoid')} END AS recommendation, CASE WHEN advice IS NOT NULL THEN 'holder' ELSE 'market' END AS perspective, {rules} AS rules, {seen} AS outlook, {fit} AS fit, {listed(h, f'>= {A.FOR}')} AS strengths, {listed(h, f'<= {A.AGAINST}')} AS weaknesses, {listed(h, 'IS NULL')} AS missing FROM positions"

    cited = """SELECT stock_id, coalesce(string_agg(code, ',' ORDER BY rank) FILTER (WHERE slot = 'strength'), '') AS bull, coalesce(string_agg(code, ',' ORDER BY rank) FILTER (WHERE slot = 'weakness'), '') AS bear FROM (
 SELECT *, row_number() OVER (PARTITION BY stock_id, slot ORDER BY weight DESC, ord) AS rank FROM stated WHERE slot IN ('strength', 'weakness')) WHERE rank <= 6 GROUP BY 1"""
    ends = _SCENARIOS.replace(", 2) AS p_", ", 6) AS p_")
    return RESEARCH.rstrip() + f""", radar AS (SELECT *, risk AS overall_risk FROM state), positions AS (SELECT s.*, v.advice, v.net_pct FROM state s LEFT JOIN (SELECT stock_id, advice, net_pct FROM ({VALUED}) WHERE price IS NOT NULL) v USING (stock_id)), h AS ({" UNION ALL ".join(map(one, S.HORIZONS))})
SELECT symbol, h.horizon, score, coverage, confidence, recommendation, perspective, rules, outlook, fit, strengths, weaknesses, missing, round(p_bull, 1) AS p_bull, round(p_bear, 1) AS p_bear, round(move, 0) AS move, coalesce(bull, '') AS bull, coalesce(bear, '') AS bear
FROM h LEFT JOIN ({ends}) e ON e.stock_id = h.stock_id AND e.horizon = h.horizon LEFT JOIN ({cited}) c ON c.stock_id = h.stock_id"""


@query(_composed_sql())
def j14_composed_analysis(spark, sf_dir):
    """The nested reports, a row for each horizon; probabilities to one digit and the move rounded once (see scenarios)."""
    context = context_of(spark, sf_dir)
    held = P.value_holdings(view(spark, sf_dir, "holdings"), context).where("price is not null")
    reports = A.compose(context, held, ST.cited(ST.statements(context)), digits=6, move_digits=None)
    csv = lambda c: F.array_join(c, ",").alias(c.split(".")[-1])
    rows = reports.select("symbol", "bull", "bear", F.explode("horizons").alias("h"))
    plain = ("horizon", "score", "coverage", "confidence", "recommendation", "perspective", "outlook", "fit")
    ends = (F.round("h.scenario.p_bull", 1).alias("p_bull"), F.round("h.scenario.p_bear", 1).alias("p_bear"), F.round("h.scenario.move", 0).alias("move"))
    return rows.select("symbol", *(f"h.{c}" for c in plain), *(csv(f"h.{c}") for c in ("rules", "strengths", "weaknesses", "missing")), *ends, csv("bull"), csv("bear"))


@query(RESEARCH.rstrip() + f", radar AS ({_RADAR})\nSELECT analyst, horizon, direction, count(*) AS n FROM (SELECT 'chief' AS analyst, horizon, CASE WHEN recommendation IN ('STRONG_OPPORTUNITY', 'WATCH') THEN 'up' WHEN recommendation IN ('AVOID', 'RISKY') THEN 'down' ELSE 'flat' END AS direction FROM ({_VERDICT}) UNION ALL SELECT analyst, horizon, CASE WHEN lean >= 58 THEN 'up' WHEN lean <= 42 THEN 'down' ELSE 'flat' END FROM said WHERE confidence >= 20) GROUP BY ALL")
def j15_i22_i24_predictions(spark, sf_dir):
    context = context_of(spark, sf_dir)
    claims = R.predictions_from(R.signals(context), R.verdicts(R.risk_radar(context)))
    return claims.groupBy("analyst", "horizon", "direction").agg(F.count("*").alias("n"))


_CLAIMED = lambda x, k: f"round_even({clamp(f'coalesce(0.5 + least(1.0, abs({x} - 50) / 50) * 0.25 * {k} / 100, 0.5)', 0.1, 0.9)}, 8)"


@query(RESEARCH.rstrip() + f""", radar AS ({_RADAR})
SELECT stock_id, analyst, horizon, direction, probability, DATE '2001-11-05' + CASE horizon WHEN 'short' THEN 10 WHEN 'medium' THEN 60 ELSE 180 END AS evaluate_on FROM (
 SELECT stock_id, 'chief' AS analyst, horizon, CASE WHEN recommendation IN ('STRONG_OPPORTUNITY', 'WATCH') THEN 'up' WHEN recommendation IN ('AVOID', 'RISKY') THEN 'down' ELSE 'flat' END AS direction, {_CLAIMED('score', 'confidence')} AS probability FROM ({_VERDICT})
 UNION ALL SELECT stock_id, analyst, horizon, CASE WHEN lean >= 58 THEN 'up' WHEN lean <= 42 THEN 'down' ELSE 'flat' END, {_CLAIMED('lean', 'confidence')} FROM said WHERE confidence >= 20)""")
def j15_i23_i25_claims(spark, sf_dir):
    """Every claim with its probability, unrounded here, and the day on which it is judged."""
    context = context_of(spark, sf_dir)
    claims = R.predictions_from(R.signals(context), R.verdicts(R.risk_radar(context)), digits=8)
    return claims.withColumn("evaluate_on", F.to_date(C.evaluation_date(now(), F.col("horizon"))))


GRADED = """SELECT *, CASE WHEN realised = predicted_direction THEN 1 ELSE 0 END AS correct FROM (SELECT *, CASE WHEN ret > 1.5 THEN 'up' WHEN ret < -1.5 THEN 'down' ELSE 'flat' END AS realised FROM (SELECT p.*, (q.current_price - price_at_prediction) / nullif(price_at_prediction, 0) * 100 AS ret FROM predictions p JOIN (SELECT * FROM prices WHERE current_price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY observed_at DESC, seq DESC) = 1) q ON q.stock_id = p.stock_id AND q.observed_at >= p.evaluate_at WHERE evaluate_at <= TIMESTAMP '2001-11-05 00:00:00'))"""


def graded_of(spark, sf_dir):
    due = view(spark, sf_dir, "predictions").where(F.col("evaluate_at") <= now())
    return R.grade(due, view(spark, sf_dir, "prices"))


@query(ctes("predictions", "prices") + f"SELECT prediction_id, realised, correct, round((predicted_probability - correct) ** 2, 6) AS brier FROM ({GRADED})")
def j16_grading(spark, sf_dir):
    return rounded(graded_of(spark, sf_dir).select("prediction_id", "realised", "correct", "brier"))


_PERF = f"SELECT analyst, horizon, count(*) AS n, avg(correct) AS hit_rate, avg((predicted_probability - correct) ** 2) AS brier, abs(avg(predicted_probability) - avg(correct)) AS calibration, count(*) FILTER (WHERE predicted_direction = 'up' AND realised = 'up') / nullif(count(*) FILTER (WHERE predicted_direction = 'up'), 0) AS precision, count(*) FILTER (WHERE predicted_direction = 'up' AND realised = 'up') / nullif(count(*) FILTER (WHERE realised = 'up'), 0) AS recall, CASE WHEN count(*) < 20 THEN 1.0 ELSE greatest(0.6, least(1.4, (sum(correct) + 5.0) / (count(*) + 10.0) / 0.5)) END AS multiplier FROM ({GRADED}) WHERE semantics_version = 2 AND claim_kind = 'direction' GROUP BY 1, 2"


@query(ctes("predictions", "prices") + f"SELECT analyst, horizon, n, {r('hit_rate', 'brier', 'calibration', 'precision', 'recall', 'multiplier')} FROM ({_PERF})")
def e18_j17_performance(spark, sf_dir):
    return rounded(R.performance(graded_of(spark, sf_dir)))


@query(QUERIES["e18_j17_performance"][1])
def e18_j17_learned_by_days(spark, sf_dir):
    """The same from a table of daily records: all days but the last week's first, then the last week, whose outcomes alone are read."""
    graded = stored(graded_of(spark, sf_dir), "graded")
    records = RangedTable(spark, fresh_path(spark, "records"), "day")
    for part in R.split_days(graded, "evaluate_at", 7):
        R.learn(records, part, "evaluate_at")
    return rounded(R.performance_of(records.read()))


@query(ctes("predictions", "prices") + f"SELECT CAST(sum(n) AS BIGINT) AS samples, count(*) FILTER (WHERE n >= 20) AS matured, count(*) AS groups FROM ({_PERF})")
def e19_reliability_summary(spark, sf_dir):
    return R.performance(graded_of(spark, sf_dir)).agg(F.sum("n").alias("samples"), F.count_if(F.col("n") >= 20).alias("matured"), F.count("*").alias("groups"))


@query(ctes("predictions") + "SELECT count(*) AS total, count(*) FILTER (WHERE evaluate_at <= TIMESTAMP '1998-01-01 00:00:00') AS matured FROM predictions")
def e23_maturity(spark, sf_dir):
    return view(spark, sf_dir, "predictions").agg(F.count("*").alias("total"), F.count_if(F.col("evaluate_at") <= F.lit("1998-01-01").cast("timestamp")).alias("matured"))


@query(ctes("reports") + "SELECT report_id, symbol, horizon, from_recommendation, to_recommendation FROM (" + " UNION ALL ".join(f"SELECT report_id, symbol, '{h}' AS horizon, lag(recommendation_{h}) OVER (PARTITION BY symbol, horizon_focus ORDER BY report_id) AS from_recommendation, recommendation_{h} AS to_recommendation FROM reports" for h in ("short", "medium")) + ") WHERE from_recommendation IS NOT NULL AND from_recommendation IS DISTINCT FROM to_recommendation")
def f13_thesis_changes(spark, sf_dir):
    return R.thesis_changes(view(spark, sf_dir, "reports")).select("report_id", "symbol", "horizon", "from_recommendation", "to_recommendation")


@query(ctes("reports") + "SELECT report_id, round(confidence_short - lag(confidence_short) OVER w, 6) AS confidence_delta, round(risk_score - lag(risk_score) OVER w, 6) AS risk_delta FROM reports WINDOW w AS (PARTITION BY symbol, horizon_focus ORDER BY report_id)")
def f14_deltas(spark, sf_dir):
    w = Window.partitionBy("symbol", "horizon_focus").orderBy("report_id")
    return rounded(view(spark, sf_dir, "reports").select("report_id", (F.col("confidence_short") - F.lag("confidence_short").over(w)).alias("confidence_delta"), (F.col("risk_score") - F.lag("risk_score").over(w)).alias("risk_delta")))


@query(ctes("reports", "favorites") + """SELECT day, symbol, report_id, kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY watched DESC, report_id, symbol) AS rank FROM (
 SELECT CAST(generated_at AS DATE) AS day, symbol, report_id, kind, symbol IN (SELECT stock_id FROM favorites) AS watched FROM (SELECT *, CASE WHEN p_rec IS NOT NULL AND p_rec IS DISTINCT FROM recommendation_short THEN 0 WHEN p_conf - confidence_short >= 15 THEN 1 WHEN risk_score - p_risk >= 15 THEN 2 END AS kind
 FROM (SELECT *, lag(recommendation_short) OVER w AS p_rec, lag(confidence_short) OVER w AS p_conf, lag(risk_score) OVER w AS p_risk FROM reports WINDOW w AS (PARTITION BY symbol, horizon_focus ORDER BY report_id))) WHERE kind IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY CAST(generated_at AS DATE), symbol ORDER BY report_id, kind) = 1)) WHERE rank <= 3""")
def g6_c6_notifications(spark, sf_dir):
    return R.notifications(view(spark, sf_dir, "reports"), view(spark, sf_dir, "favorites")).select("day", "symbol", "report_id", "kind", "rank")


def health_of(spark, sf_dir):
    p, n, m = view(spark, sf_dir, "prices"), view(spark, sf_dir, "news"), view(spark, sf_dir, "fundamentals")
    feeds = {"prices": (p, "observed_at", "stock_id", 72), "news": (n, "collected_at", "stock_id", 24), "reports": (view(spark, sf_dir, "reports"), "generated_at", "symbol", 48), "fundamentals": (m.withColumn("at", F.lit(None).cast("timestamp")), "at", "stock_id", 8760)}
    return H.feed_health(feeds, now(), stocks_of(spark, sf_dir))


_HEALTH = " UNION ALL ".join(f"SELECT '{f}' AS feed, count(*) AS n, max({at}) AS newest, round(count(DISTINCT {k}) / (SELECT count(*) FROM stocks), 3) AS coverage, CASE WHEN count(*) = 0 THEN 'empty' WHEN max({at}) IS NULL THEN 'degraded' WHEN (epoch(TIMESTAMP '2001-11-05 00:00:00') - epoch(max({at}))) / 3600 > {h} THEN 'stale' ELSE 'ok' END AS status FROM {f}" for f, at, k, h in (("prices", "observed_at", "stock_id", 72), ("news", "collected_at", "stock_id", 24), ("reports", "generated_at", "symbol", 48), ("fundamentals", "CAST(NULL AS TIMESTAMP)", "stock_id", 8760)))


@query(ctes("stocks", "prices", "news", "reports", "fundamentals") + _HEALTH)
def e22_feed_health(spark, sf_dir):
    return health_of(spark, sf_dir)


@query(ctes("stocks", "prices", "news", "reports", "fundamentals", more={"h": _HEALTH}) + "SELECT arg_max(status, CASE status WHEN 'ok' THEN 0 WHEN 'stale' THEN 1 WHEN 'degraded' THEN 2 ELSE 3 END) AS worst, string_agg(feed, ',' ORDER BY feed) FILTER (WHERE status <> 'ok') AS blind FROM h")
def e22_worst_status(spark, sf_dir):
    return H.worst(health_of(spark, sf_dir))


@query("SELECT count(*) AS n, max(l_orderkey) AS top, false AS same_with_a_row_twice, true AS same_in_other_order FROM lineitem")
def e24_fingerprint(spark, sf_dir):
    """The version of a table, and whether it tells a table with one row twice for another, and in other order, from it."""
    t = table(spark, sf_dir, "lineitem")
    low = t.agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("low"), F.max(F.struct("l_orderkey", "l_linenumber")).alias("high"))  # one row
    key = F.struct("l_orderkey", "l_linenumber")
    marked = t.crossJoin(F.broadcast(low))
    twice = marked.where(key != F.col("high")).select(*t.columns).unionByName(marked.where(key == F.col("low")).select(*t.columns))
    own = H.fingerprint(t)
    other = lambda df, name: H.fingerprint(df).select(F.struct("n", "digest").alias(name))
    both = own.crossJoin(other(twice, "a")).crossJoin(other(t.repartition("l_suppkey"), "b"))  # one row each
    same = lambda name: (F.struct("n", "digest") == F.col(name))
    return both.select("n", "top", same("a").alias("same_with_a_row_twice"), same("b").alias("same_in_other_order"))


_NUMBERS = " UNION ALL ".join(f"SELECT stock_id, 'ratio', '{k}:' || fiscal_year, printf('%.2f', CAST(round(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE)) FROM fundamentals WHERE source <> 'derived' AND {c} IS NOT NULL" for k, c in H.RATIOS.items())
_FACTS = f"""SELECT DISTINCT stock_id, category, key, value, sha256(category || '|' || key || '|' || value) AS fact_hash FROM (
 SELECT stock_id, 'profile' AS category, 'sector' AS key, sector AS value FROM stocks UNION ALL SELECT stock_id, 'profile', 'company_name', company_name FROM stocks UNION ALL {_NUMBERS} UNION ALL
 SELECT stock_id, 'notice', event_type, url FROM (SELECT * FROM news WHERE stock_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY collected_at DESC, news_id DESC) <= 60)) WHERE trim(coalesce(value, '')) <> ''"""


def facts_of(spark, sf_dir, **parts):
    return H.harvest(stocks_of(spark, sf_dir), view(spark, sf_dir, "fundamentals"), view(spark, sf_dir, "news"), **parts)


@query(ctes("stocks", "fundamentals", "news") + _FACTS)
def j18_knowledge(spark, sf_dir):
    return facts_of(spark, sf_dir).select("stock_id", "category", "key", "value", "fact_hash")


@query(ctes("stocks", "fundamentals", "news") + f"SELECT category, count(*) AS n FROM ({_FACTS}) GROUP BY ROLLUP (category)")
def e25_knowledge_counts(spark, sf_dir):
    return facts_of(spark, sf_dir).rollup("category").agg(F.count("*").alias("n"))


QUERIES["j18_knowledge_whole"], QUERIES["e25_knowledge_counts_whole"] = QUERIES["j18_knowledge"], QUERIES["e25_knowledge_counts"]


@query(ctes("reports") + "SELECT recommendation_short, recommendation_medium, count(*) AS n FROM reports GROUP BY CUBE (recommendation_short, recommendation_medium)")
def e10_recommendation_cube(spark, sf_dir):
    return view(spark, sf_dir, "reports").cube("recommendation_short", "recommendation_medium").agg(F.count("*").alias("n"))


@query(ctes("obs") + "SELECT string_agg(horizon, ',' ORDER BY horizon) FILTER (WHERE sep) AS separated, count(*) AS horizons FROM (SELECT horizon, coalesce(t.m - 1.96 * t.s / sqrt(t.n) > l.m + 1.96 * l.s / sqrt(l.n), false) AS sep FROM (SELECT horizon, round(avg(forward - 1), 4) AS m, stddev_samp(forward - 1) AS s, count(*) AS n FROM obs WHERE score >= 70 GROUP BY 1) t FULL JOIN (SELECT horizon, round(avg(forward - 1), 4) AS m, stddev_samp(forward - 1) AS s, count(*) AS n FROM obs WHERE score >= 45 AND score < 55 GROUP BY 1) l USING (horizon))")
def e17_verdict(spark, sf_dir):
    from sparktide.plans.market import spread

    s = spread(observations_of(spark, sf_dir))
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("separated"), F.col("horizon")))), ",")
    return s.agg(F.nullif(names, F.lit("")).alias("separated"), F.count("*").alias("horizons"))


@query("SELECT conv_id || ':' || turn AS id, CAST(len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?')) > 0 AS BOOLEAN) AS has_numbers FROM conversations")
def i31_numbers_found(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), (F.size(H.numbers_in(F.col("text"))) > 0).alias("has_numbers"))


@query("""WITH said AS (SELECT conv_id, turn, trim(coalesce(text, '')) <> '' AS filled, list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)?'), lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE)), lambda x: x IS NOT NULL)) AS xs FROM conversations),
n AS (SELECT conv_id, turn, unnest(xs) AS x FROM said),
bad AS (SELECT conv_id, turn, count(*) AS n FROM (SELECT DISTINCT * FROM n) a WHERE NOT (x = floor(x) AND x <= 100) AND NOT EXISTS (SELECT 1 FROM n b WHERE b.conv_id = a.conv_id AND b.turn <> a.turn AND abs(a.x - b.x) <= 0.011) GROUP BY 1, 2)
SELECT conv_id, turn, CAST(len(xs) AS BIGINT) AS n_numbers, coalesce(n, 0) AS n_ungrounded, filled AND n IS NULL AS ok FROM said LEFT JOIN bad USING (conv_id, turn)""")
def i31_number_grounding(spark, sf_dir):
    """Numbers of each turn against those of the other turns of its conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    texts = c.select(F.col("conv_id").alias("id"), "turn", "text")
    known = texts.select("id", "turn", F.explode(H.numbers_in(F.col("text"))).alias("x"))
    return H.grounded(texts, known, own="turn").withColumnRenamed("id", "conv_id")


_NAMED = lambda names, k: "CASE " + k + " " + " ".join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(names)) + " END"


@query(f"SELECT doc_id, CASE WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || ' min' WHEN s < 172800 THEN CAST(s // 3600 AS VARCHAR) || ' h' ELSE CAST(s // 86400 AS VARCHAR) || ' j' END AS age, printf('%+.1f', (n_chars % 1000) / 7.0 - 50.01) AS move, concat_ws(' ', {_NAMED(C.DAYS, 'isodow(d)')}, CAST(day(d) AS VARCHAR), {_NAMED(C.MONTHS, 'month(d)')}, CAST(year(d) AS VARCHAR)) AS line FROM (SELECT doc_id, n_chars, doc_id * 37 AS s, DATE '2001-11-05' - CAST(doc_id % 3000 AS INT) AS d FROM documents)")
def i29_formats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    day = F.date_sub(F.to_date(now()), (F.col("doc_id") % 3000).cast("int"))
    return d.select("doc_id", C.age_label(F.col("doc_id") * 37).alias("age"), C.signed((F.col("n_chars") % 1000) / 7.0 - 50.01).alias("move"), C.date_line(day).alias("line"))


@query(ctes("stocks", "prices", "news") + """SELECT s.symbol, p.*, n.* FROM stocks s LEFT JOIN (SELECT stock_id AS pid, count(*) AS n_points, round(sum(k * current_price), 4) AS weighted, max(observed_at) AS newest, min(observed_at) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY observed_at DESC, seq DESC) AS k FROM prices WHERE current_price IS NOT NULL) WHERE k <= 180 GROUP BY 1) p ON p.pid = s.stock_id
 LEFT JOIN (SELECT stock_id AS nid, count(*) AS n_news, sha256(string_agg(coalesce(title, ''), chr(10) ORDER BY k)) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY collected_at DESC, news_id DESC) AS k FROM news WHERE stock_id IS NOT NULL) WHERE k <= 10 GROUP BY 1) n ON n.nid = s.stock_id""".replace("p.*, n.*", "n_points, weighted, newest, oldest, n_news, titles"))
def j22_symbol_detail(spark, sf_dir):
    """What a stock's detail holds: its points as their number, sum by rank and ends, its notices as their number and a digest of their titles in order."""
    d = detail_of(spark, sf_dir)
    n = F.size("points")
    weighted = F.aggregate(F.transform("points", lambda x, i: (n - i) * x["current_price"]), F.lit(0.0), lambda a, x: a + x)
    out = d.select("symbol", F.when(F.col("points").isNotNull(), n.cast("long")).alias("n_points"), weighted.alias("weighted"), F.array_max("points")["observed_at"].alias("newest"), F.array_min("points")["observed_at"].alias("oldest"), F.when(F.col("notices").isNotNull(), F.size("notices").cast("long")).alias("n_news"), F.sha2(F.array_join(F.transform("notices", lambda x: F.coalesce(x["title"], F.lit(""))), "\n"), 256).alias("titles"))
    return rounded(out, 4)


@query()
def j22_symbol_detail_whole(spark, sf_dir):
    """Per stock: the last 180 price points, oldest first, and the last 10 notices, newest first, as arrays."""
    return detail_of(spark, sf_dir).select("symbol", "points", "notices")


def detail_of(spark, sf_dir):
    newest = lambda df, n, *order: df.withColumn("k", F.row_number().over(Window.partitionBy("stock_id").orderBy(*order))).where(F.col("k") <= n)
    p = newest(view(spark, sf_dir, "prices").where("current_price is not null").select("stock_id", "observed_at", "seq", "current_price"), 180, F.desc("observed_at"), F.desc("seq"))
    n = newest(view(spark, sf_dir, "news").where("stock_id is not null").select("stock_id", "collected_at", "news_id", "title"), 10, F.desc("collected_at"), F.desc("news_id"))
    points = p.groupBy("stock_id").agg(F.sort_array(F.collect_list(F.struct("observed_at", "seq", "current_price"))).alias("points"))
    notices = n.groupBy("stock_id").agg(F.sort_array(F.collect_list(F.struct("collected_at", "news_id", "title")), asc=False).alias("notices"))
    return stocks_of(spark, sf_dir).join(points, "stock_id", "left").join(notices, "stock_id", "left")


@query(ctes("state", "holdings") + f"""SELECT m.*, b.* FROM (SELECT count(*) FILTER (WHERE buy >= 60) AS n_strong, count(*) FILTER (WHERE abs(daily_variation) >= 5) AS n_moves, count(*) FILTER (WHERE recommendation = 'AVOID') AS n_avoid, count(*) AS n, count(*) FILTER (WHERE daily_variation > 0) AS n_up, count(*) FILTER (WHERE daily_variation < 0) AS n_down,
 arg_max(symbol, struct_pack(v := daily_variation, s := symbol)) FILTER (WHERE daily_variation IS NOT NULL) AS best, arg_min(symbol, struct_pack(v := daily_variation, s := symbol)) FILTER (WHERE daily_variation IS NOT NULL) AS worst, arg_max(symbol, struct_pack(v := buy, s := symbol)) AS first_choice FROM state) m
 CROSS JOIN (SELECT round(sum(value), 4) AS value, round(sum(net), 4) AS net, count(*) FILTER (WHERE advice = 'SELL') AS n_sell FROM ({VALUED})) b""")
def j21_digest(spark, sf_dir):
    """The day in one row: counts, best and worst mover, first choice, and what the portfolio is worth."""
    state = stored(state_of(spark, sf_dir), "state")
    by = lambda c: F.when(F.col(c).isNotNull(), F.struct(c, "symbol"))
    market = state.agg(
        F.count_if(F.col("buy") >= 60).alias("n_strong"), F.count_if(F.abs("daily_variation") >= 5).alias("n_moves"), F.count_if(F.col("recommendation") == "AVOID").alias("n_avoid"), F.count("*").alias("n"),
        F.count_if(F.col("daily_variation") > 0).alias("n_up"), F.count_if(F.col("daily_variation") < 0).alias("n_down"),
        F.max(by("daily_variation"))["symbol"].alias("best"), F.min(by("daily_variation"))["symbol"].alias("worst"), F.max(by("buy"))["symbol"].alias("first_choice"),
    )
    book = P.totals(P.value_holdings(view(spark, sf_dir, "holdings"), state)).select(F.round("value", 4).alias("value"), F.round("net", 4).alias("net"), "n_sell")
    return market.crossJoin(F.broadcast(book))  # one row each


@query(ctes("stocks", "news") + "SELECT kind, symbol FROM (SELECT DISTINCT 'event' AS kind, symbol FROM stocks JOIN news USING (stock_id) WHERE event_type = 'results' UNION SELECT 'negative', symbol FROM stocks JOIN news USING (stock_id) WHERE sentiment = 'negative')")
def h1_h2_unions(spark, sf_dir):
    n = view(spark, sf_dir, "news").join(stocks_of(spark, sf_dir), "stock_id")
    a = n.where("event_type = 'results'").select(F.lit("event").alias("kind"), "symbol")
    return a.unionByName(n.where("sentiment = 'negative'").select(F.lit("negative").alias("kind"), "symbol")).distinct()


@query("SELECT user_id, event_type, CAST(ts AS DATE) AS day, round(last(value ORDER BY ts, event_id), 6) AS value FROM events GROUP BY 1, 2, 3")
def k2_daily_last_value(spark, sf_dir):
    """Batch twin of the streaming daily bars."""
    return rounded(jobs.daily_last(table(spark, sf_dir, "events")))


@query("SELECT user_id, w AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT user_id, value, unnest([time_bucket(INTERVAL '15 minutes', ts) - i * INTERVAL '15 minutes' for i in [0, 1, 2, 3]]) AS w FROM events) GROUP BY 1, 2")
def k3_sliding_activity(spark, sf_dir):
    """Batch twin of the streaming sliding windows."""
    return rounded(jobs.sliding_activity(table(spark, sf_dir, "events")), 4)


@query("SELECT user_id, count(*) AS n, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1")
def k4_sessions(spark, sf_dir):
    """Batch twin of the streaming session windows."""
    return jobs.sessions(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("n").alias("events"))


@query("SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, event_type AS became FROM events QUALIFY was IS NOT NULL AND was <> event_type")
def k6_opinion_changes(spark, sf_dir):
    """Batch twin of the stateful change detector."""
    return jobs.opinion_changes_batch(table(spark, sf_dir, "events"))


_SLID = "SELECT user_id, w AS window_start, count(*) AS n, sum(value) AS total FROM (SELECT user_id, value, unnest([time_bucket(INTERVAL '15 minutes', ts) - i * INTERVAL '15 minutes' for i in [0, 1, 2, 3]]) AS w FROM events) GROUP BY 1, 2"


@query(f"SELECT user_id, window_start, n, round(total, 4) AS total, round(usual, 4) AS usual FROM ({_SLID}) JOIN (SELECT user_id, avg(total) AS usual FROM ({_SLID}) GROUP BY 1) USING (user_id) WHERE total >= 2 * usual + 1e-9")
def k3_unusual_activity(spark, sf_dir):
    """Hours in which a key's activity is twice its usual: the batch twin of the stream's join with a static baseline."""
    e = table(spark, sf_dir, "events")
    return rounded(jobs.unusual_activity(e, jobs.usual_activity(e)), 4)
