"""Analysts, debate, risk, verdicts, predictions and their grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktide.functions import columns as C
from sparktide.operators.scoring import HORIZONS, components, decide, with_context_defaults
from sparktide.sources.ranged import RangedTable
from sparktide.sources.state import upsert_replace

#: An analyst's own weights on the shared components.
TECHNICAL_WEIGHTS = {
    "short": {"momentum_court": 0.40, "volume": 0.25, "cassure": 0.20, "support": 0.15},
    "medium": {"tendance": 0.50, "moyennes_mobiles": 0.30, "volatilite": 0.20},
    "long": {"tendance_longue": 0.40, "stabilite": 0.35, "structure_52s": 0.25},
}
FUNDAMENTAL_WEIGHTS = {"valorisation": 0.35, "rentabilite": 0.30, "rendement": 0.20, "actif_net": 0.15}
RISK_WEIGHTS = {"technique": 0.30, "historique": 0.20, "valorisation": 0.15, "evenementiel": 0.15, "liquidite": 0.10, "portefeuille": 0.10}
#: What unmeasured risk counts, the weight of a flag and the most that flags add.
UNKNOWN_RISK, FLAG_WEIGHT, FLAG_MOST = 58.0, 6.0, 22.0
#: A day's fall that makes an event, sessions to look ahead, days of history needed.
EVENT_FALL, EVENT_AHEAD, EVENT_DAYS = -3.0, 5, 20
BULL, BEAR, HEARD = 58.0, 42.0, 20.0
#: Constants of an analyst's reliability.
PRIOR_HITS, PRIOR_N, LEAST_N, LOW, HIGH = 5.0, 10.0, 20, 0.6, 1.4


def _present(*cols: Column) -> Column:
    return sum((c.isNotNull().cast("int") for c in cols), F.lit(0))


def event_study(bars: DataFrame) -> DataFrame:
    """After a fall of three percent or more: the mean return of the next sessions, how often it was positive, and the usual move."""
    w = Window.partitionBy("stock_id").orderBy("dn")
    moves = bars.withColumns({"ret": (F.col("price") / F.lag("price").over(w) - 1) * 100, "fwd": (F.lead("price", EVENT_AHEAD).over(w) / F.col("price") - 1) * 100})
    hit = F.when((F.col("ret") <= EVENT_FALL) & F.col("fwd").isNotNull(), F.col("fwd"))
    return moves.groupBy("stock_id").agg(F.avg(hit).alias("avg_fwd"), F.avg((hit > 0).cast("double")).alias("share_up"), F.count(hit).alias("n_events"), F.sqrt(F.avg(F.col("ret") * F.col("ret"))).alias("rms"), F.count("*").alias("n_bars"))


def known_components(ctx: DataFrame) -> dict[str, dict[str, Column]]:
    """The components of each horizon, as columns where the state holds them already: what reads them several times then stays small."""
    return {h: {k: F.col(f"{h}_{k}") if f"{h}_{k}" in ctx.columns else v for k, v in parts.items()} for h, parts in components(ctx).items()}


def signals(context: DataFrame) -> DataFrame:
    """``(stock_id, analyst, horizon, lean, confidence)`` of all analysts, one row each.

    ``context`` is the market state with event studies, fundamentals and the market's mean 5-day momentum joined to it. An
    analyst without its inputs isn't heard: its confidence says so, and missing rows mean a confidence of 0.
    """
    ctx = with_context_defaults(context)
    c, parts = F.col, known_components(ctx)
    days = F.col("history_days")
    med_cover = C.coverage_of(parts["medium"], TECHNICAL_WEIGHTS["medium"])
    rel5 = C.clamp(50 + (c("momentum_5d") - c("market_5d")) * 3)
    rel30, sector = C.clamp(50 + c("relative_performance_30d") * 2.5), C.clamp(50 + c("sector_strength") * 2.5)
    structure_conf = C.half_even(C.clamp(_present(rel5, rel30, sector) / 3 * 55 + F.least(days / 60, F.lit(1.0)) * 30 + 5), 1)
    mood = F.when(c("news_count") > 0, C.clamp(50 + F.coalesce("avg_impact", F.lit(0.0)) * 35))
    news_conf = F.when(c("news_count") > 0, C.half_even(C.clamp(35 + 8 * F.least(c("news_count"), F.lit(6)) + F.when(c("avg_impact").isNotNull(), 10).otherwise(0)), 1)).otherwise(15.0)
    history = C.clamp(50 + c("avg_fwd") * 4)
    history_conf = F.when(c("n_bars") < EVENT_DAYS, c("n_bars") / 20.0 * 20).when(c("n_events") > 0, 20 + C.clamp(c("n_events") * 12.0, 0, 60)).otherwise(F.least(F.lit(40.0), days / 90 * 40))
    own = {"valorisation": C.clamp(50 - (c("per") - 15) * 3), "rentabilite": C.clamp(50 + (c("roe_pct") - 10) * 2.5), "rendement": C.clamp(25 + c("dividend_yield_pct") * 10), "actif_net": C.clamp(85 - (c("pbr") - 1) * 15)}
    value, value_conf = C.lean(own, FUNDAMENTAL_WEIGHTS), C.half_even(C.clamp(20 + 12 * _present(*own.values()) - F.when(c("per_is_derived"), 8).otherwise(0)), 1)
    rows = [(f"technical:{h}", "technical", h, C.lean(parts[h], TECHNICAL_WEIGHTS[h]), C.half_even(C.clamp(60 * med_cover + 40 * F.least(days / 90, F.lit(1.0))), 1)) for h in HORIZONS]
    rows += [("", "market_structure", "short", C.lean({"r": rel5}, {"r": 1.0}), structure_conf), ("", "market_structure", "medium", C.lean({"s": sector, "r": rel30}, {"s": 0.5, "r": 0.5}), structure_conf), ("", "market_structure", "long", C.lean({"s": sector}, {"s": 1.0}), structure_conf)]
    rows += [("", "news", h, F.when(c("news_count") > 0, C.half_even(mood, 1) if h != "long" else C.half_even(F.when(c("has_dividend") | c("has_results"), 65.0).otherwise(0.5 * mood + 25), 1)), news_conf) for h in HORIZONS]
    rows += [("", "history", h, F.when(c("n_events") > 0, C.half_even(history if h == "short" else (history + 50) / 2, 1)), C.half_even(history_conf, 1)) for h in ("short", "medium")]
    rows += [("", "fundamental", h, F.when(_present(*own.values()) > 0, value), value_conf) for h in ("medium", "long")]
    each = F.array(*(F.struct(F.lit(a).alias("analyst"), F.lit(h).alias("horizon"), x.cast("double").alias("lean"), k.cast("double").alias("confidence")) for _, a, h, x, k in rows))
    return ctx.select("stock_id", F.explode(each).alias("s")).select("stock_id", "s.*").where("lean is not null")


def debate(said: DataFrame, reliability: DataFrame | None = None) -> DataFrame:
    """Every bull against every bear of a stock and horizon: weights, winner, or unresolved within 15 percent."""
    heard = said.where(F.col("confidence") >= HEARD)
    if reliability is not None:
        heard = heard.join(reliability, ["analyst", "horizon"], "left")
    else:
        heard = heard.withColumn("multiplier", F.lit(1.0))
    heard = heard.withColumn("weight", C.half_even(F.abs(F.col("lean") - 50) / 50 * F.col("confidence") / 100 * F.coalesce("multiplier", F.lit(1.0)), 4))
    side = lambda name, cond: heard.where(cond).select("stock_id", "horizon", F.col("analyst").alias(name), F.col("weight").alias(f"{name}_weight"))
    pairs = side("bull", F.col("lean") >= BULL).join(side("bear", F.col("lean") <= BEAR), ["stock_id", "horizon"])  # at most a handful of analysts a side
    most, gap = F.greatest("bull_weight", "bear_weight"), F.abs(F.col("bull_weight") - F.col("bear_weight"))
    close = (most == 0) | (gap / F.nullif(most, F.lit(0.0)) < 0.15)
    return pairs.withColumn("winner", F.when(close, "unresolved").when(F.col("bull_weight") > F.col("bear_weight"), "bull").otherwise("bear"))


def debate_summary(pairs: DataFrame) -> DataFrame:
    count = lambda w: F.count_if(F.col("winner") == w).alias(f"n_{w}")
    return pairs.groupBy("stock_id", "horizon").agg(F.count("*").alias("clashes"), count("bull"), count("bear"), count("unresolved"))


def contradictions(said: DataFrame) -> DataFrame:
    """Stocks and horizons on which some analyst is a bull and another a bear."""
    names = lambda cond, n: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("analyst")))), ",").alias(n)
    out = said.groupBy("stock_id", "horizon").agg(names(F.col("lean") >= BULL, "bulls"), names(F.col("lean") <= BEAR, "bears"))
    return out.where("bulls <> '' and bears <> ''")


def risk_radar(ctx: DataFrame) -> DataFrame:
    """Overall risk: weighted dimensions, what isn't measured priced prudently, flags on top up to a bound."""
    ctx = with_context_defaults(ctx)
    c = F.col
    dims = {
        "technique": C.half_even(C.clamp(c("risk")), 1),
        "historique": C.half_even(C.clamp(100 - c("history_days") * 1.1, 10, 90), 1),
        "valorisation": C.half_even(C.clamp((c("per") - 15) * 3), 1),
        "evenementiel": F.when(c("news_count") == 0, 40.0).when(c("fresh_negative") | (F.coalesce("avg_impact", F.lit(0.0)) <= -0.3), 70.0).otherwise(30.0),
        "liquidite": F.when(c("volume").isNull(), 60.0).when(c("volume_anomaly") < 0.5, 55.0).otherwise(30.0),
        "portefeuille": F.when(c("has_book"), C.half_even(C.clamp(20.0 + 20.0 * c("n_flags")), 1)),
    }
    out = ctx.withColumns({f"risk_{k}": v for k, v in dims.items()})
    measured = sum((F.coalesce(C.half_even(F.col(f"risk_{k}") * w, 2), F.lit(0.0)) for k, w in RISK_WEIGHTS.items()), F.lit(0.0))
    coverage = C.half_even(sum((F.when(F.col(f"risk_{k}").isNotNull(), w).otherwise(0.0) for k, w in RISK_WEIGHTS.items()), F.lit(0.0)), 3)
    flags = C.half_even(F.least(F.lit(FLAG_MOST), FLAG_WEIGHT * F.coalesce("flag_weight", F.lit(0.0))), 1)
    out = out.withColumns({"risk_coverage": coverage, "flag_penalty": flags, "measured": measured})
    overall = C.half_even(C.clamp(F.col("measured") + C.half_even(UNKNOWN_RISK * (1.0 - F.col("risk_coverage")), 2) + F.col("flag_penalty")), 1)
    known = _present(*(F.col(f"risk_{k}") for k in RISK_WEIGHTS))
    return out.withColumns({"overall_risk": overall, "risk_confidence": C.half_even(C.clamp(35 + known / 6 * 40 + F.least(F.col("history_days") / 90, F.lit(1.0)) * 20), 1)})


def verdicts(radar: DataFrame) -> DataFrame:
    """One row for each stock and horizon: score, confidence and the policy's decision under the overall risk."""
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"{h}_score").alias("score"), F.col(f"{h}_confidence").alias("confidence")) for h in HORIZONS))
    out = radar.select("stock_id", "overall_risk", F.explode(each).alias("v")).select("stock_id", "overall_risk", "v.*")
    return out.withColumn("recommendation", decide(F.col("score"), F.col("overall_risk"), F.col("confidence"), F.col("overall_risk")))


def scenarios(rows: DataFrame, digits: int = 2, move_digits: int | None = 1) -> DataFrame:
    """Bull, base and bear probabilities and the expected move of each verdict; needs score, confidence, overall_risk, volatility_30d and horizon. Without ``move_digits`` the move is left as it is, for those who round it themselves."""
    score, w = F.col("score"), F.col("confidence") / 100
    raw = [F.greatest(F.lit(0.05), (score - 35) / 65), F.lit(0.9), F.greatest(F.lit(0.05), (65 - score) / 65) * (1 + F.col("overall_risk") / 100)]
    total = sum(raw, F.lit(0.0))
    mixed = [w * p / total + (1 - w) / 3 for p in raw]
    again = sum(mixed, F.lit(0.0))
    days = F.when(F.col("horizon") == "short", 10).when(F.col("horizon") == "medium", 60).otherwise(180)
    move = F.greatest(F.lit(2.0), F.coalesce("volatility_30d", F.lit(25.0)) * F.sqrt(days / 252))
    return rows.withColumns({n: C.half_even(p / again, digits) for n, p in zip(("p_bull", "p_base", "p_bear"), mixed)} | {"move": move if move_digits is None else C.half_even(move, move_digits)})


def predictions_from(said: DataFrame, final: DataFrame, digits: int = 4) -> DataFrame:
    """Falsifiable claims: three of the verdicts, and one for each analyst's lean that is heard."""
    chief = final.select("stock_id", F.lit("chief").alias("analyst"), "horizon", C.claim_direction(F.col("recommendation")).alias("direction"), C.claimed_probability(F.col("score"), F.col("confidence"), digits).alias("probability"))
    others = said.where(F.col("confidence") >= HEARD).select("stock_id", "analyst", "horizon", C.lean_direction(F.col("lean")).alias("direction"), C.claimed_probability(F.col("lean"), F.col("confidence"), digits).alias("probability"))
    return chief.unionByName(others)


def realised(due: DataFrame, prices: DataFrame) -> DataFrame:
    """What became of due predictions: the newest price of the stock, if it isn't before the evaluation date.

    Only the newest price of a stock can be the answer, so it is one row for each stock that predictions meet; there is no
    range join. A prediction whose date lies after that row has no outcome yet.
    """
    last = prices.where("current_price is not null").groupBy("stock_id").agg(F.max_by(F.struct("observed_at", F.col("current_price").alias("last_price")), F.struct("observed_at", "seq")).alias("q"))
    out = due.join(last, "stock_id").where(F.col("q.observed_at") >= F.col("evaluate_at"))
    anchor = F.nullif(F.col("price_at_prediction"), F.lit(0.0))
    return out.withColumn("ret", (F.col("q.last_price") - F.col("price_at_prediction")) / anchor * 100).drop("q")


def grade(due: DataFrame, prices: DataFrame) -> DataFrame:
    """Outcomes: realised direction, whether it came as predicted, and the Brier score."""
    out = realised(due, prices).where("ret is not null").withColumn("realised", C.direction(F.col("ret")))
    hit = (F.col("realised") == F.col("predicted_direction")).cast("int")
    return out.withColumns({"correct": hit, "brier": (F.col("predicted_probability") - hit) * (F.col("predicted_probability") - hit)})


#: What a group's record consists of: counts and sums, which add up over days.
RECORD = ("n", "hits", "n_brier", "brier_sum", "n_p", "p_sum", "both", "said_up", "was_up")


def outcome_record(outcomes: DataFrame, *by: str) -> DataFrame:
    """The record of each analyst and horizon, and of each ``by``: sufficient statistics of gradable directional claims of the current semantics."""
    use = outcomes.where("semantics_version = 2 and claim_kind = 'direction' and predicted_direction is not null")
    said_up, was_up = F.col("predicted_direction") == "up", F.col("realised") == "up"
    return use.groupBy(*by, "analyst", "horizon").agg(
        F.count("*").alias("n"), F.sum("correct").alias("hits"), F.count("brier").alias("n_brier"), F.sum("brier").alias("brier_sum"), F.count("predicted_probability").alias("n_p"), F.sum("predicted_probability").alias("p_sum"),
        F.count_if(said_up & was_up).alias("both"), F.count_if(said_up).alias("said_up"), F.count_if(was_up).alias("was_up"),
    )


def performance_of(record: DataFrame) -> DataFrame:
    """Reliability of each analyst and horizon from records of any days, which are added up."""
    out = record.groupBy("analyst", "horizon").agg(*(F.sum(c).alias(c) for c in RECORD))
    mean = lambda total, n: F.col(total) / F.nullif(n, F.lit(0))
    rate = F.col("hits") / F.col("n")
    multiplier = F.when(F.col("n") < LEAST_N, 1.0).otherwise(C.clamp((F.col("hits") + PRIOR_HITS) / (F.col("n") + PRIOR_N) / 0.5, LOW, HIGH))
    return out.select("analyst", "horizon", "n", rate.alias("hit_rate"), mean("brier_sum", "n_brier").alias("brier"), F.abs(mean("p_sum", "n_p") - rate).alias("calibration"), mean("both", "said_up").alias("precision"), mean("both", "was_up").alias("recall"), multiplier.alias("multiplier"))


def performance(outcomes: DataFrame) -> DataFrame:
    """Record and reliability of each analyst and horizon, from gradable directional claims of the current semantics."""
    return performance_of(outcome_record(outcomes))


def learn(records: RangedTable, outcomes: DataFrame, day: str, batch: int | None = None) -> None:
    """Put the record of the days that ``outcomes`` are of into a table in ranges of days; outcomes of other days aren't read, and a day that comes again is replaced."""
    new = outcome_record(outcomes.withColumn("day", F.col(day).cast("date")), "day")
    records.merge(new, lambda old, fresh: upsert_replace(old, fresh, ["day", "analyst", "horizon"], [F.lit(0)]), batch)


def split_days(outcomes: DataFrame, at: str, last: int) -> tuple[DataFrame, DataFrame]:
    """Outcomes before the ``last`` days and those of them; the cut lies between days, since a day that is learnt in two parts would be replaced by the second."""
    day = F.to_date(at)
    newest = outcomes.agg(F.max(day)).first()[0]
    new = F.coalesce(day > F.date_sub(F.lit(newest).cast("date"), last), F.lit(False))
    return outcomes.where(~new), outcomes.where(new)


def thesis_changes(reports: DataFrame) -> DataFrame:
    """A row for each horizon on which a report's recommendation differs from the one before it."""
    w = Window.partitionBy("symbol", "horizon_focus").orderBy("report_id")
    prior = F.lag(F.struct("recommendation_short", "recommendation_medium", "confidence_short", "risk_score")).over(w)
    seen = reports.withColumn("was", prior)
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"was.recommendation_{h}").alias("from_recommendation"), F.col(f"recommendation_{h}").alias("to_recommendation")) for h in ("short", "medium")))
    deltas = {"confidence_delta": F.col("confidence_short") - F.col("was.confidence_short"), "risk_delta": F.col("risk_score") - F.col("was.risk_score")}
    out = seen.withColumns(deltas).select("report_id", "symbol", "confidence_delta", "risk_delta", F.explode(each).alias("c")).select("report_id", "symbol", "confidence_delta", "risk_delta", "c.*")
    changed = F.col("from_recommendation").isNotNull() & ~F.col("from_recommendation").eqNullSafe(F.col("to_recommendation"))
    part = lambda c, name: F.when(F.abs(c) >= 5, F.concat(F.lit(name), C.signed(F.col(c))))
    return out.where(changed).withColumn("reason", F.concat_ws("; ", part("confidence_delta", "confidence "), part("risk_delta", "risk ")))


def notifications(reports: DataFrame, favorites: DataFrame, *, cap: int = 3) -> DataFrame:
    """What is worth telling: changes of opinion, falls of confidence and rises of risk; watched symbols first, at most ``cap`` a day, one for each symbol."""
    w = Window.partitionBy("symbol", "horizon_focus").orderBy("report_id")
    was = reports.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("recommendation_short", "confidence_short", "risk_score")})
    kind = (
        F.when(F.col("p_recommendation_short").isNotNull() & ~F.col("p_recommendation_short").eqNullSafe(F.col("recommendation_short")), 0)
        .when(F.col("p_confidence_short") - F.col("confidence_short") >= 15, 1)
        .when(F.col("risk_score") - F.col("p_risk_score") >= 15, 2)
    )
    events = was.withColumns({"kind": kind, "day": F.to_date("generated_at")}).where("kind is not null")
    events = events.join(favorites.select(F.col("stock_id").alias("symbol"), F.lit(True).alias("watched")).distinct(), "symbol", "left").withColumn("watched", F.coalesce("watched", F.lit(False)))
    once = events.groupBy("day", "symbol").agg(F.min_by(F.struct("report_id", "kind", "watched"), F.struct("report_id", "kind")).alias("e")).select("day", "symbol", "e.*")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("watched"), "report_id", "symbol"))).where(F.col("rank") <= cap)
