"""The composed analysis: for every stock and each of its horizons what is advised, on what grounds, and what may follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktide.operators.scoring import HORIZONS, WEIGHTS, decide, decide_holder, rules_met
from sparktide.plans.research import scenarios

#: Bounds of the outlook, days of history for a view of the long run, and the lead from which another horizon fits better.
OUTLOOK = (("favourable", 70.0), ("to_confirm", 55.0), ("neutral", 45.0))
LEAST_COVERAGE, LONG_DAYS, LEAD = 0.5, 120, 8.0
#: From which value on a component speaks for a stock, and up to which it speaks against it.
FOR, AGAINST = 60.0, 40.0


def outlook(score: Column, coverage: Column) -> Column:
    """What a score says: nothing much under half of the data, else by bounds."""
    out = F.when(coverage < LEAST_COVERAGE, "short_of_data")
    for name, low in OUTLOOK:
        out = out.when(score >= low, name)
    return out.otherwise("unfavourable")


def best_horizon() -> Column:
    """The horizon of the greatest score, the shortest on ties."""
    scores = [F.col(f"{h}_score") for h in HORIZONS]
    return F.coalesce(*(F.when(s == F.greatest(*scores), F.lit(h)) for h, s in zip(HORIZONS, scores)))


def fit_of(horizon: str) -> Column:
    """Whether a horizon suits a stock: too short a history for the long run, better at another one, or coherent."""
    lead = F.greatest(*(F.col(f"{h}_score") for h in HORIZONS)) - F.col(f"{horizon}_score")
    elsewhere = F.when((best_horizon() != horizon) & (lead >= LEAD), F.concat(F.lit("better:"), best_horizon())).otherwise("coherent")
    return F.when(F.col("history_days") < LONG_DAYS, "history_short").otherwise(elsewhere) if horizon == "long" else elsewhere


def _named(horizon: str, test) -> Column:
    """Names of a horizon's components that pass a test, in the order of the weights."""
    return F.filter(F.array(*(F.when(test(F.col(f"{horizon}_{k}")), F.lit(k)) for k in WEIGHTS[horizon])), lambda x: x.isNotNull())


def horizon_rows(state: DataFrame, held: DataFrame) -> DataFrame:
    """A row for each stock and horizon of ``state``. ``held (stock_id, advice, net_pct)`` are valued holdings: to their holders the portfolio's advice decides, to all others the policy."""
    risk, avoid = F.col("risk"), F.col("avoid")

    def one(h: str) -> Column:
        score, confidence, coverage = F.col(f"{h}_score"), F.col(f"{h}_confidence"), F.col(f"{h}_coverage")
        advised = F.when(F.col("advice").isNotNull(), decide_holder(F.col("advice"), F.col("net_pct"), risk)).otherwise(decide(score, risk, confidence, avoid))
        return F.struct(
            F.lit(h).alias("horizon"), score.alias("score"), coverage.alias("coverage"), confidence.alias("confidence"), advised.alias("recommendation"),
            F.when(F.col("advice").isNotNull(), "holder").otherwise("market").alias("perspective"), rules_met(score, risk, confidence, avoid).alias("rules"), outlook(score, coverage).alias("outlook"), fit_of(h).alias("fit"),
            _named(h, lambda x: x >= FOR).alias("strengths"), _named(h, lambda x: x <= AGAINST).alias("weaknesses"), _named(h, lambda x: x.isNull()).alias("missing"),
        )

    joined = state.join(held.select("stock_id", "advice", "net_pct"), "stock_id", "left")
    rows = joined.select("stock_id", "symbol", risk.alias("overall_risk"), "volatility_30d", F.explode(F.array(*map(one, HORIZONS))).alias("h"))
    return rows.select("stock_id", "symbol", "overall_risk", "volatility_30d", "h.*")


def compose(state: DataFrame, held: DataFrame, cited: DataFrame, digits: int = 2, move_digits: int | None = 1) -> DataFrame:
    """One nested report for each stock: ``(stock_id, symbol, risk, horizons, bull, bear)``.

    ``horizons`` is an array, shortest first, of score, advice, rules, outlook, fit, reasons, missing data and scenario;
    ``bull`` and ``bear`` are the codes of the cited statements ``(stock_id, case, rank, code)`` by rank. A stock without
    metrics has its horizons with what is missing; one without statements has empty lists. ``digits`` and ``move_digits`` are
    those of the scenarios.
    """
    order = F.array_position(F.array(*map(F.lit, HORIZONS)), F.col("horizon")).alias("k")
    rows = scenarios(horizon_rows(state, held), digits, move_digits)
    scenario = F.struct(*(F.col(c) for c in ("p_bull", "p_base", "p_bear", "move"))).alias("scenario")
    each = F.struct(order, "horizon", "score", "coverage", "confidence", "recommendation", "perspective", "rules", "outlook", "fit", "strengths", "weaknesses", "missing", scenario)
    reports = rows.groupBy("stock_id").agg(F.any_value("symbol").alias("symbol"), F.any_value("overall_risk").alias("risk"), F.sort_array(F.collect_list(each)).alias("horizons"))  # three a stock
    codes = lambda case: F.transform(F.sort_array(F.collect_list(F.when(F.col("case") == case, F.struct("rank", "code")))), lambda x: x["code"])
    said = cited.groupBy("stock_id").agg(codes("bull").alias("bull"), codes("bear").alias("bear"))  # as many as are cited
    none = F.array().cast("array<string>")
    return reports.join(said, "stock_id", "left").withColumns({c: F.coalesce(c, none) for c in ("bull", "bear")})
