"""What analysts state about a stock: an ordered registry of analysts, each with rules that turn the context's columns into weighted statements.

A rule is a condition in SQL over the context, so that a table of rules is configuration: the same text can be read from a
table, and serves any engine. Statements are codes with the value that they rest on; wording is left to who shows them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktide.functions.columns import half_even

_RANGE = "week52_high > 0 AND (week52_high - week52_low) / week52_high > 0.05"
#: By analyst, in the order in which they speak: slot, code, condition, polarity, weight, value.
ANALYSTS: dict[str, tuple[tuple[str, str, str, str, float, str], ...]] = {
    "technical": (
        ("strength", "above_ma50", "price > ma50", "bullish", 0.6, "ma50"),
        ("weakness", "below_ma50", "price <= ma50", "bearish", 0.6, "ma50"),
        ("strength", "momentum_up", "momentum_30d >= 3", "bullish", 0.6, "momentum_30d"),
        ("weakness", "momentum_down", "momentum_30d <= -3", "bearish", 0.6, "momentum_30d"),
        ("strength", "unusual_volume", "volume_anomaly >= 1.8", "bullish", 0.5, "volume_anomaly"),
        ("risk", "selling_pressure", "volume_anomaly >= 2 AND coalesce(daily_variation, 0) < 0", "bearish", 0.6, "volume_anomaly"),
        ("strength", "near_year_high", f"{_RANGE} AND week52_high_proximity > -2", "bullish", 0.5, "week52_high_proximity"),
        ("weakness", "near_year_low", f"{_RANGE} AND week52_high_proximity <= -2 AND week52_low_proximity >= 0 AND week52_low_proximity < 5", "bearish", 0.6, "week52_low_proximity"),
        ("strength", "near_support", "support_distance >= 0 AND support_distance <= 4", "bullish", 0.4, "support"),
        ("risk", "volatile", "volatility_30d > 40", "bearish", 0.5, "volatility_30d"),
    ),
    "market_structure": (
        ("strength", "leads_5d", "momentum_5d - market_5d >= 1.5", "bullish", 0.5, "momentum_5d - market_5d"),
        ("weakness", "lags_5d", "momentum_5d - market_5d <= -1.5", "bearish", 0.5, "momentum_5d - market_5d"),
        ("strength", "leads_30d", "relative_performance_30d >= 3", "bullish", 0.6, "relative_performance_30d"),
        ("weakness", "lags_30d", "relative_performance_30d <= -3", "bearish", 0.6, "relative_performance_30d"),
        ("strength", "strong_sector", "sector_strength >= 4", "bullish", 0.5, "sector_strength"),
        ("weakness", "weak_sector", "sector_strength <= -4", "bearish", 0.5, "sector_strength"),
        ("strength", "rotation", "sector_rank <= greatest(1, floor(n_sectors / 3))", "bullish", 0.4, "sector_rank"),
    ),
    "news": (
        ("strength", "good_news", "news_count > 0 AND coalesce(avg_impact, 0) >= 0.3", "bullish", 0.6, "avg_impact"),
        ("weakness", "bad_news", "news_count > 0 AND coalesce(avg_impact, 0) <= -0.3", "bearish", 0.6, "avg_impact"),
        ("risk", "fresh_bad_news", "news_count > 0 AND fresh_negative", "bearish", 0.7, "avg_impact"),
        ("weakness", "recent_bad_news", "news_count > 0 AND fresh_negative", "bearish", 0.6, "avg_impact"),
        ("strength", "dividend_announced", "news_count > 0 AND has_dividend", "bullish", 0.5, "news_count"),
    ),
    "history": (
        ("strength", "rebounds", "n_bars >= 20 AND n_events > 0 AND avg_fwd > 0", "bullish", 0.5, "avg_fwd"),
        ("weakness", "keeps_falling", "n_bars >= 20 AND n_events > 0 AND avg_fwd <= 0", "bearish", 0.5, "avg_fwd"),
    ),
    "company": (("risk", "controlled", "top_pct >= 50", "neutral", 0.35, "top_pct"),),
    "fundamental": (
        ("strength", "low_per", "per < 12", "bullish", 0.55, "per"),
        ("weakness", "high_per", "per > 25", "bearish", 0.55, "per"),
        ("strength", "high_roe", "roe_pct >= 15", "bullish", 0.6, "roe_pct"),
        ("weakness", "low_roe", "roe_pct < 8", "bearish", 0.55, "roe_pct"),
        ("strength", "high_yield", "dividend_yield_pct >= 4", "bullish", 0.5, "dividend_yield_pct"),
        ("risk", "high_payout", "payout_pct > 85", "bearish", 0.5, "payout_pct"),
        ("strength", "low_pbr", "pbr < 1.2", "bullish", 0.45, "pbr"),
        ("weakness", "high_pbr", "pbr > 4", "bearish", 0.45, "pbr"),
    ),
    "macro": (
        ("strength", "low_inflation", "inflation <= 2", "bullish", 0.35, "inflation"),
        ("weakness", "high_inflation", "inflation >= 5", "bearish", 0.45, "inflation"),
        ("observation", "rate_sensitive", "policy_rate IS NOT NULL AND (lower(sector) LIKE '%banque%' OR lower(sector) LIKE '%immobilier%' OR lower(sector) LIKE '%assurance%' OR lower(sector) LIKE '%crédit%' OR lower(sector) LIKE '%credit%' OR lower(sector) LIKE '%financement%')", "neutral", 0.4, "policy_rate"),
    ),
    "portfolio": (
        ("risk", "few_positions", "positions < 4", "bearish", 0.5, "positions"),
        ("strength", "diversified", "positions >= 4", "bullish", 0.3, "positions"),
        ("risk", "heavy_sector", "top_share >= 40", "bearish", 0.6, "top_share"),
        ("risk", "heavy_position", "position_share >= 25", "bearish", 0.6, "position_share"),
        ("risk", "adds_to_heavy_sector", "position_share IS NULL AND top_share >= 40 AND sector = top_sector", "bearish", 0.6, "top_share"),
    ),
}
#: Statements that a case cites at most, and the share that an analyst's lean has no part in (macro, company and portfolio only state).
CITED = 6


def statements(context: DataFrame, analysts: dict[str, tuple] = ANALYSTS) -> DataFrame:
    """``(stock_id, ord, analyst, slot, code, polarity, weight, value)`` of all rules that hold; a rule over nulls doesn't."""
    each, ord_ = [], 0
    for analyst, rules in analysts.items():
        for slot, code, condition, polarity, weight, value in rules:
            said = F.struct(F.lit(ord_).alias("ord"), F.lit(analyst).alias("analyst"), F.lit(slot).alias("slot"), F.lit(code).alias("code"), F.lit(polarity).alias("polarity"), F.lit(weight).alias("weight"), F.expr(value).cast("double").alias("value"))
            each.append(F.when(F.expr(condition), said))
            ord_ += 1
    return context.select("stock_id", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("s")).select("stock_id", "s.*")


def statements_sql(context: str) -> str:
    """The same for an engine that has no arrays of structs."""
    rows = [(a, *rule) for a, rules in ANALYSTS.items() for rule in rules]
    return " UNION ALL ".join(f"SELECT stock_id, {k} AS ord, '{a}' AS analyst, '{slot}' AS slot, '{code}' AS code, '{polarity}' AS polarity, CAST({weight} AS DOUBLE) AS weight, CAST({value} AS DOUBLE) AS value FROM {context} WHERE {condition}" for k, (a, slot, code, condition, polarity, weight, value) in enumerate(rows))


def cited(said: DataFrame, limit: int = CITED) -> DataFrame:
    """The heaviest strengths and weaknesses of each stock across analysts, in the registry's order on ties."""
    case = F.when(F.col("slot") == "strength", "bull").when(F.col("slot") == "weakness", "bear")
    w = Window.partitionBy("stock_id", "case").orderBy(F.desc("weight"), "ord")
    return said.withColumn("case", case).where("case is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def flag_weights(said: DataFrame) -> DataFrame:
    """``(stock_id, flag_weight, n_flags)``: what the bearish risk flags of all analysts weigh, and how many the portfolio analyst raises."""
    flags = said.where("slot = 'risk' and polarity = 'bearish'")
    return flags.groupBy("stock_id").agg(F.sum("weight").alias("flag_weight"), F.count_if(F.col("analyst") == "portfolio").alias("n_flags"))


def macro_report(context: DataFrame) -> DataFrame:
    """The macro analyst: no lean; how many indicators it used and how sure it is."""
    used = sum((F.col(c).isNotNull().cast("int") for c in ("policy_rate", "interbank_rate", "inflation", "core_inflation", "eur_rate", "usd_rate")), F.lit(0))
    return context.select("stock_id", used.alias("n_used"), half_even(F.when(used > 0, F.least(F.lit(100.0), 20.0 + 11.0 * used)).otherwise(0.0), 1).alias("confidence"))


def company_report(context: DataFrame) -> DataFrame:
    """The company analyst: no lean; main holder, and confidence by how many fields of the profile are there."""
    used = sum((F.col(c).isNotNull().cast("int") for c in ("description", "ownership_size")), F.lit(0))
    return context.select("stock_id", used.alias("n_used"), "main_holder", "top_pct", half_even(F.when(used > 0, F.least(F.lit(100.0), 20.0 + 12.0 * used)).otherwise(0.0), 1).alias("confidence"))
