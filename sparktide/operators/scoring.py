"""Scores on three horizons with coverage, confidence and risk, and the decision policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktide.functions.columns import clamp, covered_score, half_even, interpolate, present_mean

HORIZONS = ("short", "medium", "long")
#: Weights of the components of each horizon, and days of history that give full confidence.
WEIGHTS = {
    "short": {"momentum_court": 0.30, "volume": 0.20, "cassure": 0.20, "support": 0.15, "actualites": 0.15},
    "medium": {"tendance": 0.35, "moyennes_mobiles": 0.25, "secteur": 0.15, "volatilite": 0.15, "actualites": 0.10},
    "long": {"tendance_longue": 0.25, "stabilite": 0.20, "structure_52s": 0.15, "secteur": 0.10, "evenements": 0.10, "fondamentaux": 0.20},
}
HISTORY_DAYS = {"short": 30, "medium": 90, "long": 250}
FUNDAMENTAL_WEIGHTS = {"valorisation": 0.45, "rentabilite": 0.35, "rendement": 0.20}
PER_BANDS = ((6.0, 90.0), (12.0, 70.0), (18.0, 50.0), (25.0, 30.0), (40.0, 10.0))
PBR_BANDS = ((0.6, 90.0), (1.2, 70.0), (2.0, 50.0), (3.5, 30.0), (6.0, 10.0))
ROE_BANDS = ((2.0, 10.0), (8.0, 35.0), (13.0, 55.0), (18.0, 75.0), (25.0, 92.0))
YIELD_BANDS = ((0.0, 20.0), (2.0, 45.0), (4.0, 65.0), (6.0, 82.0), (9.0, 92.0))

#: Columns that scoring reads beside the metrics; absent ones count as no news and no fundamentals.
NEWS_DEFAULTS = {"news_count": ("long", 0), "avg_impact": ("double", None), "fresh_negative": ("boolean", False), "has_dividend": ("boolean", False), "has_results": ("boolean", False), "fundamental_score": ("double", None)}


def with_context_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(v).cast(kind) for c, (kind, v) in NEWS_DEFAULTS.items() if c not in df.columns})


def fundamental_score(per: Column, pbr: Column, roe: Column, dividend_yield: Column, digits: int | None = 1) -> Column:
    """Score of published ratios, shrunk below full coverage; null if none counts. A multiple counts only above 0."""
    value = present_mean([(F.when(per > 0, interpolate(per, PER_BANDS)), 1.0), (F.when(pbr > 0, interpolate(pbr, PBR_BANDS)), 1.0)])
    parts = {"valorisation": value, "rentabilite": interpolate(roe, ROE_BANDS), "rendement": interpolate(dividend_yield, YIELD_BANDS)}
    score, _ = covered_score(parts, FUNDAMENTAL_WEIGHTS, digits=digits)
    return F.when(F.coalesce(*parts.values()).isNotNull(), score)


def components(df: DataFrame) -> dict[str, dict[str, Column]]:
    """The components of each horizon as columns of metrics, news and fundamentals."""
    c = F.col
    has_news = c("news_count") > 0
    impact = F.coalesce("avg_impact", F.lit(0.0))
    near_high = clamp(100 - F.abs(c("week52_high_proximity")) * 6)
    tests = [F.when(c(a).isNotNull() & c(b).isNotNull(), F.when(c(a) > c(b), 100.0).otherwise(0.0)) for a, b in (("price", "ma20"), ("price", "ma50"), ("ma20", "ma50"))]
    long_base = clamp(50 + c("momentum_90d") * 1.5)
    long_base = F.when(c("ma200").isNotNull() & (c("history_days") >= 180), clamp(long_base + F.when(c("price") > c("ma200"), 8.0).otherwise(-8.0))).otherwise(long_base)
    position = (c("price") - c("week52_low")) / (c("week52_high") - c("week52_low")) * 100
    sector = clamp(50 + c("sector_strength") * 2.5)
    return {
        "short": {
            "momentum_court": present_mean([(clamp(50 + c("momentum_1d") * 4), 0.4), (clamp(50 + c("momentum_5d") * 4), 0.6)]),
            "volume": clamp((c("volume_anomaly") - 1.0) / 1.5 * 100),
            "cassure": F.when(F.coalesce("momentum_5d", F.lit(0.0)) <= 0, near_high * 0.6).otherwise(near_high),
            "support": clamp(100 - F.abs(c("support_distance")) * 8),
            "actualites": F.when(has_news, clamp(50 + impact * 35)),
        },
        "medium": {
            "tendance": present_mean([(clamp(50 + c("momentum_30d") * 2.5), 0.6), (clamp(50 + c("momentum_90d") * 2.5), 0.4)]),
            "moyennes_mobiles": present_mean([(t, 1.0) for t in tests]),
            "secteur": sector,
            "volatilite": clamp(100 - c("volatility_30d") * 1.5),
            "actualites": F.when(has_news, clamp(50 + impact * 30)),
        },
        "long": {
            "tendance_longue": long_base,
            "stabilite": present_mean([(clamp(100 - c("volatility_30d") * 1.8), 1.0), (clamp(100 + c("drawdown") * 2), 1.0)]),
            "structure_52s": F.when(c("week52_high") > c("week52_low"), clamp(F.when(position >= 20, position).otherwise(position * 0.5))),
            "secteur": sector,
            "evenements": F.when(c("has_dividend"), 70.0).when(c("has_results") & (impact > 0), 65.0).when(has_news, 50.0),
            "fondamentaux": c("fundamental_score"),
        },
    }


def risk_score() -> Column:
    """Additive technical risk, each term capped; an unknown volatility or a short history adds."""
    c = F.col
    vol, m30, fall = c("volatility_30d"), c("momentum_30d"), c("drawdown")
    terms = [
        F.when(vol.isNull(), 10.0).when(vol > 15, clamp((vol - 15) * 1.2, 0, 30)).otherwise(0.0),
        F.when(m30 < 0, clamp(-m30 * 1.5, 0, 25)).otherwise(0.0),
        F.when(fall < -10, clamp(-(fall + 10) * 1.2, 0, 20)).otherwise(0.0),
        F.when((c("volume_anomaly") >= 2) & (F.coalesce("daily_variation", F.lit(0.0)) < 0), 10.0).otherwise(0.0),
        F.when(F.coalesce("fresh_negative", F.lit(False)) | F.coalesce(c("avg_impact") <= -0.4, F.lit(False)), 12.0).otherwise(0.0),
        F.when(c("history_days") < 30, 10.0).otherwise(0.0),
    ]
    return half_even(clamp(sum(terms, F.lit(0.0))), 1)


def with_confidence(df: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """``df`` with each horizon's confidence, from coverage, history and agreement of its components (rounded to one digit, as they are reported).

    What several terms use is a column of its own: as one expression it would be made again for each use, and for each use of that.
    """
    each = [(h, c, F.col(f"__{c}")) for h, names in parts.items() for c in names]
    add = lambda h, term: sum((F.coalesce(term(x), F.lit(0.0)) for g, _, x in each if g == h), F.lit(0.0))
    n = {h: F.nullif(F.col(f"__{h}_n"), F.lit(0.0)) for h in parts}
    mean = {h: F.col(f"__{h}_mean") for h in parts}
    out = df.withColumns({f"__{c}": half_even(F.col(c), 1) for _, c, _ in each})
    out = out.withColumns({f"__{h}_n": add(h, lambda x: x.isNotNull().cast("double")) for h in parts})
    out = out.withColumns({f"__{h}_mean": add(h, lambda x: x) / n[h] for h in parts})
    out = out.withColumns({f"__{h}_near": F.lit(20.0) - F.sqrt(add(h, lambda x, h=h: (x - mean[h]) * (x - mean[h])) / n[h]) / 2.5 for h in parts})
    agreement = {h: F.when(F.col(f"__{h}_n") >= 2, clamp(F.col(f"__{h}_near"), 0, 20)).otherwise(5.0) for h in parts}
    out = out.withColumns({f"__{h}_total": F.col(f"{h}_coverage") * 50 + F.least(F.col("history_days") / HISTORY_DAYS[h], F.lit(1.0)) * 30 + agreement[h] for h in parts})
    total = {h: F.when(F.col(f"{h}_coverage") < 0.5, F.least(F.col(f"__{h}_total"), F.lit(35.0))).otherwise(F.col(f"__{h}_total")) for h in parts}
    out = out.withColumns({f"{h}_confidence": half_even(clamp(total[h]), 1) for h in parts})
    return out.drop(*(f"__{c}" for _, c, _ in each), *(f"__{h}_{x}" for h in parts for x in ("n", "mean", "near", "total")))


@dataclass(frozen=True)
class Policy:
    """Thresholds of the decision policy."""

    strong: float = 70.0
    watch: float = 55.0
    weak: float = 45.0
    risky: float = 65.0
    holder_risky: float = 70.0
    avoid: float = 60.0
    sure: float = 50.0
    take_profit: float = 15.0


def decide(score: Column, risk: Column, confidence: Column, avoid_score: Column, policy: Policy = Policy()) -> Column:
    """The recommendation to someone without a position."""
    return (
        F.when((risk >= policy.risky) & (score < policy.strong), "RISKY")
        .when(avoid_score >= policy.avoid, "AVOID")
        .when((score >= policy.strong) & (confidence >= policy.sure), "STRONG_OPPORTUNITY")
        .when(score >= policy.watch, "WATCH")
        .when(score < policy.weak, "AVOID")
        .otherwise("WATCH")
    )


def decide_holder(advice: Column, gain_pct: Column, risk: Column, policy: Policy = Policy()) -> Column:
    """The recommendation to a holder, from the portfolio's advice."""
    return F.when((advice == "SELL") & (gain_pct >= policy.take_profit), "TAKE_PROFIT").when(advice == "SELL", "RISKY").when(risk >= policy.holder_risky, "RISKY").otherwise("HOLD")


def rules_met(score: Column, risk: Column, confidence: Column, avoid_score: Column, policy: Policy = Policy()) -> Column:
    """Names of the policy's rules that hold, in order."""
    tests = [("risk_high", risk >= policy.risky), ("avoid_high", avoid_score >= policy.avoid), ("score_strong", score >= policy.strong), ("confidence_ok", confidence >= policy.sure), ("score_watch", score >= policy.watch), ("score_weak", score < policy.weak)]
    return F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests)), lambda x: x.isNotNull())


def label(recommendation: Column, buy: Column) -> Column:
    """The short label shown beside a score."""
    return F.when(recommendation == "STRONG_OPPORTUNITY", "ACHETER").when(recommendation == "WATCH", F.when(buy < 55, "NEUTRE").otherwise("SURVEILLER")).when(recommendation.isin("AVOID", "RISKY"), "ÉVITER").otherwise("NEUTRE")


def score_all(df: DataFrame, weights: dict[str, dict[str, float]] = WEIGHTS) -> DataFrame:
    """Scores, coverages and confidences of the three horizons and the risk, as columns; ``history_days`` must be there."""
    df = with_context_defaults(df)
    parts = components(df)
    df = df.withColumns({f"{h}_{k}": v for h in HORIZONS for k, v in parts[h].items()})
    out: dict[str, Column] = {"risk": risk_score()}
    for h in HORIZONS:
        own = {k: F.col(f"{h}_{k}") for k in parts[h]}
        penalty = F.when(F.col("daily_variation") > 4, 6.0).otherwise(0.0) if h == "short" else None
        out[f"{h}_score"], out[f"{h}_coverage"] = covered_score(own, weights[h], penalty)
    return with_confidence(df.withColumns(out), {h: [f"{h}_{k}" for k in parts[h]] for h in HORIZONS})


def opportunity(df: DataFrame) -> DataFrame:
    """buy, avoid and watch scores, recommendation and label."""
    df = df.withColumns({"buy": half_even(F.col("short_score"), 2), "avoid": half_even(F.col("risk"), 2)})
    df = df.withColumn("watch", half_even(clamp(0.65 * F.col("buy") + 0.35 * (100 - F.col("avoid"))), 2))
    df = df.withColumn("recommendation", decide(F.col("buy"), F.col("risk"), F.col("short_confidence"), F.col("avoid")))
    return df.withColumn("label", label(F.col("recommendation"), F.col("buy")))


def to_horizons(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each horizon: score, coverage, confidence and recommendation."""
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), *(F.col(f"{h}_{c}").alias(c) for c in ("score", "coverage", "confidence"))) for h in HORIZONS))
    out = df.select(*keep, "risk", F.explode(each).alias("h")).select(*keep, "risk", "h.*")
    return out.withColumn("recommendation", decide(F.col("score"), F.col("risk"), F.col("confidence"), F.col("risk")))
