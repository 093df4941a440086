"""SQL of the core tables for the checking engine: bars, metrics, scores, observations. Written apart from the DataFrame code."""

from __future__ import annotations

from sparktide.operators import scoring as S
from sparktide.sources.views import VIEWS


def clamp(x: str, low: float = 0, high: float = 100) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({low}, least({high}, {x})) END"


def mean(parts: list[tuple[str, float]]) -> str:
    top = " + ".join(f"coalesce(({v}) * {w}, 0.0)" for v, w in parts)
    low = " + ".join(f"CASE WHEN ({v}) IS NULL THEN 0.0 ELSE {w} END" for v, w in parts)
    return f"(CAST({top} AS DOUBLE) / nullif(CAST({low} AS DOUBLE), 0))"


def cover(parts: dict[str, str], weights: dict[str, float]) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN ({parts[k]}) IS NULL THEN 0.0 ELSE CAST({w} AS DOUBLE) END" for k, w in weights.items()) + " AS DOUBLE)"


def score(parts: dict[str, str], weights: dict[str, float], penalty: str = "0.0") -> str:
    m = mean([(parts[k], w) for k, w in weights.items()])
    c = cover(parts, weights)
    return f"round_even({clamp(f'coalesce(50 + ({m} - 50) * least(1.0, {c} / 0.8), 50.0) - ({penalty})')}, 1)"


def bands(x: str, points) -> str:
    out = f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {points[0][0]} THEN {points[0][1]}"
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out += f" WHEN {x} <= {x1} THEN {y0} + ({y1 - y0}) * (({x} - {x0}) / CAST({x1 - x0} AS DOUBLE))"
    return f"CAST({out} ELSE {points[-1][1]} END AS DOUBLE)"


def pct(v: str, a: str) -> str:
    return f"(({v}) - ({a})) / nullif({a}, 0) * 100"


def ctes(*names: str, more: dict[str, str] | None = None) -> str:
    """WITH clause of the named views and core tables, each after those that it needs, then ``more``."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in out:
            return
        for need in NEEDS.get(name, ()):
            add(need)
        out[name] = VIEWS.get(name) or CORE[name]

    for name in names:
        add(name)
    out |= more or {}
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in out.items()) + "\n"


BARS = """SELECT stock_id, CAST(observed_at AS DATE) AS day, datediff('day', DATE '1970-01-01', CAST(observed_at AS DATE)) AS dn,
 last(current_price ORDER BY observed_at, seq) AS price,
 last(daily_variation ORDER BY observed_at, seq) FILTER (WHERE daily_variation IS NOT NULL) AS daily_variation,
 last(volume ORDER BY observed_at, seq) FILTER (WHERE volume IS NOT NULL) AS volume
 FROM prices WHERE current_price IS NOT NULL GROUP BY ALL"""

_over = "OVER (PARTITION BY stock_id ORDER BY dn"


def _rows(n: int) -> str:
    return f"{_over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _back(d: int) -> str:
    return f"last_value(price) {_over} RANGE BETWEEN UNBOUNDED PRECEDING AND {d} PRECEDING)"


HISTORY = f"""SELECT *, {pct('price', 'resistance')} AS drawdown, {pct('price', 'support')} AS support_distance, {pct('price', 'resistance')} AS resistance_distance,
 {pct('price', 'week52_high')} AS week52_high_proximity, {pct('price', 'week52_low')} AS week52_low_proximity FROM (
SELECT stock_id, day, dn, price, daily_variation, volume, n_days,
 {', '.join(f"{pct('price', _back(d))} AS momentum_{d}d" for d in (1, 5, 30, 90))},
 {', '.join(f"CASE WHEN n_days >= {n} THEN avg(price) {_rows(n)} END AS ma{n}" for n in (20, 50, 200))},
 CASE WHEN n_days >= 21 THEN stddev_samp(ret) {_rows(30)} * sqrt(252) * 100 END AS volatility_30d,
 volume / avg(nullif(volume, 0)) {_rows(20)} AS volume_anomaly,
 CASE WHEN n_days >= 20 THEN min(price) {_rows(90)} END AS support, CASE WHEN n_days >= 20 THEN max(price) {_rows(90)} END AS resistance,
 CASE WHEN n_days >= 120 THEN max(price) {_rows(365)} END AS week52_high, CASE WHEN n_days >= 120 THEN min(price) {_rows(365)} END AS week52_low
FROM (SELECT *, row_number() {_over}) AS n_days, price / lag(price) {_over}) - 1 AS ret FROM bars))"""

LATEST = "SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY dn DESC) = 1"

STRENGTH = """SELECT m.*, s.symbol, s.company_name, s.sector, avg(m.momentum_30d) OVER (PARTITION BY s.sector) AS sector_strength,
 m.momentum_30d - avg(m.momentum_30d) OVER () AS relative_performance_30d FROM latest m JOIN stocks s USING (stock_id)"""

NEWS_AGG = """SELECT stock_id, count(*) AS news_count, avg(impact_score) AS avg_impact, count(*) FILTER (WHERE sentiment = 'positive') AS n_positive, count(*) FILTER (WHERE sentiment = 'negative') AS n_negative,
 last(title ORDER BY collected_at, news_id) AS latest_title, max(collected_at) AS latest_at,
 coalesce(bool_or(collected_at >= TIMESTAMP '2001-11-04 00:00:00' AND sentiment = 'negative'), false) AS fresh_negative,
 bool_or(event_type IN ('ex_dividend', 'dividend_payment', 'dividend_announcement', 'dividend_cut', 'dividend')) AS has_dividend, bool_or(event_type IN ('results', 'profit_warning')) AS has_results
 FROM news WHERE stock_id IS NOT NULL AND (collected_at IS NULL OR collected_at >= TIMESTAMP '2001-10-06 00:00:00') GROUP BY stock_id"""

_has, _imp = "news_count > 0", "coalesce(avg_impact, 0.0)"
_near = clamp("100 - abs(week52_high_proximity) * 6")
_pos = "((price - week52_low) / nullif(week52_high - week52_low, 0) * 100)"
_lng = clamp("50 + momentum_90d * 1.5")
_sec = clamp("50 + sector_strength * 2.5")
_tests = [f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CASE WHEN {a} > {b} THEN 100.0 ELSE 0.0 END END" for a, b in (("price", "ma20"), ("price", "ma50"), ("ma20", "ma50"))]
PARTS = {
    "short": {
        "momentum_court": mean([(clamp("50 + momentum_1d * 4"), 0.4), (clamp("50 + momentum_5d * 4"), 0.6)]),
        "volume": clamp("(volume_anomaly - 1.0) / 1.5 * 100"),
        "cassure": f"CASE WHEN coalesce(momentum_5d, 0) <= 0 THEN ({_near}) * 0.6 ELSE {_near} END",
        "support": clamp("100 - abs(support_distance) * 8"),
        "actualites": f"CASE WHEN {_has} THEN {clamp(f'50 + {_imp} * 35')} END",
    },
    "medium": {
        "tendance": mean([(clamp("50 + momentum_30d * 2.5"), 0.6), (clamp("50 + momentum_90d * 2.5"), 0.4)]),
        "moyennes_mobiles": mean([(t, 1.0) for t in _tests]),
        "secteur": _sec,
        "volatilite": clamp("100 - volatility_30d * 1.5"),
        "actualites": f"CASE WHEN {_has} THEN {clamp(f'50 + {_imp} * 30')} END",
    },
    "long": {
        "tendance_longue": f"CASE WHEN ma200 IS NOT NULL AND history_days >= 180 THEN {clamp(f'({_lng}) + CASE WHEN price > ma200 THEN 8.0 ELSE -8.0 END')} ELSE {_lng} END",
        "stabilite": mean([(clamp("100 - volatility_30d * 1.8"), 1.0), (clamp("100 + drawdown * 2"), 1.0)]),
        "structure_52s": f"CASE WHEN week52_high > week52_low THEN {clamp(f'CASE WHEN {_pos} >= 20 THEN {_pos} ELSE {_pos} * 0.5 END')} END",
        "secteur": _sec,
        "evenements": f"CASE WHEN has_dividend THEN 70.0 WHEN has_results AND {_imp} > 0 THEN 65.0 WHEN {_has} THEN 50.0 END",
        "fondamentaux": "fundamental_score",
    },
}

RISK = f"""round_even({clamp(f'''CASE WHEN volatility_30d IS NULL THEN 10.0 WHEN volatility_30d > 15 THEN {clamp("(volatility_30d - 15) * 1.2", 0, 30)} ELSE 0.0 END
 + CASE WHEN momentum_30d < 0 THEN {clamp("-momentum_30d * 1.5", 0, 25)} ELSE 0.0 END + CASE WHEN drawdown < -10 THEN {clamp("-(drawdown + 10) * 1.2", 0, 20)} ELSE 0.0 END
 + CASE WHEN volume_anomaly >= 2 AND coalesce(daily_variation, 0) < 0 THEN 10.0 ELSE 0.0 END + CASE WHEN fresh_negative OR coalesce(avg_impact <= -0.4, false) THEN 12.0 ELSE 0.0 END
 + CASE WHEN history_days < 30 THEN 10.0 ELSE 0.0 END''')}, 1)"""


def decide(score_: str, risk: str, conf: str, avoid: str) -> str:
    return f"CASE WHEN {risk} >= 65 AND {score_} < 70 THEN 'RISKY' WHEN {avoid} >= 60 THEN 'AVOID' WHEN {score_} >= 70 AND {conf} >= 50 THEN 'STRONG_OPPORTUNITY' WHEN {score_} >= 55 THEN 'WATCH' WHEN {score_} < 45 THEN 'AVOID' ELSE 'WATCH' END"


def scored(source: str) -> str:
    """Scores of a table that has all inputs."""
    parts = ", ".join(f"{v} AS {h}_{k}" for h in S.HORIZONS for k, v in PARTS[h].items())
    names = {h: {k: f"{h}_{k}" for k in PARTS[h]} for h in S.HORIZONS}
    pen = {"short": "CASE WHEN daily_variation > 4 THEN 6.0 ELSE 0.0 END"}
    scores = ", ".join(f"{score(names[h], S.WEIGHTS[h], pen.get(h, '0.0'))} AS {h}_score, round_even({cover(names[h], S.WEIGHTS[h])}, 2) AS {h}_coverage" for h in S.HORIZONS)
    conf = []
    for h in S.HORIZONS:
        known = f"list_filter([{', '.join(f'round_even(CAST({n} AS DOUBLE), 1)' for n in names[h].values())}], lambda x: x IS NOT NULL)"
        agree = f"CASE WHEN len({known}) >= 2 THEN {clamp(f'20 - list_stddev_pop({known}) / 2.5', 0, 20)} ELSE 5.0 END"
        total = f"({h}_coverage * 50 + least(history_days / {S.HISTORY_DAYS[h]}.0, 1.0) * 30 + {agree})"
        conf.append(f"round_even({clamp(f'CASE WHEN {h}_coverage < 0.5 THEN least({total}, 35.0) ELSE {total} END')}, 1) AS {h}_confidence")
    return f"SELECT *, {', '.join(conf)} FROM (SELECT *, {scores} FROM (SELECT *, {parts}, {RISK} AS risk FROM {source}))"


_W = "short_score"
CORE = {
    "bars": BARS,
    "history": HISTORY,
    "latest": LATEST,
    "strength": STRENGTH,
    "news_agg": NEWS_AGG,
    "state_in": "SELECT s.*, n_days AS history_days, coalesce(a.news_count, 0) AS news_count, a.avg_impact, coalesce(a.fresh_negative, false) AS fresh_negative, coalesce(a.has_dividend, false) AS has_dividend, coalesce(a.has_results, false) AS has_results, CAST(NULL AS DOUBLE) AS fundamental_score FROM strength s LEFT JOIN news_agg a USING (stock_id)",
    "state": f"""SELECT *, {decide('buy', 'risk', 'short_confidence', 'avoid')} AS recommendation FROM (SELECT *, round_even({clamp('0.65 * buy + 0.35 * (100 - avoid)')}, 2) AS watch FROM (SELECT *, short_score AS buy, risk AS avoid FROM ({scored('state_in')})))""",
    "days": "SELECT dn, row_number() OVER (ORDER BY dn) - 1 AS idx FROM (SELECT DISTINCT dn FROM bars)",
    "sampled": "SELECT dn FROM days WHERE idx % 20 = 0",
    "pit_in": """SELECT h.* EXCLUDE (dn, day), p.dn, s.symbol, s.sector, h.n_days AS history_days, 0 AS news_count, CAST(NULL AS DOUBLE) AS avg_impact, false AS fresh_negative, false AS has_dividend, false AS has_results, CAST(NULL AS DOUBLE) AS fundamental_score,
 avg(h.momentum_30d) OVER (PARTITION BY p.dn, s.sector) AS sector_strength
 FROM (SELECT st.stock_id, sampled.dn FROM (SELECT DISTINCT stock_id FROM bars) st CROSS JOIN sampled) p ASOF JOIN history h ON p.stock_id = h.stock_id AND p.dn >= h.dn JOIN stocks s ON s.stock_id = p.stock_id""",
    "pit": scored("(SELECT * FROM pit_in WHERE history_days >= 60)"),
    "level": "SELECT b.dn, idx, avg(price) AS level FROM bars b JOIN days USING (dn) GROUP BY ALL",
    "said": "SELECT stock_id, symbol, sector, dn, history_days, risk, horizon, score, coverage, confidence, ahead FROM (" + " UNION ALL ".join(f"SELECT stock_id, symbol, sector, dn, history_days, risk, '{h}' AS horizon, {h}_score AS score, {h}_coverage AS coverage, {h}_confidence AS confidence, {n} AS ahead FROM pit" for h, n in (("short", 10), ("medium", 60), ("long", 180))) + ")",
    "obs": f"""SELECT stock_id, symbol, sector, dn, history_days, risk, horizon, score, coverage, confidence, {decide('score', 'risk', 'confidence', 'risk')} AS recommendation,
 round_even((p1 - p0) / p0 * 100, 4) AS forward, round_even(coalesce(bench, 0.0), 4) AS benchmark, round_even((p1 - p0) / p0 * 100 - coalesce(bench, 0.0), 4) AS excess
 FROM (SELECT x.*, a.price AS p0, z.price AS p1, (l2.level - l1.level) / nullif(l1.level, 0) * 100 AS bench
  FROM (SELECT said.*, t.dn AS target, d.idx FROM said JOIN days d ON d.dn = said.dn JOIN days t ON t.idx = d.idx + said.ahead) x
  ASOF JOIN bars a ON a.stock_id = x.stock_id AND x.dn >= a.dn ASOF JOIN bars z ON z.stock_id = x.stock_id AND x.target >= z.dn
  LEFT JOIN level l1 ON l1.dn = x.dn LEFT JOIN level l2 ON l2.dn = x.target) WHERE p0 <> 0""",
}
NEEDS = {
    "bars": ("prices",), "history": ("bars",), "latest": ("history",), "strength": ("latest", "stocks"), "news_agg": ("news",), "state_in": ("strength", "news_agg"), "state": ("state_in",),
    "days": ("bars",), "sampled": ("days",), "pit_in": ("history", "sampled", "stocks"), "pit": ("pit_in",), "level": ("bars", "days"), "said": ("pit",), "obs": ("said", "days", "bars", "level"),
}
