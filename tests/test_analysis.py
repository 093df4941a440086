"""The composed analysis on stocks of all kinds."""

import math

from pyspark.sql import functions as F

from sparktide import queries_analysis
from sparktide.operators.scoring import HORIZONS, WEIGHTS
from sparktide.plans import analysis

SF = "/root/testdata/sf0.001"


def state(spark, *stocks):
    """Stocks of given scores; every component has the score of its horizon, or is null with it."""
    names = [f"{h}_{c}" for h in HORIZONS for c in ("score", "coverage", "confidence", *WEIGHTS[h])]
    kinds = "stock_id long, symbol string, risk double, avoid double, volatility_30d double, history_days int, " + ", ".join(f"{n} double" for n in names)
    rows = []
    for stock, scores, risk, days in stocks:
        values = {f"{h}_{c}": s if c != "coverage" else (0.2 if s is None else 1.0) for h, s in zip(HORIZONS, scores) for c in ("score", "coverage", "confidence", *WEIGHTS[h])}
        rows.append((stock, f"S{stock}", risk, risk, None, days, *(values[n] for n in names)))
    return spark.createDataFrame(rows, kinds)


def test_horizons_reasons_and_scenarios(spark):
    given = state(spark, (1, (50.0, 60.0, 72.0), 20.0, 300), (2, (72.0, 30.0, 71.0), 20.0, 90), (3, (40.0, 40.0, 40.0), 75.0, 300), (4, (None, None, None), 20.0, 3))
    held = spark.createDataFrame([(3, "SELL", 20.0), (9, "HOLD", 1.0)], "stock_id long, advice string, net_pct double")
    cited = spark.createDataFrame([(1, "bull", 2, "b"), (1, "bull", 1, "a"), (1, "bear", 1, "c")], "stock_id long, case string, rank int, code string")
    got = {r["stock_id"]: r for r in analysis.compose(given, held, cited).collect()}
    assert sorted(got) == [1, 2, 3, 4] and all([h["horizon"] for h in r["horizons"]] == list(HORIZONS) for r in got.values())
    one = {h["horizon"]: h for h in got[1]["horizons"]}
    assert [one[h]["outlook"] for h in HORIZONS] == ["neutral", "to_confirm", "favourable"]
    assert [one[h]["fit"] for h in HORIZONS] == ["better:long", "better:long", "coherent"]
    assert one["long"]["recommendation"] == "STRONG_OPPORTUNITY" and one["long"]["perspective"] == "market" and one["long"]["strengths"] == list(WEIGHTS["long"]) and one["long"]["missing"] == []
    assert abs(sum(one["short"]["scenario"][p] for p in ("p_bull", "p_base", "p_bear")) - 1) < 0.02
    assert (got[1]["bull"], got[1]["bear"], got[2]["bull"]) == (["a", "b"], ["c"], [])
    assert [h["fit"] for h in got[2]["horizons"]] == ["coherent", "better:short", "history_short"]
    assert {h["recommendation"] for h in got[3]["horizons"]} == {"TAKE_PROFIT"} and got[3]["horizons"][0]["perspective"] == "holder"
    assert got[3]["horizons"][0]["rules"] == ["risk_high", "avoid_high", "score_weak"] and got[3]["horizons"][0]["weaknesses"] == list(WEIGHTS["short"])
    assert [h["outlook"] for h in got[4]["horizons"]] == ["short_of_data"] * 3 and got[4]["horizons"][0]["missing"] == list(WEIGHTS["short"])
    assert analysis.compose(given.limit(0), held, cited).count() == 0


def nearly_half(monkeypatch):
    """All stocks with a volatility whose move over ten days is 9.499998, which five digits make a half."""
    whole = queries_analysis.context_of
    monkeypatch.setattr(queries_analysis, "context_of", lambda spark, sf_dir: whole(spark, sf_dir).withColumn("volatility_30d", F.lit(9.499998 / math.sqrt(10 / 252))))


def test_the_move_of_scenarios_is_rounded_once(spark, monkeypatch):
    nearly_half(monkeypatch)
    rows = queries_analysis.i27_j12_scenarios(spark, SF).where("horizon = 'short'").collect()
    assert rows and {r["move"] for r in rows} == {9.0}


def test_the_move_of_composed_reports_is_rounded_once(spark, monkeypatch):
    nearly_half(monkeypatch)
    rows = queries_analysis.j14_composed_analysis(spark, SF).where("horizon = 'short'").collect()
    assert rows and {r["move"] for r in rows} == {9.0}
