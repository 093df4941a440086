"""Boundaries, ladders and identities of the rules, on tiny frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparktide.functions import columns as C
from sparktide.operators import metrics as M
from sparktide.operators import news as N
from sparktide.operators import scoring as S
from sparktide.plans import health, market, research
from sparktide.sources import state

DAY0 = dt.datetime(2020, 1, 1)


def bars(spark, prices, stock=1):
    rows = [(k, stock, DAY0 + dt.timedelta(days=k), float(p), 0.1, 10.0) for k, p in enumerate(prices)]
    return M.daily_bars(spark.createDataFrame(rows, "seq long, stock_id long, observed_at timestamp, current_price double, daily_variation double, volume double"))


@pytest.mark.parametrize("n,col,known", [(19, "ma20", False), (20, "ma20", True), (49, "ma50", False), (50, "ma50", True), (20, "volatility_30d", False), (21, "volatility_30d", True), (19, "support", False), (20, "support", True), (119, "week52_high", False), (120, "week52_high", True)])
def test_window_boundaries(spark, n, col, known):
    b = bars(spark, [100 + k for k in range(n)])
    both = [M.latest_metrics(b).first()[col], M.metrics_history(b).orderBy(F.desc("dn")).first()[col]]
    assert [x is not None for x in both] == [known, known]


def test_momentum_takes_the_last_price_at_or_before_the_cutoff(spark):
    b = bars(spark, [100, 110, 121]).where("dn <> 18263")  # the second day is missing
    row = M.latest_metrics(b).first()
    assert row["momentum_1d"] == pytest.approx(21.0) and row["momentum_5d"] is None


def test_daily_bar_keeps_the_last_value_of_each_column(spark):
    t = DAY0.replace(hour=15)
    rows = [(1, 1, t, 10.0, 1.0, None), (2, 1, t.replace(hour=16), 11.0, None, 5.0), (3, 1, t.replace(hour=17), None, None, 7.0)]
    out = M.daily_bars(spark.createDataFrame(rows, "seq long, stock_id long, observed_at timestamp, current_price double, daily_variation double, volume double")).first()
    assert (out["price"], out["daily_variation"], out["volume"]) == (11.0, 1.0, 5.0)


@pytest.mark.parametrize("score,risk,confidence,want", [(44, 0, 90, "AVOID"), (45, 0, 90, "WATCH"), (54, 0, 90, "WATCH"), (55, 0, 90, "WATCH"), (69, 0, 90, "WATCH"), (70, 0, 49, "WATCH"), (70, 0, 50, "STRONG_OPPORTUNITY"), (69, 65, 90, "RISKY"), (70, 65, 90, "AVOID"), (80, 59, 90, "STRONG_OPPORTUNITY"), (80, 60, 90, "AVOID")])
def test_policy_ladder(spark, score, risk, confidence, want):
    row = spark.createDataFrame([(float(score), float(risk), float(confidence))], "s double, r double, c double")
    assert row.select(S.decide(F.col("s"), F.col("r"), F.col("c"), F.col("r"))).first()[0] == want


def test_missing_is_never_zero(spark):
    row = spark.createDataFrame([(None, 5.0)], "x double, y double")
    got = row.select(C.clamp(F.col("x")), C.pct_distance(F.col("x"), F.col("y")), C.pct_distance(F.col("y"), F.lit(0.0)), C.present_mean([(F.col("x"), 1.0)]), C.interpolate(F.col("x"), S.PER_BANDS)).first()
    assert all(v is None for v in got)


def test_coverage_shrinks_toward_fifty(spark):
    row = spark.createDataFrame([(90.0, None)], "a double, b double")
    score, cover = C.covered_score({"a": F.col("a"), "b": F.col("b")}, {"a": 0.4, "b": 0.6})
    assert tuple(row.select(score, cover).first()) == (70.0, 0.4)


@pytest.mark.parametrize("text,want", [("1.234,50", 1234.5), ("12,5 %", 12.5), ("3 K", 3000.0), ("2,5 M", 2.5e6), ("-", None), ("N/A", None), ("", None), ("100 MAD", 100.0), ("abc", None), ("+3.2", 3.2)])
def test_parse_number(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(C.parse_number(F.col("s"))).first()[0] == want


def test_parse_number_makes_each_step_once(spark):
    assert str(C.parse_number(F.col("written"))).count("written") == 1


def test_confidence_makes_no_array_again_for_each_element(spark):
    row = spark.createDataFrame([(90.0, None, 10.0, 0.9, 30)], "a double, b double, c double, h_coverage double, history_days int").withColumnRenamed("h_coverage", "short_coverage")
    out = S.with_confidence(row, {"short": ["a", "b", "c"]})
    assert out.first()["short_confidence"] == 79.0 and "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("title,event,mood", [("Détachement du dividende", "ex_dividend", "neutral"), ("Distribution de dividende", "dividend_announcement", "positive"), ("PROFIT WARNING", "profit_warning", "negative"), ("Résultats en forte hausse", "results", "positive"), ("Résultats semestriels", "results", "neutral"), ("Résultats en baisse", "results", "negative"), ("Augmentation de capital réservée aux salariés", "capital_increase_employees", "neutral"), ("Augmentation de capital en numéraire", "capital_increase_cash", "negative"), ("Rachat d’actions", "share_buyback", "positive"), ("Bonjour", "announcement", "neutral"), (None, "announcement", "neutral")])
def test_classifier(spark, title, event, mood):
    got = spark.createDataFrame([(title,)], "t string").select(N.classify(F.col("t")).alias("c")).first()["c"]
    assert (got["event"], got["sentiment"]) == (event, mood)


def test_forward_return_never_looks_past_the_calendar(spark):
    b = bars(spark, [100 + k for k in range(7)])
    days = market.calendar(b)
    got = {r["dn"]: r["ret"] for r in market.forward_returns(b, days, 3, b.select("stock_id", "dn")).collect()}
    first = min(got)
    assert len(got) == 4 and got[first] == pytest.approx(3.0)


def test_no_leak_from_the_future(spark):
    path = [100 + (k * 7) % 13 + k * 0.05 for k in range(320)]
    twice = path[:300] + [p * 3 for p in path[300:]]
    stocks = spark.createDataFrame([(1, "A", "A", "x"), (2, "B", "B", "y")], "stock_id long, symbol string, company_name string, sector string")
    both = bars(spark, path, 1).unionByName(bars(spark, twice, 2))
    days = market.calendar(both)
    seen = S.score_all(market.point_in_time(both, stocks, days, 20, 60)).select("stock_id", "dn", "medium_score", "long_score").collect()
    by = {(r["stock_id"], r["dn"]): (r["medium_score"], r["long_score"]) for r in seen}
    start = min(d for _, d in by) - 60
    early = [d for s, d in by if s == 1 and d < start + 300]
    assert early and all(by[1, d] == by[2, d] for d in early)
    late = [d for s, d in by if s == 1 and d >= start + 300]
    assert any(by[1, d] != by[2, d] for d in late)


def test_insert_if_absent_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k long, v string")
    added = state.insert_if_absent(old, new, ["k"], [F.asc("v")])
    assert [tuple(r) for r in added.collect()] == [(2, "c")]
    assert state.insert_if_absent(old.unionByName(added), new, ["k"], [F.asc("v")]).count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert {tuple(r) for r in state.upsert_replace(old, new, ["k"], [F.asc("v")]).collect()} == {(1, "a"), (2, None), (3, "c")}
    assert {tuple(r) for r in state.upsert_coalesce(old, new, "k", ["v"], []).collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_grounding(spark):
    texts = spark.createDataFrame([(1, "up 3.14 in 5 days"), (2, "up 271.8"), (3, ""), (4, None)], "id long, text string")
    known = spark.createDataFrame([(1, 3.149), (2, 3.0)], "id long, x double")
    got = {r["id"]: r["ok"] for r in health.grounded(texts, known).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_scenarios_sum_to_one(spark):
    rows = spark.createDataFrame([("short", 80.0, 60.0, 30.0, None), ("long", 20.0, 0.0, 90.0, 40.0)], "horizon string, score double, confidence double, overall_risk double, volatility_30d double")
    for r in research.scenarios(rows).collect():
        assert r["p_bull"] + r["p_base"] + r["p_bear"] == pytest.approx(1.0, abs=0.011)


def test_symbols_match_whole_words_first_in_order(spark):
    titles = spark.createDataFrame([(1, "Avis ATW et IAM"), (2, "ATWX monte"), (3, "Maroc Telecom SA en hausse"), (4, None)], "title_id long, title string")
    names = spark.createDataFrame([(7, "IAM", "Maroc Telecom"), (9, "ATW", "Attijari")], "ord long, symbol string, name string")
    assert {tuple(r) for r in N.match_symbols(titles, names).collect()} == {(1, 7), (3, 7)}


def test_halves_are_those_of_the_scaled_double(spark):
    """A half that the order of terms has moved by a last bit is still a half, and weights add up exactly."""
    given = [26.450000000000003, 26.45, 26.55, -26.450000000000003, 26.46, None]
    df = spark.createDataFrame([(x,) for x in given], "x double")
    assert [r[0] for r in df.select(C.half_even(F.col("x"), 1)).collect()] == [26.4, 26.4, 26.6, -26.4, 26.5, None]
    value, none = F.lit(1.0), F.lit(None).cast("double")
    mean = C.present_mean([(value, 0.35), (value, 0.30), (none, 0.20), (F.lit(3.0), 0.15)])
    assert spark.range(1).select(mean).first()[0] == (0.35 + 0.30 + 3.0 * 0.15) / 0.8


def test_words_of_rules_end_at_letters_beyond_ascii(spark):
    titles = ["Résultats en forte hausse chüteß", "Résultats en forte hausse chutes", "Résultats: chute", "ßopa lancée", "xopa lancée"]
    got = spark.createDataFrame(list(enumerate(titles)), "k int, t string").select("k", N.classify(F.col("t")).alias("c")).orderBy("k").collect()
    assert [(r["c"]["event"], r["c"]["impact"]) for r in got] == [("results", -0.55), ("results", 0.5), ("results", -0.55), ("tender_offer_buy", 0.5), ("announcement", 0.0)]
