"""Queries that answer for whole tables, against brute force."""

import re

from sparktide import registry

SF = "/root/testdata/sf0.001"


def run(spark, name, sf_dir=SF):
    return registry.queries()[name](spark, sf_dir)


def test_each_turn_is_checked_against_the_other_turns(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text")
    made = [(-1, 0, "it was 123.45 and 7"), (-1, 1, "so 123,46 then 555"), (-1, 2, "555.02 or 999.5, 999.5"), (-1, 3, " "), (-2, 0, "only 444.4"), (-1, 4, "9000")]
    given.unionByName(spark.createDataFrame(made, given.schema)).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/conversations.parquet").collect()]
    said = {}
    for conv, turn, text in rows:
        said.setdefault((conv, turn), set()).update(float(x.replace(",", ".")) for x in re.findall(r"[0-9]+(?:[.,][0-9]+)?", text or ""))
    some = {(c, t) for c, t, text in rows if (text or "").strip()}
    others = {}
    for (c, t), xs in said.items():
        others.setdefault(c, []).append((t, xs))
    want = {}
    for (c, t), xs in said.items():
        known = [k for u, ks in others[c] if u != t for k in ks]
        bad = sum(not (x == int(x) and x <= 100 or any(abs(x - k) <= 0.011 for k in known)) for x in xs)
        want[c, t] = (len(xs), bad, (c, t) in some and not bad)
    got = {(r["conv_id"], r["turn"]): (r["n_numbers"], r["n_ungrounded"], r["ok"]) for r in run(spark, "i31_number_grounding", str(tmp_path)).collect()}
    assert got == want
    assert got[-1, 0][1] == 0 and got[-1, 2][1] == 2 and got[-2, 0][1] == 1


def test_whole_texts_are_folded_and_matched(spark, tmp_path):
    far = "x " * 300
    docs = [(1, far + "Éclair"), (2, far + "alpha"), (3, far + "zeta beta gammas"), (4, "zetas beta gamma"), (5, "none")]
    items = [(1, "Alpha one two"), (2, "omega"), (3, "Zeta Beta Gamma delta")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["doc_id"]: r["folded"] for r in run(spark, "i1_i5_fold_whole", str(tmp_path)).collect()}[1] == far + "eclair"
    assert {r["title_id"]: r["ord"] for r in run(spark, "d9_title_to_symbol_whole", str(tmp_path)).collect()} == {2: 1, 3: 3}


def test_a_name_alone_matches(spark, tmp_path):
    docs, items = [(1, "the quick brown fox"), (2, "quick brown foxes")], [(7, "Quick Brown Fox")]
    from sparktide.operators.news import match_symbols

    titles = spark.createDataFrame(docs, "title_id long, title string")
    names = spark.createDataFrame([(o, "QBF", n) for o, n in items], "ord long, symbol string, name string")
    assert {r["title_id"] for r in match_symbols(titles, names).collect()} == {1, 2}


def test_all_stocks_have_places(spark):
    n = spark.read.parquet(f"{SF}/supplier.parquet").count()
    rows = run(spark, "g2_null_last_sorts_whole").collect()
    assert sorted(r["by_move"] for r in rows) == sorted(r["by_volume"] for r in rows) == list(range(1, n + 1))


def test_places_run_on_over_ranges(spark):
    from pyspark.sql import functions as F

    from sparktide.queries_analysis import placed

    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 7 != 0, F.col("id") % 100).alias("x")).repartition(5)
    want = sorted(df.collect(), key=lambda r: (r["x"] is None, -(r["x"] or 0), r["id"]))
    got = placed(df, "place", F.desc_nulls_last("x"), "id").collect()
    assert {r["id"]: r["place"] for r in got} == {r["id"]: k + 1 for k, r in enumerate(want)}


def test_every_ratio_becomes_a_fact(spark):
    keys = {r["key"].split(":")[0] for r in run(spark, "j18_knowledge_whole").where("category <> 'notice'").select("key").distinct().collect()}
    assert keys == {"sector", "company_name", "roe", "dividend_yield", "eps", "per", "pbr", "payout"}


def test_titles_are_classified(spark, tmp_path):
    for t in ("supplier", "nation", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = [(4, "Profit warning du groupe", "a"), (11, "Rien", "a"), (18, "Radiation", "a"), (25, None, "a")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["news_id"]: r["event"] for r in run(spark, "i6_i7_classify", str(tmp_path)).collect()}
    assert got == {4: "profit_warning", 11: "announcement", 18: "delisting", 25: "announcement"}


def test_details_hold_the_newest_points_and_notices(spark):
    from sparktide.sources.views import view

    stocks, prices, news = ([r.asDict() for r in view(spark, SF, t).collect()] for t in ("stocks", "prices", "news"))
    got = {r["symbol"]: r for r in run(spark, "j22_symbol_detail_whole").collect()}
    assert len(got) == len(stocks)
    for s in stocks:
        points = sorted((p["observed_at"], p["seq"], p["current_price"]) for p in prices if p["stock_id"] == s["stock_id"] and p["current_price"] is not None)[-180:]
        notices = sorted(((n["collected_at"], n["news_id"], n["title"]) for n in news if n["stock_id"] == s["stock_id"]), reverse=True)[:10]
        row = got[s["symbol"]]
        assert [tuple(p) for p in row["points"] or []] == points
        assert [tuple(n) for n in row["notices"] or []] == notices


def test_streams_read_a_file_and_a_folder(spark, tmp_path):
    from sparktide.queries_streaming import drained, stream_of

    given = spark.read.parquet(f"{SF}/events.parquet")
    given.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for d in (SF, str(tmp_path)):
        assert drained(spark, stream_of(spark, d).select("event_id"), "append", "both").count() == given.count()


def test_notices_of_a_page(spark):
    from sparktide.operators.news import notices_from_pages

    html = """<body><nav><a href="/avis/short">Short</a></nav><ul>
     <li>2026-03-04 <a class="x" href="/files/a.pdf">Alpha &amp; Co : suspension de la cotation</a></li><li><a href="/files/a.pdf">The same address once more</a> 2026-03-05</li>
     <li>le 2025.12.31 <a href="https://other.example/avis?id=7">Résultats en <b>forte hausse</b> de Beta</a></li><li><a href="/contact">A link that is no notice at all</a></li></ul></body>"""
    pages = spark.createDataFrame([(1, "https://bourse.example/page?x=1", html), (2, "https://b.example/", None), (3, "https://c.example", "<a href='x.pdf'>no quotes of that kind</a>")], "page_id long, url string, html string")
    names = spark.createDataFrame([(1, "BETA", "Beta Works"), (2, "ALPHA", "Alpha & Co")], "ord long, symbol string, name string")
    got = [(r["page_id"], r["pos"], r["link"], r["title"], str(r["date"]), r["event"], r["ord"]) for r in notices_from_pages(pages, names).orderBy("pos").collect()]
    assert got == [
        (1, 1, "https://bourse.example/files/a.pdf", "Alpha & Co : suspension de la cotation", "2026-03-04", "trading_suspension", 2),
        (1, 2, "https://other.example/avis?id=7", "Résultats en forte hausse de Beta", "2025-12-31", "results", 1),
    ]
    assert notices_from_pages(pages, names, most=1).count() == 1


def test_upserts_of_several_epochs(spark, tmp_path):
    from sparktide.streaming import jobs

    path = str(tmp_path / "table")
    write = jobs.upsert_sink(path, ["k"], "at")
    rows = lambda *x: spark.createDataFrame(list(x), "k long, at long, v string")
    write(rows((1, 5, "a"), (1, 4, "old"), (2, 1, "b")), 0)
    write(rows((3, 1, "c")), 1)
    write(rows((1, 3, "late"), (2, 9, "new")), 7)  # epochs in between had no rows
    write(rows((1, 3, "late"), (2, 9, "new")), 7)
    want = {1: "a", 2: "new", 3: "c"}
    assert {r["k"]: r["v"] for r in jobs.upserted(spark, path, ["k"], "at").collect()} == want
    jobs.compacted(spark, path, ["k"], "at", str(tmp_path / "next"))
    assert {r["k"]: r["v"] for r in jobs.upserted(spark, str(tmp_path / "next"), ["k"], "at").collect()} == want


def test_a_digest_counts_repeated_rows(spark):
    from sparktide.sources import state

    ones, twos = (spark.createDataFrame([(x,), (x,)], "x int") for x in (1, 2))
    assert not state.reconcile(ones, twos, "t").first()["ok"] and state.reconcile(ones, ones.repartition(2), "t").first()["ok"]
    assert state.reconcile(ones.limit(0), ones.limit(0), "t").first()["ok"]


def test_statements_and_flags(spark):
    from sparktide.plans import statements as ST

    names = sorted({w for rules in ST.ANALYSTS.values() for _, _, condition, _, _, value in rules for w in re.findall(r"[a-z_][a-z0-9_]+", condition + " " + value)} - {"coalesce", "greatest", "floor", "lower", "banque", "immobilier", "assurance", "credit", "financement", "cr", "dit", "sector", "top_sector"})
    flags = {"fresh_negative", "has_dividend"}
    kinds = "stock_id long, sector string, top_sector string, " + ", ".join(f"{n} {'boolean' if n in flags else 'double'}" for n in names)
    row = {"stock_id": 1, "sector": "Banque", "top_sector": "Banque", "price": 11.0, "ma50": 10.0, "per": 30.0, "payout_pct": 90.0, "positions": 2.0, "top_share": 50.0, "inflation": 6.0, "policy_rate": 2.0, "top_pct": 60.0}
    nothing = {"stock_id": 2, "sector": None, "top_sector": None}
    said = ST.statements(spark.createDataFrame([tuple(r.get(c.split()[0]) for c in kinds.split(", ")) for r in (row, nothing)], kinds))
    got = {(r["slot"], r["code"]) for r in said.where("stock_id = 1").collect()}
    assert got == {("strength", "above_ma50"), ("weakness", "high_per"), ("risk", "high_payout"), ("risk", "few_positions"), ("risk", "heavy_sector"), ("risk", "adds_to_heavy_sector"), ("weakness", "high_inflation"), ("observation", "rate_sensitive"), ("risk", "controlled")}
    assert said.where("stock_id = 2").count() == 0
    weight = ST.flag_weights(said).first()
    assert round(weight["flag_weight"], 6) == 2.2 and weight["n_flags"] == 3  # a controlling holder is neutral
    assert [(r["case"], r["code"]) for r in ST.cited(said).orderBy("case", "rank").collect()] == [("bear", "high_per"), ("bear", "high_inflation"), ("bull", "above_ma50")]


def test_rules_from_a_table(spark):
    from sparktide.operators.news import RULES, classify, rules_from

    table = spark.createDataFrame([(k, e, list(some), also) for k, (e, some, also) in enumerate(RULES)][::-1] + [(99, None, ["x"], None), (98, "none", [], None)], "ord int, event string, some array<string>, also string")
    rules = rules_from(table)
    assert rules == RULES
    own = spark.createDataFrame([(2, "late", ["b"], None), (1, "early", ["a", "b c"], "d")], "ord int, event string, some array<string>, also string")
    titles = spark.createDataFrame([("B C d",), ("b c",), ("z",), (None,)], "t string")
    assert [r["e"] for r in titles.select(classify(titles["t"], rules_from(own))["event"].alias("e")).collect()] == ["early", "late", "announcement", "announcement"]


def test_fingerprint_in_other_order_deals_rows_to_as_many_tasks_as_the_session_has(spark):
    from sparktide import registry

    plan = registry.queries()["e24_fingerprint"](spark, SF)._jdf.queryExecution().logical().toString()
    assert "RepartitionByExpression" in plan and "], 5" not in plan


def test_facts_are_told_apart_after_their_exchange(spark):
    from sparktide import registry

    plan = registry.queries()["j18_knowledge"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.index("HashAggregate(keys=[stock_id") < plan.index("Exchange hashpartitioning(stock_id") and plan.count("Exchange hashpartitioning(stock_id") <= 2
