"""Queries over sources, sinks, filters, joins, notices and text rules. Names begin with the inventory's ids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparktide.functions import columns as C
from sparktide.operators import news as N
from sparktide.operators.intervals import overlapping, points_in
from sparktide.operators.scan import last_before
from sparktide.operators.scoring import fundamental_score
from sparktide.queries_core import NOW, bars_of, r, rounded, stocks_of
from sparktide.sources import state
from sparktide.sources.ranged import RangedTable
from sparktide.sources.shared import fresh_path
from sparktide.sources.views import table, view
from sparktide.sql_core import bands, clamp, cover, ctes, mean

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def now():
    return F.to_timestamp(F.lit(NOW))


NEWS = "SELECT * FROM news WHERE stock_id IS NOT NULL AND (collected_at IS NULL OR collected_at >= TIMESTAMP '2001-10-06 00:00:00')"


@query(ctes("news", "stocks") + "SELECT news_id, symbol, collected_at, event_type FROM news LEFT JOIN stocks USING (stock_id) QUALIFY row_number() OVER (ORDER BY collected_at DESC, news_id) <= 50")
def a3_recent_news(spark, sf_dir):
    joined = view(spark, sf_dir, "news").join(stocks_of(spark, sf_dir), "stock_id", "left")
    return joined.select("news_id", "symbol", "collected_at", "event_type").orderBy(F.desc("collected_at"), "news_id").limit(50)  # the feature is a newest-50 list


@query(ctes("fundamentals") + "SELECT stock_id, count(*) AS n, max(fiscal_year) AS newest, string_agg(CAST(fiscal_year AS VARCHAR) || ':' || source, ',' ORDER BY fiscal_year DESC, seq DESC) AS years FROM fundamentals GROUP BY 1")
def a4_fundamentals_by_stock(spark, sf_dir):
    f = view(spark, sf_dir, "fundamentals")
    rows = F.sort_array(F.collect_list(F.struct("fiscal_year", "seq", "source")), asc=False)
    return f.groupBy("stock_id").agg(F.count("*").alias("n"), F.max("fiscal_year").alias("newest"), F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["fiscal_year"], x["source"])), ",").alias("years"))


@query(ctes("stocks") + "SELECT symbol, lower(company_name) AS name, sector FROM stocks WHERE sector IS NOT NULL")
def a5_profiles(spark, sf_dir):
    return stocks_of(spark, sf_dir).where("sector is not null").select("symbol", F.lower("company_name").alias("name"), "sector")


@query(ctes("macro") + "SELECT indicator, as_of, round(value, 6) AS value FROM macro QUALIFY row_number() OVER (PARTITION BY indicator ORDER BY as_of DESC, seq) = 1")
def a6_latest_macro(spark, sf_dir):
    latest = view(spark, sf_dir, "macro").groupBy("indicator").agg(F.max_by(F.struct("as_of", "value"), F.struct("as_of", -F.col("seq"))).alias("x"))
    return rounded(latest.select("indicator", "x.as_of", "x.value"))


MACRO_SERIES = ("click", "purchase", "view", "signup")


@query(ctes("macro") + "SELECT " + ", ".join(f"round(max(value) FILTER (WHERE indicator = '{s}'), 6) AS {s}" for s in MACRO_SERIES) + ", max(as_of) AS as_of FROM (SELECT * FROM macro WHERE indicator IN ('click', 'purchase', 'view', 'signup') QUALIFY row_number() OVER (PARTITION BY indicator ORDER BY as_of DESC, seq) = 1)")
def a7_macro_snapshot(spark, sf_dir):
    latest = view(spark, sf_dir, "macro").where(F.col("indicator").isin(*MACRO_SERIES)).groupBy("indicator").agg(F.max_by(F.struct("as_of", "value"), F.struct("as_of", -F.col("seq"))).alias("x"))
    return rounded(latest.select("indicator", "x.*").agg(*(F.max(F.when(F.col("indicator") == s, F.col("value"))).alias(s) for s in MACRO_SERIES), F.max("as_of").alias("as_of")))


@query(ctes("predictions") + "SELECT prediction_id FROM predictions WHERE evaluate_at <= TIMESTAMP '1998-01-01 00:00:00' AND price_at_prediction IS NOT NULL")
def a8_due_predictions(spark, sf_dir):
    return view(spark, sf_dir, "predictions").where((F.col("evaluate_at") <= F.lit("1998-01-01").cast("timestamp")) & F.col("price_at_prediction").isNotNull()).select("prediction_id")


@query(ctes("predictions") + "SELECT analyst, horizon, count(*) AS n FROM predictions WHERE semantics_version = 2 AND claim_kind = 'direction' AND predicted_direction IS NOT NULL GROUP BY ALL")
def a9_gradable_predictions(spark, sf_dir):
    p = view(spark, sf_dir, "predictions").where("semantics_version = 2 and claim_kind = 'direction' and predicted_direction is not null")
    return p.groupBy("analyst", "horizon").agg(F.count("*").alias("n"))


@query(ctes("reports") + "SELECT symbol, report_id FROM (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY generated_at DESC, report_id DESC) = 1) WHERE generated_at >= TIMESTAMP '2000-01-01 00:00:00'")
def a10_fresh_report(spark, sf_dir):
    newest = view(spark, sf_dir, "reports").groupBy("symbol").agg(F.max_by("report_id", F.struct("generated_at", "report_id")).alias("report_id"), F.max("generated_at").alias("at"))
    return newest.where(F.col("at") >= F.lit("2000-01-01").cast("timestamp")).select("symbol", "report_id")


@query(ctes("reports") + "SELECT symbol, report_id, lag(report_id) OVER w AS previous_id FROM reports WINDOW w AS (PARTITION BY symbol, horizon_focus ORDER BY report_id)")
def a11_previous_report(spark, sf_dir):
    return view(spark, sf_dir, "reports").select("symbol", "report_id", F.lag("report_id").over(Window.partitionBy("symbol", "horizon_focus").orderBy("report_id")).alias("previous_id"))


@query(ctes("reports") + "SELECT symbol, report_id, generated_at FROM reports QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY generated_at DESC, report_id DESC) <= 5")
def a12_report_timeline(spark, sf_dir):
    return N.newest_per_key(view(spark, sf_dir, "reports").select("symbol", "report_id", "generated_at"), "symbol", [F.desc("generated_at"), F.desc("report_id")], 5).drop("rank")


@query(ctes("holdings") + "SELECT upper(symbol) AS symbol, CAST(quantity AS DOUBLE) AS quantity, round(buy_price, 6) AS buy_price FROM holdings WHERE quantity > 0 AND buy_price > 0")
def a13_holdings_json(spark, sf_dir):
    """Holdings as they come in JSON documents of a portfolio's size (a thousand ids each), parsed and cleaned."""
    h = view(spark, sf_dir, "holdings")
    docs = h.groupBy(F.floor(F.col("stock_id") / 1000).alias("k")).agg(F.to_json(F.struct(F.lit(0.005).alias("fee_rate"), F.collect_list(F.struct(F.lower("symbol").alias("symbol"), F.col("quantity").cast("string").alias("quantity"), F.col("buy_price").cast("string").alias("buy_price"))).alias("holdings"))).alias("doc"))
    parsed = docs.select(F.explode(F.from_json("doc", "struct<holdings: array<struct<symbol: string, quantity: string, buy_price: string>>>")["holdings"]).alias("h")).select("h.*")
    typed = parsed.select(F.upper("symbol").alias("symbol"), F.col("quantity").try_cast("double").alias("quantity"), F.col("buy_price").try_cast("double").alias("buy_price"))
    return rounded(typed.where("quantity > 0 and buy_price > 0"))


@query(ctes("prices") + "SELECT stock_id, CAST(observed_at AS DATE) AS day, round(first(current_price ORDER BY seq), 6) AS price FROM prices WHERE current_price IS NOT NULL GROUP BY ALL")
def a14_session_rows(spark, sf_dir):
    """Session records as landed JSON lines become one price row for each stock and day, anchored at 15:30."""
    p = view(spark, sf_dir, "prices")
    landed = p.select("stock_id", "seq", F.to_json(F.struct(F.date_format("observed_at", "yyyy-MM-dd").alias("created"), F.when(F.col("seq") % 2 == 0, F.col("current_price").cast("string")).alias("coursAjuste"), F.col("current_price").cast("string").alias("closingPrice"))).alias("line"))
    rows = landed.select("stock_id", "seq", F.from_json("line", "created string, coursAjuste string, closingPrice string, lastTradedPrice string").alias("x"))
    price = F.coalesce(*(F.col(f"x.{c}").try_cast("double") for c in ("coursAjuste", "closingPrice", "lastTradedPrice")))
    rows = rows.select("stock_id", "seq", F.to_date("x.created").alias("day"), price.alias("price")).where("price is not null and day is not null")
    first = rows.groupBy("stock_id", "day").agg(F.min_by("price", "seq").alias("price"))
    return rounded(first)


@query(ctes("macro") + "SELECT indicator, as_of, round(value, 6) AS value FROM macro QUALIFY row_number() OVER (PARTITION BY indicator ORDER BY as_of DESC, seq DESC) <= 750")
def a16_macro_series(spark, sf_dir):
    """Series as pages embed them, arrays of times and values in pages of ten thousand events, back to rows; the newest 750 points of each."""
    m = view(spark, sf_dir, "macro")
    landed = m.groupBy("indicator", F.floor(F.col("seq") / 10_000).alias("part")).agg(F.array_join(F.collect_list(F.concat(F.lit("{x:"), F.unix_micros(F.col("as_of").cast("timestamp")), F.lit(",y:"), F.col("value"), F.lit(",s:"), F.col("seq"), F.lit("}"))), ",").alias("text"))
    points = landed.select("indicator", F.explode(F.regexp_extract_all("text", F.lit(r"\{x:(-?[0-9]+),y:([-0-9.E]+),s:[0-9]+\}"), F.lit(0))).alias("p"))
    part = lambda k: F.regexp_extract("p", r"\{x:(-?[0-9]+),y:([-0-9.E]+),s:([0-9]+)\}", k)
    rows = points.select("indicator", F.timestamp_micros(part(1).cast("long")).alias("as_of"), part(2).cast("double").alias("value"), part(3).cast("long").alias("seq"))
    return rounded(N.newest_per_key(rows, "indicator", [F.desc("as_of"), F.desc("seq")], 750).select("indicator", "as_of", "value"))


@query(ctes("prices") + "SELECT seq, round(floor(current_price * 100) / 100, 2) AS price, round(floor(volume * 100) / 100, 2) AS volume FROM prices")
def a17_raw_cells(spark, sf_dir):
    """Header-keyed text cells with aliases to typed columns, by the number rule."""
    p = view(spark, sf_dir, "prices")
    text = lambda c: F.replace((F.floor(F.col(c) * 100) / 100).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    raw = F.map_from_arrays(F.array(F.when(F.col("seq") % 2 == 0, "Cours").otherwise("Dernier cours"), F.lit("Volume")), F.array(text("current_price"), F.coalesce(F.concat(text("volume"), F.lit(" MAD")), F.lit("-"))))
    cells = p.select("seq", raw.alias("raw"))
    return cells.select("seq", F.round(C.parse_number(F.coalesce(F.col("raw")["Cours"], F.col("raw")["Dernier cours"])), 2).alias("price"), F.round(C.parse_number(F.col("raw")["Volume"]), 2).alias("volume"))


#: Aliases of names, in order.
ALIASES = {"UNITED STATES": "USA", "UNITED": "UNI", "SAUDI": "KSA", "RUSSIA": "RUS", "CHINA": "CHN"}


@query(ctes("stocks") + "SELECT stock_id, CASE " + " ".join(f"WHEN contains(upper(sector), '{k}') THEN '{v}'" for k, v in ALIASES.items()) + " ELSE coalesce(nullif(regexp_extract(upper(sector), '^[A-Z]{2,5}'), ''), symbol) END AS guess FROM stocks")
def a18_symbol_guess(spark, sf_dir):
    s = stocks_of(spark, sf_dir)
    return s.select("stock_id", C.guessed_symbol(F.col("sector"), F.col("symbol"), ALIASES).alias("guess"))


@query(ctes("fundamentals") + "SELECT seq, 'per' AS ratio, round(per, 6) AS value FROM fundamentals WHERE per IS NOT NULL UNION ALL SELECT seq, 'pbr', round(pbr, 6) FROM fundamentals WHERE pbr IS NOT NULL UNION ALL SELECT seq, 'roe_pct', round(roe_pct, 6) FROM fundamentals WHERE roe_pct IS NOT NULL")
def a19_ratio_unpivot(spark, sf_dir):
    f = view(spark, sf_dir, "fundamentals").select("seq", F.col("per").cast("double").alias("per"), F.col("pbr").cast("double").alias("pbr"), F.col("roe_pct").cast("double").alias("roe_pct"))
    return rounded(f.unpivot(["seq"], ["per", "pbr", "roe_pct"], "ratio", "value").where("value is not null"))


@query("SELECT n_nationkey AS nation, round(max(s_acctbal), 6) AS main_pct, count(*) AS holders FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal IS NOT NULL AND upper(s_name) <> 'TOTAL' GROUP BY 1")
def a20_e31_ownership(spark, sf_dir):
    """Holders of each company as an array, totals and blanks aside, and the main holder by a higher-order function."""
    rows = table(spark, sf_dir, "supplier").where(F.col("s_acctbal").isNotNull() & (F.upper("s_name") != "TOTAL")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    held = rows.groupBy(F.col("n_nationkey").alias("nation")).agg(F.collect_list(F.struct(F.col("s_acctbal").alias("pct"), F.col("s_name").alias("holder"))).alias("ownership"))
    return rounded(held.select("nation", F.array_max(F.transform("ownership", lambda o: o["pct"])).alias("main_pct"), F.size("ownership").cast("long").alias("holders")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN 2 END AS n_items, CASE WHEN event_id % 3 = 0 THEN 2 * CAST(json_extract(props, '$.k') AS BIGINT) + 1 END AS total FROM events")
def a21_json_columns(spark, sf_dir):
    """JSON objects parsed; a column that must hold a list and doesn't gives null: a third of the events have one."""
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    landed = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" ["), F.col("props"), F.lit(', {"k": '), (F.col("k") + 1).cast("string"), F.lit("}]"))).otherwise(F.col("props"))
    items = F.when(F.ltrim(landed).startswith("["), F.from_json(landed, "array<struct<k: long>>"))
    out = e.select("event_id", "k", items.alias("items"))
    total = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["k"])
    return out.select("event_id", "k", F.when(F.col("items").isNotNull(), F.size("items")).alias("n_items"), total.alias("total"))


def _price_split(spark, sf_dir):
    p = view(spark, sf_dir, "prices").select("seq", "stock_id", "observed_at", "source", "current_price")
    return p.where("seq % 3 <> 0"), p.where("seq % 3 = 0")


@query(ctes("prices") + "SELECT seq FROM (SELECT * FROM prices WHERE seq % 3 = 0 QUALIFY row_number() OVER (PARTITION BY stock_id, observed_at, source ORDER BY seq) = 1) n WHERE NOT EXISTS (SELECT 1 FROM prices o WHERE o.seq % 3 <> 0 AND o.stock_id = n.stock_id AND o.observed_at = n.observed_at AND o.source = n.source)")
def b1_insert_if_absent(spark, sf_dir):
    old, new = _price_split(spark, sf_dir)
    return state.insert_if_absent(old, new, ["stock_id", "observed_at", "source"], [F.asc("seq")]).select("seq")


@query(ctes("fundamentals") + "SELECT stock_id, fiscal_year, source, seq, round(per, 6) AS per FROM fundamentals QUALIFY row_number() OVER (PARTITION BY stock_id, fiscal_year, source ORDER BY seq % 2 DESC, seq DESC) = 1")
def b2_upsert_replace(spark, sf_dir):
    f = view(spark, sf_dir, "fundamentals").select("stock_id", "fiscal_year", "source", "seq", F.col("per").cast("double").alias("per"))
    held = RangedTable(spark, _scratch(spark, "fundamentals"), "stock_id")
    held.create(f.where("seq % 2 = 0"))
    held.merge(f.where("seq % 2 = 1"), lambda old, new: state.upsert_replace(old, new, ["stock_id", "fiscal_year", "source"], [F.desc("seq")]))
    return rounded(held.read())


@query(ctes("stocks") + "SELECT stock_id, CASE WHEN stock_id % 2 = 0 AND stock_id % 3 <> 0 THEN 'new ' || company_name ELSE company_name END AS company_name, CASE WHEN stock_id % 2 = 0 THEN 'live' ELSE 'old' END AS source FROM stocks")
def b3_upsert_coalesce(spark, sf_dir):
    s = stocks_of(spark, sf_dir).select("stock_id", "company_name")
    new = s.where("stock_id % 2 = 0").select("stock_id", F.when(F.col("stock_id") % 3 != 0, F.concat(F.lit("new "), "company_name")).alias("company_name"), F.lit("live").alias("source"))
    held = RangedTable(spark, _scratch(spark, "stocks"), "stock_id")
    held.create(s.withColumn("source", F.lit("old")))
    held.merge(new, lambda old, new: state.upsert_coalesce(old, new, "stock_id", ["company_name"], ["source"]))
    return held.read()


FACTS = "SELECT stock_id, event_type AS category, sentiment AS value, collected_at FROM news WHERE stock_id IS NOT NULL AND sentiment IS NOT NULL"


@query(ctes("news") + f"SELECT stock_id, category, sha256(category || '|' || category || '|' || value) AS fact_hash, min(collected_at) AS first_seen, max(collected_at) AS last_seen FROM ({FACTS}) GROUP BY ALL")
def b4_i26_upsert_touch(spark, sf_dir):
    facts = view(spark, sf_dir, "news").where("stock_id is not null and sentiment is not null").select("stock_id", F.col("event_type").alias("category"), F.col("sentiment").alias("value"), "collected_at")
    facts = facts.withColumn("fact_hash", C.fact_hash(F.col("category"), F.col("category"), F.col("value")))
    return state.upsert_touch(facts, ["stock_id", "category", "fact_hash"], "collected_at", []).select("stock_id", "category", "fact_hash", "first_seen", "last_seen")


@query(ctes("reports") + "SELECT CAST(date_trunc('month', generated_at) AS DATE) AS dt, count(*) AS n FROM reports GROUP BY 1")
def b5_append_log(spark, sf_dir):
    """Reports appended to a log by month, in the session's shared folder, and read back."""
    path = _scratch(spark, "report-log")
    state.append_log(view(spark, sf_dir, "reports").select("report_id", "symbol", "generated_at"), path, "generated_at")
    return spark.read.parquet(path).groupBy(F.col("dt").cast("date").alias("dt")).agg(F.count("*").alias("n"))


def _scratch(spark, name: str) -> str:
    return fresh_path(spark, name)


@query(ctes("prices") + "SELECT stock_id, source, seq FROM prices QUALIFY row_number() OVER (PARTITION BY stock_id, source, CAST(observed_at AS DATE) ORDER BY (current_price IS NOT NULL)::INT + (daily_variation IS NOT NULL)::INT + (volume IS NOT NULL)::INT DESC, seq) = 1")
def b6_fullest_row(spark, sf_dir):
    p = view(spark, sf_dir, "prices").withColumn("day", F.to_date("observed_at"))
    return state.fullest(p, ["stock_id", "source", "day"], ["current_price", "daily_variation", "volume"], [F.asc("seq")]).select("stock_id", "source", "seq")


@query(ctes("prices") + "SELECT day, source, count(*) AS n FROM (SELECT *, CAST(observed_at AS DATE) AS day, CASE source WHEN 'A' THEN 0 WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS p FROM prices) QUALIFY min(p) OVER (PARTITION BY day) = p GROUP BY day, source, p".replace(" QUALIFY min(p) OVER (PARTITION BY day) = p GROUP BY day, source, p", " x WHERE p = (SELECT min(CASE y.source WHEN 'A' THEN 0 WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) FROM prices y WHERE CAST(y.observed_at AS DATE) = x.day) GROUP BY day, source"))
def b7_source_cascade(spark, sf_dir):
    p = view(spark, sf_dir, "prices").select(F.to_date("observed_at").alias("day"), "source")
    return state.first_source(p, "day", "source", ["A", "R", "N"]).groupBy("day", "source").agg(F.count("*").alias("n"))


@query(ctes("prices") + "SELECT n.seq FROM prices n WHERE n.seq % 3 = 0 AND NOT EXISTS (SELECT 1 FROM prices o WHERE o.seq % 3 <> 0 AND o.source = n.source AND o.stock_id = n.stock_id AND CAST(o.observed_at AS DATE) = CAST(n.observed_at AS DATE))")
def b8_gap_fill(spark, sf_dir):
    old, new = _price_split(spark, sf_dir)
    return state.missing_days(old, new, ["stock_id", "source"]).select("seq")


@query(ctes("stocks", "news") + "SELECT symbol FROM stocks s WHERE NOT EXISTS (SELECT 1 FROM news n WHERE n.stock_id = s.stock_id AND n.event_type = 'ex_dividend')")
def b9_h3_symbols_to_fill(spark, sf_dir):
    done = view(spark, sf_dir, "news").where("event_type = 'ex_dividend'").select("stock_id").distinct()
    return stocks_of(spark, sf_dir).join(done, "stock_id", "left_anti").select("symbol")


@query(ctes("stocks", "favorites") + "SELECT symbol, s.stock_id, count(*) OVER () AS n FROM stocks s WHERE s.stock_id IN (SELECT stock_id FROM favorites UNION SELECT stock_id FROM stocks WHERE stock_id % 5 = 0) AND s.stock_id % 7 <> 0")
def b10_watchlist(spark, sf_dir):
    """Favourites, more added if their stock is known, some removed, listed in order."""
    stocks, have = stocks_of(spark, sf_dir), view(spark, sf_dir, "favorites").select("stock_id")
    asked = stocks.where("stock_id % 5 = 0").select("stock_id").unionByName(spark.range(-2, 0).withColumnRenamed("id", "stock_id"))
    added = have.unionByName(asked.join(stocks, "stock_id", "left_semi").select("stock_id")).distinct()
    kept = added.join(stocks.where("stock_id % 7 = 0"), "stock_id", "left_anti")
    listed = kept.join(stocks, "stock_id").select("symbol", "stock_id")
    return listed.crossJoin(F.broadcast(listed.agg(F.count("*").alias("n")))).orderBy("stock_id")  # one row


@query()
def b11_reclassification(spark, sf_dir):
    return N.reclassification(view(spark, sf_dir, "news"))[0].withColumn("impact_score", F.col("impact_score").cast("double"))


@query()
def e30_before_after_counts(spark, sf_dir):
    return N.reclassification(view(spark, sf_dir, "news"))[1]


@query("SELECT 'orders' AS name, count(*) AS n_source, count(*) AS n_target, true AS ok FROM orders UNION ALL SELECT 'a row twice for another', count(*), count(*), false FROM orders UNION ALL SELECT 'an order lost', count(*), count(*) - 1, false FROM orders")
def b12_copy_reconciled(spark, sf_dir):
    """A copy as it was written; one that holds its first row twice and not its last; and one without its last."""
    source, path = table(spark, sf_dir, "orders"), _scratch(spark, "orders-copy")
    source.write.parquet(path)
    copy = spark.read.parquet(path)
    ends = copy.agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))  # one row
    marked = copy.crossJoin(F.broadcast(ends))
    lost = marked.where("o_orderkey <> high").select(*copy.columns)
    twice = lost.unionByName(marked.where("o_orderkey = low").select(*copy.columns))
    out = state.reconcile(source, copy, "orders")
    return out.unionByName(state.reconcile(source, twice, "a row twice for another")).unionByName(state.reconcile(source, lost, "an order lost"))


@query(ctes("fundamentals", "latest") + "SELECT f.stock_id, fiscal_year, 'derived' AS source, round_even(price / eps, 2) AS per FROM (SELECT * FROM fundamentals QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY fiscal_year DESC, seq DESC) = 1) f JOIN latest l ON l.stock_id = f.stock_id WHERE per IS NULL AND eps > 0")
def b13_derived_per(spark, sf_dir):
    f = view(spark, sf_dir, "fundamentals").groupBy("stock_id").agg(F.max_by(F.struct("fiscal_year", "per", "eps"), F.struct("fiscal_year", "seq")).alias("x")).select("stock_id", "x.*")
    last = bars_of(spark, sf_dir).groupBy("stock_id").agg(F.max_by("price", "dn").alias("price"))
    return f.where("per is null and eps > 0").join(last, "stock_id").select("stock_id", "fiscal_year", F.lit("derived").alias("source"), C.half_even(F.col("price") / F.col("eps"), 2).alias("per"))


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 AND c_mktsegment = 'BUILDING')")
def b14_usable_profiles(spark, sf_dir):
    """Profiles that hold anything: blank ones, here those of two traits, are skipped."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("b"))
    return c.where(F.coalesce(F.col("a").cast("string"), F.col("b")).isNotNull()).select("c_custkey")


@query(ctes("reports") + "SELECT report_id, symbol, generated_at, recommendation_short, recommendation_medium, round(confidence_short, 6) AS confidence_short, round(risk_score, 6) AS risk_score FROM reports")
def b15_report_json(spark, sf_dir):
    """Reports as JSON documents, and what they give back when they are parsed."""
    made = view(spark, sf_dir, "reports").select("report_id", F.to_json(F.struct("symbol", "generated_at", F.struct("recommendation_short", "recommendation_medium").alias("verdicts"), "confidence_short", "risk_score")).alias("report_json"))
    kind = "symbol long, generated_at timestamp_ntz, verdicts struct<recommendation_short: string, recommendation_medium: string>, confidence_short double, risk_score double"
    back = made.select("report_id", F.from_json("report_json", kind).alias("r")).select("report_id", "r.symbol", "r.generated_at", "r.verdicts.*", "r.confidence_short", "r.risk_score")
    return rounded(back)


@query(ctes("predictions") + "SELECT CASE WHEN prediction_id % 2 = 0 THEN 1 ELSE semantics_version END AS semantics_version, CASE WHEN prediction_id % 2 = 0 THEN 'direction' ELSE claim_kind END AS claim_kind, count(*) AS n FROM predictions GROUP BY 1, 2")
def b16_schema_evolution(spark, sf_dir):
    p = view(spark, sf_dir, "predictions").select("prediction_id", "semantics_version", "claim_kind")
    out = state.with_defaults(p.where("prediction_id % 2 = 0").select("prediction_id"), p.where("prediction_id % 2 <> 0"), {"semantics_version": 1, "claim_kind": "direction"})
    return out.groupBy("semantics_version", "claim_kind").agg(F.count("*").alias("n"))


@query(ctes("news") + f"SELECT news_id, stock_id, collected_at FROM ({NEWS})")
def c2_news_window(spark, sf_dir):
    return N.recent_news(view(spark, sf_dir, "news"), now()).select("news_id", "stock_id", "collected_at")


@query(ctes("stocks") + "SELECT symbol, sector FROM stocks WHERE lower(sector) = 'france' OR contains(lower(symbol), '07')")
def c3_table_filter(spark, sf_dir):
    return stocks_of(spark, sf_dir).where((F.lower("sector") == "france") | F.lower("symbol").contains("07")).select("symbol", "sector")


@query(ctes("latest", "stocks", "holdings", "favorites") + "SELECT symbol, CASE WHEN h.stock_id IS NOT NULL THEN 'held' ELSE 'watched' END AS why FROM latest JOIN stocks s USING (stock_id) LEFT JOIN holdings h ON h.stock_id = s.stock_id LEFT JOIN favorites f ON f.stock_id = s.stock_id WHERE daily_variation <= -5 AND (h.stock_id IS NOT NULL OR f.stock_id IS NOT NULL)".replace("SELECT symbol,", "SELECT s.symbol,"))
def c5_d4_crash_alerts(spark, sf_dir):
    bars = bars_of(spark, sf_dir)
    last = bars.groupBy("stock_id").agg(F.max_by("daily_variation", "dn").alias("daily_variation")).where("daily_variation <= -5")
    held = view(spark, sf_dir, "holdings").select("stock_id")
    watched = view(spark, sf_dir, "favorites").select("stock_id").join(held, "stock_id", "left_anti")
    who = held.withColumn("why", F.lit("held")).unionByName(watched.withColumn("why", F.lit("watched")))
    return last.join(who, "stock_id").join(stocks_of(spark, sf_dir), "stock_id").select("symbol", "why")


@query(ctes("bars") + "SELECT stock_id, day, CASE WHEN abs(daily_variation) >= 5 THEN 'line' ELSE 'push' END AS kind FROM bars WHERE abs(daily_variation) >= 3")
def c7_movers(spark, sf_dir):
    move = F.abs("daily_variation")
    return bars_of(spark, sf_dir).where(move >= 3).select("stock_id", "day", F.when(move >= 5, "line").otherwise("push").alias("kind"))


@query(ctes("stocks") + "SELECT symbol FROM stocks WHERE symbol IN ('Supplier#000000003', 'Supplier#000000007')")
def c8_h4_subset(spark, sf_dir):
    wanted = spark.createDataFrame([("supplier#000000003",), ("supplier#000000007",)], "asked string").select(F.initcap("asked").alias("symbol"))
    return stocks_of(spark, sf_dir).select("symbol").intersect(wanted)


@query(ctes("prices") + "SELECT stock_id, count(*) AS n FROM prices WHERE observed_at <= TIMESTAMP '1998-06-30 23:59:00' GROUP BY 1")
def c9_point_in_time_cut(spark, sf_dir):
    return view(spark, sf_dir, "prices").where(F.col("observed_at") <= F.lit("1998-06-30 23:59:00").cast("timestamp")).groupBy("stock_id").agg(F.count("*").alias("n"))


@query(ctes("prices") + "SELECT max(observed_at) AS newest, epoch(TIMESTAMP '2001-11-05 00:00:00') - epoch(max(observed_at)) > 900 AS stale FROM prices")
def c10_freshness(spark, sf_dir):
    return view(spark, sf_dir, "prices").agg(F.max("observed_at").alias("newest")).withColumn("stale", F.unix_timestamp(now()) - F.unix_timestamp("newest") > 900)


@query(ctes("predictions", "prices") + "SELECT prediction_id, round((last_price - price_at_prediction) / nullif(price_at_prediction, 0) * 100, 6) AS ret FROM (SELECT p.prediction_id, any_value(p.price_at_prediction) AS price_at_prediction, last(q.current_price ORDER BY q.observed_at, q.seq) AS last_price FROM (SELECT * FROM predictions WHERE evaluate_at <= TIMESTAMP '2001-11-05 00:00:00') p JOIN (SELECT * FROM prices WHERE current_price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY observed_at DESC, seq DESC) <= 400) q ON q.stock_id = p.stock_id AND q.observed_at >= p.evaluate_at GROUP BY 1)")
def d7_realised(spark, sf_dir):
    from sparktide.plans.research import realised

    due = view(spark, sf_dir, "predictions").where(F.col("evaluate_at") <= now())
    return rounded(realised(due, view(spark, sf_dir, "prices")).select("prediction_id", "ret"))


@query(ctes("predictions", "prices") + "SELECT prediction_id, round(current_price, 6) AS price FROM (SELECT p.prediction_id, q.current_price FROM predictions p ASOF JOIN (SELECT stock_id, observed_at, first(current_price ORDER BY seq) AS current_price FROM prices GROUP BY 1, 2) q ON q.stock_id = p.stock_id AND p.evaluate_at <= q.observed_at)")
def d7_realised_at_date(spark, sf_dir):
    """The first price at or after the evaluation date: an as-of join that looks ahead, on negated time."""
    p = view(spark, sf_dir, "predictions").select("prediction_id", "stock_id", (-F.unix_timestamp("evaluate_at")).alias("t"))
    q = view(spark, sf_dir, "prices").groupBy("stock_id", (-F.unix_timestamp("observed_at")).alias("t")).agg(F.min_by("current_price", "seq").alias("price"))
    return rounded(last_before(p, q, "stock_id", "t", ["price"], cell_days=64 * 86_400).where("quote is not null").select("prediction_id", "quote.price"))


def _windows_of(events, kind: str, key: str, hours: str):
    """Intervals from events of a kind on, as long in hours as ``hours`` says, in microseconds."""
    low = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where(F.col("event_type") == kind)
    return rows.select("user_id", F.col("event_id").alias(key), low.alias(f"{key}_low"), (low + F.floor(F.expr(hours) * 3_600_000_000)).cast("long").alias(f"{key}_high"))


_WINDOW = "SELECT user_id, event_id, epoch_us(ts) AS low, epoch_us(ts) + CAST(floor({hours} * 3600000000) AS BIGINT) AS high FROM events WHERE event_type = '{kind}'"


@query(f"SELECT p.user_id, w.event_id AS window_id, count(*) AS n, min(p.event_id) AS first_event FROM (SELECT user_id, event_id, epoch_us(ts) AS at FROM events) p JOIN ({_WINDOW.format(kind='purchase', hours='value')}) w ON p.user_id = w.user_id AND p.at >= w.low AND p.at < w.high GROUP BY ALL")
def c9_d14_events_in_windows(spark, sf_dir):
    """The events of a key within each of its purchases' windows, whose lengths differ a thousandfold: points in intervals, on levels of length."""
    events = table(spark, sf_dir, "events")
    points = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    met = points_in(points, _windows_of(events, "purchase", "window_id", "value"), "at", "window_id_low", "window_id_high", key=["user_id"])
    return met.groupBy("user_id", "window_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(f"SELECT a.event_id AS a_id, count(*) AS n, CAST(sum(least(a.high, b.high) - greatest(a.low, b.low)) AS BIGINT) AS shared FROM ({_WINDOW.format(kind='purchase', hours='value')}) a JOIN ({_WINDOW.format(kind='view', hours='value / 7')}) b ON a.user_id = b.user_id AND a.low < b.high AND b.low < a.high GROUP BY 1")
def d14_overlapping_windows(spark, sf_dir):
    """Windows of purchases and of views that overlap, and for how long."""
    events = table(spark, sf_dir, "events")
    a, b = _windows_of(events, "purchase", "a_id", "value"), _windows_of(events, "view", "b_id", "value / 7")
    met = overlapping(a, b, "a_id_low", "a_id_high", "b_id_low", "b_id_high", key=["user_id"], any_length=True)
    return met.groupBy("a_id").agg(F.count("*").alias("n"), F.sum(F.least("a_id_high", "b_id_high") - F.greatest("a_id_low", "b_id_low")).alias("shared"))


_WORDS = "list_distinct(string_split_regex(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9]+'))"


@query(f"""SELECT title_id, min(ord) AS ord FROM (SELECT doc_id AS title_id, ord, symbol, name, words, t FROM (SELECT doc_id, upper(replace(text, 'ß', 'SS')) AS t, {_WORDS} AS words FROM documents) d
 CROSS JOIN (SELECT item_id AS ord, upper(regexp_extract(text, '^[A-Za-z]+')) AS symbol, upper(regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+')) AS name FROM benchmark)) WHERE (symbol <> '' AND list_contains(words, symbol)) OR (name <> '' AND contains(t, name)) GROUP BY 1""")
def d9_title_to_symbol(spark, sf_dir):
    """Whole texts against symbols and names of three words."""
    titles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("title_id"), F.col("text").alias("title"))
    name = lambda p: F.regexp_extract("text", p, 0)
    names = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), name("^[A-Za-z]+").alias("symbol"), name("^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+").alias("name"))
    return N.match_symbols(titles, names)


QUERIES["d9_title_to_symbol_whole"] = QUERIES["d9_title_to_symbol"]


@query(ctes("fundamentals") + "SELECT stock_id, fiscal_year, round(coalesce(per, derived_per), 6) AS per, per IS NULL AND derived_per IS NOT NULL AS per_is_derived FROM (SELECT stock_id, fiscal_year, last(per ORDER BY seq) FILTER (WHERE source = 'official') AS per, last(per ORDER BY seq) FILTER (WHERE source = 'derived') AS derived_per FROM (SELECT *, max(fiscal_year) OVER (PARTITION BY stock_id) AS newest FROM fundamentals) WHERE fiscal_year = newest GROUP BY 1, 2)")
def d12_official_fundamentals(spark, sf_dir):
    return rounded(latest_fundamentals(view(spark, sf_dir, "fundamentals")).select("stock_id", "fiscal_year", "per", "per_is_derived"))


def latest_fundamentals(f):
    """Each stock's latest year: the newest official row, with the derived PER where the official one is null."""
    newest = f.groupBy("stock_id").agg(F.max("fiscal_year").alias("newest")).withColumnRenamed("stock_id", "sid")
    own = f.join(newest, (F.col("stock_id") == F.col("sid")) & (F.col("fiscal_year") == F.col("newest")))
    last = lambda c, s: F.max_by(c, F.when(F.col("source") == s, F.col("seq")))
    out = own.groupBy("stock_id", "fiscal_year").agg(*(last(c, "official").alias(c) for c in ("per", "pbr", "roe_pct", "dividend_yield_pct", "payout_pct", "eps")), last("per", "derived").alias("derived_per"))
    return out.withColumns({"per_is_derived": F.col("per").isNull() & F.col("derived_per").isNotNull(), "per": F.coalesce("per", "derived_per")}).drop("derived_per")


_FV = mean([(f"CASE WHEN per > 0 THEN {bands('per', ((6.0, 90.0), (12.0, 70.0), (18.0, 50.0), (25.0, 30.0), (40.0, 10.0)))} END", 1.0), (f"CASE WHEN pbr > 0 THEN {bands('pbr', ((0.6, 90.0), (1.2, 70.0), (2.0, 50.0), (3.5, 30.0), (6.0, 10.0)))} END", 1.0)])
_FR, _FY = bands("roe_pct", ((2.0, 10.0), (8.0, 35.0), (13.0, 55.0), (18.0, 75.0), (25.0, 92.0))), bands("dividend_yield_pct", ((0.0, 20.0), (2.0, 45.0), (4.0, 65.0), (6.0, 82.0), (9.0, 92.0)))


_SHRUNK = f"50 + ({mean([('v', 0.45), ('ro', 0.35), ('yi', 0.20)])} - 50) * least(1.0, {cover({'a': 'v', 'b': 'ro', 'c': 'yi'}, {'a': 0.45, 'b': 0.35, 'c': 0.20})} / 0.8)"


@query(ctes("fundamentals") + f"SELECT seq, round({clamp(_SHRUNK)}, 3) AS score FROM (SELECT seq, {_FV} AS v, {_FR} AS ro, {_FY} AS yi FROM fundamentals)")
def i9_fundamental_score(spark, sf_dir):
    f = view(spark, sf_dir, "fundamentals")
    return rounded(f.select("seq", fundamental_score(F.col("per"), F.col("pbr"), F.col("roe_pct").cast("double"), F.col("dividend_yield_pct").cast("double"), digits=None).alias("score")), 3)


@query(ctes("news_agg") + f"SELECT stock_id, news_count, {r('avg_impact')}, n_positive, n_negative, latest_at, fresh_negative, has_dividend, has_results FROM news_agg")
def e7_news_aggregate(spark, sf_dir):
    return rounded(N.news_aggregate(N.recent_news(view(spark, sf_dir, "news"), now()), now()).drop("latest_title"))


@query(ctes("news") + "SELECT stock_id, count(DISTINCT event_type || '::' || array_to_string(string_split_regex(lower(title), '\\s+')[1:6], ' ')) AS n_topics FROM news WHERE stock_id IS NOT NULL GROUP BY 1")
def e8_topic_count(spark, sf_dir):
    return N.topic_count(view(spark, sf_dir, "news").where("stock_id is not null"))


_FROM, _TO = C.ACCENTED + "’‘`–—-/", C.PLAIN + "'''    "
_FOLD = f"trim(regexp_replace(lower(replace(replace(translate(trim(regexp_replace(text, '\\s+', ' ', 'g')), '{_FROM}', '{_TO.replace(chr(39), chr(39) * 2)}'), 'œ', 'oe'), 'Œ', 'oe')), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_FOLD} AS folded FROM documents")
def i1_i5_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.fold(F.col("text")).alias("folded"))


QUERIES["i1_i5_fold_whole"] = QUERIES["i1_i5_fold"]


@query("SELECT p_partkey, round(p_retailprice, 2) * CASE p_partkey % 4 WHEN 0 THEN 1000.0 WHEN 1 THEN 1000000.0 ELSE 1.0 END AS value FROM part WHERE p_partkey % 9 <> 0")
def i2_parse_number(spark, sf_dir):
    """Prices written with unit suffixes, currency and decimal commas come back as numbers."""
    p = table(spark, sf_dir, "part")
    text = F.replace(F.round("p_retailprice", 2).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    written = F.when(F.col("p_partkey") % 9 == 0, "N/A").when(F.col("p_partkey") % 4 == 0, F.concat(text, F.lit(" K"))).when(F.col("p_partkey") % 4 == 1, F.concat(text, F.lit(" M"))).otherwise(F.concat(text, F.lit(" MAD")))
    return p.select("p_partkey", C.parse_number(written).alias("value")).where("value is not null")


_PHRASES = ["Détachement du dividende", "Augmentation de capital en numéraire", "Résultats en forte hausse", "Avertissement sur résultat", "Avis divers", "Offre publique d’achat", "Suspension de la cotation"]


def _classified_sql(title: str, source: str = "news") -> str:
    """Columns event, impact and sentiment of a title, from the rule table."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    any_of = lambda patterns: "regexp_matches(f, " + quoted("|".join(patterns)) + ")"
    event = "CASE " + " ".join(f"WHEN {any_of(some)}{' AND ' + any_of((also,)) if also else ''} THEN '{name}'" for name, some, also in N.RULES) + " ELSE 'announcement' END"
    impact = f"CASE WHEN event = 'results' THEN CASE WHEN {any_of(N.RESULT_DOWN)} THEN {N.RESULT_IMPACT['down']} WHEN {any_of(N.RESULT_UP)} THEN {N.RESULT_IMPACT['up']} ELSE 0.0 END " + " ".join(f"WHEN event = '{k}' THEN {v}" for k, v in N.IMPACTS.items()) + " ELSE 0.0 END"
    folded = _FOLD.replace("regexp_replace(text,", f"regexp_replace({title},")
    return f"SELECT *, CASE WHEN impact >= 0.15 THEN 'positive' WHEN impact <= -0.15 THEN 'negative' ELSE 'neutral' END AS mood FROM (SELECT *, CAST({impact} AS DOUBLE) AS impact FROM (SELECT *, {event} AS event FROM (SELECT *, coalesce({folded}, '') AS f FROM {source})))"


_FAMILY = "CASE event " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.FAMILIES.items()) + " ELSE 'announcement' END"
_PHRASE = "CASE news_id % 7 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PHRASES)) + " END"


@query(ctes("news") + f"SELECT news_id, event, impact, mood AS sentiment, {_FAMILY} AS family, event IN ({', '.join(repr(x) for x in N.MECHANICAL_TYPES)}) AS mechanical FROM ({_classified_sql(f'concat_ws(chr(32), {_PHRASE}, title)')})")
def i6_i7_classify(spark, sf_dir):
    """Notices with a French phrase for each kind of event put before them, classified and folded to families."""
    at = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("news_id") % len(_PHRASES) + 1).cast("int"))
    c = view(spark, sf_dir, "news").select("news_id", N.classify(F.concat_ws(" ", at, "title")).alias("c"))
    return c.select("news_id", "c.*", N.event_family(F.col("c.event")).alias("family"), N.is_mechanical(F.col("c.event")).alias("mechanical"))


_NEW = _classified_sql("title")
QUERIES["b11_reclassification"] = (b11_reclassification, ctes("news") + f"SELECT news_id, event_type, sentiment, CAST(impact_score AS DOUBLE) AS impact_score, event AS new_event, impact AS new_impact, mood AS new_sentiment FROM ({_NEW}) WHERE NOT (event_type IS NOT DISTINCT FROM event AND sentiment IS NOT DISTINCT FROM mood AND coalesce(abs(impact_score - impact) <= 1e-9, false))")
QUERIES["e30_before_after_counts"] = (e30_before_after_counts, ctes("news") + f"SELECT coalesce(a.event, b.event) AS event, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after, coalesce(n_after, 0) - coalesce(n_before, 0) AS delta FROM (SELECT event_type AS event, count(*) AS n_before FROM news GROUP BY 1) a FULL JOIN (SELECT event, count(*) AS n_after FROM ({_NEW}) GROUP BY 1) b ON a.event = b.event")


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS text FROM pages")
def i30_markup_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.html_to_text(F.col("html")).alias("text"))


QUERIES["i30_markup_strip_whole"] = QUERIES["i30_markup_strip"]


_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"
_LINKS = f"""SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY part, spot) AS pos FROM (SELECT * FROM (
 SELECT page_id, part, spot, CASE WHEN starts_with(href, '/') THEN base || href ELSE href END AS link, {_PLAIN.format('a')} AS title, try_cast(regexp_replace(near, '[/.]', '-', 'g') AS DATE) AS date FROM (
 SELECT page_id, part, spot, a, regexp_extract(url, '^[a-z]+://[^/?#]+') AS base, regexp_extract(a, '(?i)href="([^"]*)"', 1) AS href, nullif(regexp_extract({_PLAIN.format('around')}, '\\b(20[0-9]{{2}}[-/.][0-9]{{2}}[-/.][0-9]{{2}})\\b', 1), '') AS near FROM (
 SELECT *, unnest(found) AS a, generate_subscripts(found, 1) AS spot FROM (SELECT *, regexp_extract_all(around, '{N._ANCHOR}', 0) AS found FROM (
 SELECT page_id, url, unnest(parts) AS around, generate_subscripts(parts, 1) AS part FROM (SELECT page_id, url, string_split_regex(html, '{N._AROUND}') AS parts FROM pages)))))) WHERE length(title) >= 4
 QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY part, spot) = 1)"""


@query(f"""WITH links AS ({_LINKS}), found AS (SELECT l.page_id, l.link, min(b.ord) AS ord FROM (SELECT *, list_distinct(string_split_regex(upper(replace(title, 'ß', 'SS')), '[^A-Z0-9]+')) AS words FROM links) l JOIN (SELECT item_id AS ord, upper(regexp_extract(text, '^[A-Za-z]+')) AS symbol FROM benchmark) b ON b.symbol <> '' AND list_contains(words, b.symbol) GROUP BY 1, 2)
SELECT c.page_id, c.pos, c.link, c.title, c.date, c.event, c.impact, c.mood AS sentiment, f.ord FROM ({_classified_sql("title", "links")}) c LEFT JOIN found f ON f.page_id = c.page_id AND f.link = c.link WHERE c.pos <= 100""")
def a15_page_links(spark, sf_dir):
    """Links of landed pages as notices. The given pages' links are words, so titles of four letters count here and every address; by default it takes twelve and a notice's address."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    names = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.regexp_extract("text", "^[A-Za-z]+", 0).alias("symbol"), F.lit("").alias("name"))
    return N.notices_from_pages(pages, names, least=4, marks="")
