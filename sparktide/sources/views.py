"""Input views over the given tables; the same SQL text serves Spark and the checking engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations", "benchmark")

VIEWS = {
    "stocks": "SELECT s_suppkey AS stock_id, s_name AS symbol, s_name AS company_name, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "prices": """SELECT l_orderkey * 10 + l_linenumber AS seq, l_suppkey AS stock_id, l_shipdate AS observed_at,
 97 + (l_extendedprice / l_quantity) - floor(l_extendedprice / l_quantity / 6) * 6 + (year(l_shipdate) - 1995) * (l_suppkey % 3 - 1) * 4 AS current_price,
 CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE (l_tax - l_discount) * 100 END AS daily_variation,
 CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_extendedprice END AS volume,
 l_quantity AS traded_quantity, l_returnflag AS source FROM lineitem""",
    "news": """SELECT d.doc_id AS news_id,
 CASE WHEN d.doc_id % 10 = 9 THEN NULL ELSE d.doc_id % (SELECT count(*) FROM supplier) END AS stock_id,
 TIMESTAMP '2001-11-05 00:00:00' - d.doc_id * INTERVAL '1' HOUR AS collected_at,
 substr(d.text, 1, 200) AS title, concat('https://n.example/', d.doc_id) AS url, d.source AS source,
 CASE d.doc_id % 4 WHEN 0 THEN 'ex_dividend' WHEN 1 THEN 'results' WHEN 2 THEN 'dividend_announcement' ELSE 'market_notice' END AS event_type,
 CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' WHEN l.quality = 0 THEN 'neutral' END AS sentiment,
 CASE WHEN l.toxic = 1 THEN -0.5 WHEN l.quality = 1 THEN 0.35 WHEN l.quality = 0 THEN 0.0 END AS impact_score
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "holdings": "SELECT s_suppkey AS stock_id, s_name AS symbol, 1 + s_suppkey % 50 AS quantity, 80 + abs(s_acctbal) % 40 AS buy_price FROM supplier WHERE s_suppkey % 3 = 0",
    "favorites": "SELECT s_suppkey AS stock_id, s_name AS symbol FROM supplier WHERE s_suppkey % 4 = 0",
    "fundamentals": """SELECT p_partkey AS seq, p_partkey % (SELECT count(*) FROM supplier) AS stock_id, 2020 + p_size % 5 AS fiscal_year,
 CASE WHEN p_partkey % 7 = 0 THEN 'derived' ELSE 'official' END AS source,
 CASE WHEN p_size % 6 = 0 THEN NULL ELSE (p_retailprice - 900) / 2 END AS per,
 CASE WHEN p_size % 4 = 0 THEN NULL ELSE (p_retailprice - 900) / 20 END AS pbr,
 p_size / CAST(2 AS DOUBLE) AS roe_pct, p_size / CAST(6 AS DOUBLE) AS dividend_yield_pct, p_size * CAST(2 AS DOUBLE) AS payout_pct, p_retailprice / 30 AS eps FROM part""",
    "macro": "SELECT event_type AS indicator, ts AS as_of, value, 'bank' AS source, event_id AS seq FROM events",
    "reports": """SELECT o_orderkey AS report_id, o_custkey AS symbol, 'short' AS horizon_focus, o_orderdate AS generated_at,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'STRONG_OPPORTUNITY' WHEN '2-HIGH' THEN 'WATCH' WHEN '3-MEDIUM' THEN 'HOLD' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'AVOID' END AS recommendation_short,
 CASE o_orderstatus WHEN 'F' THEN 'WATCH' WHEN 'O' THEN 'RISKY' ELSE 'AVOID' END AS recommendation_medium,
 o_totalprice % 100 AS confidence_short, (o_totalprice / 7) % 100 AS risk_score FROM orders""",
    "predictions": """SELECT event_id AS prediction_id, event_type AS analyst, user_id % (SELECT count(*) FROM supplier) AS stock_id,
 CASE event_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS horizon,
 TIMESTAMP '1996-01-01 00:00:00' + (event_id % 10000) * INTERVAL '4' HOUR AS generated_at,
 TIMESTAMP '1996-01-01 00:00:00' + (event_id % 10000) * INTERVAL '4' HOUR + (CASE event_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 60 ELSE 180 END) * INTERVAL '1' DAY AS evaluate_at,
 CASE event_id % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'flat' WHEN 2 THEN 'down' ELSE 'up' END AS predicted_direction,
 CASE WHEN event_id % 11 = 0 THEN 'stability' ELSE 'direction' END AS claim_kind,
 CASE WHEN event_id % 13 = 0 THEN 1 ELSE 2 END AS semantics_version,
 0.5 + (value - floor(value)) * 0.25 AS predicted_probability, 97 + value % 6 AS price_at_prediction FROM events""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input view as a lazy DataFrame; filters and columns still reach its Parquet scans."""
    sql = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})
