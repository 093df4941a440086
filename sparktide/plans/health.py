"""Health of feeds, fingerprints of inputs, knowledge facts, and numbers in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktide.functions.columns import fact_hash
from sparktide.sources.state import digest

SEVERITY = {"ok": 0, "stale": 1, "degraded": 2, "empty": 3}


def feed_health(feeds: dict[str, tuple[DataFrame, str, str, int]], now: Column, known: DataFrame) -> DataFrame:
    """One row for each feed: rows, newest time, coverage of known stocks, status. A feed is (rows, time column, stock column, greatest age in hours)."""
    out = None
    total = known.agg(F.count("*").alias("n_known"))
    for name, (rows, at, key, hours) in feeds.items():
        one = rows.agg(F.count("*").alias("n"), F.max(at).alias("newest"), F.countDistinct(key).alias("n_keys")).crossJoin(F.broadcast(total))  # one row each
        age = (F.unix_timestamp(now) - F.unix_timestamp("newest")) / 3600
        status = F.when(F.col("n") == 0, "empty").when(F.col("newest").isNull(), "degraded").when(age > hours, "stale").otherwise("ok")
        one = one.select(F.lit(name).alias("feed"), "n", "newest", F.round(F.col("n_keys") / F.col("n_known"), 3).alias("coverage"), status.alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def worst(health: DataFrame) -> DataFrame:
    severity = F.coalesce(*(F.when(F.col("status") == k, F.lit(v)) for k, v in SEVERITY.items()))
    blind = F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") != "ok", F.col("feed")))), ",")
    return health.agg(F.max_by("status", severity).alias("worst"), blind.alias("blind"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Count, greatest first column and an order-free digest of a table, in which repeated rows count: its version."""
    return df.agg(F.max(df.columns[0]).alias("top")).crossJoin(digest(df)).select("n", "top", "digest")  # one row each


#: Key and column of each ratio, and fields of a profile.
RATIOS = {"roe": "roe_pct", "dividend_yield": "dividend_yield_pct", "eps": "eps", "per": "per", "pbr": "pbr", "payout": "payout_pct"}
FIELDS = ("sector", "company_name")


def harvest(profiles: DataFrame, ratios: DataFrame, notices: DataFrame, per_stock: int = 60, *, fields=FIELDS, names=tuple(RATIOS)) -> DataFrame:
    """Facts about companies from profiles, official ratios and the newest notices: (stock_id, category, key, value, fact_hash). Blanks are skipped."""
    from pyspark.sql import Window

    a = profiles.select("stock_id", F.lit("profile").alias("category"), *fields).unpivot(["stock_id", "category"], list(fields), "key", "value")
    b = ratios.where("source <> 'derived'").select("stock_id", F.lit("ratio").alias("category"), F.col("fiscal_year").cast("string").alias("year"), *(F.round(RATIOS[k], 2).cast("double").alias(k) for k in names))
    b = b.unpivot(["stock_id", "category", "year"], list(names), "name", "number").where("number is not null")
    b = b.select("stock_id", "category", F.concat_ws(":", "name", "year").alias("key"), F.format_string("%.2f", "number").alias("value"))
    w = Window.partitionBy("stock_id").orderBy(F.desc("collected_at"), F.desc("news_id"))
    c = notices.where("stock_id is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_stock).select("stock_id", F.lit("notice").alias("category"), F.col("event_type").alias("key"), F.col("url").alias("value"))
    facts = a.unionByName(b).unionByName(c).where(F.trim(F.coalesce("value", F.lit(""))) != "")
    # dealt out first: told apart before the exchange, all facts of a task's file would be held at once, though few come twice
    facts = facts.select("stock_id", "category", "key", "value").repartition("stock_id", "category", "key").distinct()
    return facts.withColumn("fact_hash", fact_hash(F.col("category"), F.col("key"), F.col("value")))


def numbers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))


def grounded(texts: DataFrame, known: DataFrame, tolerance: float = 0.011, *, own: str | None = None) -> DataFrame:
    """``(id, n_numbers, n_ungrounded, ok)``: every number of a text must be one of its known ones, within a tolerance; whole numbers up to 100 always are. An empty text isn't ok.

    Known numbers are spread to the tenths that they may be met in, so that the comparison is an equi join. With ``own``, a
    column of both, texts are told apart by it too, and a number is known only from rows of another ``own``: the least and
    the greatest ``own`` of each number tell, so that no two texts are compared.
    """
    key = ["id", own] if own else ["id"]
    numbers = known.groupBy("id", "x").agg(F.min(own).alias("least"), F.max(own).alias("most")) if own else known.select("id", "x", F.lit(0).alias("least"), F.lit(0).alias("most"))
    elsewhere = ((F.col("least") != F.col(own)) | (F.col("most") != F.col(own))) if own else F.lit(True)
    some = (F.trim(F.coalesce("text", F.lit(""))) != "").alias("some")  # all that is still asked of the text
    said = texts.select(*key, some, F.explode_outer(numbers_in(F.col("text"))).alias("x")).withColumn("cell", F.floor(F.col("x") * 10))
    near = numbers.select("id", F.col("x").alias("k"), "least", "most").withColumn("cell", F.explode(F.array_distinct(F.array(F.floor((F.col("k") - tolerance) * 10), F.floor((F.col("k") + tolerance) * 10))))).distinct()
    free = (F.col("x") == F.floor("x")) & (F.col("x") <= 100)
    met = said.join(near, ["id", "cell"], "left").withColumn("good", F.coalesce(free | ((F.abs(F.col("x") - F.col("k")) <= tolerance) & elsewhere), F.lit(False)) | F.col("x").isNull())
    each = met.groupBy(*key, "x").agg(F.max("good").alias("good"), F.max("some").alias("some"))
    out = each.groupBy(*key).agg(F.count("x").alias("n_numbers"), F.count_if(~F.col("good")).alias("n_ungrounded"), F.max("some").alias("some"))
    return out.select(*key, "n_numbers", "n_ungrounded", (F.col("some") & (F.col("n_ungrounded") == 0)).alias("ok"))
