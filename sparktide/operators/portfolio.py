"""Holdings: valuation, advice, totals and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fee of one side, stop loss, gain that is taken when the trend turns, and limits of concentration.
FEE, STOP_LOSS, TAKE, TURN, AVOID = 0.005, -8.0, 15.0, -3.0, 60.0
FEW_POSITIONS, SECTOR_MOST, WEIGHT_MOST = 4, 40.0, 25.0


def value_holdings(holdings: DataFrame, state: DataFrame, fee: float = FEE) -> DataFrame:
    """Cost, value, net gain after fees on both sides, and advice; unpriced holdings keep nulls and are held."""
    out = holdings.drop("symbol").join(state.select("stock_id", "symbol", "sector", "price", "avoid", "momentum_30d"), "stock_id", "left")
    cost, value = F.col("quantity") * F.col("buy_price"), F.col("quantity") * F.col("price")
    out = out.withColumns({"cost": cost, "value": value})
    out = out.withColumn("net", F.col("value") - F.col("cost") - F.col("cost") * fee - F.col("value") * fee)
    out = out.withColumn("net_pct", F.col("net") / F.nullif(F.col("cost") * (1 + fee), F.lit(0.0)) * 100)
    sell = (F.col("net_pct") <= STOP_LOSS) | (F.col("avoid") >= AVOID) | ((F.col("net_pct") >= TAKE) & (F.col("momentum_30d") <= TURN))
    return out.withColumn("advice", F.when(F.coalesce(sell & F.col("price").isNotNull(), F.lit(False)), "SELL").otherwise("HOLD"))


def totals(valued: DataFrame) -> DataFrame:
    """Sums over priced holdings, and how many to sell."""
    priced = lambda c: F.sum(F.when(F.col("value").isNotNull(), F.col(c)))
    return valued.agg(priced("value").alias("value"), priced("cost").alias("cost"), priced("net").alias("net"), F.count_if(F.col("advice") == "SELL").alias("n_sell")).withColumn("net_pct", F.col("net") / F.nullif("cost", F.lit(0.0)) * 100)


def sectors(valued: DataFrame) -> DataFrame:
    """Value and share of each sector; holdings without one count as unknown."""
    by = valued.where("value is not null").groupBy(F.coalesce("sector", F.lit("Inconnu")).alias("sector")).agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    total = by.agg(F.sum("value").alias("total"))
    return by.crossJoin(F.broadcast(total)).withColumn("share", F.col("value") / F.col("total") * 100).drop("total")  # one row


def concentration(valued: DataFrame) -> DataFrame:
    """Weight of each position with its flags: few positions, a sector or a position too heavy, a loss."""
    by = sectors(valued)
    top = by.agg(F.max("share").alias("top_share"), F.sum("value").alias("total"), F.sum("n").alias("positions"))
    out = valued.where("value is not null").crossJoin(F.broadcast(top))  # one row
    flags = [("few", F.col("positions") < FEW_POSITIONS), ("sector", F.col("top_share") >= SECTOR_MOST), ("weight", F.col("weight") >= WEIGHT_MOST), ("loss", F.col("net") < 0)]
    out = out.withColumn("weight", F.col("value") / F.col("total") * 100)
    return out.withColumn("flags", F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in flags)), lambda x: x.isNotNull()))
