"""State changes as functions of (existing, incoming): what a table holds after a batch. Writers overwrite to a new path or run them in foreachBatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """New rows of keys that the table lacks; of several incoming rows of a key the first in ``order``."""
    first = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
    return first.join(existing.select(*key).distinct(), key, "left_anti")


def upsert_replace(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The table with each incoming key's row put in place of the old one, nulls included; the last in ``order`` wins among the incoming."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("__new"), *order)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def upsert_coalesce(existing: DataFrame, incoming: DataFrame, key: str, filled: list[str], replaced: list[str]) -> DataFrame:
    """Columns ``filled`` change only where the new value is there; columns ``replaced`` always do."""
    old, new = existing.select(key, *(F.col(c).alias(f"o_{c}") for c in (*filled, *replaced)), F.lit(True).alias("__o")), incoming.select(key, *(F.col(c).alias(f"n_{c}") for c in (*filled, *replaced)), F.lit(True).alias("__n"))
    out = old.join(new, key, "full_outer")
    return out.select(key, *(F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in filled), *(F.when(F.col("__n"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in replaced))


def upsert_touch(facts: DataFrame, key: list[str], at: str, values: list[str]) -> DataFrame:
    """One row for each fact: first and last time seen, and the newest values."""
    return facts.groupBy(*key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), *(F.max_by(v, at).alias(v) for v in values))


def append_log(df: DataFrame, path: str, at: str, grain: str = "month") -> None:
    """Append to a log that is split by time. Rows are ranged by time with a salt beside it, so that a task writes few parts and a part that holds most rows has several tasks."""
    rows = df.withColumns({"dt": F.to_date(F.date_trunc(grain, F.col(at))), "__salt": F.xxhash64(*df.columns)})
    rows.repartitionByRange("dt", "__salt").drop("__salt").write.mode("append").partitionBy("dt").parquet(path)


def digest(df: DataFrame, *, n: str = "n", total: str = "digest") -> DataFrame:
    """(rows, sum of the rows' hashes): a digest that doesn't depend on order and counts repeated rows."""
    return df.agg(F.count("*").alias(n), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(total))


def fullest(snapshots: DataFrame, key: list[str], fields: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row with the most fields present, the first in ``order`` on ties."""
    n = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    return snapshots.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(n.desc(), *order))).where("__n = 1").drop("__n")


def first_source(batch: DataFrame, of: str, source: str, priority: list[str]) -> DataFrame:
    """Rows of the first source in ``priority`` that delivered any to the batch ``of``; sources are never mixed."""
    rank = F.coalesce(*(F.when(F.col(source) == s, F.lit(i)) for i, s in enumerate(priority)), F.lit(len(priority)))
    best = batch.groupBy(of).agg(F.min(rank).alias("__best"))
    return batch.join(best, of).where(rank == F.col("__best")).drop("__best")


def missing_days(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows on days that the table doesn't hold for their key."""
    have = existing.select(*key, F.to_date("observed_at").alias("__day")).distinct()
    return incoming.withColumn("__day", F.to_date("observed_at")).join(have, [*key, "__day"], "left_anti").drop("__day")


def with_defaults(old: DataFrame, new: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Old and new rows in the newer schema; columns that old rows lack take the given defaults."""
    out = old.unionByName(new, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def reconcile(source: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """(table, rows of each, whether they hold the same rows): counts and an order-free digest."""
    both = digest(source, n="n_source", total="h_source").crossJoin(digest(target.select(*source.columns), n="n_target", total="h_target"))  # one row each
    return both.select(F.lit(name).alias("name"), "n_source", "n_target", ((F.col("n_source") == F.col("n_target")) & (F.col("h_source") == F.col("h_target"))).alias("ok"))
