"""Tables in parts by ranges of a column: a merge reads and rewrites the parts that its rows fall into, and one manifest switches the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparktide.sources.shared import stored

#: Rows from which on a part is split; a manifest has a row for each part.
MOST_ROWS = 1_000_000


def newest_of(key: list[str], order: list[Column]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A change in which of old and new rows of a key the first in ``order`` stays, so that a late row never shadows a newer one."""

    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(*order)
        return old.unionByName(new).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

    return change


class RangedTable:
    """Rows under ``path``, in parts by ranges of the column ``by``, whose values can be ordered; nulls lie in the first part.

    The greatest epoch of the manifest names every part's lower bound and folder. A merge writes new folders for the parts it
    touches and then the next epoch, as one file: readers see the table before or after it. Old folders stay for readers that are
    still at an older epoch; ``vacuum_paths`` names those that no longer count.
    """

    def __init__(self, spark: SparkSession, path: str, by: str, most_rows: int = MOST_ROWS):
        self.spark, self.path, self.by, self.most_rows = spark, path.rstrip("/"), by, most_rows

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def manifest(self) -> list:
        """``(epoch, part, low, at, n, batch)`` of the newest epoch, by part; none before the table is made."""
        if not self._exists("manifest"):
            return []
        every = self.spark.read.parquet(f"{self.path}/manifest")
        newest = every.agg(F.max("epoch").alias("newest"))  # one row
        return every.join(F.broadcast(newest), F.col("epoch") == F.col("newest")).drop("newest").orderBy("part").collect()

    def _switch(self, epoch: int, entries: list[tuple], kind, batch: int | None) -> None:
        long = lambda name: StructField(name, LongType())
        schema = StructType([long("epoch"), long("part"), StructField("low", kind), StructField("at", StringType()), long("n"), long("batch")])
        rows = [(epoch, part, low, at, n, batch) for part, (low, at, n) in enumerate(entries)]
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _part(self, lows: list, kind) -> Column:
        """The number of a row's part: how many of the lower bounds after the first part's are at or under its value."""
        bounds = F.array(*(F.lit(x).cast(kind) for x in lows)) if lows else F.array().cast(f"array<{kind.simpleString()}>")
        return F.when(F.col(self.by).isNull(), 0).otherwise(F.size(F.filter(bounds, lambda x: x <= F.col(self.by))))

    def _bounds(self, rows: DataFrame, parts: int) -> list:
        """Lower bounds of about equal ranges, without the first range's; the ranges come from Spark's own sample."""
        if parts < 2:
            return []
        dealt = rows.where(F.col(self.by).isNotNull()).select(self.by).repartitionByRange(parts, self.by)
        least = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(self.by).alias("low")).collect()  # a row a part
        return sorted({r["low"] for r in least})[1:]

    def _write(self, rows: DataFrame, lows: list, at: str) -> dict[int, int]:
        kind = rows.schema[self.by].dataType
        placed = rows.withColumn("__part", self._part(lows, kind))
        placed.write.mode("overwrite").partitionBy("__part").parquet(f"{self.path}/{at}")
        return {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}

    def create(self, rows: DataFrame, batch: int | None = None) -> int:
        """Make the table of ``rows``; the number of its parts."""
        rows = stored(rows, "ranged")
        lows = self._bounds(rows, -(-rows.count() // self.most_rows))
        counts = self._write(rows, lows, "rows-0")
        kind = rows.schema[self.by].dataType
        entries = [(low, f"rows-0/__part={k}" if counts.get(k) else None, counts.get(k, 0)) for k, low in enumerate([None, *lows])]
        rows.limit(0).write.parquet(f"{self.path}/empty")
        self._switch(0, entries, kind, batch)
        return len(entries)

    def _rows(self, entries: list) -> DataFrame:
        none = self.spark.read.parquet(f"{self.path}/empty")
        paths = [f"{self.path}/{e['at']}" for e in entries if e["at"]]
        return self.spark.read.schema(none.schema).parquet(*paths) if paths else none

    def read(self) -> DataFrame:
        held = self.manifest()
        if not held:
            raise ValueError("the table hasn't been made yet")
        return self._rows(held)

    def merge(self, incoming: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> list[int]:
        """Put ``change(old, incoming)`` in place of the old rows, where old are those of the ranges that ``incoming`` falls into; the parts written.

        What ``change`` does with a row must follow from rows of its own value of ``by``. With a ``batch`` number, a batch that the
        table has already taken changes nothing, so a stream may repeat its last one. A part of more than ``most_rows`` is
        split. No incoming rows: nothing is written.
        """
        held = self.manifest()
        if batch is not None and held and held[0]["batch"] is not None and held[0]["batch"] >= batch:
            return []
        if not held:
            return list(range(self.create(change(incoming.limit(0), incoming), batch)))
        incoming, kind, epoch = stored(incoming, "incoming"), self.spark.read.parquet(f"{self.path}/empty").schema[self.by].dataType, held[0]["epoch"] + 1
        lows = [e["low"] for e in held][1:]
        touched = sorted(r[0] for r in incoming.select(self._part(lows, kind)).distinct().collect())  # at most the parts
        if not touched:
            return []
        old = self._rows([held[k] for k in touched])
        new = stored(change(old, incoming.select(*old.columns)).select(*old.columns), "merged")
        placed = new.withColumn("__part", self._part(lows, kind))
        finer = []
        for r in placed.groupBy("__part").count().where(F.col("count") > self.most_rows).collect():
            finer += self._bounds(placed.where(F.col("__part") == r["__part"]), -(-2 * r["count"] // self.most_rows))
        all_lows = sorted({*lows, *finer})
        at = f"rows-{epoch}"
        counts = self._write(new, all_lows, at)
        place = {low: k for k, low in enumerate([None, *lows])}
        entries, k, written = [], 0, []
        for low in [None, *all_lows]:
            k = place.get(low, k)  # the old part that this range lies in
            if k in touched:
                number = len(entries)
                written.append(number)
                entries.append((low, f"{at}/__part={number}" if counts.get(number) else None, counts.get(number, 0)))
            else:
                entries.append((low, held[k]["at"], held[k]["n"]))
        self._switch(epoch, entries, kind, batch)
        return written

    def vacuum_paths(self) -> list[str]:
        """Folders of parts that the newest epoch doesn't name."""
        every = self.spark.read.parquet(f"{self.path}/manifest").where("at is not null").select("at").distinct().collect()  # parts of all epochs
        return sorted({f"{self.path}/{r['at']}" for r in every} - {f"{self.path}/{e['at']}" for e in self.manifest()})
