"""Result tables that are made anew part by part: a part of the keys is computed again only when the digest of its input has changed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.sources.shared import stored

#: Parts into which keys fall; manifests and the driver hold a row for each.
PARTS = 64


def files_version(spark: SparkSession, path: str) -> str:
    """A version of the files under a path from their names, sizes and times: reads the listing and no data."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files, found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def part_digests(inputs: dict[str, DataFrame], key: str, parts: int) -> DataFrame:
    """``(part, digest)``: for each part its rows' number and the sums of two hashes of them, over all inputs. Order plays no part, repeated rows do.

    A hash is added in pieces of 22 bits, whose sums are plain integers up to 2^41 rows of a part.
    """
    each = None
    for name, df in sorted(inputs.items()):
        columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
        rows = df.select(part_of(key, parts).alias("part"), *(F.xxhash64(F.lit(s), F.lit(name), *columns).alias(f"h{s}") for s in (0, 1)))
        each = rows if each is None else each.unionByName(rows)
    pieces = {f"{h}_{at}": F.sum(F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << 22) - 1))) for h in ("h0", "h1") for at in (0, 22, 44)}
    summed = each.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *(x.alias(c) for c, x in pieces.items()))
    return summed.select("part", F.sha2(F.concat_ws(":", "n", *pieces), 256).alias("digest"))


class PartedResult:
    """The result of ``compute`` over inputs that all have ``key``, kept under ``path`` in parts of keys.

    ``compute`` takes the inputs by name and returns rows with ``key``; what it says of a key must follow from the rows of that
    key alone. A manifest (one file an epoch, the greatest one counts) names each part's digest and where its rows lie, so a
    reader sees the table before or after a refresh and never between, and a refresh that fails leaves it as it was.
    """

    MANIFEST = "epoch long, part int, digest string, at string, version string"

    def __init__(self, spark: SparkSession, path: str, key: str, compute: Callable[[dict[str, DataFrame]], DataFrame], parts: int = PARTS):
        self.spark, self.path, self.key, self.compute, self.parts = spark, path.rstrip("/"), key, compute, parts

    def manifest(self) -> list:
        """The rows of the newest manifest, at most one for each part; none before the first refresh."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return []
        every = self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest")
        newest = every.agg(F.max("epoch").alias("newest"))  # one row
        return every.join(F.broadcast(newest), F.col("epoch") == F.col("newest")).drop("newest").collect()

    def refresh(self, inputs: dict[str, DataFrame], version: str | None = None) -> list[int]:
        """Bring the table up to its inputs and return the parts that were computed again.

        With a ``version`` of the inputs that the manifest knows already (see ``files_version``) nothing of them is read. Else
        one aggregation gives the digests, and ``compute`` sees the changed parts' rows only. A part whose keys are all gone goes.
        """
        held = self.manifest()
        if version is not None and held and all(r["version"] == version for r in held):
            return []
        known = {r["part"]: (r["digest"], r["at"]) for r in held}
        now = {r["part"]: r["digest"] for r in part_digests(inputs, self.key, self.parts).collect()}  # at most PARTS rows
        changed = sorted(p for p, digest in now.items() if known.get(p, ("",))[0] != digest)
        epoch = max((r["epoch"] for r in held), default=-1) + 1
        at = f"rows-{epoch}"
        if changed:
            among = part_of(self.key, self.parts).isin(changed)
            rows = self.compute({name: df.where(among) for name, df in inputs.items()})
            self._write(rows, f"{self.path}/{at}")
        entries = [(epoch, p, digest, at if p in changed else known[p][1], version) for p, digest in now.items()] or [(epoch, None, None, None, version)]
        self.spark.createDataFrame(entries, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return changed

    def _write(self, rows: DataFrame, at: str) -> None:
        """Rows in a folder for each part. A part's rows meet in one task first (a large part's in some), else every task would leave a file in every part."""
        placed = rows.withColumn("__part", part_of(self.key, self.parts)).hint("rebalance", "__part")
        placed.write.mode("overwrite").partitionBy("__part").parquet(at)

    def read(self) -> DataFrame:
        """The table as the newest manifest has it: each part from the epoch that wrote it."""
        by_epoch: dict[str, list[int]] = {}
        for r in self.manifest():
            if r["at"] is not None:
                by_epoch.setdefault(r["at"], []).append(r["part"])
        if not by_epoch:
            raise ValueError("nothing has been stored yet")
        out = None
        for at, parts in sorted(by_epoch.items()):
            rows = self.spark.read.parquet(f"{self.path}/{at}").where(F.col("__part").isin(parts)).drop("__part")
            out = rows if out is None else out.unionByName(rows)
        return out

    def compacted(self, to: str) -> PartedResult:
        """The same table with all parts in one epoch under a new path, for a table of many epochs."""
        rows, entries = stored(self.read(), "parts"), self.manifest()
        self._write(rows, f"{to}/rows-0")
        self.spark.createDataFrame([(0, r["part"], r["digest"], r["at"] and "rows-0", r["version"]) for r in entries], self.MANIFEST).coalesce(1).write.parquet(f"{to}/manifest")
        return PartedResult(self.spark, to, self.key, self.compute, self.parts)
