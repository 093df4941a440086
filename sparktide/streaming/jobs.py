"""Structured Streaming jobs with their batch twins; each transformation takes a streaming or a static DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparktide.sources import state

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark, path: str) -> DataFrame:
    """Events of a folder as a stream."""
    return spark.readStream.schema(EVENTS).parquet(path)


def ingest(events: DataFrame, key: list[str], at: str = "ts", late: str = "2 days") -> DataFrame:
    """Each key once, whatever the order and number of its deliveries within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def daily_last(events: DataFrame, late: str = "2 days") -> DataFrame:
    """The last value of each key and day by event time, so that late rows never shadow later ones."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        out = out.withWatermark("ts", late)
    out = out.groupBy("user_id", "event_type", F.window("ts", "1 day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return out.select("user_id", "event_type", F.to_date("window.start").alias("day"), "value")


def daily_latest(batch: DataFrame) -> DataFrame:
    """The last row by event time of each key and day of a batch, with that time."""
    latest = F.max_by(F.struct("value", "ts", "event_id"), F.struct("ts", "event_id")).alias("x")
    return batch.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(latest).select("user_id", "event_type", "day", "x.*")


def sliding_activity(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and sums of each key over one hour, every 15 minutes."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        out = out.withWatermark("ts", late)
    out = out.groupBy("user_id", F.window("ts", "1 hour", "15 minutes")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n", "total")


def unusual_activity(events: DataFrame, baseline: DataFrame, times: float = 2.0) -> DataFrame:
    """Sliding sums against a static baseline ``(user_id, usual)``: a stream-static join."""
    return sliding_activity(events).join(baseline, "user_id").where(F.col("total") >= times * F.col("usual") + 1e-9)


def usual_activity(history: DataFrame) -> DataFrame:
    """``(user_id, usual)``: the mean of a key's hourly sums over its history, which is static."""
    return sliding_activity(history).groupBy("user_id").agg(F.avg("total").alias("usual"))


def late_router(path: str, delay: str, write: Callable[[DataFrame, str, int], None], at: str = "ts") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives ``write`` a batch's rows in two parts: ``live``, and ``late``, which a watermark of ``delay`` would drop.

    The watermark of a batch is the greatest event time of the batches before it less the delay, as the engine has it. Each
    epoch's greatest time is written under ``path``, so a restarted query and a repeated epoch find the same watermark. Rows
    without a time are late.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        marks = f"{path}/marks"
        batch.agg(F.max(at).alias("newest")).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{marks}/of={epoch}")
        seen = spark.read.schema("newest timestamp, epoch long").option("basePath", marks).parquet(f"{marks}/of=*").where(F.col("epoch") < epoch)
        mark = seen.agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("__mark"))  # one row
        judged = batch.crossJoin(F.broadcast(mark))
        late = F.coalesce(F.col(at) < F.col("__mark"), F.col(at).isNull())
        write(judged.where(~late).drop("__mark"), "live", epoch)
        write(judged.where(late).drop("__mark"), "late", epoch)

    return run


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of a key's events without a silence of ``gap``."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        out = out.withWatermark("ts", late)
    out = out.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("until"), "n")


def urgent(events: DataFrame, watched: DataFrame, floor: float, late: str = "1 day") -> DataFrame:
    """Falls to ``floor`` or under of watched keys, once for each key and day."""
    hit = events.withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("value") <= floor).join(watched, "user_id").withColumn("day", F.to_date("ts"))
    if not events.isStreaming:
        return hit.groupBy("user_id", "day").agg(F.min("ts").alias("ts"))
    return hit.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "day"]).select("user_id", "day", "ts")


#: Groups of keys that share their state for changes of opinion: a state is asked once for a group and micro-batch, not for each key. A checkpoint belongs to its number.
OPINION_GROUPS = 512


class _Opinions(StatefulProcessor):
    """Holds the rows of a group of keys back until the watermark has passed them, then takes them in event order against each key's last type."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "user_id long, event_type string")
        self.waiting = handle.getListState("waiting", "user_id long, at long, event_id long, event_type string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(u), int(t.value // 1000), int(i), e) for batch in rows for u, t, i, e in zip(batch["user_id"], batch["ts"], batch["event_id"], batch["event_type"])]
        if new:
            self.waiting.appendList(new)
            at, set_to = min(x[1] for x in new) // 1000 + 1, self.timer.get()[0] if self.timer.exists() else None
            if set_to is None or at < set_to:
                if set_to is not None:
                    self.handle.deleteTimer(set_to)
                self._wake(at)
        yield pd.DataFrame([], columns=["event_id", "user_id", "was", "became"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, last, left, due, out = timerValues.getCurrentWatermarkInMs() * 1000, {u: e for u, e in self.last.get()}, [], [], []
        for x in self.waiting.get():
            (due if x[1] <= now else left).append(tuple(x))
        for user, _, event, became in sorted(due):
            was = last.get(user)
            if was is not None and became != was:
                out.append((event, user, was, became))
            last[user] = became
        if due:
            self.last.put(list(last.items()))
        if left:
            self.waiting.put(left)
            self._wake(min(x[1] for x in left) // 1000 + 1)
        else:
            self.waiting.clear()
            self.timer.clear()
        yield pd.DataFrame(out, columns=["event_id", "user_id", "was", "became"])

    def _wake(self, at: int) -> None:
        """The group's one timer, for its earliest waiting row."""
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


def opinion_changes(events: DataFrame, late: str = "1 day", groups: int = OPINION_GROUPS) -> DataFrame:
    """A row whenever a key's type of event differs from its last one by event time, whichever micro-batches brought the two.

    Rows wait in list state until the watermark passes them; an event-time timer for each of ``groups`` of keys then takes them
    in order (ties: event_id), and only the last type of each key stays. So state holds the rows of ``late`` and one value for
    each key. Needs the RocksDB state store: start the query within ``rocksdb_state``. Null keys, times and types: no part.
    """
    # one condition on the time as well, which stays above the watermark: rows without a key move it on too
    whole = F.when(F.col("ts").isNotNull(), F.col("user_id").isNotNull() & F.col("event_type").isNotNull()).otherwise(False)
    known = events.select("user_id", "ts", "event_id", "event_type").withWatermark("ts", late).where(whole)
    grouped = known.withColumn("of", F.pmod(F.xxhash64("user_id"), F.lit(groups)))
    return grouped.groupBy("of").transformWithStateInPandas(_Opinions(), "event_id long, user_id long, was string, became string", "Append", "EventTime")


@contextmanager
def rocksdb_state(spark) -> Iterator[None]:
    """Queries that are started within take the RocksDB state store; the session's own setting is as before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def opinion_changes_batch(events: DataFrame) -> DataFrame:
    """The batch twin: the last event of each key by a window."""
    was = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select("event_id", "user_id", was.alias("was"), F.col("event_type").alias("became")).where("was is not null and was <> became")


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """``(day, user_id, n)``; of a stream in append mode all keys of a day come in the batch that closes it."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        out = out.withWatermark("ts", late)
    out = out.groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.to_date("window.start").alias("day"), "user_id", "n")


def capped_sink(write: Callable[[DataFrame, int], None], rank: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps what ``rank`` selects of a batch and hands it on."""
    return lambda batch, epoch: write(rank(batch), epoch)


def upsert_sink(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the newest row of each of a batch's keys goes to the epoch's own part, so the work grows with the batch, a repeated epoch gives the same, and no epoch depends on another's part."""

    def write(batch: DataFrame, epoch: int) -> None:
        state.upsert_replace(batch.limit(0), batch, key, [F.desc(order)]).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def upserted(spark, path: str, key: list[str], order: str) -> DataFrame:
    """What a table of upserts holds: of each key the row of greatest ``order``, whichever epoch brought it, so that late rows never shadow newer ones. ``compacted`` writes it as one part."""
    parts = spark.read.option("basePath", path).parquet(f"{path}/epoch=*")
    w = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("epoch"))
    return parts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "epoch")


def compacted(spark, path: str, key: list[str], order: str, to: str) -> None:
    """The table's present rows as epoch 0 of a new path, for a stream to go on from."""
    upserted(spark, path, key, order).write.mode("overwrite").parquet(f"{to}/epoch=0")


def mature(predictions: DataFrame, prices: DataFrame, wait: str = "3 days") -> DataFrame:
    """Predictions meet the prices of the days after their date: a stream-stream join with two watermarks."""
    p = predictions.withWatermark("evaluate_at", wait)
    q = prices.withWatermark("ts", wait)
    near = (F.col("user_id") == F.col("of_user")) & (F.col("ts") >= F.col("evaluate_at")) & (F.col("ts") <= F.col("evaluate_at") + F.expr("INTERVAL 1 DAY"))
    return p.join(q, near)
