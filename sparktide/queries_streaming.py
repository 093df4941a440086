"""Streaming queries: each reads the events table as a stream until nothing is left, and returns what its sink then holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.queries_core import rounded
from sparktide.queries_data import _scratch
from sparktide.sources.ranged import RangedTable, newest_of
from sparktide.sources.views import table
from sparktide.streaming import jobs

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def stream_of(spark, sf_dir: str, files_a_batch: int | None = None) -> DataFrame:
    reader, path = spark.readStream.schema(table(spark, sf_dir, "events").schema), f"{sf_dir}/events.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    folder = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()
    out = reader.parquet(path) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)  # a stream reads folders only
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


#: Files that ``arriving`` lands, the disorder within them, and the time that the rows which end a stream lie after all others.
FILES, DISORDER_HOURS, END_DAYS = 5, 12, 400


def arriving(spark, sf_dir: str, files: int = FILES, late_one_in: int | None = None) -> DataFrame:
    """The events as a stream of several files, one a micro-batch, in an order of arrival that event time doesn't follow.

    A row arrives up to half a day after its time, as the hash of its id says; of ``late_one_in`` rows one comes ten days later still.
    Two last files hold a row without an id, of a key that no event has, long after all others: they move the watermark on, so
    that append mode gives all that was open. (A null key would be filtered out below the watermark by a later join on it.)
    """
    events, path = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), _scratch(spark, "arriving")
    hours = lambda h: F.lit(h * 3_600_000_000)
    h = F.xxhash64("event_id")
    at = F.unix_micros("ts") + F.pmod(h, hours(DISORDER_HOURS))
    if late_one_in:
        at = at + F.when(F.pmod(F.shiftright(h, 8), F.lit(late_one_in)) == 0, hours(240)).otherwise(hours(0))
    first, last, end = events.agg(F.min(at), F.max(at), F.max("ts")).first()
    columns = events.columns
    part = F.least(F.floor((at - F.lit(first)) * files / F.lit(max(1, last - first))), F.lit(files - 1)) if first is not None else F.lit(0)
    for k in range(files):
        events.where(part == k).write.mode("append").parquet(path)
    for _ in range(2):
        ends = {"ts": F.lit(end).cast("timestamp") + F.expr(f"INTERVAL {END_DAYS} DAYS"), "user_id": F.lit(-(2**63))}
        close = spark.range(1).select(*(ends.get(c, F.lit(None)).cast(events.schema[c].dataType).alias(c) for c in columns))
        close.coalesce(1).write.mode("append").parquet(path)
    # one trigger takes what one write has brought, however many files that was
    written = max(1, -(-len(spark.read.parquet(path).inputFiles()) // (files + 2)))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", written).parquet(path)


def drained(spark, stream: DataFrame, mode: str, name: str, progress: list | None = None) -> DataFrame:
    """Run a stream over all that is there; the sink is a folder of the shared one, overwritten by epoch so that a repeated epoch changes nothing. ``progress`` gets what each batch reported."""
    path = _scratch(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    if progress is not None:
        progress += run.recentProgress
    return spark.read.schema(stream.schema).parquet(f"{path}/out/*")


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def k1_stream_ingest(spark, sf_dir):
    """Every event once, though the stream delivers each twice."""
    events = stream_of(spark, sf_dir)
    twice = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return rounded(drained(spark, jobs.ingest(twice, ["event_id"], late="60 days"), "append", "ingest").select("event_id", "user_id", "event_type", "value"))


@query("SELECT user_id, event_type, CAST(ts AS DATE) AS day, round(last(value ORDER BY ts, event_id), 6) AS value FROM events GROUP BY 1, 2, 3")
def k2_stream_daily_bars(spark, sf_dir):
    """Days are given once, when the watermark has closed them; then their state goes."""
    return rounded(drained(spark, jobs.daily_last(arriving(spark, sf_dir)), "append", "daily"))


@query("SELECT user_id, count(*) AS n, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1")
def k4_stream_sessions(spark, sf_dir):
    """Sessions are given once, when the watermark has closed them; then their state goes."""
    out = drained(spark, jobs.sessions(arriving(spark, sf_dir)), "append", "sessions")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("n").alias("events"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS ts FROM events WHERE value <= 5 AND user_id % 3 = 0 GROUP BY 1, 2")
def k5_urgent_alerts(spark, sf_dir):
    """Batch twin of the urgent alert: a watched key's first fall of each day."""
    e = table(spark, sf_dir, "events")
    return jobs.urgent(e, e.select("user_id").where("user_id % 3 = 0").distinct(), 5.0).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE value <= 5 AND user_id % 3 = 0 GROUP BY 1, 2")
def k5_stream_urgent_alerts(spark, sf_dir):
    watched = table(spark, sf_dir, "events").select("user_id").where("user_id % 3 = 0").distinct()
    return drained(spark, jobs.urgent(stream_of(spark, sf_dir), watched, 5.0, late="60 days"), "append", "urgent").select("user_id", "day")


@query("SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, event_type AS became FROM events QUALIFY was IS NOT NULL AND was <> event_type")
def k6_stream_opinion_changes(spark, sf_dir):
    """Changes in event order though the files come in another: rows wait for the watermark."""
    with jobs.rocksdb_state(spark):
        return drained(spark, jobs.opinion_changes(arriving(spark, sf_dir)), "append", "changes")


@query("SELECT day, user_id, rank FROM (SELECT day, user_id, row_number() OVER (PARTITION BY day ORDER BY n DESC, user_id) AS rank FROM (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2)) WHERE rank <= 3")
def k7_capped_notifications(spark, sf_dir):
    """At most three keys a day, the busiest first, selected in foreachBatch when the watermark closes the day."""
    from pyspark.sql import Window

    path = _scratch(spark, "capped")
    w = Window.partitionBy("day").orderBy(F.desc("n"), "user_id")
    sink = jobs.capped_sink(lambda b, epoch: b.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}"), lambda b: b.withColumn("rank", F.row_number().over(w)).where("rank <= 3").drop("n"))
    jobs.daily_counts(arriving(spark, sf_dir)).writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return spark.read.schema("day date, user_id long, rank int").parquet(f"{path}/out/*").select("day", "user_id", "rank")


@query("SELECT user_id, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def k10_stream_upsert(spark, sf_dir):
    """The newest event of each key, by merges in foreachBatch into a table in ranges of keys: a batch rewrites the ranges that it falls into."""
    path = _scratch(spark, "upsert")
    held = RangedTable(spark, f"{path}/table", "user_id")
    newest = newest_of(["user_id"], [F.desc("event_id")])
    merge = lambda batch, epoch: held.merge(batch.where("event_id is not null"), newest, epoch)
    arriving(spark, sf_dir).select("user_id", "event_id", "value").writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    return rounded(held.read())


@query("SELECT user_id, event_type, CAST(ts AS DATE) AS day, round(last(value ORDER BY ts, event_id), 6) AS value FROM events GROUP BY 1, 2, 3")
def k9_stream_late_rows(spark, sf_dir):
    """Daily values when a tenth of the rows comes ten days late: what the watermark would drop goes the batch way, and the value of a day is that of its last event time, whichever way brought it."""
    from pyspark.sql import Window

    path = _scratch(spark, "late")
    write = lambda rows, side, epoch: jobs.daily_latest(rows.where("event_id is not null")).write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}/side={side}")
    router = jobs.late_router(path, "2 DAYS", write)
    arriving(spark, sf_dir, late_one_in=10).writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(router).start().awaitTermination()
    held = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out/epoch=*/side=*")
    w = Window.partitionBy("user_id", "event_type", "day").orderBy(F.desc("ts"), F.desc("event_id"))
    return rounded(held.withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_type", "day", "value"))


@query("""SELECT user_id, window_start, n, round(total, 4) AS total FROM (SELECT user_id, w AS window_start, count(*) AS n, sum(value) AS total FROM (SELECT user_id, value, unnest([time_bucket(INTERVAL '15 minutes', ts) - i * INTERVAL '15 minutes' for i in [0, 1, 2, 3]]) AS w FROM events) GROUP BY 1, 2)
 JOIN (SELECT user_id, avg(total) AS usual FROM (SELECT user_id, w, sum(value) AS total FROM (SELECT user_id, value, unnest([time_bucket(INTERVAL '15 minutes', ts) - i * INTERVAL '15 minutes' for i in [0, 1, 2, 3]]) AS w FROM events) GROUP BY 1, 2) GROUP BY 1) USING (user_id) WHERE total >= 2 * usual + 1e-9""")
def k3_stream_unusual_activity(spark, sf_dir):
    """Sliding hours against a static baseline: a stream-static join."""
    usual = jobs.usual_activity(table(spark, sf_dir, "events"))
    out = drained(spark, jobs.unusual_activity(arriving(spark, sf_dir), usual), "append", "unusual")
    return rounded(out.select("user_id", "window_start", "n", "total"), 4)


@query("SELECT p.event_id, count(*) AS n_after FROM events p JOIN events q ON q.user_id = p.user_id AND q.ts >= p.ts + INTERVAL '10 days' AND q.ts <= p.ts + INTERVAL '11 days' WHERE p.event_type = 'purchase' GROUP BY 1")
def k8_stream_maturation(spark, sf_dir):
    """Claims meet the events of the day after their date: a stream-stream join within a time range."""
    events = stream_of(spark, sf_dir)
    claims = events.where("event_type = 'purchase'").select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("evaluate_at"))
    prices = events.select(F.col("user_id").alias("of_user"), "ts", F.col("event_id").alias("of_event"))
    return drained(spark, jobs.mature(claims, prices, wait="60 days"), "append", "mature").groupBy("event_id").agg(F.count("*").alias("n_after"))
