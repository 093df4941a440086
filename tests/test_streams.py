"""Streams over several files whose order isn't that of event time: bounded state, event order, late rows."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparktide import queries_streaming as Q
from sparktide.streaming import jobs

SF = "/root/testdata/sf0.001"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def land(spark, path, batches):
    """One file for each batch, and two that close the stream."""
    for rows in [*batches, *[[(None, datetime(2026, 1, 1), None, None, None, None)]] * 2]:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def rows_of(progress):
    return [sum(o["numRowsTotal"] for o in json.loads(p.json)["stateOperators"]) for p in progress]


def test_state_of_closed_days_goes(spark):
    for job in (jobs.daily_last, jobs.sliding_activity, jobs.sessions, jobs.daily_counts):
        progress = []
        out = Q.drained(spark, job(Q.arriving(spark, SF, files=10)), "append", "bounded", progress)
        kept, given = rows_of(progress), out.count()
        assert len(kept) >= 10 and given == job(spark.read.parquet(f"{SF}/events.parquet")).count()
        assert max(kept) < 0.45 * given, (job.__name__, kept, given)  # a tenth of the span and the watermark's delay, not all of it


def test_opinion_changes_follow_event_time_over_batches(spark, tmp_path):
    rng, rows = random.Random(1), []
    for k in range(120):
        rows.append((k, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(0, 600)), k % 3, rng.choice("abc"), 1.0, None))
    rows += [(900, rows[0][1], rows[0][2], "b", 1.0, None), (901, datetime(2024, 1, 2), 7, None, 1.0, None), (902, None, 7, "a", 1.0, None), (903, datetime(2024, 1, 1), None, "a", 1.0, None)]
    rng.shuffle(rows)
    stream = land(spark, str(tmp_path / "in"), [rows[i::4] for i in range(4)])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with jobs.rocksdb_state(spark):
        got = Q.drained(spark, jobs.opinion_changes(stream), "append", "changes").collect()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    known = spark.createDataFrame([r for r in rows if None not in r[1:4]], EVENTS)
    want = jobs.opinion_changes_batch(known).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 30


def test_rows_behind_the_watermark_go_the_late_way(spark, tmp_path):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    batches = [[(1, at(1), 1, "x", 1.0, None), (2, at(10), 1, "x", 2.0, None)], [(3, at(7), 1, "x", 3.0, None), (4, at(9), 1, "x", 4.0, None), (5, at(20), 1, "x", 5.0, None)], [(6, at(10, 5), 1, "x", 6.0, None), (7, None, 1, "x", 7.0, None), (8, at(19), 1, "x", 8.0, None)]]
    seen = {}

    def write(rows, side, epoch):
        seen[epoch, side] = sorted(r["event_id"] for r in rows.where("user_id is not null").collect())

    router = jobs.late_router(str(tmp_path / "m"), "2 DAYS", write)
    stream = land(spark, str(tmp_path / "in"), batches)
    stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(router).start().awaitTermination()
    assert [seen[e, "live"] for e in range(3)] == [[1, 2], [4, 5], [8]] and [seen[e, "late"] for e in range(3)] == [[], [3], [6, 7]]
    again = spark.createDataFrame(batches[1], EVENTS)
    before = dict(seen)
    router(again, 1)  # a repeated epoch finds the watermark that it found before
    assert seen == before


def test_arriving_rows_are_all_rows_and_not_in_order(spark):
    stream = Q.arriving(spark, SF, files=4, late_one_in=5)
    batches = []
    stream.writeStream.trigger(availableNow=True).foreachBatch(lambda b, e: batches.append([(r["event_id"], r["ts"]) for r in b.where("event_id is not null").collect()])).start().awaitTermination()
    every = [x for b in batches for x in b]
    assert sorted(i for i, _ in every) == [r["event_id"] for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect()]
    assert len([b for b in batches if b]) == 4 and max(t for _, t in batches[0]) > min(t for _, t in batches[1]) + timedelta(days=5)


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("k2_stream_daily_bars", "k7_capped_notifications", "k9_stream_late_rows"):
        assert Q.QUERIES[name][0](spark, str(tmp_path)).where(F.lit(True)).count() == 0


def test_opinion_changes_share_state_among_keys(spark, tmp_path):
    """Two states for forty keys give each key's own changes."""
    rng = random.Random(2)
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(0, 600)), rng.randrange(40), rng.choice("ab"), 1.0, None) for k in range(300)]
    stream = land(spark, str(tmp_path / "in"), [rows[i::2] for i in range(2)])
    with jobs.rocksdb_state(spark):
        progress = []
        got = Q.drained(spark, jobs.opinion_changes(stream, groups=2), "append", "changes", progress).collect()
    want = jobs.opinion_changes_batch(spark.createDataFrame(rows, EVENTS)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 30
