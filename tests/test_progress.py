"""Progress in batch and as a stream, with state and event-time timers between runs."""

import datetime as dt

from pyspark.sql import functions as F

from hostlens.streaming import replay
from hostlens.streaming.progress import CHANGE, progress_changes, progress_stream

SCHEMA = "download_id bigint, seq bigint, done_bytes bigint, total_bytes bigint"
ROWS = [(1, s, s, 200) for s in (1, 2, 3, 4)] + [(2, s, s, -1) for s in (1, 2, 3)]


def test_batch(spark):
    got = sorted((x.download_id, x.seq, x.is_final) for x in progress_changes(spark.createDataFrame(ROWS, SCHEMA)).collect())
    assert got == [(1, 1, False), (1, 2, False), (1, 4, False), (1, 4, True), (2, 3, True)]


def events(spark, rows):
    """(download_id, minute, done, total); seq is the minute."""
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(d, m, done, total, start + dt.timedelta(minutes=m)) for d, m, done, total in rows], SCHEMA + ", at timestamp")


def streamed(spark, tmp_path, batches, **options):
    out = f"file://{tmp_path}/out"
    start = lambda stream, checkpoint: progress_stream(stream, **options).writeStream.outputMode("append").format("parquet").option("path", out)
    replay.replay(spark, [events(spark, b) for b in batches], start)
    return sorted((r.download_id, r.seq, r.pct, r.shown, r.is_final) for r in spark.read.schema(CHANGE + ", shown int").parquet(out).collect())


def test_stream_equals_batch_over_several_runs(spark, tmp_path):
    rows = [(d, m, m * (d + 1), [-1, 100, 0, 1000][d]) for m in range(1, 40) for d in range(4) if (m + d) % 3]
    got = streamed(spark, tmp_path, [rows[:30], rows[30:31], rows[31:], [(None, 100, 0, 0)]], idle="30 minutes")
    want = sorted((r.download_id, r.seq, r.pct, r.shown, r.is_final) for r in progress_changes(events(spark, rows)).collect())
    assert got == want and sum(x[-1] for x in got) == 4


def test_events_out_of_order_within_the_delay(spark, tmp_path):
    rows = [(1, m, m, 100) for m in range(1, 13)]
    got = streamed(spark, tmp_path, [[rows[i] for i in (3, 0, 5)], [rows[i] for i in (1, 2, 7, 4)], [rows[i] for i in (11, 6, 9, 8, 10)], [(None, 100, 0, 0)], [(None, 101, 0, 0)]], idle="30 minutes", delay="10 minutes")
    assert got == [(1, m, m, m, False) for m in range(1, 12)] + [(1, 12, 12, 12, False), (1, 12, 12, 12, True)]


def test_a_final_event_waits_for_the_idle_time_and_a_later_start_is_a_new_download(spark, tmp_path):
    first = [(1, 1, 50, 100)]
    got = streamed(spark, tmp_path, [first, [(2, 20, 1, 100)], [(None, 25, 0, 0)]], idle="30 minutes")
    assert got == [(1, 1, 50, 50, False), (2, 20, 1, 1, False)]
    got = streamed(spark, tmp_path / "again", [first, [(2, 40, 1, 100)], [(1, 50, 50, 100)], [(None, 200, 0, 0)]], idle="30 minutes")
    assert [x for x in got if x[0] == 1] == [(1, 1, 50, 50, False), (1, 1, 50, 50, True), (1, 50, 50, 50, False), (1, 50, 50, 50, True)]


def test_batches_by_order_and_hash_lose_nothing(spark):
    rows = spark.range(101).withColumnRenamed("id", "seq")
    for parts in (replay.by_order(rows, "seq", 3), replay.by_hash(rows, "seq", 3)):
        assert len(parts) == 3 and sorted(r.seq for p in parts for r in p.collect()) == list(range(101))
    assert [p.count() for p in replay.by_order(rows.filter(F.lit(False)), "seq", 3)] == [0]
