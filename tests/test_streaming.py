"""Streams over small landed files, against their batch forms."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodgetrail.catalog.streams import to_batch
from lodgetrail.operators import limits
from lodgetrail.operators.limits import Admission
from lodgetrail.plans.scan import TrackingStore
from lodgetrail.session import new_work_dir
from lodgetrail.streaming import events, quota, scans

START = datetime(2024, 1, 1)


@pytest.fixture
def landed(spark, tmp_path):
    """Two event files; the second repeats ten deliveries of the first."""
    rng = random.Random(1)
    rows = [
        (i, START + timedelta(seconds=rng.randint(0, 5 * 86400)), rng.choice([1, 1, 2, 3, 4]), rng.choice(["view", "click"]), 1.0, "{}")
        for i in range(400)
    ]
    rows.sort(key=lambda r: r[1])
    for n, part in enumerate((rows[:200], rows[200:] + rows[190:200])):
        df = spark.createDataFrame(part, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"events-{n}.parquet"))
    return str(tmp_path), rows


def read(spark, folder, files=None):
    return events.read_events(spark, f"{folder}/events-*.parquet", "*.parquet", files)


def test_each_event_once(spark, landed):
    folder, rows = landed
    out = events.drain(events.delivered_once(read(spark, folder, 1), "10 days").select("event_id"), "once")
    assert sorted(r.event_id for r in out.collect()) == [r[0] for r in sorted(rows)]


def test_daily_changes_count_listings_exactly(spark, landed):
    folder, rows = landed
    out = events.drain(events.daily_changes(read(spark, folder)), "daily").collect()
    mark = rows[-1][1] - timedelta(hours=1)
    want = {}
    for i, t, u, k, _, _ in rows:
        day = (t + timedelta(hours=7)).replace(hour=0, minute=0, second=0) - timedelta(hours=7)
        if day + timedelta(days=1) <= mark:
            want.setdefault((day, k), set()).add(u)
    assert {(r.day.start, r.event_type): r.listings for r in out} == {k: len(v) for k, v in want.items()}


def test_quota_keeps_its_state_between_batches(spark, landed, tmp_path):
    folder, rows = landed
    requests = read(spark, folder, 1).select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), "ts")
    out = quota.admitted(requests, str(tmp_path / "quota"), str(tmp_path / "checkpoint"), limit=5, window_seconds=6 * 3600, delay_seconds=6 * 24 * 3600)
    # The second file repeats ten requests of the first: they come late and are judged by what was admitted before them.
    past, want = [], {}
    for part in (rows[:200], rows[200:] + rows[190:200]):
        gates, newly = {}, []
        todo = sorted([(t, -1, u) for t, u in past] + [(r[1], r[0], r[2]) for r in part])
        for t, i, u in todo:
            us = int((t - START) / timedelta(microseconds=1))
            gate = gates.setdefault(u, Admission(5, 6 * 3600 * 1_000_000))
            if i < 0:
                gate.accepted.append(us)
                continue
            wait = gate.offer(us)
            want.setdefault(i, []).append(wait)
            if wait is None:
                newly.append((t, u))
        past += newly
    got = {}
    for r in out.collect():
        got.setdefault(r.request_id, []).append(r.retry_after)
    key = lambda waits: sorted(-1 if w is None else w for w in waits)
    assert {i: key(w) for i, w in got.items()} == {i: key(w) for i, w in want.items()}
    assert any(w[0] is not None for w in want.values())


def test_a_replayed_batch_writes_the_same(spark, tmp_path):
    schema = "client bigint, request_id bigint, ts timestamp"
    parts = [[(k % 2, 100 * n + k, START + timedelta(minutes=40 * n + k)) for k in range(40)] for n in range(3)]
    judge = quota.judge_batches(str(tmp_path / "q"), limit=3, window_seconds=600)
    plain = lambda: sorted(map(str, quota.verdicts(spark, str(tmp_path / "q")).collect()))
    for n, part in enumerate(parts):
        judge(spark.createDataFrame(part, schema), n)
    once = plain()
    for n in (1, 2):
        judge(spark.createDataFrame(parts[n], schema), n)
    assert plain() == once
    whole = limits.admit_requests(spark.createDataFrame([r for p in parts for r in p], schema), 3, 600).collect()
    assert once == sorted(map(str, whole))
    # What goes on to the next batch is what the window holds, not what came.
    assert spark.read.parquet(str(tmp_path / "q/held/2")).count() <= 2 * 3 * 2


def test_ingestion_is_one_scan_per_batch_and_replay_safe(spark, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "cp")
    store = TrackingStore(spark, str(tmp_path / "store"), buckets=2)
    schema = "event_id bigint, ts timestamp, slug bigint, scan_no bigint, price bigint, page_url string"

    def land(*rows):
        spark.createDataFrame([(i, t, s, 1, p, "p") for i, t, s, p in rows], schema).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        scans.start_ingestion(stream, store, to_batch, "ts", checkpoint, complete=True).awaitTermination()

    land((1, START, 7, 100), (2, START, 8, 100), (3, START + timedelta(seconds=1), 7, 900))
    land((4, START + timedelta(days=1), 7, 300))
    log = store.scan_log().orderBy("scan_id").collect()
    assert [(r.new_count, r.price_changed_count, r.batch_key) for r in log] == [(2, 0, f"{checkpoint}-0"), (0, 1, f"{checkpoint}-1")]
    again = scans.merge_batches(store, to_batch, "ts", stream=checkpoint)
    again(spark.read.schema(schema).parquet(landing), 1)
    assert store.version() == 2
    assert {r.slug: r.missing_scan_count for r in store.state().collect()} == {"7": 0, "8": 1}


def test_work_folder_comes_from_the_session(spark):
    assert new_work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_quota_is_right_past_one_arrow_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(1 if i % 5 else 2, i, START + timedelta(seconds=rng.randrange(4000))) for i in range(300)]
    schema = "client bigint, request_id bigint, ts timestamp"
    landing = str(tmp_path / "landing")
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(landing)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        stream = spark.readStream.schema(schema).parquet(landing)
        got = quota.admitted(stream, str(tmp_path / "q"), str(tmp_path / "c"), limit=4, window_seconds=300).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = limits.admit_requests(spark.createDataFrame(rows, schema), 4, 300).collect()
    key = lambda rs: sorted((r.client, r.request_id, r.ts, r.admitted, r.retry_after) for r in rs)
    assert [str(x) for x in key(got)] == [str(x) for x in key(want)]


def test_work_folder_must_be_shared_off_one_machine():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        new_work_dir(Session(), "x")


def test_landing_a_part_reads_its_folder_only(spark):
    from lodgetrail.catalog import streams

    rows = spark.createDataFrame([(k, k % 4 if k else None) for k in range(12)], "id int, week int").repartition(3)
    parts = streams.by_part(rows, "week")
    assert sorted(map(tuple, parts.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    one = parts.filter("week = 2")
    assert sorted(r.id for r in one.collect()) == [2, 6, 10]
    assert "PartitionFilters: [isnotnull(week" in one._jdf.queryExecution().executedPlan().toString()
