"""T: streaming. Each query drains a stream over the landed events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgetrail import adapters, schemas
from lodgetrail.catalog.registry import query
from lodgetrail.catalog.twins import OBS, QUOTA
from lodgetrail.functions import clock
from lodgetrail.operators import collect, merge
from lodgetrail.plans.scan import TrackingStore
from lodgetrail.session import new_work_dir
from lodgetrail.streaming import events, quota, scans

_WEEK = 7 * 24 * 3600


def to_batch(landed):
    """Landed events to one full row per slug: the first of the batch."""
    firsts = collect.first_occurrence(landed, ["slug"], ["ts", "event_id"])
    slug = F.col("slug").cast("string")
    rows = firsts.select(
        slug.alias("slug"), F.concat(F.lit("Listing "), slug).alias("name"),
        F.concat(F.lit(f"{adapters.SITE}/en/"), slug).alias("url"),
        F.col("price").alias("price_monthly_min"), F.col("price").alias("price_monthly_max"),
        F.lit("unknown").alias("has_monthly_contract"), F.lit(False).alias("from_structured_list"))
    return merge.invalid_rows(schemas.conform(rows, schemas.FULL_SCHEMA))


def by_part(rows, part):
    """The rows as a table with a folder per ``part``: landing one part doesn't read the others."""
    path = new_work_dir(rows.sparkSession, f"by-{part}")
    rows.write.partitionBy(part).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@adapters.remembered
def ingest_weeks(spark, sf) -> TrackingStore:
    """Weeks of events land one after the other; each is one micro-batch and one scan."""
    week = F.floor((F.unix_seconds("ts") - F.unix_seconds(clock.instant("2024-01-01 00:00:00"))) / _WEEK)
    obs = by_part(adapters.observations(spark, sf).select("event_id", "ts", "slug", "price", week.cast("int").alias("week")), "week")
    landing, checkpoint = new_work_dir(spark, "landing"), new_work_dir(spark, "ingest")
    store = TrackingStore(spark, new_work_dir(spark, "store"), buckets=8)
    for n in sorted(r.week for r in obs.select("week").distinct().collect()):  # a row per week
        obs.filter(F.col("week") == n).write.mode("append").parquet(landing)
        landed = spark.readStream.schema(obs.schema).parquet(landing)
        scans.start_ingestion(landed, store, to_batch, "ts", checkpoint, complete=True).awaitTermination()
    return store


_WEEKLY = OBS + f""",
weekly AS (SELECT slug, (epoch_us(ts) // 1000000 - epoch_us(TIMESTAMP '2024-01-01') // 1000000) // {_WEEK} AS week, ts, event_id, price FROM obs),
numbered AS (SELECT * REPLACE (dense_rank() OVER (ORDER BY week) - 1 AS week) FROM weekly),
firsts AS (SELECT slug, week, price FROM numbered QUALIFY row_number() OVER (PARTITION BY slug, week ORDER BY ts, event_id) = 1),
steps AS (SELECT *, lag(price) OVER (PARTITION BY slug ORDER BY week) AS old_price, lag(week) OVER (PARTITION BY slug ORDER BY week) AS old_week FROM firsts)"""


@query("T1_scan_ingestion", f"""
WITH {_WEEKLY}
SELECT week + 1 AS scan_id, count(*) FILTER (old_week IS NULL) AS new_count, count(*) FILTER (old_week IS NOT NULL AND price <> old_price) AS price_changed_count, count(*) AS seen
FROM steps GROUP BY week
""")
def t1(spark, sf):
    return ingest_weeks(spark, sf).scan_log().select("scan_id", "new_count", "price_changed_count", "seen")


@query("T2_event_dedup", "SELECT event_type, count(*) AS events FROM events GROUP BY event_type")
def t2(spark, sf):
    once = events.delivered_once(events.read_events(spark, sf))
    out = events.drain(once.select("event_id", "event_type"), "dedup")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("T3_daily_changes", """
WITH d AS (SELECT date_trunc('day', ts + INTERVAL 7 HOUR) AS local_day, event_type, user_id FROM events),
closed AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT strftime(local_day, '%Y-%m-%d') AS local_day, event_type, count(DISTINCT user_id) AS listings, count(*) AS rows
FROM d, closed WHERE local_day + INTERVAL 17 HOUR <= mark GROUP BY ALL
""")
def t3(spark, sf):
    out = events.drain(events.daily_changes(events.read_events(spark, sf)), "daily")
    return out.select(
        F.date_format(F.from_utc_timestamp("day.start", "Asia/Bangkok"), "yyyy-MM-dd").alias("local_day"),
        "event_type", "listings", F.col("rows").cast("bigint").alias("rows"))


@query("T4_request_quota", QUOTA)
def t4(spark, sf):
    """Two weeks of requests at a time; what one micro-batch admitted counts in the next."""
    requests = adapters.requests(spark, sf).drop("event_type").withColumn("part", F.floor(F.unix_seconds("ts") / (2 * _WEEK)).cast("int"))
    requests = by_part(requests, "part")
    landing, checkpoint, root = (new_work_dir(spark, f"quota-{x}") for x in ("landing", "checkpoint", "state"))
    for n in sorted(r.part for r in requests.select("part").distinct().collect()):  # a row per fortnight
        requests.filter(F.col("part") == n).drop("part").write.mode("append").parquet(landing)
        landed = spark.readStream.schema(requests.drop("part").schema).parquet(landing)
        found = quota.admitted(landed, root, checkpoint, limit=3, window_seconds=24 * 3600)
    return found.select("client", "request_id", "admitted", "retry_after")


@query("T5_sliding_load", """
WITH w AS (SELECT user_id, unnest([to_timestamp((epoch_us(ts) // 3600000000 - i) * 3600)::TIMESTAMP FOR i IN range(0, 6)]) AS win FROM events),
closed AS (SELECT max(ts) - INTERVAL 1 MINUTE AS mark FROM events)
SELECT requests, count(*) AS windows FROM (
  SELECT user_id, win, count(*) AS requests FROM w, closed WHERE win + INTERVAL 6 HOUR <= mark GROUP BY ALL) GROUP BY requests
""")
def t5(spark, sf):
    load = events.sliding_load(events.read_events(spark, sf), "6 hours", "1 hour")
    return events.drain(load, "load").groupBy("requests").agg(F.count(F.lit(1)).alias("windows"))


@query("T6_miss_streak_removal", f"""
WITH {_WEEKLY}, final AS (SELECT max(week) AS w FROM firsts)
SELECT slug::VARCHAR AS slug, max(week) + 1 AS last_scan, any_value(w) - max(week) AS missing_scan_count, CASE WHEN any_value(w) - max(week) >= 3 THEN 'removed' ELSE 'active' END AS status
FROM firsts, final GROUP BY slug
""")
def t6(spark, sf):
    store = ingest_weeks(spark, sf)
    seen = store.scan_log().select("scan_id", F.col("started_at").cast("timestamp").alias("at"))
    state = store.state().select("slug", "status", "missing_scan_count", "last_seen_at")
    return state.join(seen, F.col("last_seen_at") == F.col("at")).select(
        "slug", F.col("scan_id").alias("last_scan"), "missing_scan_count", "status")
