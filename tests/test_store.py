"""The tracking store: what a scan reads and writes, and that deltas change no result."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_merge import batch

from lodgetrail import schemas
from lodgetrail.functions import clock
from lodgetrail.operators import images, location, merge
from lodgetrail.plans import counters
from lodgetrail.plans.runs import FAN_IN, RunTable, run_id
from lodgetrail.plans.scan import TrackingStore


def at(n):
    return f"2024-01-{n + 1:02} 06:00:00"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def plain(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def scans(seed, n, listings, share):
    """Batches as dicts; a scan sees about ``share`` of the listings, with changed prices and places."""
    rng = random.Random(seed)
    for k in range(n):
        seen = [i for i in range(listings) if rng.random() < share]
        yield [{
            "slug": f"l{i}", "price_monthly_min": rng.choice([None, 5000, 5000, 6000]), "province": rng.choice(["Bangkok", "Phuket", "", None]),
            "district": rng.choice(["Mueang", "mueang", None]), "has_monthly_contract": rng.choice(["true", "unknown"]), "from_structured_list": True,
            "contract_3_month_raw": rng.choice([None, "-", "9,000 THB/month"]), "name": "" if rng.random() < 0.1 else f"Name {i}",
            "images": [f"u{i}-{j}" for j in range(rng.randrange(3))],
        } for i in seen or [0]], k % 5 != 3


def naive(spark, batches):
    """States, history and image rows by merging the whole state at every scan."""
    state = spark.createDataFrame([], schemas.STATE_SCHEMA)
    kept, history = [], []
    stored = spark.createDataFrame([], schemas.IMAGE_SCHEMA)
    for k, (rows, complete) in enumerate(batches):
        b = batch(spark, *rows)
        up = merge.upsert(state, b, clock.instant(at(k)), carry=("images", "thumbnail_url"))
        d = merge.decide(state, b, clock.instant(at(k)), complete=complete)
        history += merge.history_rows(d, clock.instant(at(k))).collect()
        new = images.new_image_rows(up.filter("was_applied").select("slug", "images", "thumbnail_url", "was_known"), stored)
        stored = spark.createDataFrame(stored.collect() + new.collect(), schemas.IMAGE_SCHEMA)
        state = spark.createDataFrame(merge.new_state(d).collect(), schemas.STATE_SCHEMA)
        kept.append(state)
    return kept, history, stored


@pytest.mark.parametrize("share", (0.75, 0.3))
def test_deltas_equal_whole_merges(spark, tmp_path, share):
    batches = list(scans(1, 7, 24, share))
    store = TrackingStore(spark, str(tmp_path / "s"), buckets=2)
    states, history, stored = naive(spark, batches)
    for k, (rows, complete) in enumerate(batches):
        store.apply_scan(batch(spark, *rows), at(k), complete=complete)
    assert plain(store.state()) == plain(states[-1]) and plain(store.state(3)) == plain(states[2])
    assert plain(store.history().drop("change_date")) == sorted(tuple(str(v) for v in r) for r in history)
    assert plain(store.images()) == plain(stored)
    # Counters folded from differences, against counting the stored listings.
    as_of = clock.instant("2024-01-06 12:00:00")
    tally, state = store.tally(), store.state()
    assert plain(counters.public_from_tally(tally, as_of)) == plain(counters.public_counters(state, as_of))
    assert plain(counters.provinces_from_tally(tally)) == plain(counters.by_province(state))
    assert plain(counters.facets_from_tally(tally)) == plain(location.city_facets(state))
    assert "/state" not in plan(tally)


def many(spark, ids, price):
    df = spark.range(*ids).select(
        F.concat(F.lit("listing-"), "id").alias("slug"), F.concat(F.lit("Name "), "id").alias("name"), F.concat(F.lit("u/"), "id").alias("url"),
        F.sha2(F.col("id").cast("string"), 256).alias("address"), F.lit(price).cast("bigint").alias("price_monthly_min"),
        F.lit("unknown").alias("has_monthly_contract"), F.lit(False).alias("from_structured_list"))
    return merge.invalid_rows(schemas.conform(df, schemas.FULL_SCHEMA))


def test_a_scan_writes_what_it_saw(spark, tmp_path):
    store = TrackingStore(spark, str(tmp_path / "s"), buckets=2)
    store.apply_scan(many(spark, (0, 20_000), 5000), at(0))
    base = size(tmp_path / "s/state")
    store.apply_scan(many(spark, (0, 200), 6000), at(1), complete=False)
    assert size(tmp_path / "s/state") - base < 0.03 * base
    assert store.state().filter("price_monthly_min = 6000").count() == 200 and store.state().count() == 20_000
    # Three whole scans without the last listings: they go, and no unseen listing was rewritten before.
    for n in (2, 3):
        store.apply_scan(many(spark, (0, 19_900), 6000), at(n))
    assert {(r.missing_scan_count, r.status) for r in store.state().filter("missing_scan_count > 0").collect()} == {(2, "active")}
    before = size(tmp_path / "s/state")
    out = store.apply_scan(many(spark, (0, 19_900), 6000), at(4))
    assert out.counters["removed_count"] == 100 and store.state().filter("status = 'removed'").count() == 100
    assert size(tmp_path / "s/state") > before
    store.drop_old_versions(keep=1)
    assert store.state().count() == 20_000 and size(tmp_path / "s/state") < 1.5 * base


def test_stored_rows_stay_in_their_buckets(spark, tmp_path):
    store = TrackingStore(spark, str(tmp_path / "s"), buckets=4)
    for n in range(3):
        store.apply_scan(many(spark, (0, 300 if n == 0 else 20), 5000 + n), at(n), complete=False)
    assert len(store._version()["runs"]["state"]) == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(store.state())
        slugs = many(spark, (0, 9), 1).select("slug").distinct()
        touched = plan(store._touched(store._version(), slugs, 3))
        # Only the batch's slugs move.
        assert touched.count("Exchange hashpartitioning") == touched.count("Exchange hashpartitioning(slug") and "Range (0, 9" in touched
        for part in touched.split("Exchange hashpartitioning")[1:]:
            assert "FileScan" not in part.split(":- ")[0].split("BroadcastExchange")[0] or "Range (0, 9" in part
        stored_images = store._images.read(store._version()["runs"]["images"]).join(slugs.hint("shuffle_hash"), "slug", "left_semi")
        text = plan(stored_images)
        assert text.count("Exchange") <= 2 and "Bucketed: true" in text or "LocalTableScan" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_runs_become_fewer_and_lookups_open_one_bucket(spark, tmp_path):
    schema = schemas.HISTORY_SCHEMA
    table = RunTable(spark, str(tmp_path / "h"), schema, 4, order=("changed_at",))
    runs, n = [], 0
    for version in range(1, FAN_IN * 2 + 2):
        rows = spark.range(n, n + 10).selectExpr(
            "concat('s', id % 7) slug", "timestamp_seconds(id) changed_at", "'NEW' change_type", "CAST(NULL AS STRING) field_name",
            "CAST(NULL AS STRING) old_value", "CAST(id AS STRING) new_value")
        runs = table.appended(runs, version, rows)
        n += 10
    assert len(runs) == 3 and run_id(FAN_IN + 1, 1) in runs
    all_rows = table.read(runs)
    assert sorted(int(r.new_value) for r in all_rows.collect()) == list(range(n))
    one = all_rows.filter("slug = 's3'")
    assert one.count() == len([i for i in range(n) if i % 7 == 3])
    assert "Exchange" not in plan(one)
    files = [f for f in one.inputFiles()]
    scan = one._jdf.queryExecution().executedPlan()
    read = spark.sparkContext._jvm.org.apache.spark.sql.execution.SparkPlan  # noqa: F841
    assert "EqualTo(slug,s3)" in scan.toString() and len(files) >= 3
    assert one.select(F.input_file_name().alias("f")).distinct().count() <= len(runs)


def test_failed_scans_leave_no_trace(spark, tmp_path):
    store = TrackingStore(spark, str(tmp_path / "s"), buckets=2)
    store.apply_scan(many(spark, (0, 50), 5000), at(0))
    broken = many(spark, (0, 5), 1).withColumn("name", F.raise_error(F.lit("boom")).cast("string"))
    for n in (1, 2):
        with pytest.raises(Exception, match="boom"):
            store.apply_scan(broken, at(n))
    assert store.version() == 1 and {r.price_monthly_min for r in store.state().collect()} == {5000}
    store.apply_scan(many(spark, (0, 5), 7000), at(3), complete=False)
    again = TrackingStore(spark, str(tmp_path / "s"), buckets=2)
    assert again.version() == 2 and again.state().filter("price_monthly_min = 7000").count() == 5
    assert again.state(1).filter("price_monthly_min = 7000").count() == 0


def test_seeded_counters(spark, tmp_path):
    store = TrackingStore(spark, str(tmp_path / "s"), buckets=2)
    state = schemas.conform(many(spark, (0, 40), 5000).withColumns({
        "status": F.when(F.col("slug").endswith("1"), "removed").otherwise("active"), "missing_scan_count": F.lit(2), "first_seen_at": clock.instant(at(0))}), schemas.STATE_SCHEMA)
    store.seed(state)
    assert plain(store.state()) == plain(state)
    with pytest.raises(ValueError):
        store.seed(state)
    out = store.apply_scan(many(spark, (0, 38), 5000), at(1))
    assert out.counters["removed_count"] == 2
    as_of = clock.instant(at(1))
    assert plain(counters.public_from_tally(store.tally(), as_of)) == plain(counters.public_counters(store.state(), as_of))


def test_indexes_belong_to_a_version(spark, tmp_path):
    from lodgetrail.plans import serving

    store = TrackingStore(spark, str(tmp_path / "s"), buckets=2)
    located = many(spark, (0, 60), 5000).withColumns({"latitude": F.lit(10.0) + F.length("slug"), "longitude": F.lit(100.0), "images": F.array(F.lit("x"))})
    store.apply_scan(located, at(0))
    order = [F.col("price_monthly_min").desc_nulls_last(), F.col("slug").asc()]
    first = store.rank_index("dearest", order, rows_per_range=20)
    assert [r.slug for r in first.page(3, 30).collect()] == sorted(f"listing-{i}" for i in range(60))[30:33]
    store.apply_scan(many(spark, (7, 8), 9000), at(1), complete=False)
    assert store.rank_index("dearest", order, rows_per_range=20).page(1).first().slug == "listing-7"
    assert store.rank_index("dearest", order, rows_per_range=20).page(1).first().price_monthly_min == 9000
    assert store.map_index(20).viewport(18.5, 19.5, 99, 101).count() == 10 and store.map_index(20).viewport(0, 90, 0, 180).count() == 60
    ids = store.state().withColumn("id", F.regexp_extract("slug", r"(\d+)", 1).cast("long"))
    from lodgetrail.plans.paging import RankIndex

    index = RankIndex.build(ids, serving.newest_first(), str(tmp_path / "rank"), rows_per_range=20)
    images = store.images().select(F.regexp_extract("slug", r"(\d+)", 1).cast("long").alias("listing_id"), "image_url", "position", "excluded", F.lit(1).alias("image_id"))
    page = serving.indexed_page(index, images, True, "k", limit=5, offset=50, status="active").collect()
    assert sorted(r.id for r in page) == [5, 6, 7, 8, 9] and {r.thumbnail for r in page} == {"x"}
    after = serving.indexed_page(index, images, True, "k", limit=5, after=55).collect()
    assert sorted(r.id for r in after) == [0, 1, 2, 3, 4]


def test_detail_pages_are_dealt_over_all_cores(spark):
    """Pages read in one file are parsed in more than one task, each page once, repeated ones included."""
    from lodgetrail.plans.scan import Site, full_batch
    from lodgetrail import schemas

    raw = spark.createDataFrame([], schemas.RAW_SCHEMA)
    pages = spark.createDataFrame([(f"https://x.example/en/{k % 5}", "<p>Listing no : 7</p>") for k in range(10)], "url string, html string").coalesce(1)
    plan = full_batch(raw, pages, Site("https://x.example", "https://cdn.example"))._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {3 * spark.sparkContext.defaultParallelism}, true" in plan
