"""Tracker behaviours: what one scan does to what is stored."""

import pytest
from pyspark.sql import functions as F

from lodgetrail import schemas
from lodgetrail.functions import clock
from lodgetrail.operators import merge
from lodgetrail.plans.scan import TrackingStore

AT = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00", "2024-01-04 00:00:00", "2024-01-05 00:00:00"]


def batch(spark, *rows):
    """Full rows from dicts; only the given fields are set."""
    base = {"has_monthly_contract": "unknown", "from_structured_list": False, "has_structured_data": False, "page_gone": False,
            "is_verified": False, "has_promotion": False}
    full = [{**base, "name": f"Name {r['slug']}", "url": f"u/{r['slug']}", **r} for r in rows]
    names = schemas.FULL_SCHEMA.names
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schemas.FULL_SCHEMA)
    return merge.invalid_rows(df)


def fold(spark, *batches, **options):
    """Merge batches one after the other; returns the last decision and the state."""
    state = spark.createDataFrame([], schemas.STATE_SCHEMA)
    decision = None
    for b, at in zip(batches, AT):
        decision = merge.decide(state, b, clock.instant(at), **options)
        state = spark.createDataFrame(merge.new_state(decision).collect(), schemas.STATE_SCHEMA)
    return decision, state


def history(decision):
    rows = merge.history_rows(decision, clock.instant(AT[0])).collect()
    return sorted((r.slug, r.change_type, r.field_name, r.old_value, r.new_value) for r in rows)


def one(state, slug="a"):
    return state.filter(F.col("slug") == slug).first()


def test_unchanged_scan_is_silent(spark):
    row = {"slug": "a", "price_monthly_min": 5000, "amenities": ["Fan"]}
    d, _ = fold(spark, batch(spark, row), batch(spark, row))
    assert history(d) == [] and d.first().change_class == "UNCHANGED"


def test_price_and_content_change_together(spark):
    d, _ = fold(
        spark, batch(spark, {"slug": "a", "price_monthly_min": 5000, "name": "Old"}),
        batch(spark, {"slug": "a", "price_monthly_min": 6000, "price_monthly_max": 7000, "name": "New"}))
    rows = history(d)
    assert [r[1:4] for r in rows] == [
        ("PRICE_CHANGED", "price_monthly_max", "None"), ("PRICE_CHANGED", "price_monthly_min", "5000"), ("UPDATED", "content_hash", rows[2][3])]
    assert d.first().change_class == "PRICE_CHANGED"


def test_list_only_scan_keeps_detail_fields(spark):
    first = {"slug": "a", "phone": "081", "deposit": "1 month", "has_structured_data": True, "amenities": ["Pool"], "address": "x",
             "latitude": 1.0, "longitude": 2.0, "source_id": "9"}
    _, state = fold(spark, batch(spark, first), batch(spark, {"slug": "a", "address": "", "latitude": 5.0}))
    row = one(state)
    assert (row.phone, row.deposit, row.amenities, row.address, row.latitude, row.source_id) == ("081", "1 month", ["Pool"], "x", 1.0, "9")
    assert str(row.detail_scraped_at) == AT[0] and str(row.last_seen_at) == AT[1]


def test_structured_detail_clears_stale_fields(spark):
    _, state = fold(
        spark, batch(spark, {"slug": "a", "line_id": "Unavailable", "deposit": "junk"}),
        batch(spark, {"slug": "a", "phone": "081", "has_structured_data": True}))
    assert (one(state).line_id, one(state).deposit, one(state).phone) == (None, None, "081")


def test_location_card_keeps_contracts(spark):
    known = {"slug": "a", "contract_monthly_raw": "5,000 THB/month", "contract_monthly_min": 5000, "has_monthly_contract": "true",
             "from_structured_list": True, "price_monthly_min": 4000}
    d, state = fold(spark, batch(spark, known), batch(spark, {"slug": "a", "price_monthly_min": 4500}))
    assert one(state).contract_monthly_min == 5000 and one(state).has_monthly_contract == "true"
    assert [r[1:] for r in history(d) if r[1] == "PRICE_CHANGED"] == [("PRICE_CHANGED", "price_monthly_min", "4000", "4500")]


def test_authoritative_card_may_remove_a_contract(spark):
    known = {"slug": "a", "contract_monthly_min": 5000, "has_monthly_contract": "true", "from_structured_list": True}
    d, state = fold(spark, batch(spark, known), batch(spark, {"slug": "a", "has_monthly_contract": "false", "from_structured_list": True}))
    assert one(state).contract_monthly_min is None and one(state).has_monthly_contract == "false"
    assert ("a", "PRICE_CHANGED", "contract_monthly_min", "5000", "None") in history(d)


def test_removal_after_three_misses_and_return(spark):
    both = batch(spark, {"slug": "a"}, {"slug": "b"}, {"slug": "c"})
    rest = batch(spark, {"slug": "b"}, {"slug": "c"})
    d, state = fold(spark, both, rest, rest)
    assert one(state).status == "active" and one(state).missing_scan_count == 2
    d, state = fold(spark, both, rest, rest, rest)
    assert one(state).status == "removed"
    assert ("a", "REMOVED", "missing_scan_count", "active", "3") in history(d)
    d, state = fold(spark, both, rest, rest, rest, both)
    assert (one(state).status, one(state).missing_scan_count) == ("active", 0)
    assert ("a", "REACTIVATED", None, None, None) in history(d) and d.filter("slug = 'a'").first().change_class == "REACTIVATED"


def test_partial_scans_count_no_misses(spark):
    both, little = batch(spark, *[{"slug": s} for s in "abcde"]), batch(spark, {"slug": "a"})
    _, state = fold(spark, both, little)
    assert {r.missing_scan_count for r in state.collect()} == {0}
    _, state = fold(spark, both, batch(spark, {"slug": "a"}, {"slug": "b"}, {"slug": "c"}), complete=False)
    assert {r.missing_scan_count for r in state.collect()} == {0}
    _, state = fold(spark, both, batch(spark, {"slug": "a"}, {"slug": "b"}, {"slug": "c"}))
    assert {r.slug: r.missing_scan_count for r in state.collect()} == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1}


def test_bad_row_is_isolated_but_seen(spark):
    good = [{"slug": s} for s in "abc"]
    d, state = fold(spark, batch(spark, *good), batch(spark, {"slug": "a", "name": ""}, {"slug": "b"}, {"slug": "c", "phone": "9" * 101}, {"slug": "z", "url": ""}))
    assert {r.slug: (r.name, r.missing_scan_count) for r in state.collect()} == {"a": ("Name a", 0), "b": ("Name b", 0), "c": ("Name c", 0)}
    counters = merge.scan_counters(d).first()
    assert (counters.error_count, counters.seen, counters.new_count) == (3, 4, 0)
    assert {r.slug for r in merge.history_rows(d, F.lit(AT[1]).cast("timestamp")).collect()} <= set("abc")


def test_monthly_count_is_of_the_scanned_rows(spark):
    d, state = fold(spark, batch(spark, {"slug": "a", "has_monthly_contract": "true"}), batch(spark, {"slug": "a", "has_monthly_contract": "unknown"}))
    assert one(state).has_monthly_contract == "true" and merge.scan_counters(d).first().monthly_count == 0


def test_gone_page_only_marks_the_read(spark):
    _, state = fold(spark, batch(spark, {"slug": "a", "phone": "081"}), batch(spark, {"slug": "a", "page_gone": True}))
    assert str(one(state).detail_scraped_at) == AT[1] and one(state).phone == "081"


def test_card_and_detail_schemas_stay_disjoint():
    assert not set(schemas.RAW_SCHEMA.names) & set(schemas.DETAIL_SCHEMA.names)
    assert set(schemas.FIELD_POLICIES) <= set(schemas.STATE_SCHEMA.names)


# ---- the stored tables --------------------------------------------------------

@pytest.fixture
def store(spark, tmp_path):
    return TrackingStore(spark, str(tmp_path / "store"), buckets=4)


def test_store_folds_scans(spark, store):
    out = store.apply_scan(batch(spark, {"slug": "a", "images": ["x", "y"]}, {"slug": "b", "thumbnail_url": "t"}), AT[0])
    assert out.counters["new_count"] == 2 and store.version() == 1
    store.apply_scan(batch(spark, {"slug": "a", "images": ["y", "z"], "price_monthly_min": 5}, {"slug": "b"}), AT[1])
    assert {(r.slug, r.image_url): r.position for r in store.images().collect()} == {
        ("a", "x"): 0, ("a", "y"): 1, ("a", "z"): 2, ("b", "t"): 0}
    kinds = sorted((r.slug, r.change_type) for r in store.history().collect())
    assert kinds == [("a", "NEW"), ("a", "PRICE_CHANGED"), ("a", "UPDATED"), ("b", "NEW")]
    assert [(r.scan_id, r.status) for r in store.scan_log().orderBy("scan_id").collect()] == [(1, "completed"), (2, "completed")]


def test_store_skips_replays_and_survives_failures(spark, store):
    first = batch(spark, {"slug": "a"})
    assert store.apply_scan(first, AT[0], batch_key="k1") is not None
    assert store.apply_scan(first, AT[0], batch_key="k1") is None
    broken = batch(spark, {"slug": "b"}).withColumn("name", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        store.apply_scan(broken, AT[1])
    assert store.version() == 1 and [r.slug for r in store.state().collect()] == ["a"]
    failed = store.scan_log().filter("status = 'failed'").first()
    assert "boom" in failed.error_message and len(failed.error_message) <= 2000
    store.apply_scan(batch(spark, {"slug": "a"}, {"slug": "b"}), AT[2])
    assert store.version() == 2 and store.history().count() == 2


def test_state_is_read_without_a_shuffle(spark, store):
    store.apply_scan(batch(spark, {"slug": "a"}), AT[0])
    joined = store.state().join(store.state().select("slug", F.col("name").alias("n")), "slug")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_order_of_rows_does_not_matter(spark):
    rows = [{"slug": s, "price_monthly_min": i} for i, s in enumerate("abcdef")]
    once, _ = fold(spark, batch(spark, *rows), batch(spark, *rows[::2]))
    again, _ = fold(spark, batch(spark, *rows[::-1]).repartition(3), batch(spark, *rows[::2]).repartition(5))
    key = lambda d: sorted(map(str, merge.new_state(d).collect()))
    assert key(once) == key(again)
