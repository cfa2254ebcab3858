"""The registered queries as a whole, and the shape of important plans."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodgetrail import adapters
from lodgetrail.operators import contacts, images, location
from lodgetrail.plans import exports, serving

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


def test_every_operator_is_registered():
    names = set(entry.queries())
    wanted = (
        [f"S{i}" for i in range(1, 15)] + [f"K{i}" for i in range(1, 7)] + [f"F{i}" for i in range(1, 24)]
        + [f"J{i}" for i in range(1, 17)] + [f"A{i}" for i in range(1, 21)] + [f"W{i}" for i in range(1, 9)]
        + [f"O{i}" for i in range(1, 10)] + [f"U{i}" for i in range(1, 6)] + [f"C{i}" for i in range(1, 41)]
        + ["M1", "M2", "M3a", "M3b"] + [f"M{i}" for i in range(4, 26)] + [f"Q{i}" for i in range(1, 12)] + [f"T{i}" for i in range(1, 7)])
    have = {n.split("_")[0] for n in names}
    assert [w for w in wanted if w not in have] == []
    # The operators for training text say for themselves which of them SQL can express.
    own = {n for n in names if not re.match(r"op\d+_|pipeline$", n)}
    assert own - set(entry.oracle_sql()) == set()


@needs_data
def test_flagship_query_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"scan_no", "change_class", "listings"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    img = adapters.images(spark, SF)
    text = plan(images.thumbnails(img))
    assert "l_comment" not in text
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} <= {"l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag"}
    lines = adapters.table(spark, SF, "lineitem").filter("l_quantity > 40")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan(lines.select("l_orderkey"))


@needs_data
def test_pages_are_a_top_k(spark):
    text = plan(serving.page(adapters.catalogue(spark, SF), serving.newest_first(), 50, 100))
    assert "TakeOrderedAndProject" in text


@needs_data
@pytest.mark.parametrize("name", [
    n for n in entry.queries()
    if n[0] in "FJAOUQC" and n not in ("Q11_full_scan",)])
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@needs_data
def test_growing_sides_are_never_forced_to_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cat = adapters.catalogue(spark, SF)
        cache = spark.range(5).selectExpr("CAST(id AS STRING) place_key", "1D lat", "2D lon")
        verdicts = spark.range(5).selectExpr("CAST(id AS STRING) line_id", "'valid' verdict")
        for df in (location.with_map_points(cat, cache, cache), contacts.with_verdicts(cat, verdicts, "line_id"),
                   images.watermarked_images(adapters.corner_hashes(spark, SF))):
            assert "Broadcast" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exports_round_trip(spark, tmp_path):
    from lodgetrail import schemas

    rows = [{"slug": "a", "name": 'say "hi", ok', "status": "active", "province": "Nan", "price_monthly_min": 2, "amenities": ["Fan", "Pool"]},
            {"slug": "b", "name": "b", "status": "active", "province": None, "price_monthly_min": 1},
            {"slug": "c", "name": "c", "status": "removed"}]
    state = spark.createDataFrame([tuple(r.get(n) for n in schemas.STATE_SCHEMA.names) for r in rows], schemas.STATE_SCHEMA)
    exports.write_csv(state, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"')
    assert not {"content_hash", "missing_scan_count", "source"} & set(back.columns)
    assert [(r.slug, r.name, r.amenities) for r in back.collect()] == [("b", "b", None), ("a", 'say "hi", ok', "Fan; Pool")]
    exports.write_json(state, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).filter(F.array_contains("amenities", "Pool")).count() == 1


def test_deep_pages_pick_keys_first(spark):
    df = spark.range(12_000).selectExpr("id", "timestamp_seconds(id % 100) source_updated_at", "'x' name")
    ids = [r.id for r in serving.page(df, serving.newest_first(), 5, 11_000).collect()]
    want = sorted(range(12_000), key=lambda i: (-(i % 100), -i))[11_000:11_005]
    assert ids == want
    with pytest.raises(ValueError):
        serving.page(df, serving.newest_first(), 501)
