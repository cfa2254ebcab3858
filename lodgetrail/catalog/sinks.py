"""K: sinks. Each query writes, reads back and returns what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgetrail import adapters, schemas
from lodgetrail.catalog.aggregates import HIST, history
from lodgetrail.catalog.joins import CACHES, address_cache, place_cache
from lodgetrail.catalog.predicates import _BUDGETS, _LOCATIONS, preferences
from lodgetrail.catalog.registry import query
from lodgetrail.catalog.twins import CAT
from lodgetrail.operators import location
from lodgetrail.plans import exports
from lodgetrail.session import new_work_dir


def listings(spark, sf):
    return schemas.conform(adapters.catalogue(spark, sf), schemas.STATE_SCHEMA)


@query("K1_csv_export", f"""
WITH {CAT}
SELECT slug, province, price_monthly_min::VARCHAR AS price_monthly_min, COALESCE(array_to_string(amenities, '; '), '') AS amenities,
  strftime(first_seen_at, '%Y-%m-%dT%H:%M:%SZ') AS first_seen_at FROM cat WHERE status = 'active' AND has_monthly_contract = 'true'
""")
def k1(spark, sf):
    path = new_work_dir(spark, "csv")
    exports.write_csv(listings(spark, sf), path, monthly_only=True)
    back = spark.read.csv(path, header=True, escape='"')
    return back.select(
        "slug", "province", "price_monthly_min", F.coalesce("amenities", F.lit("")).alias("amenities"), "first_seen_at")


@query("K2_json_export", f"""
WITH {CAT} SELECT slug, province, price_monthly_min, COALESCE(array_to_string(amenities, '|'), '') AS amenities FROM cat WHERE status = 'active'
""")
def k2(spark, sf):
    path = new_work_dir(spark, "json")
    exports.write_json(listings(spark, sf), path)
    back = spark.read.schema("slug string, province string, price_monthly_min bigint, amenities array<string>").json(path)
    return back.withColumn("amenities", F.coalesce(F.array_join("amenities", "|"), F.lit("")))


@query("K3_table_copy", """
SELECT 'orders' AS name, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders
UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem
""")
def k3(spark, sf):
    root = new_work_dir(spark, "copy")
    source = {n: adapters.table(spark, sf, n) for n in ("orders", "lineitem")}
    exports.copy_tables(source, root)
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
    parts = [
        spark.read.parquet(f"{root}/{n}").agg(
            F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(k).alias("keys"))
        for n, k in keys.items()
    ]
    return parts[0].unionByName(parts[1])


@query("K4_history_append", f"""
WITH {HIST} SELECT changed_at::DATE::VARCHAR AS change_date, change_type, count(*) AS rows FROM hist GROUP BY ALL
""")
def k4(spark, sf):
    path = new_work_dir(spark, "history")
    rows = schemas.conform(history(spark, sf), schemas.HISTORY_SCHEMA)
    exports.append_history(rows.filter(F.col("change_type") == "NEW"), path)
    exports.append_history(rows.filter(F.col("change_type") != "NEW"), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("change_date").cast("string").alias("change_date"), "change_type").agg(
        F.count(F.lit(1)).alias("rows"))


@query("K5_preference_append", f"""
SELECT 'session-' || event_id AS session_token, {_LOCATIONS} AS location, {_BUDGETS} AS budget,
  CASE WHEN event_id % 2 = 0 THEN user_id WHEN event_id % 3 = 0 THEN user_id + 1000 END AS user_id FROM events WHERE event_type = 'signup'
""")
def k5(spark, sf):
    path = new_work_dir(spark, "preferences")
    exports.append_preferences(preferences(spark, sf), path)
    return spark.read.parquet(path).select("session_token", "location", "budget", "user_id")


@query("K6_point_cache_upsert", f"""
WITH {CACHES}
SELECT place_key, round(lat, 6) AS lat FROM acache UNION ALL SELECT place_key, round(lat, 6) FROM pcache WHERE place_key NOT IN (SELECT place_key FROM acache)
""")
def k6(spark, sf):
    path = new_work_dir(spark, "points")
    merged = location.upsert_points(address_cache(spark, sf), place_cache(spark, sf))
    merged.write.parquet(path)
    return spark.read.parquet(path).select("place_key", F.round("lat", 6).alias("lat"))
