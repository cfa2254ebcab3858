"""J: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgetrail import adapters, dims, schemas
from lodgetrail.catalog.registry import query
from lodgetrail.catalog.tracking import FOLDED, LINE_VERDICT, LINKED, first_cards, line_verdicts
from lodgetrail.catalog.twins import CAT, FIRSTS, IMG, PLACES
from lodgetrail.operators import accounts, collect, contacts, images, location
from lodgetrail.sources import details


@query("J1_raw_with_details", f"""
WITH {CAT}
SELECT slug, price_monthly_min,
  CASE WHEN id % 25 = 0 AND id % 10 <> 3 THEN NULL WHEN id % 2 = 0 THEN id::VARCHAR END AS source_id,
  CASE WHEN id % 2 = 0 THEN id % 25 = 0 AND id % 10 <> 3 END AS page_gone FROM cat
""")
def j1(spark, sf):
    cat = adapters.catalogue(spark, sf)
    pages = adapters.detail_html(cat.filter(F.col("id") % 2 == 0))
    raw = schemas.conform(cat, schemas.RAW_SCHEMA)
    full = collect.attach_details(raw, details.read_details(pages, f"{adapters.CDN}/listing_picture"))
    return full.select("slug", "price_monthly_min", "source_id", "page_gone")


_SPLIT = FIRSTS + """,
st AS (SELECT slug, max(scan_no) AS last_scan, max_by(price, scan_no) AS price,
    CASE WHEN slug % 5 = 0 THEN 'removed' ELSE 'active' END AS status, slug % 3 AS missing_scan_count
  FROM firsts WHERE scan_no < (SELECT max(scan_no) FROM firsts) GROUP BY slug),
ba AS (SELECT slug, price FROM firsts WHERE scan_no = (SELECT max(scan_no) FROM firsts))"""


def split(spark, sf):
    """State from all scans but the last, and the last scan as batch."""
    firsts = first_cards(spark, sf)
    last = firsts.agg(F.max("scan_no")).scalar()
    state = firsts.filter(F.col("scan_no") < last).groupBy("slug").agg(
        F.max("scan_no").alias("last_scan"), F.max_by("price", "scan_no").alias("price"))
    state = state.withColumns({
        "status": F.when(F.col("slug") % 5 == 0, "removed").otherwise("active"),
        "missing_scan_count": F.col("slug") % 3,
    })
    return state, firsts.filter(F.col("scan_no") == last).select("slug", "price")


@query("J2_batch_state_full_outer", f"""
WITH {_SPLIT}
SELECT COALESCE(st.slug, ba.slug) AS slug, st.price AS old_price, ba.price AS new_price
FROM st FULL OUTER JOIN ba ON st.slug = ba.slug
""")
def j2(spark, sf):
    state, batch = split(spark, sf)
    old = state.select("slug", F.col("price").alias("old_price"))
    return old.join(batch.select("slug", F.col("price").alias("new_price")), "slug", "full_outer")


@query("J3_seen_semi_join", f"""
WITH {_SPLIT}
SELECT slug, missing_scan_count FROM st WHERE status = 'active' AND missing_scan_count > 0 AND slug IN (SELECT slug FROM ba)
""")
def j3(spark, sf):
    state, batch = split(spark, sf)
    waiting = state.filter("status = 'active' AND missing_scan_count > 0")
    return waiting.join(batch, "slug", "left_semi").select("slug", "missing_scan_count")


@query("J4_missing_anti_join", f"""
WITH {_SPLIT}
SELECT slug, missing_scan_count + 1 AS missing_scan_count FROM st WHERE status = 'active' AND slug NOT IN (SELECT slug FROM ba)
""")
def j4(spark, sf):
    state, batch = split(spark, sf)
    gone = state.filter("status = 'active'").join(batch, "slug", "left_anti")
    return gone.select("slug", (F.col("missing_scan_count") + 1).alias("missing_scan_count"))


@query("J5_location_anti_join", f"WITH {CAT} SELECT slug, name FROM cat WHERE id % 2 = 0 AND id % 3 <> 0")
def j5(spark, sf):
    cat = adapters.catalogue(spark, sf)
    return collect.unseen(cat.filter(F.col("id") % 2 == 0), cat.filter(F.col("id") % 3 == 0)).select("slug", "name")


@query("J6_thumbnail_join", f"""
WITH {IMG}
SELECT listing_id, arg_min(image_url, (position, image_id)) AS thumbnail FROM img WHERE excluded IS NOT TRUE GROUP BY listing_id
""")
def j6(spark, sf):
    return images.thumbnails(adapters.images(spark, sf))


@query("J7_listing_gallery", f"""
WITH {IMG}
SELECT listing_id, image_url, row_number() OVER (PARTITION BY listing_id ORDER BY position, image_id) AS gallery_no
FROM img WHERE excluded IS NOT TRUE
""")
def j7(spark, sf):
    return images.gallery(adapters.images(spark, sf)).select("listing_id", "image_url", "gallery_no")


def address_cache(spark, sf):
    """Points known for some address keys, derived from the catalogue."""
    keys = location.addresses_to_geocode(adapters.catalogue(spark, sf), empty_cache(spark))
    known = keys.filter(F.length("place_key") % 3 == 0)
    return known.select("place_key", (F.length("place_key") / 10.0 + 7).alias("lat"), F.lit(100.25).alias("lon"))


def place_cache(spark, sf):
    keys = location.places_to_geocode(adapters.catalogue(spark, sf), empty_cache(spark))
    known = keys.filter(F.length("place_key") % 2 == 0)
    return known.select("place_key", (F.length("place_key") / 10.0 + 6).alias("lat"), F.lit(99.5).alias("lon"))


def empty_cache(spark):
    return spark.createDataFrame([], "place_key string, lat double, lon double")


CACHES = CAT + """,
keyed AS (SELECT cat.*, lower(trim(COALESCE(address, ''))) AS ak,
    concat_ws('|', lower(trim(COALESCE(subdistrict, ''))), lower(trim(COALESCE(district, ''))), lower(trim(COALESCE(province, '')))) AS pk FROM cat),
acache AS (SELECT DISTINCT ak AS place_key, length(ak) / 10.0::DOUBLE + 7 AS lat, 100.25::DOUBLE AS lon FROM keyed WHERE ak <> '' AND length(ak) % 3 = 0),
pcache AS (SELECT DISTINCT pk AS place_key, length(pk) / 10.0::DOUBLE + 6 AS lat, 99.5::DOUBLE AS lon FROM keyed WHERE COALESCE(district, '') <> '' AND length(pk) % 2 = 0)"""


@query("J8_coordinate_fallback", f"""
WITH {CACHES}
SELECT id, round(COALESCE(latitude, a.lat, p.lat), 6) AS map_lat, round(COALESCE(longitude, a.lon, p.lon), 6) AS map_lon,
  CASE WHEN latitude IS NOT NULL THEN true WHEN a.lat IS NOT NULL THEN regexp_matches(address, '[0-9]') WHEN p.lat IS NOT NULL THEN false END AS precise
FROM keyed LEFT JOIN acache a ON a.place_key = ak LEFT JOIN pcache p ON p.place_key = pk
""")
def j8(spark, sf):
    placed = location.with_map_points(
        adapters.catalogue(spark, sf), address_cache(spark, sf), place_cache(spark, sf))
    return placed.select("id", F.round("map_lat", 6).alias("map_lat"), F.round("map_lon", 6).alias("map_lon"), "precise")


@query("J9_geocode_cache_miss", f"""
WITH {CACHES}
SELECT DISTINCT 'address' AS kind, ak AS place_key FROM keyed WHERE ak <> '' AND length(ak) % 3 <> 0
UNION ALL SELECT DISTINCT 'place', pk FROM keyed WHERE COALESCE(district, '') <> '' AND length(pk) % 2 <> 0
""")
def j9(spark, sf):
    cat = adapters.catalogue(spark, sf)
    a = location.addresses_to_geocode(cat, address_cache(spark, sf))
    p = location.places_to_geocode(cat, place_cache(spark, sf))
    return a.select(F.lit("address").alias("kind"), "place_key").unionByName(p.select(F.lit("place").alias("kind"), "place_key"))


@query("J10_city_merge", f"""
WITH {PLACES}
SELECT id, COALESCE(dst, trim(COALESCE(province, ''))) AS merged FROM cat LEFT JOIN merges ON src = trim(COALESCE(province, ''))
""")
def j10(spark, sf):
    from lodgetrail.functions import geo

    merged = F.try_element_at(dims.literal_map(dims.CITY_MERGE), geo.raw_province())
    return adapters.catalogue(spark, sf).select("id", F.coalesce(merged, geo.raw_province()).alias("merged"))


@query("J11_district_as_city", f"WITH {PLACES} SELECT id, city FROM named")
def j11(spark, sf):
    return location.with_place_names(adapters.catalogue(spark, sf)).select("id", "city")


@query("J12_region_lookup", f"WITH {PLACES} SELECT region, count(*) AS listings FROM named GROUP BY region")
def j12(spark, sf):
    named = location.with_place_names(adapters.catalogue(spark, sf))
    return named.groupBy("region").agg(F.count(F.lit(1)).alias("listings"))


_FEATURED = ", ".join(f"('{n}')" for n in dims.FEATURED_CITIES)
FEATURED = f"""
SELECT n AS featured_city, count(*) AS listings FROM named, (VALUES {_FEATURED}) AS f(n)
WHERE status <> 'removed' AND (contains(lower(city), lower(n)) OR contains(lower(COALESCE(province, '')), lower(n)) OR contains(lower(quarter), lower(n)))
GROUP BY n"""


@query("J13_featured_city_match", f"WITH {PLACES} {FEATURED}")
def j13(spark, sf):
    return location.featured_counts(adapters.catalogue(spark, sf))


@query("J14_near_duplicate_hashes", f"""
WITH {LINKED} SELECT listing_id, corner, hash, near_hash FROM linked WHERE hash <> near_hash
""")
def j14(spark, sf):
    return images.near_links(images.distinct_hashes(adapters.corner_hashes(spark, sf)))


@query("J15_verdict_fan_out", f"""
WITH {CAT}
SELECT id, CASE WHEN status = 'active' AND line_id IS NOT NULL THEN {LINE_VERDICT} END AS verdict FROM cat
""")
def j15(spark, sf):
    cat = adapters.catalogue(spark, sf)
    return contacts.with_verdicts(cat, line_verdicts(spark, sf), "line_id").select("id", "verdict")


@query("J16_account_entitlement", f"""
WITH {FOLDED}
SELECT user_id, arg_max(subscription_id, (created_at, subscription_id)) AS subscription_id,
  arg_max(status, (created_at, subscription_id)) AS status,
  arg_max(status, (created_at, subscription_id)) IN ('active', 'trialing') AS is_premium
FROM folded WHERE user_id IS NOT NULL GROUP BY user_id
""")
def j16(spark, sf):
    return accounts.account_entitlements(accounts.fold_subscriptions(adapters.billing_events(spark, sf)))


