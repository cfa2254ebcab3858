"""Q: whole serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgetrail import adapters, dims
from lodgetrail.catalog.aggregates import FACETS, HIST, PUBLIC, history
from lodgetrail.catalog.predicates import located_index, scans
from lodgetrail.catalog.registry import query
from lodgetrail.catalog.scalars import _HMAC, _price_of
from lodgetrail.catalog.twins import CAT, IMG, OBS, PLACES, contract_num
from lodgetrail.functions.price import from_eur
from lodgetrail.operators import location
from lodgetrail.plans import counters, exports, serving
from lodgetrail.plans.scan import Site, TrackingStore, run_scan
from lodgetrail.session import new_work_dir, stage

_FUZZED = f"""
h AS (SELECT chosen.*, {_HMAC} AS d FROM chosen),
u AS (SELECT *, ('0x' || substr(d, 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 * pi() AS angle,
  100 + ('0x' || substr(d, 9, 8))::BIGINT / 4294967296.0::DOUBLE * 200 AS dist FROM h),
thumbs AS (SELECT listing_id, arg_min(image_url, (position, image_id)) AS thumbnail FROM img WHERE excluded IS NOT TRUE GROUP BY listing_id)"""


@query("Q1_catalogue_page", f"""
WITH {CAT}, {IMG},
chosen AS (SELECT * FROM cat WHERE status = 'active' AND (price_monthly_min <= 25000 OR price_monthly_min IS NULL)
  AND source_updated_at >= TIMESTAMP '1995-12-31 17:00:00' ORDER BY source_updated_at DESC NULLS LAST, id DESC LIMIT 500 OFFSET 20),
{_FUZZED}
SELECT id, name, thumbnail, NULL::VARCHAR AS phone, round(latitude + dist * cos(angle) / 111320, 5) AS latitude,
  latitude IS NOT NULL AS location_approx FROM u LEFT JOIN thumbs ON listing_id = id
""")
def q1(spark, sf):
    page = serving.catalogue_page(
        adapters.catalogue(spark, sf), adapters.images(spark, sf), premium=False, secret=adapters.SECRET,
        limit=500, offset=20, status="active", price_max=25000, since="1996-01-01")
    return page.select("id", "name", "thumbnail", "phone", "latitude", "location_approx")


@query("Q2_listing_card", f"""
WITH {CAT}, {IMG},
g AS (SELECT image_url, row_number() OVER (ORDER BY position, image_id) AS gallery_no FROM img WHERE listing_id = 42 AND excluded IS NOT TRUE)
SELECT id, name, phone, url, gallery_no, image_url FROM cat LEFT JOIN g ON true WHERE id = 42
""")
def q2(spark, sf):
    card = serving.listing_card(
        adapters.catalogue(spark, sf), adapters.images(spark, sf), 42, premium=True, secret=adapters.SECRET)
    return card.select("id", "name", "phone", "url", "gallery_no", "image_url")


@query("Q3_public_counters", f"WITH {CAT} SELECT * EXCLUDE (total_removed) FROM ({PUBLIC})")
def q3(spark, sf):
    return counters.public_counters(adapters.catalogue(spark, sf), adapters.as_of()).drop("total_removed")


@query("Q4_full_counters", f"""
WITH {CAT}, {HIST}, {OBS}, pub AS ({PUBLIC}),
s AS (SELECT scan_no, max(ts) AS finished_at FROM obs GROUP BY scan_no)
SELECT counter, NULL::VARCHAR AS detail, value::BIGINT AS value FROM (UNPIVOT pub ON COLUMNS(*) INTO NAME counter VALUE value)
UNION ALL SELECT 'changed_today', change_type, count(DISTINCT slug) FROM hist
  WHERE changed_at >= TIMESTAMP '2024-01-29 17:00:00' AND change_type IN ('UPDATED', 'PRICE_CHANGED') GROUP BY change_type
UNION ALL SELECT 'by_province', COALESCE(nullif(province, ''), 'Unknown'), n FROM (SELECT province, count(*) AS n FROM cat WHERE status = 'active' GROUP BY province)
UNION ALL SELECT 'last_scan', NULL, epoch_us(max(finished_at)) // 1000000 FROM s WHERE scan_no % 3 <> 0
""")
def q4(spark, sf):
    return counters.full_counters(
        adapters.catalogue(spark, sf), history(spark, sf), scans(spark, sf), adapters.as_of())


_ONE = contract_num("contract_monthly_raw")


@query("Q5_browse", f"""
WITH {PLACES}
SELECT id, city, {_ONE} AS price FROM named
WHERE status = 'active' AND region = 'Est' AND has_monthly_contract = 'true'
  AND COALESCE({_ONE} >= 1914, true) AND COALESCE({_ONE} <= 38280, false)
ORDER BY COALESCE({_ONE}::DOUBLE, 'Infinity'::DOUBLE) DESC, id LIMIT 30 OFFSET 30
""")
def q5(spark, sf):
    from lodgetrail.functions.price import contract_number

    page = serving.browse_page(
        location.with_place_names(adapters.catalogue(spark, sf)), "price_desc", 2,
        region="Est", one_month=True, price_min=from_eur(50), price_max=from_eur(1000))
    return page.select("id", "city", contract_number(F.col("contract_monthly_raw")).alias("price"))


@query("Q6_facet_menus", f"WITH {PLACES}, {FACETS} SELECT level, COALESCE(city, '') AS city, COALESCE(quarter, '') AS quarter, listings FROM facets")
def q6(spark, sf):
    menus = location.city_facets(adapters.catalogue(spark, sf))
    return menus.select(
        "level", F.coalesce("city", F.lit("")).alias("city"), F.coalesce("quarter", F.lit("")).alias("quarter"), "listings",
    ).orderBy("level", F.desc("listings"))


_P6 = _price_of("contract_6_month")


@query("Q7_map_view", f"""
WITH {CAT}
SELECT id, latitude, longitude FROM cat WHERE latitude IS NOT NULL AND longitude IS NOT NULL
  AND latitude BETWEEN 6 AND 18 AND longitude BETWEEN 98 AND 105
  AND COALESCE(trim(contract_6_month_raw) NOT IN ('', '-'), false)
  AND {_P6} >= 50 * {dims.EUR_RATE} AND {_P6} <= 300 * {dims.EUR_RATE} AND list_contains(COALESCE(amenities, []), 'Parking')
ORDER BY CASE WHEN COALESCE(contract_monthly_min, price_monthly_min) > 0 THEN COALESCE(contract_monthly_min, price_monthly_min) END NULLS LAST, id
""")
def q7(spark, sf):
    shown = serving.map_view(
        adapters.catalogue(spark, sf), (6, 18, 98, 105), duration="6 mois", budget_eur=(50, 300), wanted=("Parking",))
    return shown.orderBy(*serving.map_order("price_asc")).select("id", "latitude", "longitude")


@query("Q7_map_view_by_index", f"""
WITH {CAT}
SELECT id, latitude, longitude FROM cat WHERE latitude BETWEEN 9 AND 13 AND longitude BETWEEN 99 AND 102
  AND COALESCE(trim(contract_6_month_raw) NOT IN ('', '-'), false) AND list_contains(COALESCE(amenities, []), 'Parking')
""")
def q7_index(spark, sf):
    inside = located_index(spark, sf).viewport(9, 13, 99, 102)
    return serving.map_view(inside, duration="6 mois", wanted=("Parking",)).select("id", "latitude", "longitude")


@query("Q8_city_map", f"""
WITH {CAT}, p AS (SELECT *, COALESCE(contract_monthly_min, price_monthly_min) AS p FROM cat)
SELECT id, latitude, longitude FROM p WHERE lower(province) = 'phuket' AND status = 'active' AND latitude IS NOT NULL AND longitude IS NOT NULL
  AND p > 0 AND p BETWEEN 1000 AND 9000
""")
def q8(spark, sf):
    return serving.city_map(adapters.catalogue(spark, sf), province="Phuket", price_min=1000, price_max=9000).select(
        "id", "latitude", "longitude")


@query("Q9_savings_teaser", f"""
WITH {CAT}, p AS (SELECT id, COALESCE(contract_monthly_min, price_monthly_min) AS p FROM cat WHERE status <> 'removed')
SELECT id, p AS local_price, round(nullif(p, 0) * 3.5::DOUBLE)::BIGINT AS ota_price, round(round(nullif(p, 0) * 3.5::DOUBLE) / 30)::BIGINT AS ota_night,
  round(nullif(p, 0) * 3.5::DOUBLE)::BIGINT - nullif(p, 0) AS savings, 71::BIGINT AS discount_pct FROM p
""")
def q9(spark, sf):
    return serving.teaser(adapters.catalogue(spark, sf))


@query("Q10_exports", f"""
WITH {CAT} SELECT slug, COALESCE(array_to_string(amenities, '; '), '') AS amenities, strftime(source_updated_at, '%Y-%m-%dT%H:%M:%SZ') AS source_updated_at
FROM cat WHERE status = 'active'
""")
def q10(spark, sf):
    flat = exports.flat_columns(exports.export_rows(adapters.catalogue(spark, sf)))
    return flat.select("slug", "amenities", "source_updated_at")


@query("Q11_full_scan", f"""
WITH {CAT}, kept AS (SELECT *, (id // 40) % 10 IN (8, 9) AS seen_as_text FROM cat WHERE id % 150 NOT IN (49, 99, 149)),
first_scan AS (SELECT * FROM kept WHERE id % 10 <> 7),
price_rows AS (
  SELECT id FROM first_scan WHERE id % 4 = 0 AND CASE WHEN seen_as_text THEN price_monthly_raw IS NOT NULL ELSE price_monthly_min IS NOT NULL END
  UNION ALL SELECT id FROM first_scan WHERE id % 4 = 0 AND CASE WHEN seen_as_text THEN price_monthly_raw IS NOT NULL ELSE price_monthly_max IS NOT NULL END)
SELECT 'NEW' AS change_type, count(*) AS rows FROM kept
UNION ALL SELECT 'PRICE_CHANGED', count(*) FROM price_rows
UNION ALL SELECT 'UPDATED', count(DISTINCT id) FROM price_rows
UNION ALL SELECT 'images', 2 * count(*) FILTER (NOT (id % 25 = 0 AND id % 10 <> 3)) + count(*) FILTER (id % 25 = 0 AND id % 10 <> 3 AND id % 2 = 0) FROM kept
""")
def q11(spark, sf):
    """Two scans from landed pages: the second adds a tenth and raises prices."""
    cat = adapters.catalogue(spark, sf)
    raised = cat.withColumns({
        p: F.when(F.col("id") % 4 == 0, F.col(p) + 500).otherwise(F.col(p)) for p in ("price_monthly_min", "price_monthly_max")})
    site = Site(adapters.SITE, adapters.CDN)
    store = TrackingStore(spark, new_work_dir(spark, "store"), buckets=8)
    details = adapters.landed_details(spark, sf)
    seven = F.col("url").rlike(r"/listing-\d*7$")
    late, early = details.filter(seven), details.filter(~seven)
    run_scan(store, site, adapters.landed_lists(spark, sf).transform(_without_sevens), "2024-02-01 00:00:00",
             detail_landing=early)
    run_scan(store, site, stage(adapters.list_pages(raised), "list-pages"), "2024-02-01 12:00:00", detail_landing=late)
    kinds = store.history().groupBy("change_type").agg(F.count(F.lit(1)).alias("rows"))
    return kinds.unionByName(store.images().agg(F.lit("images").alias("change_type"), F.count(F.lit(1)).alias("rows")))


def _without_sevens(pages):
    """Pages as landed before listings ending in 7 were published."""
    gone = F.regexp_replace("html", r'"slug":"listing-\d*7"', '"slug":""')
    return pages.withColumn("html", F.regexp_replace(gone, r'<li><a href="/en/listing-\d*7">.*?</li>', ""))
