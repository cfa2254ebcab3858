"""F: projections, filters, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgetrail import adapters, dims
from lodgetrail.catalog.registry import query
from lodgetrail.catalog.twins import CAT, IMG, OBS, PLACES, contract_num, joined, ts_text
from lodgetrail.functions import geo
from lodgetrail.functions.price import contract_flag, is_short_term
from lodgetrail.operators import collect, filters, images, repair
from lodgetrail.plans import exports, serving
from lodgetrail.plans.paging import MapIndex
from lodgetrail.session import new_work_dir

_AS_OF = f"TIMESTAMP '{adapters.AS_OF}'"


@query("F1_catalogue_filter", f"""
WITH {CAT}
SELECT id, province, district, price_monthly_min, price_monthly_max FROM cat
WHERE lower(province) = 'bangkok' AND (price_monthly_max >= 3000 OR price_monthly_max IS NULL)
  AND (price_monthly_min <= 20000 OR price_monthly_min IS NULL) AND has_monthly_contract = 'true' AND status = 'active'
""")
def f1(spark, sf):
    cond = filters.catalogue(province="BANGKOK", price_min=3000, price_max=20000, monthly=True, status="active")
    return adapters.catalogue(spark, sf).filter(cond).select(
        "id", "province", "district", "price_monthly_min", "price_monthly_max")


@query("F2_exact_text_match", f"""
WITH {CAT}
SELECT 'mueang 1' AS wanted, count(*) AS listings FROM cat WHERE lower(district) = 'mueang 1'
UNION ALL SELECT 'mueang%', count(*) FROM cat WHERE lower(district) = 'mueang%'
UNION ALL SELECT 'mueang__', count(*) FROM cat WHERE lower(district) = 'mueang__'
""")
def f2(spark, sf):
    hits = [
        F.struct(F.lit(v).alias("wanted"), F.count_if(filters.equals_ignoring_case(F.col("district"), v)).alias("listings"))
        for v in ("mueang 1", "mueang%", "mueang__")
    ]
    one = adapters.catalogue(spark, sf).agg(F.array(*hits).alias("h"))
    return one.select(F.inline("h"))


@query("F3_price_overlap", f"""
WITH {CAT}
SELECT id FROM cat WHERE (price_monthly_max >= 12000 OR price_monthly_max IS NULL)
  AND (price_monthly_min <= 15000 OR price_monthly_min IS NULL)
""")
def f3(spark, sf):
    return adapters.catalogue(spark, sf).filter(filters.price_overlap(12000, 15000)).select("id")


@query("F4_updated_since", f"""
WITH {CAT}
SELECT id, {ts_text('source_updated_at')} AS updated FROM cat
WHERE source_updated_at >= TIMESTAMP '2000-06-14 17:00:00'
""")
def f4(spark, sf):
    return adapters.catalogue(spark, sf).filter(filters.updated_since("2000-06-15")).select(
        "id", F.date_format("source_updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query("F5_monthly_only", f"WITH {CAT} SELECT id, name FROM cat WHERE has_monthly_contract = 'true'")
def f5(spark, sf):
    return adapters.catalogue(spark, sf).filter(F.col("has_monthly_contract") == "true").select("id", "name")


@query("F6_short_term", f"""
WITH {CAT}
SELECT id, has_monthly_contract = 'true' OR COALESCE(trim(contract_3_month_raw) NOT IN ('', '-'), false)
  OR COALESCE(trim(contract_6_month_raw) NOT IN ('', '-'), false) AS short_term FROM cat
""")
def f6(spark, sf):
    return adapters.catalogue(spark, sf).select("id", is_short_term().alias("short_term"))


@query("F7_contract_tristate", f"""
WITH {CAT}
SELECT id, CASE WHEN contract_6_month_raw IS NULL THEN 'unknown'
  WHEN trim(contract_6_month_raw) IN ('', '-') THEN 'false' ELSE 'true' END AS flag6,
  CASE WHEN contract_3_month_raw IS NULL THEN 'unknown'
  WHEN trim(contract_3_month_raw) IN ('', '-') THEN 'false' ELSE 'true' END AS flag3 FROM cat
""")
def f7(spark, sf):
    return adapters.catalogue(spark, sf).select(
        "id", contract_flag(F.col("contract_6_month_raw")).alias("flag6"),
        contract_flag(F.col("contract_3_month_raw")).alias("flag3"))


_C1, _C3, _C6 = (contract_num(c) for c in ("contract_monthly_raw", "contract_3_month_raw", "contract_6_month_raw"))


@query("F8_browser_filter", f"""
WITH {PLACES}
SELECT id, city, region FROM named
WHERE status = 'active' AND first_seen_at >= {_AS_OF} - INTERVAL 24 HOUR
  AND (contains(lower(city), 'a') ) AND region = 'Sud'
  AND {_C3} IS NOT NULL AND list_contains(COALESCE(amenities, []), 'Parking')
  AND (COALESCE(greatest({_C1}, {_C3}, {_C6}), price_monthly_max, 0) <= 0
       OR COALESCE(greatest({_C1}, {_C3}, {_C6}), price_monthly_max, 0) >= 3828)
  AND (COALESCE(least({_C1}, {_C3}, {_C6}), price_monthly_min, 0) <= 0
       OR COALESCE(least({_C1}, {_C3}, {_C6}), price_monthly_min, 0) <= 22968)
""")
def f8(spark, sf):
    from lodgetrail.functions.price import from_eur

    cond = filters.browse(
        as_of=adapters.as_of(), new_only=True, city="a", region="Sud", three_months=True,
        amenities=["Parking"], price_min=from_eur(100), price_max=from_eur(600))
    named = adapters.catalogue(spark, sf).filter(cond)
    return named.select("id", geo.city_of().alias("city"), geo.region_of(geo.city_of()).alias("region"))


@query("F9_contract_price_overlap", f"""
WITH {CAT}
SELECT id,
  (COALESCE(greatest({_C1}, {_C3}, {_C6}), price_monthly_max, 0) <= 0
    OR COALESCE(greatest({_C1}, {_C3}, {_C6}), price_monthly_max, 0) >= 8000)
  AND (COALESCE(least({_C1}, {_C3}, {_C6}), price_monthly_min, 0) <= 0
    OR COALESCE(least({_C1}, {_C3}, {_C6}), price_monthly_min, 0) <= 12000) AS overlaps,
  COALESCE({_C1} >= 8000, true) AND COALESCE({_C1} <= 12000, false) AS monthly_fits
FROM cat
""")
def f9(spark, sf):
    return adapters.catalogue(spark, sf).select(
        "id", filters.contract_overlap(8000, 12000).alias("overlaps"),
        filters.contract_overlap(8000, 12000, monthly_only=True).alias("monthly_fits"))


_LEAD3 = "TRY_CAST(regexp_replace(regexp_extract(contract_3_month_raw, '([0-9,\\s]+)', 1), '[\\s,]', '', 'g') AS BIGINT)"
_LEAD1 = "TRY_CAST(regexp_replace(regexp_extract(contract_monthly_raw, '([0-9,\\s]+)', 1), '[\\s,]', '', 'g') AS BIGINT)"
_PRICE_OF_3 = (
    f"COALESCE(nullif(contract_3_month_min, 0), CASE WHEN trim(contract_3_month_raw) NOT IN ('', '-') THEN {_LEAD3} END, "
    f"nullif(price_monthly_min, 0), CASE WHEN trim(contract_monthly_raw) NOT IN ('', '-') THEN {_LEAD1} END)"
)


@query("F10_map_filter", f"""
WITH {CAT}
SELECT id FROM cat
WHERE COALESCE(trim(contract_3_month_raw) NOT IN ('', '-'), false)
  AND {_PRICE_OF_3} >= 100 * {dims.EUR_RATE} AND {_PRICE_OF_3} <= 400 * {dims.EUR_RATE}
  AND COALESCE(line_id, '') <> '' AND length(regexp_replace(COALESCE(whatsapp, ''), '[^0-9]', '', 'g')) >= 5
  AND list_contains(COALESCE(amenities, []), 'Fitness')
""")
def f10(spark, sf):
    cond = filters.map_view(duration="3 mois", budget_eur=(100, 400), wanted=("LINE", "WhatsApp", "Fitness"))
    return adapters.catalogue(spark, sf).filter(cond).select("id")


@query("F11_city_map_filter", f"""
WITH {CAT}, priced AS (SELECT *, COALESCE(contract_monthly_min, price_monthly_min) AS p FROM cat)
SELECT id FROM priced WHERE has_monthly_contract = 'true' AND p > 0 AND p BETWEEN 2000 AND 9000
""")
def f11(spark, sf):
    cond = filters.city_map_price(2000, 9000, 26000, monthly_only=True)
    return adapters.catalogue(spark, sf).filter(cond).select("id")


@query("F12_viewport", f"WITH {CAT} SELECT id FROM cat WHERE latitude BETWEEN 7 AND 9.5 AND longitude BETWEEN 98 AND 101")
def f12(spark, sf):
    return adapters.catalogue(spark, sf).filter(filters.in_viewport(7, 9.5, 98, 101)).select("id")


@adapters.remembered
def located_index(spark, sf) -> MapIndex:
    """The located listings stored by place."""
    return MapIndex.build(adapters.catalogue(spark, sf), new_work_dir(spark, "map"), rows_per_part=200)


@query("F12_viewport_by_index", f"WITH {CAT} SELECT id, latitude, longitude FROM cat WHERE latitude BETWEEN 7.25 AND 8.5 AND longitude BETWEEN 98 AND 99.75")
def f12_index(spark, sf):
    return located_index(spark, sf).viewport(7.25, 8.5, 98, 99.75).select("id", "latitude", "longitude")


@query("F13_country_box", """
SELECT c_custkey AS id, COALESCE(TRY_CAST(replace(replace((c_acctbal / 100)::VARCHAR, '.', ','), ',', '.') AS DOUBLE) BETWEEN 5 AND 21, false) AS inside
FROM customer
""")
def f13(spark, sf):
    text = F.replace((F.col("c_acctbal") / 100).cast("string"), F.lit("."), F.lit(","))
    return adapters.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), geo.in_country(geo.coordinate(text), geo.coordinate(F.lit("100,5"))).alias("inside"))


@query("F14_finite_coordinates", f"WITH {CAT} SELECT id, latitude, longitude FROM cat WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def f14(spark, sf):
    return adapters.catalogue(spark, sf).filter(filters.located()).select("id", "latitude", "longitude")


@query("F15_stale_details", f"""
WITH {CAT}
SELECT slug FROM cat WHERE detail_scraped_at IS NULL OR detail_scraped_at < {_AS_OF} - INTERVAL 7 DAY
""")
def f15(spark, sf):
    cat = adapters.catalogue(spark, sf)
    return collect.stale_details(cat.select("slug"), cat, adapters.as_of()).select("slug")


@query("F16_missing_groups", f"""
WITH {CAT}
SELECT id, amenities IS NULL OR len(amenities) = 0 AS no_amenities, latitude IS NULL OR longitude IS NULL AS no_coords,
  phone IS NULL AND line_id IS NULL AND whatsapp IS NULL AND email IS NULL AS no_contact
FROM cat WHERE status = 'active'
""")
def f16(spark, sf):
    active = repair.repair_targets(adapters.catalogue(spark, sf), ["contact"])
    return active.select(
        "id", filters.missing_group("amenities").alias("no_amenities"),
        filters.missing_group("coords").alias("no_coords"), filters.missing_group("contact").alias("no_contact"))


@query("F17_review_queue", f"""
WITH {IMG}
SELECT listing_id, count(*) AS pending FROM img WHERE reviewed_at IS NULL GROUP BY listing_id
""")
def f17(spark, sf):
    queue = images.review_queue(adapters.images(spark, sf))
    return queue.groupBy("listing_id").agg(F.count(F.lit(1)).alias("pending"))


@query("F18_stuck_scans", f"""
WITH {OBS}, scans AS (SELECT scan_no, min(ts) AS started_at, CASE WHEN scan_no % 3 = 0 THEN 'running' ELSE 'completed' END AS status FROM obs GROUP BY scan_no)
SELECT scan_no FROM scans WHERE status = 'running' AND started_at < {_AS_OF} - INTERVAL 12 HOUR
""")
def f18(spark, sf):
    return scans(spark, sf).filter(repair.is_stuck(adapters.as_of())).select("scan_no")


def scans(spark, sf):
    """Observed scans as log rows; every third one never reported."""
    per_scan = adapters.observations(spark, sf).groupBy("scan_no").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("_last"))
    running = F.col("scan_no") % 3 == 0
    return per_scan.select(
        "scan_no", "started_at",
        F.when(running, "running").otherwise("completed").alias("status"),
        F.when(~running, F.col("_last")).alias("finished_at"),
        F.lit(None).cast("string").alias("error_message"))


@query("F19_access_tier_mask", f"""
WITH {CAT}
SELECT id, NULL::VARCHAR AS phone, NULL::VARCHAR AS url, NULL::VARCHAR AS address, name,
  latitude IS NOT NULL AND longitude IS NOT NULL AS location_approx FROM cat
""")
def f19(spark, sf):
    masked = filters.mask(adapters.catalogue(spark, sf), premium=False, secret=adapters.SECRET)
    return masked.select("id", "phone", "url", "address", "name", "location_approx")


@query("F20_export_pruning", f"WITH {CAT} SELECT id, slug, source_id, name, status FROM cat WHERE status = 'active'")
def f20(spark, sf):
    rows = exports.export_rows(adapters.catalogue(spark, sf))
    assert not {"missing_scan_count", "source", "content_hash"} & set(rows.columns)
    return rows.select("id", "slug", "source_id", "name", "status")


_LOCATIONS = "CASE user_id % 6 WHEN 0 THEN 'bangkok' WHEN 1 THEN 'phuket' WHEN 2 THEN 'chiang_mai' WHEN 3 THEN 'pattaya' ELSE 'other' END"
_BUDGETS = "CASE event_id % 5 WHEN 0 THEN 'under_10k' WHEN 1 THEN '10k_20k' WHEN 2 THEN '20k_30k' WHEN 3 THEN '30k_plus' END"


def preferences(spark, sf):
    """Signup events as questionnaire answers."""
    signups = adapters.table(spark, sf, "events").filter(F.col("event_type") == "signup")
    return signups.select(
        F.concat(F.lit("session-"), "event_id").alias("session_token"),
        F.expr(_LOCATIONS).alias("location"), F.expr(_BUDGETS).alias("budget"),
        F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 3 == 0, F.col("user_id") + 1000).alias("session_user_id"))


@query("F21_funnel_matches", f"""
WITH {CAT},
prefs AS (SELECT {_LOCATIONS} AS location, {_BUDGETS} AS budget FROM events WHERE event_type = 'signup'),
bounds(budget, lo, hi) AS (VALUES ('under_10k', NULL, 5742), ('10k_20k', 5742, 11484), ('20k_30k', 11484, 19140), ('30k_plus', 19140, NULL)),
answers AS (SELECT location, budget, count(*) AS sessions FROM prefs GROUP BY ALL)
SELECT a.location, a.budget, a.sessions, count(cat.id) AS matches
FROM answers a LEFT JOIN bounds b ON a.budget = b.budget
LEFT JOIN cat ON cat.status = 'active'
  AND (a.location = 'other' OR (a.location = 'pattaya' AND lower(cat.district) = 'bang lamung')
    OR (a.location = 'bangkok' AND lower(cat.province) = 'bangkok') OR (a.location = 'phuket' AND lower(cat.province) = 'phuket')
    OR (a.location = 'chiang_mai' AND lower(cat.province) = 'chiang mai'))
  AND (b.lo IS NULL OR cat.price_monthly_max >= b.lo OR cat.price_monthly_max IS NULL)
  AND (b.hi IS NULL OR cat.price_monthly_min <= b.hi OR cat.price_monthly_min IS NULL)
GROUP BY a.location, a.budget, a.sessions
""")
def f21(spark, sf):
    return serving.funnel_matches(preferences(spark, sf), adapters.catalogue(spark, sf))


@query("F22_lookup_by_id", f"WITH {CAT} SELECT id, name, province, {joined('amenities')} AS amenities FROM cat WHERE id = 42")
def f22(spark, sf):
    return adapters.catalogue(spark, sf).filter(F.col("id") == 42).select(
        "id", "name", "province", F.coalesce(F.array_join("amenities", "|"), F.lit("")).alias("amenities"))


@query("F23_province_restriction", f"WITH {CAT} SELECT id, province FROM cat WHERE province IN ('Bangkok', 'Phuket')")
def f23(spark, sf):
    return collect.restrict_to(adapters.catalogue(spark, sf), "province", ["Bangkok", "Phuket"]).select("id", "province")
