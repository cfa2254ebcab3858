"""A: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgetrail import adapters, dims
from lodgetrail.catalog.predicates import scans
from lodgetrail.catalog.registry import query
from lodgetrail.catalog.tracking import LINE_VERDICT, LINKED, MERGED, _CLASS, decision, line_verdicts
from lodgetrail.catalog.twins import CAT, FIRSTS, IMG, OBS, PLACES, STEPS, contract_num, ts_text, values
from lodgetrail.functions import clock
from lodgetrail.operators import collect, contacts, images, location, merge, observe
from lodgetrail.plans import counters, serving

_AS_OF = f"TIMESTAMP '{adapters.AS_OF}'"
_OFFER = "{0} IS NOT NULL AND {0} NOT IN ('', '-')"
PUBLIC = f"""
SELECT count(*) FILTER (status = 'active') AS total_active,
  count(*) FILTER (first_seen_at >= TIMESTAMP '2024-01-29 17:00:00') AS new_today,
  count(*) FILTER (status = 'active' AND has_monthly_contract = 'true') AS monthly_contract_count,
  count(*) FILTER (status = 'active' AND {_OFFER.format('contract_3_month_raw')}) AS three_month_contract_count,
  count(*) FILTER (status = 'active' AND {_OFFER.format('contract_6_month_raw')}) AS six_month_contract_count,
  count(*) FILTER (status = 'removed') AS total_removed FROM cat"""


@query("A1_conditional_counts", f"WITH {CAT} {PUBLIC}")
def a1(spark, sf):
    return counters.public_counters(adapters.catalogue(spark, sf), adapters.as_of())


@query("A2_new_today", f"""
WITH {OBS}, seen AS (SELECT slug, min(ts) AS first_seen_at FROM obs GROUP BY slug)
SELECT date_trunc('day', first_seen_at + INTERVAL 7 HOUR)::DATE::VARCHAR AS local_day, count(*) AS new_listings FROM seen GROUP BY ALL
""")
def a2(spark, sf):
    seen = adapters.observations(spark, sf).groupBy("slug").agg(F.min("ts").alias("first_seen_at"))
    return seen.groupBy(clock.local_day(F.col("first_seen_at")).cast("string").alias("local_day")).agg(
        F.count(F.lit(1)).alias("new_listings"))


def history(spark, sf):
    """Events as history rows."""
    return adapters.table(spark, sf, "events").select(
        F.col("user_id").alias("slug"), F.col("ts").cast("timestamp").alias("changed_at"),
        F.when(F.col("event_type") == "view", "UPDATED").when(F.col("event_type") == "click", "PRICE_CHANGED")
        .when(F.col("event_type") == "signup", "NEW").when(F.col("event_type") == "error", "REMOVED")
        .otherwise("REACTIVATED").alias("change_type"))


HIST = """
hist AS (SELECT user_id AS slug, ts AS changed_at, CASE event_type WHEN 'view' THEN 'UPDATED' WHEN 'click' THEN 'PRICE_CHANGED'
  WHEN 'signup' THEN 'NEW' WHEN 'error' THEN 'REMOVED' ELSE 'REACTIVATED' END AS change_type FROM events)"""


@query("A3_changed_today", f"""
WITH {HIST} SELECT change_type, count(DISTINCT slug) AS listings FROM hist
WHERE changed_at >= TIMESTAMP '2024-01-29 17:00:00' GROUP BY change_type
""")
def a3(spark, sf):
    return counters.changed_today(history(spark, sf), adapters.as_of())


@query("A4_by_province", f"""
WITH {CAT}
SELECT COALESCE(nullif(province, ''), 'Unknown') AS province, n AS listings
FROM (SELECT province, count(*) AS n FROM cat WHERE status = 'active' GROUP BY province)
""")
def a4(spark, sf):
    return counters.by_province(adapters.catalogue(spark, sf))


@query("A5_last_completed_scan", f"""
WITH {OBS}, s AS (SELECT scan_no, max(ts) AS finished_at FROM obs GROUP BY scan_no)
SELECT {ts_text('max(finished_at)')} AS last_scan FROM s WHERE scan_no % 3 <> 0
""")
def a5(spark, sf):
    last = counters.last_completed_scan(scans(spark, sf))
    return last.select(F.date_format("last_scan", "yyyy-MM-dd HH:mm:ss").alias("last_scan"))


@query("A6_first_position", f"""
WITH {IMG} SELECT listing_id, min(position) AS first_position FROM img WHERE excluded IS NOT TRUE GROUP BY listing_id
""")
def a6(spark, sf):
    return images.first_positions(adapters.images(spark, sf))


@query("A7_duplicate_groups", f"""
WITH {IMG} SELECT listing_id, image_url, min(image_id) AS keep_id, count(*) AS copies FROM img GROUP BY ALL HAVING count(*) > 1
""")
def a7(spark, sf):
    return images.duplicate_groups(adapters.images(spark, sf))


FACETS = """
active AS (SELECT * FROM named WHERE status = 'active' AND city <> ''),
facets AS (
  SELECT 'all' AS level, NULL::VARCHAR AS city, NULL::VARCHAR AS quarter, count(*) AS listings FROM active
  UNION ALL SELECT 'city', min(city), NULL, count(*) FROM active GROUP BY lower(city)
  UNION ALL SELECT 'quarter', min(city), min(quarter), count(*) FROM active WHERE quarter <> '' GROUP BY lower(city), lower(quarter))"""


@query("A8_nested_facets", f"WITH {PLACES}, {FACETS} SELECT * FROM facets")
def a8(spark, sf):
    return location.city_facets(adapters.catalogue(spark, sf))


@query("A9_scan_counters", f"""
WITH {MERGED}, c AS (SELECT *, {_CLASS} AS cls FROM fin)
SELECT count(*) FILTER (seen) + (SELECT count(*) FROM strange) AS seen, count(*) FILTER (cls = 'NEW') AS new_count, count(*) FILTER (cls = 'UPDATED') AS updated_count,
  count(*) FILTER (cls = 'PRICE_CHANGED') AS price_changed_count, count(*) FILTER (was_removed) AS removed_count,
  count(*) FILTER (applied AND b.has_monthly_contract = 'true') AS monthly_count,
  count(*) FILTER (seen AND NOT applied) + (SELECT count(*) FROM strange) AS error_count FROM c
""")
def a9(spark, sf):
    return merge.scan_counters(decision(spark, sf, rejected=True))


@query("A10_distinct_pages", f"""
WITH {FIRSTS} SELECT scan_no, count(DISTINCT page_url) AS pages_scanned, count(*) AS listings_found FROM firsts GROUP BY scan_no
""")
def a10(spark, sf):
    return collect.pages_with_first_cards(
        adapters.observations(spark, sf), "scan_no", "slug", "page_url", ["ts", "event_id"])


_NUMS = ", ".join(contract_num(c) for c in ("contract_monthly_raw", "contract_3_month_raw", "contract_6_month_raw"))


@query("A11_row_min_max", f"WITH {CAT} SELECT id, least({_NUMS}) AS lowest, greatest({_NUMS}) AS highest FROM cat")
def a11(spark, sf):
    return counters.contract_price_range(adapters.catalogue(spark, sf))


@query("A12_price_ceiling", f"""
WITH {CAT}, p AS (SELECT COALESCE(contract_monthly_min, price_monthly_min) AS p FROM cat)
SELECT COALESCE(ceil(max(p) / 1000.0) * 1000, 0)::BIGINT AS price_ceiling FROM p WHERE p > 0
""")
def a12(spark, sf):
    return serving.price_ceiling(adapters.catalogue(spark, sf))


@query("A13_map_extent", f"""
WITH {CAT} SELECT min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east, count(*) AS points
FROM cat WHERE latitude IS NOT NULL AND longitude IS NOT NULL
""")
def a13(spark, sf):
    return serving.extent(serving.map_view(adapters.catalogue(spark, sf)))


@query("A14_verdict_weighting", f"""
WITH {CAT}
SELECT {LINE_VERDICT} AS verdict, count(*) AS listings, count(DISTINCT line_id) AS contacts
FROM cat WHERE status = 'active' AND line_id IS NOT NULL GROUP BY 1
""")
def a14(spark, sf):
    return contacts.verdict_weights(adapters.catalogue(spark, sf), line_verdicts(spark, sf), "line_id")


@query("A15_new_in_24_hours", f"""
WITH {CAT} SELECT count(*) AS new_24h FROM cat WHERE status <> 'removed' AND first_seen_at >= {_AS_OF} - INTERVAL 24 HOUR
""")
def a15(spark, sf):
    return counters.new_in_24_hours(adapters.catalogue(spark, sf), adapters.as_of())


@query("A16_review_counters", f"""
WITH {IMG} SELECT count(*) AS processed, count(*) FILTER (error IS NULL AND (has_qr OR has_text)) AS excluded, count(error) AS errors FROM img
""")
def a16(spark, sf):
    img = adapters.images(spark, sf)
    excluded, reason = images.verdict(F.col("has_qr"), F.col("has_text"), error=F.col("error"))
    return images.review_counters(img.select("image_id", excluded.alias("excluded"), reason.alias("exclusion_reason")))


@query("A17_cluster_size", f"WITH {LINKED} SELECT listing_id, corner, hash, cluster_size FROM clusters")
def a17(spark, sf):
    hashes = images.distinct_hashes(adapters.corner_hashes(spark, sf))
    return images.cluster_sizes(hashes, images.near_links(hashes)).select("listing_id", "corner", "hash", "cluster_size")


@query("A18_room_size_mean", f"""
WITH {CAT} SELECT url, CASE WHEN id % 2 = 0 THEN ((id % 30 + 20) + (id % 30 + 25)) / 2.0::DOUBLE ELSE (id % 30 + 25)::DOUBLE END AS size_sqm
FROM cat WHERE id % 25 <> 0 AND id % 10 <> 3
""")
def a18(spark, sf):
    from lodgetrail.functions.fees import variant_kind
    from lodgetrail.sources import details, pages

    html = adapters.landed_details(spark, sf)
    listing = F.try_variant_get(pages.embedded_json(F.col("html")), "$.props.pageProps.listing", "variant")
    read = html.select("url", listing.alias("listing")).filter(variant_kind(F.col("listing"), "$") != "")
    return read.select("url", F.explode(details.room_list(F.col("listing"))).alias("room")).select("url", "room.size_sqm")


@query("A19_history_mix", f"WITH {STEPS} SELECT change_class AS change_type, count(*) AS rows FROM classified WHERE change_class <> 'UNCHANGED' GROUP BY ALL")
def a19(spark, sf):
    from lodgetrail.catalog.tracking import first_cards

    steps = observe.classify_steps(observe.price_steps(first_cards(spark, sf)))
    changed = steps.filter(F.col("change_class") != "UNCHANGED").withColumnRenamed("change_class", "change_type")
    return counters.history_mix(changed)


_PROVINCES = values((s, s.replace("-", " ").title()) for s in dims.PROVINCE_SLUGS.values())


@query("A20_cards_per_location", f"""
WITH {CAT}, p(province_slug, display_name) AS (VALUES {_PROVINCES})
SELECT province_slug, count(cat.id) AS cards FROM p LEFT JOIN cat ON cat.province = display_name GROUP BY province_slug
""")
def a20(spark, sf):
    slug = F.lower(F.replace("province", F.lit(" "), F.lit("-")))
    cards = adapters.catalogue(spark, sf).select("id", slug.alias("province_slug"))
    return counters.cards_per_location(cards)
