"""U: set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgetrail import adapters
from lodgetrail.catalog.joins import _SPLIT, CACHES, address_cache, place_cache, split
from lodgetrail.catalog.registry import query
from lodgetrail.catalog.twins import CAT
from lodgetrail.operators import collect, location
from lodgetrail.sources import details, pages


@query("U1_precedence_union", f"""
WITH {CAT},
main AS (SELECT slug, id, 'main' AS origin FROM cat WHERE id % 2 = 0),
loc AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY card_no) AS rn FROM (
  SELECT slug, id, 1 AS card_no, has_monthly_contract, contract_3_month_raw, contract_6_month_raw FROM cat WHERE id % 3 = 0
  UNION ALL SELECT slug, id, 0, 'false', NULL, NULL FROM cat WHERE id % 9 = 0))
SELECT slug, origin FROM main
UNION ALL SELECT slug, 'location' FROM loc WHERE rn = 1 AND slug NOT IN (SELECT slug FROM main)
  AND (has_monthly_contract = 'true' OR COALESCE(trim(contract_3_month_raw) NOT IN ('', '-'), false) OR COALESCE(trim(contract_6_month_raw) NOT IN ('', '-'), false))
""")
def u1(spark, sf):
    cat = adapters.catalogue(spark, sf).select("slug", "id", "has_monthly_contract", "contract_3_month_raw", "contract_6_month_raw")
    nothing = F.lit(None).cast("string")
    main = cat.filter("id % 2 = 0").withColumns({"card_no": F.lit(1), "origin": F.lit("main")})
    third = cat.filter("id % 3 = 0").withColumns({"card_no": F.lit(1), "origin": F.lit("location")})
    early = third.filter("id % 9 = 0").withColumns({
        "card_no": F.lit(0), "has_monthly_contract": F.lit("false"),
        "contract_3_month_raw": nothing, "contract_6_month_raw": nothing})
    return collect.precedence_union(main, third.unionByName(early), ["card_no"]).select("slug", "origin")


@query("U2_distinct_keys", f"""
WITH {CAT}
SELECT DISTINCT subdistrict, district, province FROM cat WHERE COALESCE(district, '') <> ''
""")
def u2(spark, sf):
    places = adapters.catalogue(spark, sf).filter(F.coalesce("district", F.lit("")) != "")
    return places.select("subdistrict", "district", "province").distinct()


@query("U3_active_minus_seen", f"""
WITH {_SPLIT} SELECT slug FROM st WHERE status = 'active' EXCEPT SELECT slug FROM ba
""")
def u3(spark, sf):
    state, batch = split(spark, sf)
    return state.filter("status = 'active'").select("slug").subtract(batch.select("slug"))


@query("U4_array_distinct", """
WITH l AS (SELECT page_id, [split_part(u, '?', 1) FOR u IN regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref="([^"]*)"', 1)] AS urls FROM pages)
SELECT page_id, len(urls) AS links, len(list_distinct(urls)) AS distinct_links, list_contains(urls, '/the') AS has_the FROM l
""")
def u4(spark, sf):
    urls = pages.links(F.col("html"))
    bare = F.transform(urls, lambda u: F.substring_index(u, "?", 1))
    return adapters.table(spark, sf, "pages").select(
        "page_id", F.size(urls).cast("bigint").alias("links"),
        F.size(details.distinct_addresses(urls)).cast("bigint").alias("distinct_links"),
        F.array_contains(bare, "/the").alias("has_the"))


@query("U5_cache_union", f"""
WITH {CACHES}
SELECT place_key, round(lat, 6) AS lat, lon FROM acache
UNION ALL SELECT place_key, round(lat, 6), lon FROM pcache WHERE place_key NOT IN (SELECT place_key FROM acache)
""")
def u5(spark, sf):
    points = location.upsert_points(address_cache(spark, sf), place_cache(spark, sf))
    return points.select("place_key", F.round("lat", 6).alias("lat"), "lon")
