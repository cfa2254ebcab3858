"""S: scans and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgetrail import adapters
from lodgetrail.catalog.joins import CACHES, address_cache
from lodgetrail.catalog.registry import query
from lodgetrail.catalog.scalars import DETAIL_KINDS, detail_rows
from lodgetrail.catalog.twins import CAT, joined, ts_text
from lodgetrail.functions import geo, text
from lodgetrail.functions.fees import variant_kind
from lodgetrail.operators import collect
from lodgetrail.sources import details, pages, tables


def landed(spark, sf):
    return adapters.landed_lists(spark, sf)


_PAGES = "p AS (SELECT DISTINCT id // 40 AS page_no FROM cat)"


@query("S1_embedded_json", f"""
WITH {CAT}, {_PAGES} SELECT page_no, page_no % 10 NOT IN (8, 9) AS has_json FROM p
""")
def s1(spark, sf):
    return landed(spark, sf).select("page_no", pages.embedded_json(F.col("html")).isNotNull().alias("has_json"))


@query("S1_embedded_json_raw_pages", "SELECT page_id, contains(html, '__NEXT_DATA__') AS has_json FROM pages")
def s1_raw(spark, sf):
    return adapters.table(spark, sf, "pages").select(
        "page_id", pages.embedded_json(F.col("html")).isNotNull().alias("has_json"))


@query("S2_card_explode", f"""
WITH {CAT}
SELECT id // 40 AS page_no, count(*) AS cards, count(*) FILTER (id % 150 NOT IN (49, 99, 149)) AS usable,
  count(*) FILTER (id % 150 IN (49, 99, 149)) AS quarantined FROM cat WHERE (id // 40) % 10 NOT IN (8, 9) GROUP BY 1
""")
def s2(spark, sf):
    cards = pages.explode_cards(pages.with_payload(landed(spark, sf)))
    marked = cards.select("page_no", pages.card_is_valid().alias("ok"))
    return marked.groupBy("page_no").agg(
        F.count(F.lit(1)).alias("cards"), F.count_if("ok").alias("usable"), F.count_if(~F.col("ok")).alias("quarantined"))


@query("S3_card_projection", f"""
WITH {CAT}
SELECT slug, name, url, district, subdistrict, province,
  nullif(concat_ws(' ', subdistrict, nullif(district, ''), province), '') AS address,
  price_monthly_raw, price_monthly_min, price_monthly_max, daily_price_raw,
  CASE WHEN id % 5 <> 0 THEN contract_monthly_raw END AS contract_monthly_raw,
  CASE WHEN id % 17 <> 0 THEN contract_3_month_raw END AS contract_3_month_raw,
  CASE WHEN id % 19 <> 0 THEN contract_6_month_raw END AS contract_6_month_raw,
  has_monthly_contract, id % 5 <> 0 AS from_structured_list, {ts_text('source_updated_at')} AS source_updated_at,
  CASE WHEN id % 2 = 0 THEN '{adapters.CDN}/c/' || id || '.jpg' END AS thumbnail_url, is_verified, has_promotion
FROM cat WHERE (id // 40) % 10 NOT IN (8, 9) AND id % 150 NOT IN (49, 99, 149)
""")
def s3(spark, sf):
    raw = pages.read_cards(landed(spark, sf).withColumnRenamed("url", "page_url"), adapters.SITE, adapters.CDN)
    return raw.select(
        "slug", "name", "url", "district", "subdistrict", "province", "address", "price_monthly_raw",
        "price_monthly_min", "price_monthly_max", "daily_price_raw", "contract_monthly_raw",
        "contract_3_month_raw", "contract_6_month_raw", "has_monthly_contract", "from_structured_list",
        F.date_format("source_updated_at", "yyyy-MM-dd HH:mm:ss").alias("source_updated_at"),
        "thumbnail_url", "is_verified", "has_promotion")


@query("S4_page_count", f"""
WITH {CAT}, {_PAGES}
SELECT page_no, CASE WHEN page_no % 10 IN (8, 9) OR page_no % 6 IN (1, 2, 3) THEN NULL WHEN page_no % 6 = 0 THEN 7 WHEN page_no >= 1 THEN page_no END AS total_pages FROM p
""")
def s4(spark, sf):
    return landed(spark, sf).select("page_no", pages.page_count(pages.embedded_json(F.col("html"))).alias("total_pages"))


@query("S5_last_linked_page", """
SELECT page_id, greatest(1, COALESCE(list_max([TRY_CAST(regexp_extract(u, '/fr/([0-9]+)$', 1) AS BIGINT)
  FOR u IN regexp_extract_all(html || '<a class="x" href="/fr/' || (page_id % 9) || '">', '(?i)<a\\b[^>]*?\\bhref="([^"]*)"', 1)]), 1))::BIGINT AS last_page FROM pages
""")
def s5(spark, sf):
    html = F.concat("html", F.lit('<a class="x" href="/fr/'), F.col("page_id") % 9, F.lit('">'))
    return adapters.table(spark, sf, "pages").select("page_id", pages.last_page(html, "/fr").alias("last_page"))


@query("S6_text_cards", f"""
WITH {CAT}
SELECT id, COALESCE(contract_monthly_raw, '-') AS contract_monthly_raw,
  COALESCE(nullif(contract_3_month_raw, ''), '-') AS contract_3_month_raw,
  CASE WHEN source_updated_at IS NOT NULL THEN strftime(date_trunc('minute', source_updated_at) - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') END AS source_updated_at,
  is_verified, has_promotion, CASE WHEN contract_monthly_raw IS NULL THEN 'false' ELSE 'true' END AS has_monthly_contract,
  CASE WHEN province IS NOT NULL THEN address END AS address, CASE WHEN address IS NOT NULL THEN province END AS province FROM cat
""")
def s6(spark, sf):
    read = pages.read_text_cards(adapters.text_cards(adapters.catalogue(spark, sf)))
    return read.select(
        "id", "contract_monthly_raw", "contract_3_month_raw",
        F.date_format("source_updated_at", "yyyy-MM-dd HH:mm:ss").alias("source_updated_at"),
        "is_verified", "has_promotion", "has_monthly_contract", "address", "province")


@query("S6_page_cards", f"""
WITH {CAT}
SELECT id // 40 AS page_no, slug, name, url, COALESCE(price_monthly_raw, contract_monthly_raw) AS price_monthly_raw,
  COALESCE(contract_monthly_raw, '-') AS contract_monthly_raw, CASE WHEN contract_monthly_raw IS NULL THEN 'false' ELSE 'true' END AS has_monthly_contract,
  CASE WHEN id % 2 = 0 THEN '{adapters.CDN}/c/' || id || '.jpg' END AS thumbnail_url
FROM cat WHERE (id // 40) % 10 IN (8, 9) AND id % 150 NOT IN (49, 99, 149)
""")
def s6_pages(spark, sf):
    read = pages.read_html_cards(landed(spark, sf).withColumnRenamed("url", "page_url"), adapters.SITE, adapters.CDN)
    return read.select(
        "page_no", "slug", "name", "url", "price_monthly_raw", "contract_monthly_raw", "has_monthly_contract", "thumbnail_url")


@query("S6_text_lines_in_documents", """
WITH l AS (SELECT doc_id, [trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS lines FROM documents)
SELECT doc_id, len(lines)::BIGINT AS lines, lines[2] AS after_first FROM l
""")
def s6_docs(spark, sf):
    lines = text.text_lines(F.col("text"))
    return adapters.table(spark, sf, "documents").select(
        "doc_id", F.size(lines).cast("bigint").alias("lines"), F.get(lines, F.lit(1)).alias("after_first"))


@query("S7_detail_scan", f"""
WITH {CAT}, d AS (SELECT *, {DETAIL_KINDS} FROM cat)
SELECT url, NOT gone AND NOT no_json AS has_structured_data, gone AS page_gone,
  CASE WHEN NOT gone THEN id::VARCHAR END AS source_id,
  CASE WHEN gone THEN 0 ELSE 2 END::BIGINT AS images, CASE WHEN gone OR no_json THEN 0 ELSE 1 END::BIGINT AS rooms FROM d
""")
def s7(spark, sf):
    return detail_rows(spark, sf).select(
        "url", "has_structured_data", "page_gone", "source_id",
        F.size("images").cast("bigint").alias("images"), F.size("room_types").cast("bigint").alias("rooms"))


@query("S8_room_list", f"""
WITH {CAT}, d AS (SELECT *, {DETAIL_KINDS} FROM cat)
SELECT url, CASE WHEN id % 3 <> 0 THEN 'Room ' || (id % 3) ELSE 'Unknown' END AS name, 'STUDIO_ROOM' AS room_type,
  price_monthly_min AS monthly_min_thb, price_monthly_max AS monthly_max_thb, contract_monthly_min AS contract_1_month_thb,
  CASE WHEN id % 4 = 1 THEN 'Available' WHEN id % 4 <> 0 THEN 'Not Available' END AS status FROM d WHERE NOT gone AND NOT no_json
""")
def s8(spark, sf):
    html = adapters.landed_details(spark, sf)
    listing = F.try_variant_get(pages.embedded_json(F.col("html")), "$.props.pageProps.listing", "variant")
    found = html.select("url", listing.alias("listing")).filter(variant_kind(F.col("listing"), "$") != "")
    return found.select("url", F.inline(details.room_list(F.col("listing")))).select(
        "url", "name", "room_type", "monthly_min_thb", "monthly_max_thb", "contract_1_month_thb", "status")


@query("S9_amenity_grid", f"WITH {CAT} SELECT url, {joined('amenities')} AS amenities FROM cat")
def s9(spark, sf):
    html = adapters.landed_details(spark, sf)
    # The page lists categories in rule order, which is the catalogue's own.
    return html.select("url", F.array_join(details.icon_amenities(details.amenity_section(F.col("html"))), "|").alias("amenities"))


@query("S10_image_list", """
SELECT page_id, array_to_string([u FOR u IN regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref="([^"]*)"', 1) IF contains(u, 'a')], ' ') AS urls FROM (
  SELECT page_id, regexp_replace(html, '(?i)<a\\b[^>]*?\\bhref="[^"]*"', '<img>', 'g') AS html FROM pages)
UNION ALL SELECT page_id + 1000000, 'pic-' || page_id || '.jpg' FROM pages
""")
def s10(spark, sf):
    raw = adapters.table(spark, sf, "pages")
    none = raw.select("page_id", F.array_join(details.image_list(F.regexp_replace(F.col("html"), r"(?i)<img\b", "<i"), "a"), " ").alias("urls"))
    tagged = F.concat("html", F.lit('<img class="a" src="pic-'), "page_id", F.lit('.jpg?s=1"><div data-src="pic-'), "page_id", F.lit('.jpg">'))
    some = raw.select((F.col("page_id") + 1_000_000).alias("page_id"), F.array_join(details.image_list(tagged, "pic-"), " ").alias("urls"))
    return none.unionByName(some)


@query("S11_geo_scan", f"""
WITH {CAT}, d AS (SELECT *, {DETAIL_KINDS} FROM cat)
SELECT url, CASE WHEN id % 2 = 1 OR NOT no_json THEN CASE WHEN latitude BETWEEN 5 AND 21 AND longitude BETWEEN 97 AND 106 THEN latitude END END AS latitude,
  CASE WHEN id % 2 = 1 OR NOT no_json THEN CASE WHEN latitude BETWEEN 5 AND 21 AND longitude BETWEEN 97 AND 106 THEN longitude END END AS longitude
FROM d WHERE NOT gone
""")
def s11(spark, sf):
    html = adapters.landed_details(spark, sf)
    payload = pages.embedded_json(F.col("html"))
    parsed = html.select(
        "url", "html", payload.isNotNull().alias("has_json"),
        F.try_variant_get(payload, "$.props.pageProps.listing", "variant").alias("listing"))
    kept = parsed.filter(~F.col("has_json") | (variant_kind(F.col("listing"), "$") != ""))
    return details.with_coordinates(kept).select("url", "latitude", "longitude")


@query("S12_table_scan", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
def s12(spark, sf):
    lines = tables.read_table(spark, f"{sf}/lineitem.parquet")
    return lines.filter("l_returnflag = 'R' AND l_quantity > 40").select("l_orderkey", "l_partkey", "l_extendedprice")


@query("S13_coordinate_cache", f"WITH {CACHES} SELECT place_key, round(lat, 6) AS lat, lon FROM acache")
def s13(spark, sf):
    # The cache as JSON objects, one per point, read back as rows.
    objects = address_cache(spark, sf).select(
        F.to_json(F.create_map("place_key", F.struct("lat", "lon"))).alias("document"))
    return tables.explode_points(objects, F.col("document")).select("place_key", F.round("lat", 6).alias("lat"), "lon")


_HOSTS = ("m.ththth.example.net", "thther.example.org", "therha.example.com")


@query("S14_url_admission", f"""
SELECT page_id, regexp_matches(url, '^https?://({'|'.join(h.replace('.', '[.]') for h in _HOSTS)})([/?#:]|$)') AS admitted FROM pages
""")
def s14(spark, sf):
    return adapters.table(spark, sf, "pages").select("page_id", text.admitted_url(F.col("url"), _HOSTS).alias("admitted"))


@query("S5_page_links_by_host", """
WITH u AS (SELECT unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref="([^"]*)"', 1)) AS link FROM pages)
SELECT link, count(*) AS pages FROM u GROUP BY link
""")
def s5_links(spark, sf):
    found = adapters.table(spark, sf, "pages").select(F.explode(pages.links(F.col("html"))).alias("link"))
    return found.groupBy("link").agg(F.count(F.lit(1)).alias("pages"))


@query("S6_address_parts", f"""
WITH {CAT}
SELECT id, CASE WHEN province IS NOT NULL AND address IS NOT NULL THEN province END AS province,
  CASE WHEN province IS NOT NULL AND address IS NOT NULL THEN
    nullif(regexp_extract(trim(replace(address, province, '')), '([^ ]+)$', 1), '') END AS district FROM cat
""")
def s6_parts(spark, sf):
    parts = geo.location_parts(F.col("address"))
    return adapters.catalogue(spark, sf).select("id", parts["province"].alias("province"), parts["district"].alias("district"))


@query("S3_collected_listings", f"""
WITH {CAT}
SELECT slug, price_monthly_min FROM cat WHERE (id // 40) % 10 NOT IN (8, 9) AND id % 150 NOT IN (49, 99, 149)
""")
def s3_collected(spark, sf):
    doubled = landed(spark, sf).withColumnRenamed("url", "page_url")
    doubled = doubled.unionByName(doubled.withColumn("page_no", F.col("page_no") + 100_000))
    cards = pages.read_cards(doubled, adapters.SITE, adapters.CDN)
    return collect.first_occurrence(cards, ["slug"], ["page_no", "card_no"]).select("slug", "price_monthly_min")
