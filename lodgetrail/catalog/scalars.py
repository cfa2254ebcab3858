"""C: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgetrail import adapters, dims
from lodgetrail.catalog.joins import CACHES, address_cache, place_cache
from lodgetrail.catalog.registry import query
from lodgetrail.catalog.twins import CAT, PLACES, contract_num, fmt, joined, quoted
from lodgetrail.functions import amenities, clock, fees, geo, price, rooms, text
from lodgetrail.operators import accounts, location
from lodgetrail.sources import details

_RAWS = ("contract_monthly_raw", "contract_3_month_raw", "contract_6_month_raw", "price_monthly_raw")


def cat(spark, sf):
    return adapters.catalogue(spark, sf)


def stacked(df):
    """(id, raw) over the price texts of every listing."""
    return df.select("id", F.explode(F.array(*_RAWS)).alias("raw"))


STACK = CAT + ", stacked AS (" + " UNION ALL ".join(f"SELECT id, {r} AS raw FROM cat" for r in _RAWS) + ")"


@query("C1_parse_price_range", f"""
WITH {STACK}, n AS (SELECT id, raw, [TRY_CAST(replace(x, ',', '') AS BIGINT) FOR x IN regexp_extract_all(raw, '[0-9,]+') IF replace(x, ',', '') <> ''] AS nums FROM stacked)
SELECT id, raw, nums[1] AS low, COALESCE(nums[2], nums[1]) AS high FROM n
""")
def c1(spark, sf):
    r = price.parse_price_range(F.col("raw"))
    return stacked(cat(spark, sf)).select("id", "raw", r["min"].alias("low"), r["max"].alias("high"))


@query("C2_format_price", f"""
SELECT o_orderkey, {fmt('lo', 'hi', 'THB/month')} AS label FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice)::BIGINT * (o_orderkey % 5) END AS lo,
    CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice)::BIGINT * (o_orderkey % 4) END AS hi FROM orders)
""")
def c2(spark, sf):
    k, base = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    low, high = F.when(k % 7 != 0, base * (k % 5)), F.when(k % 3 != 0, base * (k % 4))
    return adapters.table(spark, sf, "orders").select("o_orderkey", price.format_price(low, high, "THB/month").alias("label"))


@query("C3_contract_number", f"WITH {STACK} SELECT id, raw, {contract_num('raw')} AS amount FROM stacked")
def c3(spark, sf):
    return stacked(cat(spark, sf)).select("id", "raw", price.contract_number(F.col("raw")).alias("amount"))


@query("C4_price_in_eur", f"""
WITH {STACK} SELECT id, raw, round({contract_num('raw')} / {dims.EUR_RATE}::DOUBLE)::BIGINT AS eur FROM stacked
""")
def c4(spark, sf):
    return stacked(cat(spark, sf)).select("id", "raw", price.to_eur(price.contract_number(F.col("raw"))).alias("eur"))


@query("C5_price_value", f"""
WITH {CAT} SELECT id, CASE WHEN COALESCE(contract_monthly_min, price_monthly_min) > 0 THEN COALESCE(contract_monthly_min, price_monthly_min) END AS price FROM cat
""")
def c5(spark, sf):
    return cat(spark, sf).select("id", price.price_value().alias("price"))


def _price_of(field: str | None) -> str:
    def lead(c: str) -> str:
        run = f"regexp_extract({c}, '([0-9,\\s]+)', 1)"
        return f"CASE WHEN trim({c}) NOT IN ('', '-') THEN TRY_CAST(regexp_replace({run}, '[\\s,]', '', 'g') AS BIGINT) END"

    chosen = f"nullif({field}_min, 0), {lead(field + '_raw')}, " if field else ""
    return f"COALESCE({chosen}nullif(price_monthly_min, 0), {lead('contract_monthly_raw')})"


@query("C6_price_of", f"""
WITH {CAT}
SELECT id, {_price_of(None)} AS any_length, {_price_of('contract_monthly')} AS one_month, {_price_of('contract_6_month')} AS six_months FROM cat
""")
def c6(spark, sf):
    return cat(spark, sf).select(
        "id", price.price_of(None).alias("any_length"), price.price_of("contract_monthly").alias("one_month"),
        price.price_of("contract_6_month").alias("six_months"))


@query("C7_ota_comparison", f"""
WITH {CAT}, p AS (SELECT id, nullif(COALESCE(contract_monthly_min, price_monthly_min), 0) AS p FROM cat)
SELECT id, round(p * 3.5::DOUBLE)::BIGINT AS ota_price, round(round(p * 3.5::DOUBLE) / 30)::BIGINT AS ota_night,
  round(p * 3.5::DOUBLE)::BIGINT - p AS savings, 71::BIGINT AS discount_pct FROM p
""")
def c7(spark, sf):
    local = F.coalesce("contract_monthly_min", "price_monthly_min")
    return cat(spark, sf).select("id", *[c.alias(n) for n, c in price.savings(local).items()])


_CHIP_ORDER = quoted(dims.AMENITY_ORDER)


@query("C8_amenity_chips", f"""
WITH {CAT}
SELECT id, array_to_string([x FOR x IN [{_CHIP_ORDER}] IF x <> 'Air Conditioner' AND list_contains(COALESCE(amenities, []), x)], '|') AS chips,
  array_to_string([x FOR x IN [{quoted(dims.CARD_CATEGORIES)}] IF list_contains(COALESCE(amenities, []), x)], '|') AS card_chips FROM cat
""")
def c8(spark, sf):
    full = amenities.chips(F.col("amenities"))
    card = amenities.chips(F.col("amenities"), dims.CARD_CATEGORIES, without=())
    return cat(spark, sf).select("id", F.array_join(full, "|").alias("chips"), F.array_join(card, "|").alias("card_chips"))


# Words that occur in the documents, so that the rule is exercised on them.
_DOC_PATTERNS = {
    "The": ((r"\bthe\b",), (r"no\s*the\b",)),
    "Mail": ((r"@", r"\be-?mail\b"), ()),
    "License": ((r"license",), (r"mit[\s-]*license",)),
    "Long number": ((r"\d{6,}",), ()),
    "Are": ((r"\bare\b", r"\bist\b"), (r"\bund\b",)),
}


def _doc_hit(patterns) -> str:
    def consuming(p: str) -> str:
        p = p.replace(r"[\s-]", r"[\s\p{Z}-]").replace(r"\s*", r"[\s\p{Z}]*")
        if p.startswith(r"\b"):
            p = r"(^|[^\p{L}\p{N}_])" + p[2:]
        return p[:-2] + r"($|[^\p{L}\p{N}_])" if p.endswith(r"\b") else p

    return "(" + " OR ".join(f"regexp_matches(lower(text), '(?i){consuming(p)}')" for p in patterns) + ")" if patterns else "false"


_DOC_CASES = ", ".join(
    f"CASE WHEN {_doc_hit(pos)} AND NOT {_doc_hit(neg)} THEN '{name}' END" for name, (pos, neg) in _DOC_PATTERNS.items())


@query("C9_derive_amenities", f"""
SELECT doc_id, array_to_string([x FOR x IN [{_DOC_CASES}] IF x IS NOT NULL], '|') AS found FROM documents
""")
def c9(spark, sf):
    found = amenities.derive_amenities(F.col("text"), _DOC_PATTERNS)
    return adapters.table(spark, sf, "documents").select("doc_id", F.array_join(found, "|").alias("found"))


_PHRASES = (
    "Fully furnished with air-con and WiFi", "No aircon, fan only", "Unfurnished, no smoking, no pets",
    "swimming pool, gym, CCTV and key card", "มีแอร์ ใกล้รถไฟฟ้า", "ไม่มีแอร์ มีพัดลม fan",
    "7-Eleven next door, washing machine, EV charger", "Air Conditioner : NO, parking",
)
_PHRASE_HITS = (
    "Air Conditioner|Furnished|In-room WIFI", "Fan", "", "Pool|Fitness|Security keycard|CCTV", "Air Conditioner",
    "Fan", "Convenient Store|Laundry|EV Charger", "Parking",
)


@query("C9_derive_amenities_full_table", f"""
SELECT c_custkey, list_extract([{quoted(_PHRASE_HITS)}], (c_custkey % 8)::INT + 1) AS found FROM customer
""")
def c9_full(spark, sf):
    phrase = F.get(dims.literal_array(_PHRASES), (F.col("c_custkey") % 8).cast("int"))
    found = amenities.derive_amenities(F.concat_ws("\n", "c_name", phrase))
    return adapters.table(spark, sf, "customer").select("c_custkey", F.array_join(found, "|").alias("found"))


@query("C10_contact_description", f"""
WITH {CAT}
SELECT id, concat_ws(chr(10), CASE WHEN COALESCE(deposit, '') <> '' THEN 'Deposit: ' || deposit ELSE 'Deposit:' END,
  CASE WHEN electric_price IS NOT NULL AND electric_price NOT IN ('', 'Please contact') THEN 'Electric price: ' || electric_price END,
  'Air Conditioner : ' || CASE WHEN list_contains(COALESCE(amenities, []), 'Air Conditioner') THEN 'YES' ELSE 'NO' END) AS description FROM cat
""")
def c10(spark, sf):
    d = text.contact_description(F.col("deposit"), F.col("electric_price"), F.col("amenities"))
    return cat(spark, sf).select("id", d.alias("description"))


@query("C11_address_text", f"""
WITH {CAT} SELECT id, nullif(concat_ws(' ', nullif(trim(subdistrict), ''), nullif(trim(district), ''), nullif(trim(province), '')), '') AS address FROM cat
""")
def c11(spark, sf):
    padded = F.concat(F.lit("  "), "district", F.lit("\t "))
    return cat(spark, sf).select(
        "id", text.address_text(F.col("subdistrict"), padded, F.col("province")).alias("address"))


@query("C12_url_and_thumbnail", f"""
WITH {CAT} SELECT id, '{adapters.SITE}/en/' || slug AS url, '{adapters.CDN}' || nullif(district, '') AS thumbnail FROM cat
""")
def c12(spark, sf):
    return cat(spark, sf).select(
        "id", text.prefixed(f"{adapters.SITE}/en/", F.col("slug")).alias("url"),
        text.prefixed(adapters.CDN, F.col("district")).alias("thumbnail"))


@query("C13_iso_time", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S')
  WHEN 2 THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') END AS parsed FROM events
""")
def c13(spark, sf):
    k = F.col("event_id") % 4
    raw = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+07:00'"))
        .when(k == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.lit("soon"))
    )
    return adapters.table(spark, sf, "events").select(
        "event_id", F.date_format(clock.parse_iso(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("C14_local_time", """
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN strftime(date_trunc('minute', ts) - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events
""")
def c14(spark, sf):
    raw = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("Updated "), F.date_format("ts", "dd/MM/yyyy  H:mm"), F.lit(" x"))).otherwise("31/31/2024 9:99")
    return adapters.table(spark, sf, "events").select(
        "event_id", F.date_format(clock.parse_local(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("C15_to_utc", "SELECT o_orderkey, strftime(o_orderdate - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS utc FROM orders")
def c15(spark, sf):
    aware = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+07:00")).cast("timestamp")
    return adapters.table(spark, sf, "orders").select("o_orderkey", F.date_format(aware, "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("C16_local_day_start", """
SELECT event_id, strftime(date_trunc('day', ts + INTERVAL 7 HOUR) - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS day_start FROM events
""")
def c16(spark, sf):
    start = clock.local_day_start(F.col("ts").cast("timestamp"))
    return adapters.table(spark, sf, "events").select("event_id", F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("day_start"))


_HANDLES = (
    "%40asset_", " Line ID : host_", "Unavailable", "0613963159", "Phone0971538717", "tel: kate_",
    "-", "25apartment_", "ไม่มี", "a+b%2Fc_", "50%off_", "~0620477711",
)
_CLEANED = ("@asset_", "host_", None, None, None, "kate_", None, "25apartment_", None, "a+b/c_", "50%off_", None)



@query("C17_clean_line_id", "SELECT c_custkey, CASE c_custkey % 12 " + " ".join(
    f"WHEN {i} THEN " + ("NULL" if c is None else f"'{c}' || c_custkey") for i, c in enumerate(_CLEANED)) + " END AS line_id FROM customer")
def c17(spark, sf):
    k = (F.col("c_custkey") % 12).cast("int")
    handle = F.get(dims.literal_array(_HANDLES), k)
    raw = F.when(F.endswith(handle, F.lit("_")), F.concat(handle, "c_custkey")).otherwise(handle)
    return adapters.table(spark, sf, "customer").select("c_custkey", text.clean_line_id(raw).alias("line_id"))


DETAIL_KINDS = "id % 25 = 0 AND id % 10 <> 3 AS gone, id % 10 = 3 AS no_json"
_OWN_CONTACT = "NOT no_json AND (phone IS NOT NULL OR line_id IS NOT NULL OR whatsapp IS NOT NULL OR email IS NOT NULL)"


def detail_rows(spark, sf):
    return details.read_details(adapters.landed_details(spark, sf), f"{adapters.CDN}/listing_picture")


@query("C18_contact_pick", f"""
WITH {CAT}, d AS (SELECT *, {DETAIL_KINDS} FROM cat)
SELECT url, phone, line_id, CASE WHEN id % 2 = 1 THEN whatsapp END AS whatsapp, email FROM d WHERE NOT gone AND {_OWN_CONTACT}
""")
def c18(spark, sf):
    own = F.col("phone").isNotNull() | ~F.col("line_id").startswith("@page") | ~F.col("email").startswith("desk")
    return detail_rows(spark, sf).filter(F.col("has_structured_data") & F.coalesce(own, F.lit(True))).select(
        "url", "phone", "line_id", "whatsapp", "email")


@query("C19_contact_fallback", f"""
WITH {CAT}, d AS (SELECT *, {DETAIL_KINDS} FROM cat)
SELECT url, NULL::VARCHAR AS phone, '@page' || id AS line_id,
  CASE WHEN id % 2 = 1 THEN COALESCE(whatsapp, '0') END AS whatsapp, 'desk' || id || '@example.com' AS email FROM d WHERE no_json
""")
def c19(spark, sf):
    return detail_rows(spark, sf).filter("NOT has_structured_data AND NOT page_gone").select(
        "url", "phone", "line_id", "whatsapp", "email")


@query("C20_fee_format", f"""
WITH {CAT}, d AS (SELECT *, {DETAIL_KINDS} FROM cat)
SELECT url, CASE id % 3 WHEN 0 THEN '1 month' ELSE (id % 3 + 1) || ' months' END AS advance_payment,
  CASE id % 3 WHEN 0 THEN 'Please contact' WHEN 1 THEN '8 THB/unit' ELSE 'as charged by Electricity Authority' END AS electric_price,
  '100 THB/person' AS water_price, 'Included' AS service_fee FROM d WHERE NOT gone AND NOT no_json
""")
def c20(spark, sf):
    return detail_rows(spark, sf).filter("has_structured_data").select(
        "url", "advance_payment", "electric_price", "water_price", "service_fee")


@query("C21_deposit_format", f"""
WITH {CAT}, d AS (SELECT *, {DETAIL_KINDS} FROM cat)
SELECT url, CASE id % 4 WHEN 0 THEN 'Please contact' WHEN 1 THEN '2 month' WHEN 2 THEN '5000 Baht' END AS deposit FROM d WHERE NOT gone AND NOT no_json
""")
def c21(spark, sf):
    return detail_rows(spark, sf).filter("has_structured_data").select("url", "deposit")


@query("C22_fee_labels", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey || ' THB' END AS water_price,
  CASE WHEN c_custkey % 3 = 0 THEN 'flat ' || c_mktsegment END AS electric_price, NULL::VARCHAR AS deposit FROM customer
""")
def c22(spark, sf):
    html = F.concat(
        F.lit("<div>"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("<p>Water  price</p> <p> "), "c_custkey", F.lit(" <b>THB</b></p>"))).otherwise(""),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("<span>Electric price</span><span>flat "), "c_mktsegment", F.lit("</span>"))).otherwise(""),
        F.lit("<p>Deposit</p><p>ignored</p></div>"))
    paged = adapters.table(spark, sf, "customer").select("c_custkey", html.alias("html"), F.parse_json(F.lit("{}")).alias("listing"))
    read = fees.fees(F.col("listing"), F.col("html"))
    return paged.select("c_custkey", *[read[n].alias(n) for n in ("water_price", "electric_price", "deposit")])


@query("C23_description_clean", r"""
SELECT doc_id, nullif(trim(replace(text, chr(65533), ''), ' ' || chr(9) || chr(10) || chr(13)), '') AS cleaned FROM documents
""")
def c23(spark, sf):
    dirty = F.concat(F.lit(".css-1ab{color:red;}  "), "text", F.lit("�\n.css-x_y {a:b}"))
    return adapters.table(spark, sf, "documents").select("doc_id", text.clean_description(dirty).alias("cleaned"))


@query("C24_description_section", f"""
WITH {CAT}, d AS (SELECT *, {DETAIL_KINDS} FROM cat)
SELECT url, 'Quiet room' || chr(10) || 'near ' || COALESCE(province, 'town') AS description FROM d WHERE NOT gone
""")
def c24(spark, sf):
    return detail_rows(spark, sf).filter("NOT page_gone").select("url", "description")


@query("C25_listing_number", f"WITH {CAT}, d AS (SELECT *, {DETAIL_KINDS} FROM cat) SELECT url, id::VARCHAR AS source_id FROM d WHERE NOT gone")
def c25(spark, sf):
    return detail_rows(spark, sf).filter("NOT page_gone").select("url", "source_id")


def _pad(byte: int) -> str:
    return "".join(f"\\x{b ^ byte:02X}" for b in adapters.SECRET.encode().ljust(64, b"\0"))


_HMAC = (
    f"sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || ('geo:' || id)::BLOB)))"
)


@query("C26_geo_fuzz", f"""
WITH {CAT}, h AS (SELECT id, latitude, longitude, {_HMAC} AS d FROM cat),
u AS (SELECT *, ('0x' || substr(d, 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 * pi() AS angle,
  100 + ('0x' || substr(d, 9, 8))::BIGINT / 4294967296.0::DOUBLE * 200 AS dist FROM h)
SELECT id, round(latitude + dist * cos(angle) / 111320, 5) AS lat,
  round(longitude + dist * sin(angle) / (111320 * cos(radians(latitude))), 5) AS lon FROM u
""")
def c26(spark, sf):
    point = geo.approximate_position(F.col("id"), F.col("latitude"), F.col("longitude"), adapters.SECRET)
    return cat(spark, sf).select("id", point["lat"].alias("lat"), point["lon"].alias("lon"))


@query("C27_city_region_district", f"WITH {PLACES} SELECT id, city, region, quarter FROM named")
def c27(spark, sf):
    return location.with_place_names(cat(spark, sf)).select("id", "city", "region", "quarter")


@query("C28_place_keys", f"""
WITH {CAT} SELECT id, lower(trim(COALESCE(name, ''))) AS name_key,
  concat_ws('|', lower(trim(COALESCE(subdistrict, ''))), lower(trim(COALESCE(district, ''))), lower(trim(COALESCE(province, '')))) AS place_key FROM cat
""")
def c28(spark, sf):
    return cat(spark, sf).select("id", text.text_key(F.col("name")).alias("name_key"), location.place_key_of().alias("place_key"))


@query("C29_map_query_and_zoom", f"""
WITH {CACHES}, placed AS (
  SELECT id, address, subdistrict, district, province, COALESCE(latitude, a.lat, p.lat) AS mlat,
    CASE WHEN latitude IS NOT NULL THEN true WHEN a.lat IS NOT NULL THEN regexp_matches(address, '[0-9]') WHEN p.lat IS NOT NULL THEN false END AS precise
  FROM keyed LEFT JOIN acache a ON a.place_key = ak LEFT JOIN pcache p ON p.place_key = pk)
SELECT id, CASE WHEN mlat IS NULL THEN 13 WHEN precise THEN 17 ELSE 15 END::BIGINT AS zoom,
  CASE WHEN mlat IS NULL THEN replace(replace(COALESCE(nullif(address, ''), nullif(concat_ws(', ', subdistrict, nullif(district, ''), province), '')) || ', Thailand', ' ', '%20'), ',', '%2C') END AS text_query FROM placed
""")
def c29(spark, sf):
    placed = location.with_map_points(cat(spark, sf), address_cache(spark, sf), place_cache(spark, sf))
    wanted = geo.map_query(F.col("map_lat"), F.col("map_lon"))
    return placed.select(
        "id", geo.map_zoom(F.col("map_lat"), F.col("precise")).alias("zoom"),
        F.when(F.col("map_lat").isNull(), text.encode_component(wanted)).alias("text_query"))


def roomed(spark, sf):
    """Listings with two rooms each, one of them not always available."""
    def room(name, kind, size, low, status):
        nothing = F.lit(None).cast("bigint")
        return F.struct(
            name.alias("name"), kind.alias("room_type"), size.alias("size_sqm"), low.alias("monthly_min_thb"),
            nothing.alias("monthly_max_thb"), nothing.alias("contract_1_month_thb"), nothing.alias("contract_3_month_thb"),
            nothing.alias("contract_6_month_thb"), nothing.alias("daily_thb"), status.alias("status"))

    i = F.col("id")
    first = room(F.lit("Deluxe"), F.lit("STUDIO_ROOM"), (i % 30 + 20).cast("double"), F.col("price_monthly_min"),
                 F.when(i % 3 == 0, "Not Available").when(i % 3 == 1, " available ").otherwise(F.lit(None)))
    second = room(F.lit("Unknown"), F.lit("one_bed"), F.lit(None).cast("double"), F.when(i % 2 == 0, F.lit(5000).cast("bigint")), F.lit("Not Available"))
    return cat(spark, sf).select("id", "price_monthly_min", F.array(first, second).alias("room_types"))


_ROOM_SETS = """
r AS (SELECT id, price_monthly_min IS NOT NULL AS p1, id % 2 = 0 AS p2, price_monthly_min IS NOT NULL AND id % 3 <> 0 AS a1 FROM cat),
c AS (SELECT *, CASE WHEN a1 THEN 1 ELSE p1::INT + p2::INT END AS n FROM r)"""


@query("C30_contract_rooms", f"WITH {CAT}, {_ROOM_SETS} SELECT id, n::BIGINT AS rooms FROM c")
def c30(spark, sf):
    return roomed(spark, sf).select("id", F.size(rooms.contract_rooms(F.col("room_types"))).cast("bigint").alias("rooms"))


@query("C31_section_title", f"""
WITH {CAT}, {_ROOM_SETS}
SELECT id, CASE WHEN n <> 1 THEN 'Room Type' WHEN a1 OR p1 THEN 'Deluxe · Studio room · ' || (id % 30 + 20) || ' m²' ELSE 'One bed' END AS title FROM c
""")
def c31(spark, sf):
    return roomed(spark, sf).select("id", rooms.section_title(F.col("room_types")).alias("title"))


@query("C32_phone_format", f"""
WITH {CAT}
SELECT id, length(COALESCE(whatsapp, '')) >= 5 AS real_phone,
  '(+' || substr(COALESCE(whatsapp, ''), 1, 2) || ') ' || CASE WHEN length(whatsapp) = 11
    THEN substr(whatsapp, 3, 2) || ' ' || substr(whatsapp, 5, 3) || ' ' || substr(whatsapp, 8, 4) ELSE '' END AS shown,
  '(+' || substr(COALESCE(phone, ''), 1, 2) || ') ' || COALESCE(substr(phone, 3, 3) || ' ' || substr(phone, 6, 3) || ' ' || substr(phone, 9, 3), '') AS grouped FROM cat
""")
def c32(spark, sf):
    return cat(spark, sf).select(
        "id", text.has_real_phone(F.col("whatsapp")).alias("real_phone"),
        text.format_phone(F.col("whatsapp")).alias("shown"), text.format_phone(F.col("phone")).alias("grouped"))


@query("C33_safe_link", """
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN url END AS link FROM pages
""")
def c33(spark, sf):
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url"))
    return adapters.table(spark, sf, "pages").select("page_id", text.safe_link(raw).alias("link"))


_LINES = ("Soi 4 Nana Road {p} 10110", "near Taksin bridge, {p}", "Nan view, {p}", "no place here")


@query("C34_province_names", f"""
WITH {CAT}, l AS (SELECT id, COALESCE(province, 'Bangkok') AS p FROM cat)
SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE p END AS province FROM l
""")
def c34(spark, sf):
    p = F.coalesce("province", F.lit("Bangkok"))
    line = F.replace(F.get(dims.literal_array(_LINES), (F.col("id") % 4).cast("int")), F.lit("{p}"), F.upper(p))
    return cat(spark, sf).select("id", geo.province_in(line).alias("province"))


@query("C35_list_codec", f"""
WITH {CAT}
SELECT id, CASE WHEN amenities IS NOT NULL THEN '["' || array_to_string(amenities, '","') || '"]' END AS stored, {joined('amenities')} AS read_back FROM cat
""")
def c35(spark, sf):
    stored = text.list_json(F.coalesce("amenities", F.array().cast("array<string>")))
    return cat(spark, sf).select("id", stored.alias("stored"), F.array_join(text.json_list(stored), "|").alias("read_back"))


@query("C36_email_and_token", f"WITH {CAT} SELECT id, lower(trim(email)) AS email, sha256(slug) AS token FROM cat")
def c36(spark, sf):
    return cat(spark, sf).select(
        "id", text.email_key(F.col("email")).alias("email"), text.token_digest(F.col("slug")).alias("token"))


@query("C37_entitlement", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS entitled FROM events
""")
def c37(spark, sf):
    k = F.col("event_id") % 4
    status = F.when(k == 0, "trialing").when(k == 1, "past_due").when(k == 2, "active")
    return adapters.table(spark, sf, "events").select("event_id", accounts.is_entitled(status).alias("entitled"))


@query("C38_epoch_to_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS period_end FROM events")
def c38(spark, sf):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return adapters.table(spark, sf, "events").select(
        "event_id", F.date_format(clock.from_epoch(seconds), "yyyy-MM-dd HH:mm:ss").alias("period_end"))


@query("C39_client_key", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (user_id % 250) WHEN event_id % 3 = 1 THEN 'c' || user_id ELSE 'unknown' END AS client FROM events
""")
def c39(spark, sf):
    k, u = F.col("event_id") % 3, F.col("user_id")
    forwarded = F.when(k == 0, F.concat(F.lit("1.2.3.4, 10.0.0."), u % 250, F.lit(" ,, 9.9.9.9"))).otherwise("8.8.8.8")
    socket = F.when(k == 1, F.concat(F.lit("c"), u))
    return adapters.table(spark, sf, "events").select("event_id", text.client_key(forwarded, socket, 2).alias("client"))


@query("C40_badges", f"""
WITH {CAT}
SELECT id, has_monthly_contract = 'true' AND {contract_num('contract_monthly_raw')} IS NOT NULL AS badge_1_month,
  {contract_num('contract_3_month_raw')} IS NOT NULL AS badge_3_month, {contract_num('contract_6_month_raw')} IS NOT NULL AS badge_6_month FROM cat
""")
def c40(spark, sf):
    return cat(spark, sf).select("id", *[c.alias(n) for n, c in price.badges().items()])
