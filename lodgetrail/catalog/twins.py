"""SQL texts of the adapters, as common table expressions for the twins."""

from __future__ import annotations

from lodgetrail import dims
from lodgetrail.adapters import (
    AMENITY_RULES, AS_OF, CDN, CORNERS, PLACE_NAMES, SCAN_SECONDS, SEGMENT_DISTRICTS, SITE, four_bits,
)


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def values(rows) -> str:
    """A VALUES list of text and numbers."""
    def one(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else quoted([v])

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def fmt(low: str, high: str, unit: str) -> str:
    return (
        f"CASE WHEN {low} IS NULL OR ({low} = 0 AND COALESCE({high}, 0) = 0) THEN NULL "
        f"WHEN {high} IS NULL OR {low} = {high} THEN format('{{:,}}', {low}) || ' {unit}' "
        f"ELSE format('{{:,}}', {low}) || ' - ' || format('{{:,}}', {high}) || ' {unit}' END"
    )


_SEGMENTS = " ".join(f"WHEN '{s}' THEN '{d}'" for s, d in SEGMENT_DISTRICTS.items())
_AMENITIES = ", ".join(f"CASE WHEN k % {m} < {b} THEN '{n}' END" for n, m, b in AMENITY_RULES)


def _order_price(priority: str, fn: str) -> str:
    return f"{fn}(CASE WHEN o_orderpriority = '{priority}' THEN floor(o_totalprice / 20)::BIGINT END)"


CAT = f"""
op AS (
  SELECT o_custkey, max(o_orderdate) AS source_updated_at,
    {_order_price('1-URGENT', 'min')} AS c1_min, {_order_price('1-URGENT', 'max')} AS c1_max,
    {_order_price('2-HIGH', 'min')} AS c3_min, {_order_price('2-HIGH', 'max')} AS c3_max,
    {_order_price('3-MEDIUM', 'min')} AS c6_min, {_order_price('3-MEDIUM', 'max')} AS c6_max
  FROM orders GROUP BY o_custkey),
base AS (
  SELECT c_custkey AS k, c_name, c_acctbal, c_mktsegment, n_nationkey, op.*
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN op ON o_custkey = c_custkey),
shaped AS (
  SELECT k AS id, 'listing-' || k AS slug, 'list' AS source,
    CASE WHEN k % 3 <> 0 THEN k::VARCHAR END AS source_id,
    c_name AS name, '{SITE}/en/listing-' || k AS url,
    list_extract([{quoted(PLACE_NAMES)}], n_nationkey + 1) AS province,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN ''
      WHEN k % 3 = 0 THEN CASE c_mktsegment {_SEGMENTS} END ELSE 'Mueang ' || (k % 4) END AS district,
    CASE WHEN k % 5 <> 0 THEN 'Tambon ' || (k % 23) END AS subdistrict,
    CASE WHEN k % 4 = 0 THEN (k % 200) || ' Sukhumvit Road' WHEN k % 4 = 1 THEN 'Beach Road' END AS street,
    CASE WHEN floor(c_acctbal) > 0 THEN (floor(c_acctbal) * 3)::BIGINT END AS price_monthly_min,
    CASE WHEN k % 10 <> 0 AND floor(c_acctbal) > 0 THEN (floor(c_acctbal) * 3)::BIGINT + (k % 5) * 500 END AS price_monthly_max,
    CASE WHEN k % 4 = 0 THEN 300 + k % 700 END AS daily_price_min,
    CASE WHEN k % 4 = 0 THEN 300 + k % 700 END AS daily_price_max,
    CASE WHEN k % 7 = 0 THEN 'removed' ELSE 'active' END AS status,
    k % 3 = 0 AS is_verified, k % 6 = 1 AS has_promotion,
    [x FOR x IN [{_AMENITIES}] IF x IS NOT NULL] AS amenities,
    CASE k % 4 WHEN 0 THEN 'Please contact' WHEN 1 THEN '2 month' WHEN 2 THEN '5000 Baht' END AS deposit,
    CASE k % 3 WHEN 0 THEN 'Please contact' WHEN 1 THEN '8 THB/unit' END AS electric_price,
    CASE WHEN k % 8 <> 0 THEN '08' || lpad((k % 100000000)::VARCHAR, 8, '0') END AS phone,
    CASE WHEN k % 4 = 0 THEN NULL WHEN k % 3 = 1 THEN 'bigagency' ELSE 'agency' || (k % 97) END AS line_id,
    CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN '66' ELSE '668' || lpad((k % 5000)::VARCHAR, 8, '0') END AS whatsapp,
    CASE WHEN k % 5 <> 0 THEN 'Host' || k || '@Example.com ' END AS email,
    CASE WHEN k % 9 <> 0 THEN 5 + ((k * 37) % 1600) / 100.0::DOUBLE END AS latitude,
    CASE WHEN k % 9 <> 0 THEN 97 + ((k * 53) % 900) / 100.0::DOUBLE END AS longitude,
    TIMESTAMP '{AS_OF}' - (k % 96) * INTERVAL 1 HOUR AS first_seen_at,
    CASE WHEN k % 3 <> 0 THEN TIMESTAMP '{AS_OF}' - (k % 15) * INTERVAL 1 DAY END AS detail_scraped_at,
    k % 3 AS missing_scan_count, source_updated_at,
    c1_min, c1_max, c3_min, c3_max, c6_min, c6_max
  FROM base),
cat AS (
  SELECT shaped.* EXCLUDE (c1_min, c1_max, c3_min, c3_max, c6_min, c6_max, street, amenities),
    CASE WHEN len(amenities) > 0 THEN amenities END AS amenities,
    CASE WHEN id % 29 <> 0 THEN nullif(concat_ws(' ', street, subdistrict, nullif(district, ''), province), '') END AS address,
    {fmt('price_monthly_min', 'price_monthly_max', 'THB/month')} AS price_monthly_raw,
    {fmt('daily_price_min', 'daily_price_max', 'THB/day')} AS daily_price_raw,
    {fmt('c1_min', 'c1_max', 'THB/month')} AS contract_monthly_raw,
    c1_min AS contract_monthly_min, c1_max AS contract_monthly_max,
    CASE WHEN id % 17 = 0 THEN '-' ELSE {fmt('c3_min', 'c3_max', 'THB/month')} END AS contract_3_month_raw,
    CASE WHEN id % 17 <> 0 THEN c3_min END AS contract_3_month_min,
    CASE WHEN id % 17 <> 0 THEN c3_max END AS contract_3_month_max,
    CASE WHEN id % 19 = 0 THEN '' ELSE {fmt('c6_min', 'c6_max', 'THB/month')} END AS contract_6_month_raw,
    CASE WHEN id % 19 <> 0 THEN c6_min END AS contract_6_month_min,
    CASE WHEN id % 19 <> 0 THEN c6_max END AS contract_6_month_max,
    CASE WHEN id % 5 = 0 THEN 'unknown' WHEN c1_min IS NOT NULL THEN 'true' ELSE 'false' END AS has_monthly_contract
  FROM shaped)"""

OBS = f"""
obs AS (
  SELECT event_id, ts, user_id AS slug,
    (floor((epoch_us(ts) // 1000000 - epoch_us(TIMESTAMP '2024-01-01') // 1000000) / {SCAN_SECONDS}) + 1)::BIGINT AS scan_no,
    (floor(value / 100) * 100)::BIGINT AS price, 'page-' || event_type AS page_url
  FROM events)"""

# First card of a slug in a scan.
FIRSTS = OBS + """,
firsts AS (
  SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY scan_no, slug ORDER BY ts, event_id) = 1)"""

STEPS = FIRSTS + f""",
steps AS (
  SELECT slug, scan_no, price, ts,
    lag(price) OVER w AS old_price, lag(scan_no) OVER w AS old_scan_no, lead(scan_no) OVER w AS next_scan_no
  FROM firsts WINDOW w AS (PARTITION BY slug ORDER BY scan_no)),
classified AS (
  SELECT *, scan_no - old_scan_no - 1 AS missed_scans,
    CASE WHEN old_scan_no IS NULL THEN 'NEW' WHEN price <> old_price THEN 'PRICE_CHANGED'
      WHEN scan_no - old_scan_no - 1 >= {dims.REMOVED_AFTER_MISSING_SCANS} THEN 'REACTIVATED'
      ELSE 'UNCHANGED' END AS change_class
  FROM steps)"""

IMG = f"""
img AS (
  SELECT l_orderkey AS listing_id, l_orderkey * 100000000 + round(l_extendedprice * 100)::BIGINT AS image_id,
    '{CDN}/p/' || l_partkey || '.jpg' AS image_url, l_linenumber::BIGINT AS position,
    CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS excluded,
    CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS reviewed_at,
    l_tax > 0.05 AS has_qr, l_discount > 0.06 AS has_text,
    CASE WHEN l_quantity > 45 THEN 'fetch_error' END AS error
  FROM lineitem)"""


def _corner_sql(corner: int) -> str:
    return " + ".join(
        f"CASE WHEN embedding[{corner * 16 + i + 1}] > 0 THEN ({four_bits(i)})::BIGINT ELSE 0 END" for i in range(16))


VEC = "vec AS (" + " UNION ALL ".join(
    f"SELECT vec_id AS image_id, (label % 2)::BIGINT AS listing_id, '{name}' AS corner, ({_corner_sql(i)})::BIGINT AS hash FROM embeddings"
    for i, name in enumerate(CORNERS)) + ")"

BILL = """
bill_all AS (
  SELECT event_id, ts,
    CASE event_type WHEN 'signup' THEN 'checkout.session.completed' WHEN 'view' THEN 'customer.subscription.updated'
      WHEN 'click' THEN 'customer.subscription.deleted' WHEN 'error' THEN 'invoice.payment_failed'
      ELSE 'charge.refunded' END AS event_type,
    'cus_' || user_id AS customer_id,
    CASE WHEN event_type NOT IN ('error', 'purchase') THEN 'sub_' || user_id || '_' || floor(value / 40)::BIGINT END AS subscription_id,
    CASE WHEN event_id % 3 <> 0 THEN user_id END AS user_id,
    CASE event_id % 4 WHEN 0 THEN 'trialing' WHEN 1 THEN 'past_due' ELSE 'active' END AS status
  FROM events)"""

_MERGE = values(dims.CITY_MERGE.items())
_REGION = values((k.lower(), v) for k, v in dims.CITY_REGION.items())
_PROMOTED = " ".join(
    f"WHEN contains(lower(trim(COALESCE(district, ''))), '{n.lower()}') THEN '{c}'" for n, c in dims.DISTRICT_AS_CITY.items())

PLACES = CAT + f""",
merges(src, dst) AS (VALUES {_MERGE}),
regions(ck, region_name) AS (VALUES {_REGION}),
placed AS (
  SELECT cat.*,
    CASE {_PROMOTED} ELSE COALESCE(dst, trim(COALESCE(province, ''))) END AS city,
    trim(COALESCE(nullif(district, ''), subdistrict, '')) AS quarter
  FROM cat LEFT JOIN merges ON src = trim(COALESCE(province, ''))),
named AS (
  SELECT placed.*, COALESCE(region_name, '') AS region
  FROM placed LEFT JOIN regions ON ck = lower(trim(city)))"""


def number_list(raw: str) -> str:
    """Positive numbers of a price text."""
    return (
        f"[n FOR n IN [TRY_CAST(replace(x, ',', '') AS BIGINT) FOR x IN regexp_extract_all({raw}, '[0-9,]+')] IF n > 0]"
    )


def contract_num(raw: str) -> str:
    n = number_list(raw)
    return (
        f"CASE WHEN ({n})[1] >= {dims.MIN_VALID_PRICE} THEN ({n})[1] "
        f"WHEN ({n})[-1] >= {dims.MIN_VALID_PRICE} THEN ({n})[-1] END"
    )


def ts_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def joined(c: str) -> str:
    return f"COALESCE(array_to_string({c}, '|'), '')"

#: Requests walked one after the other per client: an admitted one is remembered for the window.
QUOTA = """
WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
walk AS (
  SELECT DISTINCT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS i, CAST([] AS BIGINT[]) AS accepted, NULL::BOOLEAN AS admitted, NULL::BIGINT AS retry_after FROM events
  UNION ALL
  SELECT user_id, event_id, i, CASE WHEN len(live) < 3 THEN list_append(live, us) ELSE live END, len(live) < 3,
    CASE WHEN len(live) >= 3 THEN greatest(1, (live[1] + 86400000000 - us) // 1000000 + 1) END
  FROM (SELECT r.user_id, r.event_id, r.i, r.us, list_filter(walk.accepted, lambda a: a >= r.us - 86400000000) AS live
    FROM walk JOIN r ON r.user_id = walk.user_id AND r.i = walk.i + 1))
SELECT user_id AS client, event_id AS request_id, admitted, retry_after FROM walk WHERE event_id IS NOT NULL
"""
