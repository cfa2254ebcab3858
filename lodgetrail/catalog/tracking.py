"""M: merge and change tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetrail import adapters, schemas
from lodgetrail.catalog.predicates import scans
from lodgetrail.catalog.registry import query
from lodgetrail.catalog.twins import BILL, CAT, IMG, OBS, STEPS, VEC, ts_text
from lodgetrail.functions import clock
from lodgetrail.operators import accounts, collect, contacts, images, merge, observe, repair
from lodgetrail.plans import counters
from lodgetrail.session import new_work_dir, stage

SCAN_AT = "2024-02-01 00:00:00"


# ---- many scans at once: the observations -----------------------------------

@query("M8_change_class_per_scan", f"""
WITH {STEPS} SELECT scan_no, change_class, count(*) AS listings FROM classified GROUP BY ALL
""")
def m8_scans(spark, sf):
    return observe.changes_per_scan(observe.classify_steps(observe.price_steps(first_cards(spark, sf))))


def first_cards(spark, sf) -> DataFrame:
    return collect.first_occurrence(adapters.observations(spark, sf), ["scan_no", "slug"], ["ts", "event_id"])


@query("M9_removals_over_scans", f"""
WITH {STEPS}, ends AS (SELECT max(scan_no) AS last_scan FROM firsts)
SELECT slug, scan_no + 3 AS scan_no FROM classified, ends
WHERE COALESCE(next_scan_no, last_scan + 1) - scan_no - 1 >= 3
""")
def m9_scans(spark, sf):
    last = adapters.observations(spark, sf).agg(F.max("scan_no")).scalar()
    return observe.removals(first_cards(spark, sf), last)


# ---- one scan: the catalogue as stored state, a changed catalogue as batch ---

def stored(spark, sf) -> DataFrame:
    """Nine tenths of the catalogue as it was stored before the scan."""
    cat = adapters.catalogue(spark, sf).filter(F.col("id") % 10 != 1)
    state = schemas.conform(cat.withColumn("advance_payment", F.lit("1 month")), schemas.STATE_SCHEMA)
    return state.withColumn("content_hash", merge.content_hash())


def scanned(spark, sf) -> DataFrame:
    """Four fifths of the catalogue, changed by rules on the id."""
    cat = adapters.catalogue(spark, sf).filter(F.col("id") % 5 != 4)
    i = F.col("id")
    gone_price = i % 12 == 5
    raised = F.when(i % 3 == 0, 500).otherwise(0)
    dropped_contract = (i % 6).isin(0, 1)
    cols = {
        "name": F.when((i % 50).isin(27, 31), "").when(i % 8 == 2, F.concat("name", F.lit(" renovated"))).otherwise(F.col("name")),
        "address": F.when(i % 4 == 1, "").when(i % 4 == 2, "New address"),
        "price_monthly_min": F.when(~gone_price, F.col("price_monthly_min") + raised),
        "price_monthly_max": F.when(~gone_price, F.col("price_monthly_max") + raised),
        "from_structured_list": i % 2 == 0,
        "has_monthly_contract": F.when(i % 6 == 1, "unknown").otherwise(F.col("has_monthly_contract")),
        "contract_monthly_raw": F.when(~dropped_contract, F.col("contract_monthly_raw")),
        "contract_monthly_min": F.when(~dropped_contract, F.col("contract_monthly_min") + F.when(i % 9 == 2, 100).otherwise(0)),
        "contract_monthly_max": F.when(~dropped_contract, F.col("contract_monthly_max")),
        "has_structured_data": i % 3 == 1,
        "page_gone": i % 30 == 6,
        "phone": F.when(i % 7 == 0, F.lit(None)).when(i % 7 == 1, "").otherwise(F.concat(F.lit("09"), i)),
        "source_id": F.when(i % 4 != 0, F.concat(F.lit("n"), i)),
        "longitude": F.when(i % 5 != 0, F.col("longitude")),
        "latitude": F.lit(10.5),
        "amenities": F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.array(F.lit("Pool"))),
        "images": F.when(i % 2 == 0, F.array(F.concat(F.lit("a"), i), F.concat(F.lit("b"), i))),
        "thumbnail_url": F.concat(F.lit("t"), i),
    }
    return merge.invalid_rows(schemas.conform(cat.withColumns(cols), schemas.FULL_SCHEMA))


def decision(spark, sf, rejected: bool = False, **options) -> DataFrame:
    """The decision frame; with ``rejected``, bad rows of listings that are not stored too."""
    frame = merge.decide(stored(spark, sf), scanned(spark, sf), clock.instant(SCAN_AT), **options)
    return frame if rejected else frame.filter("was_known OR was_applied")


MERGED = CAT + f""",
st AS (SELECT * FROM cat WHERE id % 10 <> 1),
ba AS (
  SELECT id, slug, url,
    CASE WHEN id % 50 IN (27, 31) THEN '' WHEN id % 8 = 2 THEN name || ' renovated' ELSE name END AS name,
    CASE WHEN id % 4 = 1 THEN '' WHEN id % 4 = 2 THEN 'New address' END AS address,
    CASE WHEN id % 12 <> 5 THEN price_monthly_min + CASE WHEN id % 3 = 0 THEN 500 ELSE 0 END END AS price_monthly_min,
    CASE WHEN id % 12 <> 5 THEN price_monthly_max + CASE WHEN id % 3 = 0 THEN 500 ELSE 0 END END AS price_monthly_max,
    id % 2 = 0 AS auth,
    CASE WHEN id % 6 = 1 THEN 'unknown' ELSE has_monthly_contract END AS has_monthly_contract,
    CASE WHEN id % 6 NOT IN (0, 1) THEN contract_monthly_raw END AS contract_monthly_raw,
    CASE WHEN id % 6 NOT IN (0, 1) THEN contract_monthly_min + CASE WHEN id % 9 = 2 THEN 100 ELSE 0 END END AS contract_monthly_min,
    CASE WHEN id % 6 NOT IN (0, 1) THEN contract_monthly_max END AS contract_monthly_max,
    contract_3_month_raw, contract_6_month_raw, id % 3 = 1 AS structured, id % 30 = 6 AS page_gone,
    CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN '' ELSE '09' || id END AS phone,
    CASE WHEN id % 4 <> 0 THEN 'n' || id END AS source_id,
    10.5::DOUBLE AS latitude, CASE WHEN id % 5 <> 0 THEN longitude END AS longitude,
    CASE WHEN id % 4 = 1 THEN ['Pool'] END AS amenities, deposit, electric_price, id % 50 IN (27, 31) AS bad
  FROM cat WHERE id % 5 <> 4),
pairs AS (
  SELECT COALESCE(st.id, ba.id) AS id, st.id IS NOT NULL AS known, ba.id IS NOT NULL AS seen,
    ba.id IS NOT NULL AND NOT ba.bad AS applied, COALESCE(st.slug, ba.slug) AS slug,
    st.status AS old_status, st.missing_scan_count AS old_miss, st AS s, ba AS b
  FROM st FULL OUTER JOIN ba ON st.id = ba.id),
kept AS (SELECT * FROM pairs WHERE known OR applied),
strange AS (SELECT slug FROM pairs WHERE NOT known AND NOT applied),
up AS (
  SELECT id, slug, known, seen, applied, old_status, old_miss, s, b,
    CASE WHEN applied THEN b.name ELSE s.name END AS name,
    CASE WHEN applied AND known THEN COALESCE(nullif(b.address, ''), s.address) WHEN applied THEN b.address ELSE s.address END AS address,
    CASE WHEN applied AND known THEN COALESCE(nullif(b.source_id, ''), s.source_id) WHEN applied THEN b.source_id ELSE s.source_id END AS source_id,
    CASE WHEN applied THEN b.price_monthly_min ELSE s.price_monthly_min END AS price_monthly_min,
    CASE WHEN applied THEN b.price_monthly_max ELSE s.price_monthly_max END AS price_monthly_max,
    CASE WHEN applied AND known AND NOT b.auth THEN COALESCE(b.contract_monthly_raw, s.contract_monthly_raw) WHEN applied THEN b.contract_monthly_raw ELSE s.contract_monthly_raw END AS contract_monthly_raw,
    CASE WHEN applied AND known AND NOT b.auth THEN COALESCE(b.contract_monthly_min, s.contract_monthly_min) WHEN applied THEN b.contract_monthly_min ELSE s.contract_monthly_min END AS contract_monthly_min,
    CASE WHEN applied AND known AND NOT b.auth THEN COALESCE(b.contract_monthly_max, s.contract_monthly_max) WHEN applied THEN b.contract_monthly_max ELSE s.contract_monthly_max END AS contract_monthly_max,
    CASE WHEN applied AND known AND NOT b.auth THEN CASE WHEN b.has_monthly_contract <> 'unknown' THEN b.has_monthly_contract ELSE s.has_monthly_contract END
      WHEN applied THEN b.has_monthly_contract ELSE s.has_monthly_contract END AS has_monthly_contract,
    CASE WHEN applied AND known AND NOT b.structured THEN COALESCE(nullif(b.phone, ''), s.phone) WHEN applied THEN b.phone ELSE s.phone END AS phone,
    CASE WHEN applied AND known AND b.longitude IS NULL THEN s.latitude WHEN applied THEN b.latitude ELSE s.latitude END AS latitude,
    CASE WHEN applied AND known THEN COALESCE(b.amenities, s.amenities) WHEN applied THEN b.amenities ELSE s.amenities END AS amenities,
    CASE WHEN applied THEN 'active' ELSE old_status END AS up_status,
    CASE WHEN applied AND (NOT known OR old_status = 'removed') THEN 0 ELSE old_miss END AS up_miss
  FROM kept),
fin AS (
  SELECT *, up_status = 'active' AND NOT seen AND up_miss + 1 >= 3 AS was_removed,
    CASE WHEN up_status = 'active' AND NOT seen THEN up_miss + 1 WHEN up_status = 'active' THEN 0 ELSE up_miss END AS missing_scan_count
  FROM up)"""

_PRICES = ("price_monthly_min", "price_monthly_max", "contract_monthly_min", "contract_monthly_max")
_PRICE_DIFF = " OR ".join(f"s.{p} IS DISTINCT FROM fin.{p}" for p in _PRICES)
_CONTENT_DIFF = (
    "(s.name, s.price_monthly_min, s.price_monthly_max, s.contract_monthly_raw, s.amenities) IS DISTINCT FROM "
    "(fin.name, fin.price_monthly_min, fin.price_monthly_max, fin.contract_monthly_raw, fin.amenities)"
)
_CLASS = (
    "CASE WHEN NOT known THEN 'NEW' WHEN NOT applied THEN NULL "
    f"WHEN {_PRICE_DIFF} THEN 'PRICE_CHANGED' WHEN {_CONTENT_DIFF} THEN 'UPDATED' "
    "WHEN old_status = 'removed' THEN 'REACTIVATED' ELSE 'UNCHANGED' END"
)


@query("M1_insert_branch", f"""
WITH {MERGED}
SELECT slug, name, source_id, up_status AS status, missing_scan_count,
  '2024-02-01 00:00:00' AS first_seen_at,
  CASE WHEN source_id IS NOT NULL OR b.page_gone THEN '2024-02-01 00:00:00' END AS detail_scraped_at,
  COALESCE(array_to_string(amenities, '|'), 'none') AS amenities
FROM fin WHERE NOT known
""")
def m1(spark, sf):
    new = decision(spark, sf).filter("NOT was_known")
    return new.select(
        "slug", "name", "source_id", "status", "missing_scan_count",
        F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen_at"),
        F.date_format("detail_scraped_at", "yyyy-MM-dd HH:mm:ss").alias("detail_scraped_at"),
        F.coalesce(F.array_join("amenities", "|"), F.lit("none")).alias("amenities"))


@query("M2_field_policies", f"""
WITH {MERGED}
SELECT slug, name, address, source_id, price_monthly_min, price_monthly_max, latitude,
  COALESCE(array_to_string(amenities, '|'), 'none') AS amenities FROM fin
""")
def m2(spark, sf):
    return decision(spark, sf).select(
        "slug", "name", "address", "source_id", "price_monthly_min", "price_monthly_max", "latitude",
        F.coalesce(F.array_join("amenities", "|"), F.lit("none")).alias("amenities"))


@query("M3a_contract_policy", f"""
WITH {MERGED}
SELECT slug, contract_monthly_raw, contract_monthly_min, contract_monthly_max, has_monthly_contract FROM fin
""")
def m3a(spark, sf):
    return decision(spark, sf).select(
        "slug", "contract_monthly_raw", "contract_monthly_min", "contract_monthly_max", "has_monthly_contract")


@query("M3b_detail_policy", f"""
WITH {MERGED}
SELECT slug, phone, CASE WHEN NOT known OR (applied AND b.structured) THEN NULL ELSE '1 month' END AS advance_payment FROM fin
""")
def m3b(spark, sf):
    return decision(spark, sf).select("slug", "phone", "advance_payment")


@query("M4_content_hash", f"""
WITH {MERGED} SELECT slug, {_CONTENT_DIFF} AS content_changed FROM fin WHERE known AND applied
""")
def m4(spark, sf):
    changed = ~F.col("old_hash").eqNullSafe(F.col("content_hash"))
    return decision(spark, sf).filter("was_known AND was_applied").select("slug", changed.alias("content_changed"))


_PRICE_ROWS = " UNION ALL ".join(
    f"SELECT slug, '{p}' AS field_name, COALESCE(s.{p}::VARCHAR, 'None') AS old_value, COALESCE(fin.{p}::VARCHAR, 'None') AS new_value "
    f"FROM fin WHERE known AND applied AND s.{p} IS DISTINCT FROM fin.{p}" for p in _PRICES)


@query("M5_price_history", f"WITH {MERGED} {_PRICE_ROWS}")
def m5(spark, sf):
    rows = merge.history_rows(decision(spark, sf), clock.instant(SCAN_AT))
    return rows.filter(F.col("change_type") == "PRICE_CHANGED").select("slug", "field_name", "old_value", "new_value")


@query("M6_content_history", f"""
WITH {MERGED} SELECT slug, 'UPDATED' AS change_type, 'content_hash' AS field_name FROM fin WHERE known AND applied AND {_CONTENT_DIFF}
""")
def m6(spark, sf):
    rows = merge.history_rows(decision(spark, sf), clock.instant(SCAN_AT))
    return rows.filter(F.col("change_type") == "UPDATED").select("slug", "change_type", "field_name")


@query("M7_reactivation", f"""
WITH {MERGED} SELECT slug, up_status AS status, missing_scan_count FROM fin WHERE known AND applied AND old_status = 'removed'
""")
def m7(spark, sf):
    return decision(spark, sf).filter("was_applied AND old_status = 'removed'").select("slug", "status", "missing_scan_count")


@query("M8_change_class", f"WITH {MERGED} SELECT slug, {_CLASS} AS change_class FROM fin")
def m8(spark, sf):
    return decision(spark, sf).select("slug", "change_class")


@query("M9_removal", f"""
WITH {MERGED}
SELECT slug, CASE WHEN was_removed THEN 'removed' ELSE up_status END AS status, missing_scan_count,
  CASE WHEN was_removed THEN missing_scan_count::VARCHAR END AS removal_value FROM fin
""")
def m9(spark, sf):
    d = decision(spark, sf)
    return d.select(
        "slug", "status", "missing_scan_count",
        F.when(F.col("was_removed"), F.col("missing_scan_count").cast("string")).alias("removal_value"))


@query("M10_coverage_guard", f"""
WITH {MERGED}, cov AS (SELECT count(*) FILTER (up_status = 'active') AS active, count(*) FILTER (seen) + (SELECT count(*) FROM strange) AS seen FROM fin)
SELECT minimum, active, seen, seen >= active * minimum AS trusted,
  CASE WHEN seen >= active * minimum THEN (SELECT count(*) FROM fin WHERE was_removed) ELSE 0 END AS removed
FROM cov, (VALUES (0.5::DOUBLE), (0.99::DOUBLE)) AS m(minimum)
""")
def m10(spark, sf):
    upserted = stage(merge.upsert(stored(spark, sf), scanned(spark, sf), clock.instant(SCAN_AT)), "upserts")

    def under(minimum: float) -> DataFrame:
        trusted = merge.covers_enough(F.col("active"), F.col("seen"), minimum)
        counted = merge.coverage(upserted).select("active", "seen", trusted.alias("trusted"))
        marked = merge.count_missing(upserted, counted.select("trusted").scalar())
        removed = marked.agg(F.count_if("was_removed")).scalar()
        return counted.select(F.lit(minimum).alias("minimum"), "*", removed.alias("removed"))

    return under(0.5).unionByName(under(0.99))


@query("M11_partial_scan_guard", f"WITH {MERGED} SELECT slug, up_status AS status, up_miss AS missing_scan_count FROM fin")
def m11(spark, sf):
    return decision(spark, sf, complete=False).select("slug", "status", "missing_scan_count")


def scanned_store(spark, sf):
    """A store that took over the stored listings and merged one scan."""
    from lodgetrail.plans.scan import TrackingStore

    store = TrackingStore(spark, new_work_dir(spark, "store"), buckets=8)
    store.seed(stored(spark, sf))
    store.apply_scan(scanned(spark, sf), SCAN_AT)
    return store


@query("M12_scan_log", f"""
WITH {MERGED}, c AS (SELECT *, {_CLASS} AS cls FROM fin)
SELECT count(*) FILTER (cls = 'NEW') AS new_count, count(*) FILTER (cls = 'UPDATED') AS updated_count,
  count(*) FILTER (cls = 'PRICE_CHANGED') AS price_changed_count, count(*) FILTER (was_removed) AS removed_count,
  'completed' AS status FROM c
""")
def m12(spark, sf):
    return scanned_store(spark, sf).scan_log().filter("new_count IS NOT NULL").select(
        "new_count", "updated_count", "price_changed_count", "removed_count", "status")


def _kept_contract(months: int) -> str:
    raw = f"contract_{months}_month_raw"
    return (f"CASE WHEN applied AND known AND NOT b.auth THEN COALESCE(b.{raw}, s.{raw}) WHEN applied THEN b.{raw} ELSE s.{raw} END NOT IN ('', '-')")


@query("M12_counters_from_differences", f"""
WITH {MERGED}, f AS (SELECT *, CASE WHEN was_removed THEN 'removed' ELSE up_status END AS status, {_kept_contract(3)} AS three, {_kept_contract(6)} AS six FROM fin)
SELECT count(*) FILTER (status = 'active') AS total_active, count(*) FILTER (NOT known) AS new_today,
  count(*) FILTER (status = 'active' AND has_monthly_contract = 'true') AS monthly_contract_count,
  count(*) FILTER (status = 'active' AND COALESCE(three, false)) AS three_month_contract_count,
  count(*) FILTER (status = 'active' AND COALESCE(six, false)) AS six_month_contract_count,
  count(*) FILTER (status = 'removed') AS total_removed FROM f
""")
def m12_counters(spark, sf):
    """Counters after a scan, from the counts of the stored listings and what the scan changed in them."""
    tally = scanned_store(spark, sf).tally()
    return counters.public_from_tally(tally, clock.instant("2024-02-01 12:00:00"))


@query("M13_bad_row_isolation", f"""
WITH {MERGED}
SELECT slug, name, seen AND NOT applied AS rejected, missing_scan_count FROM fin
UNION ALL SELECT slug, NULL, true, NULL FROM strange
""")
def m13(spark, sf):
    return decision(spark, sf, rejected=True).select(
        "slug", "name", (F.col("was_seen") & ~F.col("was_applied")).alias("rejected"), "missing_scan_count")


@query("M14_gone_pages", f"""
WITH {MERGED}
SELECT slug, {ts_text("TIMESTAMP '2024-02-01'")} AS detail_scraped_at FROM fin
WHERE applied AND (b.page_gone OR COALESCE(b.source_id, '') <> '')
""")
def m14(spark, sf):
    read = decision(spark, sf).filter(F.col("detail_scraped_at") == clock.instant(SCAN_AT))
    return read.select("slug", F.date_format("detail_scraped_at", "yyyy-MM-dd HH:mm:ss").alias("detail_scraped_at"))


@query("M15_targeted_repair", f"""
WITH {CAT},
r AS (SELECT slug, id, phone AS old_phone, amenities AS old_am, latitude AS old_lat,
    CASE WHEN id % 2 = 0 THEN CASE WHEN id % 3 = 1 OR id % 7 <> 1 THEN '09' || id ELSE phone END ELSE phone END AS phone,
    CASE WHEN id % 2 = 0 AND id % 4 = 0 THEN ['Pool'] ELSE amenities END AS amenities FROM cat)
SELECT slug, phone, COALESCE(array_to_string(amenities, '|'), 'none') AS amenities,
  phone IS DISTINCT FROM old_phone AS phone_touched, amenities IS DISTINCT FROM old_am AS amenities_touched FROM r
""")
def m15(spark, sf):
    cat = adapters.catalogue(spark, sf)
    i = F.col("id")
    fresh = schemas.conform(
        cat.filter(i % 2 == 0).withColumns({
            "has_structured_data": i % 3 == 1,
            "phone": F.when((i % 3 == 1) | (i % 7 != 1), F.concat(F.lit("09"), i)),
            "amenities": F.when(i % 4 == 0, F.array(F.lit("Pool"))),
        }),
        schemas.T.StructType([schemas.T.StructField("slug", schemas.T.StringType())] + schemas.DETAIL_SCHEMA.fields))
    state = schemas.conform(cat, schemas.STATE_SCHEMA)
    fixed = repair.repair(state, fresh, {"contact", "amenities"}, clock.instant(SCAN_AT))
    return fixed.select(
        "slug", "phone", F.coalesce(F.array_join("amenities", "|"), F.lit("none")).alias("amenities"),
        F.array_contains("touched", "phone").alias("phone_touched"),
        F.array_contains("touched", "amenities").alias("amenities_touched"))


@query("M16_image_review_apply", f"""
WITH {IMG}
SELECT image_id, image_url, CASE WHEN error IS NOT NULL THEN false ELSE has_qr OR has_text END AS excluded,
  CASE WHEN error IS NOT NULL THEN error ELSE nullif(concat_ws(',', CASE WHEN has_qr THEN 'qr_code' END, CASE WHEN has_text THEN 'text_overlay' END), '') END AS exclusion_reason
FROM img WHERE reviewed_at IS NULL
UNION ALL SELECT image_id, image_url, excluded, NULL FROM img WHERE reviewed_at IS NOT NULL
""")
def m16(spark, sf):
    img = adapters.images(spark, sf)
    excluded, reason = images.verdict(F.col("has_qr"), F.col("has_text"), error=F.col("error"))
    pending = img.filter(F.col("reviewed_at").isNull())
    reviews = pending.select("image_id", excluded.alias("excluded"), reason.alias("exclusion_reason"))
    done = images.apply_reviews(img, reviews, clock.instant(SCAN_AT))
    return done.select("image_id", "image_url", "excluded", "exclusion_reason")


LINKED = VEC + """,
hashes AS (SELECT listing_id, corner, hash, count(*) AS images FROM vec GROUP BY ALL),
linked AS (
  SELECT a.listing_id, a.corner, a.hash, b.hash AS near_hash, b.images
  FROM hashes a JOIN hashes b ON a.listing_id = b.listing_id AND a.corner = b.corner AND bit_count(xor(a.hash, b.hash)) <= 6),
clusters AS (SELECT listing_id, corner, hash, sum(images)::BIGINT AS cluster_size FROM linked GROUP BY ALL)"""


_CORNER_NO = " ".join(f"WHEN '{c}' THEN {n}" for n, c in enumerate(images.CORNERS))


@query("M17_watermark_clusters", f"""
WITH RECURSIVE {VEC},
v AS (SELECT listing_id, image_id, hash, CASE corner {_CORNER_NO} END AS c FROM vec),
cl AS (SELECT a.listing_id, a.c, a.image_id, list(b.image_id) AS members FROM v a JOIN v b ON a.listing_id = b.listing_id AND a.c = b.c
  AND bit_count(xor(a.hash, b.hash)) <= 6 GROUP BY ALL HAVING count(*) >= 3),
e AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY c, image_id) AS i FROM cl),
walk AS (
  SELECT DISTINCT listing_id, 0::BIGINT AS i, CAST([] AS BIGINT[]) AS flagged FROM e
  UNION ALL
  SELECT e.listing_id, e.i, CASE WHEN list_contains(flagged, e.image_id) THEN flagged ELSE list_distinct(list_concat(flagged, members)) END
  FROM walk JOIN e ON e.listing_id = walk.listing_id AND e.i = walk.i + 1),
ends AS (SELECT listing_id, max(i) AS i FROM walk GROUP BY listing_id)
SELECT unnest(flagged) AS image_id FROM walk JOIN ends USING (listing_id, i)
""")
def m17(spark, sf):
    return images.watermarked_images(adapters.corner_hashes(spark, sf))


@query("M18_image_dedup", f"""
WITH {IMG}
SELECT listing_id, image_url, min(image_id) AS image_id FROM img GROUP BY ALL
""")
def m18(spark, sf):
    return images.deduplicate(adapters.images(spark, sf)).select("listing_id", "image_url", "image_id")


@query("M19_rehash", f"WITH {CAT} SELECT slug, id % 4 = 0 AS rehashed FROM cat WHERE id % 10 <> 1")
def m19(spark, sf):
    state = stored(spark, sf)
    number = F.regexp_extract("slug", r"(\d+)", 1).cast("bigint")
    outdated = state.withColumn(
        "content_hash", F.when(number % 4 == 0, F.lit("old")).otherwise(F.col("content_hash")))
    return repair.rehash(outdated).select("slug", "rehashed")


@query("M20_stuck_scans", f"""
WITH {OBS}, s AS (SELECT scan_no, min(ts) AS started_at, max(ts) AS last_ts, scan_no % 3 = 0 AS running FROM obs GROUP BY scan_no)
SELECT scan_no, CASE WHEN running AND started_at < TIMESTAMP '{adapters.AS_OF}' - INTERVAL 12 HOUR THEN 'failed'
  WHEN running THEN 'running' ELSE 'completed' END AS status,
  CASE WHEN running AND started_at < TIMESTAMP '{adapters.AS_OF}' - INTERVAL 12 HOUR THEN '{adapters.AS_OF}'
  WHEN NOT running THEN {ts_text('last_ts')} END AS finished_at FROM s
""")
def m20(spark, sf):
    fixed = repair.fail_stuck_scans(scans(spark, sf), adapters.as_of())
    return fixed.select("scan_no", "status", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"))


def line_verdicts(spark, sf) -> DataFrame:
    """One verdict per LINE handle, from its length and last digit."""
    used = contacts.contacts_to_check(adapters.catalogue(spark, sf), "line_id")
    last = F.right("line_id", F.lit(1))
    verdict = F.when(last.isin("1", "2", "3", "y"), "valid").when(last.isin("4", "5"), "invalid").otherwise("unknown")
    return used.select("line_id", verdict.alias("verdict"))


def whatsapp_verdicts(spark, sf) -> DataFrame:
    used = contacts.contacts_to_check(adapters.catalogue(spark, sf), "whatsapp")
    return used.select("whatsapp", F.when(F.length("whatsapp") < 5, "invalid").otherwise("valid").alias("verdict"))


LINE_VERDICT = (
    "CASE WHEN right(line_id, 1) IN ('1', '2', '3', 'y') THEN 'valid' "
    "WHEN right(line_id, 1) IN ('4', '5') THEN 'invalid' ELSE 'unknown' END"
)


@query("M21_verdict_apply", f"""
WITH {CAT}
SELECT id, CASE WHEN status = 'active' AND line_id IS NOT NULL THEN CASE {LINE_VERDICT} WHEN 'valid' THEN true WHEN 'invalid' THEN false END END AS line_verified,
  CASE WHEN status = 'active' AND length(whatsapp) < 5 THEN NULL ELSE whatsapp END AS whatsapp FROM cat
""")
def m21(spark, sf):
    cat = adapters.catalogue(spark, sf)
    lined = contacts.apply_line_verdicts(cat, line_verdicts(spark, sf))
    return contacts.apply_whatsapp_verdicts(lined, whatsapp_verdicts(spark, sf)).select("id", "line_verified", "whatsapp")


FOLDED = BILL + """,
firsts AS (SELECT subscription_id, min_by(ts, (ts, event_id)) AS fts, min_by(event_id, (ts, event_id)) AS fid
  FROM bill_all WHERE event_type = 'checkout.session.completed' GROUP BY subscription_id),
resolved AS (
  SELECT e.*, CASE WHEN event_type IN ('invoice.payment_failed', 'charge.refunded') THEN
      last_value(CASE WHEN f.fid = e.event_id THEN e.subscription_id END IGNORE NULLS)
        OVER (PARTITION BY e.customer_id ORDER BY e.ts, e.event_id)
    ELSE e.subscription_id END AS target_id,
    e.event_type IN ('invoice.payment_failed', 'charge.refunded') OR (f.fts, f.fid) <= (e.ts, e.event_id) AS known
  FROM bill_all e LEFT JOIN firsts f ON e.subscription_id = f.subscription_id),
folded AS (
  SELECT target_id AS subscription_id, arg_min(customer_id, (ts, event_id)) AS customer_id,
    arg_min(user_id, (ts, event_id)) FILTER (event_type = 'checkout.session.completed' AND user_id IS NOT NULL) AS user_id,
    min(ts) AS created_at, count(*) AS events,
    arg_max(CASE WHEN event_type IN ('checkout.session.completed', 'customer.subscription.updated') THEN status
      WHEN event_type = 'invoice.payment_failed' THEN 'past_due' ELSE 'canceled' END, (ts, event_id)) AS status
  FROM resolved WHERE known AND target_id IS NOT NULL GROUP BY target_id)"""


@query("M22_subscription_fold", f"""
WITH {FOLDED}
SELECT subscription_id, customer_id, user_id, events, status, status IN ('active', 'trialing') AS is_premium FROM folded
""")
def m22(spark, sf):
    return accounts.fold_subscriptions(adapters.billing_events(spark, sf)).select(
        "subscription_id", "customer_id", "user_id", "events", "status", "is_premium")


@query("M23_event_idempotency", f"WITH {BILL} SELECT event_id, event_type, customer_id FROM bill_all")
def m23(spark, sf):
    return accounts.once(adapters.billing_events(spark, sf)).select("event_id", "event_type", "customer_id")


@query("M24_first_claim_wins", """
WITH c AS (SELECT event_id, ts, 'cs_' || (user_id % 40) || '_' || event_type AS session_id FROM events)
SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) = 1 AS granted FROM c
""")
def m24(spark, sf):
    claims = adapters.table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("cs_"), F.col("user_id") % 40, F.lit("_"), "event_type").alias("session_id"))
    return accounts.first_claims(claims).select("event_id", "session_id", "granted")


@query("M25_disjoint_merge_order", f"""
WITH {CAT} SELECT slug, name, CASE WHEN id % 2 = 0 THEN phone END AS phone FROM cat
""")
def m25(spark, sf):
    cat = adapters.catalogue(spark, sf)
    raw = schemas.conform(cat, schemas.RAW_SCHEMA)
    details = schemas.conform(
        cat.filter(F.col("id") % 2 == 0),
        schemas.T.StructType([schemas.T.StructField("url", schemas.T.StringType())] + schemas.DETAIL_SCHEMA.fields))
    return collect.attach_details(raw, details).select("slug", "name", "phone")
