"""Declared schemas and the field policies of the scan merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---- fixed values: field groups of a listing, in storage order -------------
HEADER_PRICE_FIELDS = (
    "price_monthly_raw", "price_monthly_min", "price_monthly_max",
    "daily_price_raw", "daily_price_min", "daily_price_max",
)
CONTRACT_FIELDS = (
    "contract_monthly_raw", "contract_monthly_min", "contract_monthly_max",
    "contract_3_month_raw", "contract_3_month_min", "contract_3_month_max",
    "contract_6_month_raw", "contract_6_month_min", "contract_6_month_max",
)
DETAIL_FIELDS = (
    "phone", "line_id", "whatsapp", "email",
    "deposit", "advance_payment", "electric_price", "water_price", "service_fee",
)
HASH_FIELDS = (
    "name",
    "price_monthly_min", "price_monthly_max",
    "contract_monthly_raw", "contract_3_month_raw", "contract_6_month_raw",
    "deposit", "electric_price",
    "amenities",
)
PRICE_FIELDS = (
    "price_monthly_min", "price_monthly_max",
    "contract_monthly_min", "contract_monthly_max",
    "contract_3_month_min", "contract_3_month_max",
    "contract_6_month_min", "contract_6_month_max",
    "daily_price_min", "daily_price_max",
)
CONTACT_COLUMNS = ("phone", "line_id", "whatsapp", "email", "line_verified")
PRECIOUS_COLUMNS = ("address", "url")
INTERNAL_COLUMNS = (
    "content_hash", "missing_scan_count", "source", "source_id", "slug",
    "created_at", "updated_at", "last_scraped_at", "detail_scraped_at", "last_seen_at",
)
EXPORT_DROPPED_COLUMNS = ("content_hash", "missing_scan_count", "source")
FIELD_GROUPS = ("contact", "amenities", "coords", "rooms")
# ---- end of fixed values ---------------------------------------------------

# How an existing listing takes a scanned value.
OVERWRITE = "overwrite"              # the scanned value, NULL included
KEEP_IF_EMPTY = "keep_if_empty"      # NULL and '' leave the stored value
PAIR = "pair"                        # only if both of the pair are present
NONEMPTY_LIST = "nonempty_list"      # only a list with items replaces
CONTRACT = "contract"                # depends on the card being authoritative
DETAIL = "detail"                    # depends on the detail page being structured
INSERT_ONLY = "insert_only"          # never changed after the first sight

FIELD_POLICIES: dict[str, str] = {
    "source_id": KEEP_IF_EMPTY,
    "name": OVERWRITE,
    "url": INSERT_ONLY,
    "address": KEEP_IF_EMPTY,
    "subdistrict": KEEP_IF_EMPTY,
    "district": KEEP_IF_EMPTY,
    "province": KEEP_IF_EMPTY,
    "latitude": PAIR,
    "longitude": PAIR,
    **{f: OVERWRITE for f in HEADER_PRICE_FIELDS},
    **{f: CONTRACT for f in CONTRACT_FIELDS},
    "has_monthly_contract": CONTRACT,
    "amenities": NONEMPTY_LIST,
    "room_types": NONEMPTY_LIST,
    **{f: DETAIL for f in DETAIL_FIELDS},
    "is_verified": OVERWRITE,
    "has_promotion": OVERWRITE,
    "source_updated_at": OVERWRITE,
}

ROOM_TYPE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("room_type", T.StringType()),
    T.StructField("size_sqm", T.DoubleType()),
    T.StructField("monthly_min_thb", T.LongType()),
    T.StructField("monthly_max_thb", T.LongType()),
    T.StructField("contract_1_month_thb", T.LongType()),
    T.StructField("contract_3_month_thb", T.LongType()),
    T.StructField("contract_6_month_thb", T.LongType()),
    T.StructField("daily_thb", T.LongType()),
    T.StructField("status", T.StringType()),
])

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _price_type(name: str) -> T.DataType:
    return _S if name.endswith("_raw") else _L


RAW_SCHEMA = T.StructType(
    [T.StructField(n, _S) for n in ("name", "url", "slug", "address", "subdistrict", "district", "province")]
    + [T.StructField(n, _price_type(n)) for n in HEADER_PRICE_FIELDS + CONTRACT_FIELDS]
    + [
        T.StructField("has_monthly_contract", _S),
        T.StructField("from_structured_list", _B),
        T.StructField("source_updated_at", _TS),
        T.StructField("thumbnail_url", _S),
        T.StructField("is_verified", _B),
        T.StructField("has_promotion", _B),
    ]
)

DETAIL_SCHEMA = T.StructType(
    [
        T.StructField("source_id", _S),
        T.StructField("description", _S),
        T.StructField("amenities", T.ArrayType(_S)),
        T.StructField("room_types", T.ArrayType(ROOM_TYPE)),
    ]
    + [T.StructField(n, _S) for n in DETAIL_FIELDS]
    + [
        T.StructField("latitude", _D),
        T.StructField("longitude", _D),
        T.StructField("images", T.ArrayType(_S)),
        T.StructField("has_structured_data", _B),
        T.StructField("page_gone", _B),
    ]
)

FULL_SCHEMA = T.StructType(RAW_SCHEMA.fields + DETAIL_SCHEMA.fields)

STATE_SCHEMA = T.StructType(
    [
        T.StructField("slug", _S, False),
        T.StructField("source", _S),
        T.StructField("source_id", _S),
    ]
    + [T.StructField(n, _S) for n in ("name", "url", "address", "subdistrict", "district", "province")]
    + [T.StructField("latitude", _D), T.StructField("longitude", _D)]
    + [T.StructField(n, _price_type(n)) for n in HEADER_PRICE_FIELDS + CONTRACT_FIELDS]
    + [
        T.StructField("has_monthly_contract", _S),
        T.StructField("description", _S),
        T.StructField("amenities", T.ArrayType(_S)),
        T.StructField("room_types", T.ArrayType(ROOM_TYPE)),
    ]
    + [T.StructField(n, _S) for n in DETAIL_FIELDS]
    + [
        T.StructField("line_verified", _B),
        T.StructField("is_verified", _B),
        T.StructField("has_promotion", _B),
        T.StructField("status", _S),
        T.StructField("missing_scan_count", _L),
        T.StructField("content_hash", _S),
        T.StructField("source_updated_at", _TS),
        T.StructField("first_seen_at", _TS),
        T.StructField("last_seen_at", _TS),
        T.StructField("last_scraped_at", _TS),
        T.StructField("detail_scraped_at", _TS),
    ]
)

IMAGE_SCHEMA = T.StructType([
    T.StructField("slug", _S, False),
    T.StructField("image_url", _S, False),
    T.StructField("position", _L),
    T.StructField("excluded", _B),
    T.StructField("exclusion_reason", _S),
    T.StructField("reviewed_at", _TS),
])

HISTORY_SCHEMA = T.StructType([
    T.StructField("slug", _S, False),
    T.StructField("changed_at", _TS),
    T.StructField("change_type", _S),
    T.StructField("field_name", _S),
    T.StructField("old_value", _S),
    T.StructField("new_value", _S),
])


def assert_disjoint(raw: DataFrame, detail: DataFrame, key: str = "url") -> None:
    """The card and the detail page may share the join key only.

    A shared name would let an absent detail value silently win over the card.
    """
    shared = (set(raw.columns) & set(detail.columns)) - {key}
    if shared:
        raise ValueError(f"card and detail columns overlap: {sorted(shared)}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project on a target schema: missing columns as NULL, unknown ones dropped."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
