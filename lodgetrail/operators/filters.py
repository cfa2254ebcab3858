"""Predicates of the catalogue, the browser view and the maps.

Each returns a boolean Column; absent parameters add nothing, so simple
comparisons reach the parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetrail import dims, schemas
from lodgetrail.functions import clock, geo
from lodgetrail.functions.price import contract_number, has_raw, price_of, price_value
from lodgetrail.functions.text import contains_key, equals_ignoring_case, has_real_phone, text_key


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def price_overlap(price_min: int | None, price_max: int | None) -> Column:
    """Header price range overlaps the bounds; an unknown end never excludes."""
    parts = []
    if price_min is not None:
        parts.append((F.col("price_monthly_max") >= price_min) | F.col("price_monthly_max").isNull())
    if price_max is not None:
        parts.append((F.col("price_monthly_min") <= price_max) | F.col("price_monthly_min").isNull())
    return all_of(*parts)


def updated_since(day: str, tz: str = dims.LOCAL_TZ) -> Column:
    """Source update at or after the local midnight that begins ``day``."""
    return F.col("source_updated_at") >= clock.local_midnight(F.lit(day).cast("date"), tz)


def catalogue(
    province: str | None = None, district: str | None = None, price_min: int | None = None,
    price_max: int | None = None, monthly: bool | None = None, status: str | None = None,
    since: str | None = None,
) -> Column:
    parts = [price_overlap(price_min, price_max)]
    if province:
        parts.append(equals_ignoring_case(F.col("province"), province))
    if district:
        parts.append(equals_ignoring_case(F.col("district"), district))
    if monthly is not None:
        parts.append(F.col("has_monthly_contract") == ("true" if monthly else "false"))
    if status:
        parts.append(F.col("status") == status)
    if since:
        parts.append(updated_since(since))
    return all_of(*parts)


def seen_within(as_of: Column, hours: int = 24) -> Column:
    return F.col("first_seen_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours))


def has_all(amenities) -> Column:
    owned = F.coalesce(F.col("amenities"), F.array().cast("array<string>"))
    return all_of(*[F.array_contains(owned, a) for a in amenities])


def contract_overlap(price_min: int = 0, price_max: int | None = None, monthly_only: bool = False) -> Column:
    """Bounds against contract prices: the 1-month price alone, or the range of all three."""
    numbers = [contract_number(F.col(f"{d}_raw")) for d in dims.DURATION_FIELDS.values()]
    if monthly_only:
        one = numbers[0]
        parts = [] if price_min <= 0 else [F.coalesce(one >= price_min, F.lit(True))]
        if price_max is not None:
            parts.append(F.coalesce(one <= price_max, F.lit(False)))
        return all_of(*parts)
    low = F.coalesce(F.least(*numbers), F.col("price_monthly_min"), F.lit(0))
    high = F.coalesce(F.greatest(*numbers), F.col("price_monthly_max"), F.lit(0))
    parts = [] if price_min <= 0 else [(high <= 0) | (high >= price_min)]
    if price_max is not None:
        parts.append((low <= 0) | (low <= price_max))
    return all_of(*parts)


def names_place(name: str) -> Column:
    """City, province or district contains the name."""
    needle = F.lit(name)
    return (
        contains_key(geo.city_of(), needle)
        | contains_key(geo.raw_province(), needle)
        | contains_key(geo.district_of(), needle)
    )


def browse(
    as_of: Column | None = None, new_only: bool = False, city: str = "", district: str = "",
    featured: str = "", region: str = "", one_month: bool = False, three_months: bool = False,
    six_months: bool = False, amenities=(), price_min: int = 0, price_max: int | None = None,
) -> Column:
    parts = [F.col("status") == "active"]
    if new_only:
        parts.append(F.coalesce(seen_within(as_of), F.lit(False)))
    if city:
        parts.append(contains_key(geo.city_of(), F.lit(city)))
    if district:
        parts.append(text_key(geo.district_of()) == text_key(F.lit(district)))
    if featured:
        parts.append(names_place(featured))
    if region:
        parts.append(geo.region_of(geo.city_of()) == region)
    if one_month:
        parts.append(F.col("has_monthly_contract") == "true")
    if three_months:
        parts.append(contract_number(F.col("contract_3_month_raw")).isNotNull())
    if six_months:
        parts.append(contract_number(F.col("contract_6_month_raw")).isNotNull())
    if amenities:
        parts.append(has_all(amenities))
    parts.append(contract_overlap(price_min, price_max, one_month))
    return all_of(*parts)


def map_view(
    as_of: Column | None = None, duration: str | None = None, budget_eur: tuple | None = None,
    new_only: bool = False, wanted=(), rate: float = dims.EUR_RATE,
) -> Column:
    """Map filter; 'LINE' and 'WhatsApp' stand beside the amenities."""
    field = dims.DURATION_FIELDS.get(duration) if duration else None
    parts = [has_raw(F.col(f"{field}_raw"))] if field else []
    if new_only:
        parts.append(F.coalesce(seen_within(as_of), F.lit(False)))
    if budget_eur:
        price = price_of(field)
        low, high = budget_eur
        parts.append(F.coalesce(price >= low * rate, F.lit(False)))
        if high is not None:
            parts.append(F.coalesce(price <= high * rate, F.lit(False)))
    for name in wanted:
        if name == "LINE":
            parts.append(F.coalesce(F.col("line_id"), F.lit("")) != "")
        elif name == "WhatsApp":
            parts.append(has_real_phone(F.col("whatsapp")))
        else:
            parts.append(has_all([name]))
    return all_of(*parts)


def city_map_price(price_min: int, price_max: int, bound: int, monthly_only: bool = False) -> Column:
    """City-map toggles; listings without a price drop out once a bound moves."""
    parts = [F.col("has_monthly_contract") == "true"] if monthly_only else []
    if price_min > 0 or price_max < bound:
        parts.append(F.coalesce(price_value().between(price_min, price_max), F.lit(False)))
    return all_of(*parts)


def in_viewport(south: float, north: float, west: float, east: float) -> Column:
    return F.col("latitude").between(south, north) & F.col("longitude").between(west, east)


def located() -> Column:
    return geo.finite(F.col("latitude"), F.col("longitude"))


def missing_group(group: str) -> Column:
    """Active-listing repair: the named field group is empty."""
    if group == "amenities":
        return F.coalesce(F.size("amenities") == 0, F.lit(True)) | F.col("amenities").isNull()
    if group == "coords":
        return F.col("latitude").isNull() | F.col("longitude").isNull()
    if group == "rooms":
        return F.col("room_types").isNull()
    if group == "contact":
        return all_of(*[F.col(c).isNull() for c in ("phone", "line_id", "whatsapp", "email")])
    raise ValueError(f"unknown field group: {group}")


def mask(df: DataFrame, premium: bool, secret: str, listing_id: str = "id") -> DataFrame:
    """What a visitor of the given tier may see of each row."""
    have = set(df.columns)
    out = df.withColumn("location_approx", F.lit(False))
    if not premium:
        hidden = [c for c in schemas.CONTACT_COLUMNS + schemas.PRECIOUS_COLUMNS if c in have]
        out = out.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in hidden})
        if {"latitude", "longitude"} <= have:
            both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
            shifted = geo.approximate_position(F.col(listing_id), F.col("latitude"), F.col("longitude"), secret)
            out = (
                out.withColumn("_shifted", F.when(both, shifted))
                .withColumns({
                    "latitude": F.when(both, F.col("_shifted.lat")).otherwise(F.col("latitude")),
                    "longitude": F.when(both, F.col("_shifted.lon")).otherwise(F.col("longitude")),
                    "location_approx": both,
                })
                .drop("_shifted")
            )
    return out.drop(*schemas.INTERNAL_COLUMNS)
