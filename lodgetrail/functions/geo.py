"""Places, coordinates and map links."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgetrail import dims
from lodgetrail.functions.text import (
    NOT_AFTER_WORD, NOT_BEFORE_WORD, encode_component, let, strip, text_key,
)


def coordinate(value: Column) -> Column:
    """Number or text with a decimal comma, as a double; bad text is NULL."""
    return F.replace(value.cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def in_country(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(*dims.LAT_BOX) & lon.between(*dims.LON_BOX), F.lit(False))


def finite(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)


def _hmac_sha256_hex(secret: bytes, message: Column) -> Column:
    """RFC 2104 with the two key pads as literals."""
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in key))
    inner = F.unhex(F.sha2(F.concat(inner_pad, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def approximate_position(listing_id: Column, lat: Column, lon: Column, secret: str) -> Column:
    """Shift by 100-300 m in a direction fixed per listing; struct(lat, lon)."""
    digest = _hmac_sha256_hex(secret.encode(), F.concat(F.lit("geo:"), listing_id.cast("string")))

    def unit(start: int) -> Column:
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / F.lit(float(2**32))

    angle = unit(1) * 2 * F.pi()
    dist = F.lit(float(dims.FUZZ_MIN_M)) + unit(9) * (dims.FUZZ_MAX_M - dims.FUZZ_MIN_M)
    dlat = dist * F.cos(angle) / dims.METRES_PER_DEGREE
    dlon = dist * F.sin(angle) / (F.lit(float(dims.METRES_PER_DEGREE)) * F.cos(F.radians(lat)))
    return F.struct(F.round(lat + dlat, 5).alias("lat"), F.round(lon + dlon, 5).alias("lon"))


def raw_province() -> Column:
    return strip(F.coalesce(F.col("province"), F.lit("")))


def city_of() -> Column:
    """District promoted to a city first, else the merged province."""
    district = text_key(F.col("district"))
    promoted = F.coalesce(*[
        F.when(F.contains(district, F.lit(name.lower())), F.lit(city))
        for name, city in dims.DISTRICT_AS_CITY.items()
    ])
    province = raw_province()
    merged = F.try_element_at(dims.literal_map(dims.CITY_MERGE), province)
    return F.coalesce(promoted, merged, province)


def region_of(city: Column) -> Column:
    by_key = dims.literal_map({k.lower(): v for k, v in dims.CITY_REGION.items()})
    return F.coalesce(F.try_element_at(by_key, text_key(city)), F.lit(""))


def district_of() -> Column:
    """District, else subdistrict, else ''."""
    return strip(F.coalesce(
        F.nullif(F.col("district"), F.lit("")), F.nullif(F.col("subdistrict"), F.lit("")), F.lit("")
    ))


_PROVINCE_PATTERN = f"(?i){NOT_AFTER_WORD}({'|'.join(dims.PROVINCE_NAMES)}){NOT_BEFORE_WORD}"


def province_in(text: Column) -> Column:
    """The longest province name present as whole words; earlier in the table on ties."""
    names = dims.literal_array([n.lower() for n in dims.PROVINCE_NAMES])
    ranked = F.transform(
        F.regexp_extract_all(text, F.lit(_PROVINCE_PATTERN), F.lit(1)),
        lambda m: F.struct(
            (-F.array_position(names, F.lower(m))).alias("rank"), F.initcap(F.lower(m)).alias("name")
        ),
    )
    return F.array_max(ranked)["name"]


def names_a_province(text: Column) -> Column:
    return text.rlike(_PROVINCE_PATTERN)


def location_parts(address: Column) -> Column:
    """struct(subdistrict, district, province) read off an address line."""
    def split_at(province: Column) -> Column:
        pattern = F.concat(F.lit(f"(?i){NOT_AFTER_WORD}"), province, F.lit(NOT_BEFORE_WORD))
        before = strip(F.substring(address, F.lit(1), F.regexp_instr(address, pattern) - 1))
        words = F.filter(F.split(before, r"\s+"), lambda w: w != "")
        return let(words, lambda w: F.struct(
            F.when(F.size(w) > 1, F.array_join(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), " ")).alias("subdistrict"),
            F.try_element_at(w, F.lit(-1)).alias("district"),
            province.alias("province"),
        ))

    return let(province_in(address), split_at)


def map_query(lat: Column, lon: Column) -> Column:
    """Point, else the address, else the place names, with the country added."""
    names = F.filter(
        F.array("subdistrict", "district", "province"), lambda x: x.isNotNull() & (x != "")
    )
    text = F.coalesce(
        F.nullif(F.col("address"), F.lit("")), F.nullif(F.array_join(names, ", "), F.lit(""))
    )
    point = F.concat_ws(",", lat.cast("string"), lon.cast("string"))
    return F.when(lat.isNotNull() & lon.isNotNull(), point).otherwise(
        F.concat(text, F.lit(", Thailand"))
    )


def map_zoom(lat: Column, precise: Column) -> Column:
    return F.when(lat.isNull(), 13).when(precise, 17).otherwise(15).cast("bigint")


def map_link(query: Column, base: str) -> Column:
    return F.concat(F.lit(base), encode_component(query))
