"""Landed detail pages: rooms, amenities, images, contacts, fees, coordinates."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgetrail import dims, schemas
from lodgetrail.functions import geo, markup, text
from lodgetrail.functions.amenities import derive_amenities
from lodgetrail.functions.fees import fees, variant_kind, variant_text
from lodgetrail.sources.pages import embedded_json, links

_LISTING = "$.props.pageProps.listing"


def room_list(listing: Column) -> Column:
    """Rooms of the page's JSON; items that are not objects are left out."""
    rooms = F.filter(
        F.try_variant_get(listing, "$.rooms", "array<variant>"),
        lambda r: F.schema_of_variant(r).startswith("OBJECT"),
    )

    def as_struct(r: Column) -> Column:
        sizes = F.array_compact(F.array(
            F.try_variant_get(r, "$.minSize", "double"), F.try_variant_get(r, "$.maxSize", "double")))
        available = F.try_variant_get(r, "$.availability", "boolean")
        values = {
            "name": F.coalesce(F.nullif(variant_text(r, "$.roomName"), F.lit("")), F.lit("Unknown")),
            "room_type": variant_text(r, "$.roomType"),
            "size_sqm": F.when(
                F.size(sizes) > 0,
                F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / F.size(sizes)),
            "monthly_min_thb": F.try_variant_get(r, "$.price.monthly.minPrice", "bigint"),
            "monthly_max_thb": F.try_variant_get(r, "$.price.monthly.maxPrice", "bigint"),
            "contract_1_month_thb": F.try_variant_get(r, "$.price.shortTerm.oneMonth", "bigint"),
            "contract_3_month_thb": F.try_variant_get(r, "$.price.shortTerm.threeMonth", "bigint"),
            "contract_6_month_thb": F.try_variant_get(r, "$.price.shortTerm.sixMonth", "bigint"),
            "daily_thb": F.try_variant_get(r, "$.price.daily.minPrice", "bigint"),
            "status": F.when(available, "Available").when(~available, "Not Available"),
        }
        return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in schemas.ROOM_TYPE.fields])

    return F.coalesce(F.transform(rooms, as_struct), F.array().cast(f"array<{schemas.ROOM_TYPE.simpleString()}>"))


_GRID = rf"(?is)<h2\b{markup.ATTRIBUTES}>[^<]*Amenities.*?</h2\s*>(.*)$"
_STYLE = r'<style data-emotion="css ([\w-]+)">\.css-\1\{([^}]*)\}'


def amenity_section(html: Column) -> Column:
    """The element that holds the amenity grid, the first ``div`` after the heading beside it; NULL without one."""
    return markup.next_element(text.first_match(html, _GRID), "div")


def icon_amenities(section: Column) -> Column:
    """Labels of the amenity grid that are not struck through; NULL without rows.

    The grid is cut at every row element, so a label's row is simply the piece
    it lies in. The struck classes travel beside each piece: a lambda would
    evaluate a captured expression again for every piece.
    """
    return text.let(section, _icon_amenities)


def _icon_amenities(section: Column) -> Column:
    styles = F.arrays_zip(
        F.regexp_extract_all(section, F.lit(_STYLE), F.lit(1)).alias("cls"),
        F.regexp_extract_all(section, F.lit(_STYLE), F.lit(2)).alias("rule"),
    )
    struck = F.transform(F.filter(styles, lambda s: F.contains(s["rule"], F.lit("line-through"))), lambda s: s["cls"])
    pieces = F.split(section, r'<div class="css-(?=[\w-]+">)')
    beside = F.arrays_zip(pieces.alias("piece"), F.array_repeat(struck, F.size(pieces)).alias("struck"))
    # The text before the first row belongs to no row.
    rows = F.slice(beside, F.lit(2), F.greatest(F.size(beside) - 1, F.lit(0)))
    present = F.filter(
        rows, lambda r: ~F.array_contains(r["struck"], F.regexp_extract(r["piece"], r"^([\w-]+)", 1)))
    labels = F.flatten(F.transform(
        present,
        lambda r: F.regexp_extract_all(r["piece"], F.lit(r'<span class="css-[\w-]+">([^<]+)</span>'), F.lit(1)),
    ))
    return F.when(F.size(pieces) > 1, labels)


def image_list(html: Column, cdn_marker: str) -> Column:
    """Gallery addresses without their query, each once, src before data-src."""

    def attribute(pattern: str) -> Column:
        return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))

    found = F.concat(
        attribute(r'(?i)<img\b[^>]*?\ssrc="([^"]*)"'),
        attribute(r'(?i)<(?:img|div)\b[^>]*?\sdata-src="([^"]*)"'),
    )
    return distinct_addresses(F.filter(found, lambda u: F.contains(u, F.lit(cdn_marker))))


def distinct_addresses(urls: Column) -> Column:
    return F.array_distinct(F.transform(urls, lambda u: F.substring_index(u, "?", 1)))


def contacts(listing: Column, hrefs: Column, visible: Column) -> dict[str, Column]:
    """The first contact of the JSON, else explicit links and the LINE label.

    ``hrefs`` are the page's link targets and ``visible`` its text.
    """
    first = F.try_variant_get(listing, "$.contactInformation[0]", "variant")
    own = {
        "phone": variant_text(first, "$.phone[0].phoneNumber"),
        "line_id": text.clean_line_id(variant_text(first, "$.lineId")),
        "whatsapp": F.nullif(variant_text(first, "$.whatsApp"), F.lit("")),
        "email": F.nullif(variant_text(first, "$.email"), F.lit("")),
    }
    given = F.coalesce(F.nullif(own["phone"], F.lit("")), *[own[k] for k in ("line_id", "whatsapp", "email")]).isNotNull()
    shown_link = F.exists(hrefs, lambda u: F.contains(u, F.lit("wa.me/")))

    def first_link(marker: str) -> Column:
        return F.get(F.filter(hrefs, lambda u: F.contains(u, F.lit(marker))), F.lit(0))

    label = text.first_match(visible, r"(?i)Line\s+ID\s*:\s*(@[\w.]+|\w[\w.]+)")
    line_link = text.first_match(first_link("line.me/ti/p/"), r"line\.me/ti/p/(.+)$")
    mail = F.get(F.filter(hrefs, lambda u: u.startswith("mailto:")), F.lit(0))
    return {
        "phone": F.when(given, own["phone"]),
        "line_id": F.when(given, own["line_id"]).otherwise(text.clean_line_id(F.coalesce(line_link, label))),
        "whatsapp": F.when(given, F.when(shown_link, own["whatsapp"])).otherwise(
            text.first_match(first_link("wa.me/"), r"wa\.me/(\d+)")),
        "email": F.when(given, own["email"]).otherwise(
            F.substring_index(F.replace(mail, F.lit("mailto:"), F.lit("")), "?", 1)),
    }


# ---- JSON-LD coordinates: nesting of unknown depth needs a walk -------------

_LD_JSON = r'(?is)<script\b[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'


def _inside(lat, lon) -> tuple[float, float] | None:
    try:
        point = float(str(lat).replace(",", ".")), float(str(lon).replace(",", "."))
    except ValueError:
        return None
    ok = dims.LAT_BOX[0] <= point[0] <= dims.LAT_BOX[1] and dims.LON_BOX[0] <= point[1] <= dims.LON_BOX[1]
    return point if ok else None


def _pairs_of(node: dict) -> Iterator[tuple]:
    geo_part = node.get("geo")
    if isinstance(geo_part, dict):
        yield geo_part.get("latitude"), geo_part.get("longitude")
    for lat_name in ("latitude", "lat"):
        for lon_name in ("longitude", "lng", "lon"):
            if lat_name in node and lon_name in node:
                yield node[lat_name], node[lon_name]


def _first_point(document: str) -> tuple[float, float] | None:
    """Depth-first over the document, objects before their members."""
    try:
        stack = [json.loads(document)]
    except ValueError:
        return None
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            for pair in _pairs_of(node):
                point = _inside(*pair)
                if point:
                    return point
            stack.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            stack.extend(reversed(node))
    return None


_POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


@F.pandas_udf(_POINT)
def _ld_point(documents: pd.Series) -> pd.DataFrame:
    points = []
    for docs in documents:
        hit = next((p for p in map(_first_point, docs if docs is not None else []) if p), None)
        points.append(hit or (None, None))
    return pd.DataFrame(points, columns=["lat", "lon"], dtype="float64")


def with_coordinates(pages: DataFrame) -> DataFrame:
    """Adds ``latitude``/``longitude`` from ``listing``, else from JSON-LD.

    Only pages that need the walk, and only their JSON-LD blocks, cross to
    Python.
    """
    lat = geo.coordinate(variant_text(F.col("listing"), "$.location.lat"))
    lon = geo.coordinate(variant_text(F.col("listing"), "$.location.lng"))
    own = F.when(geo.in_country(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))
    blocks = F.when(F.col("own_point").isNull(), F.regexp_extract_all("html", F.lit(_LD_JSON), F.lit(1)))
    return (
        pages.withColumn("own_point", own)
        .withColumn("ld_point", _ld_point(blocks))
        .withColumn("latitude", F.coalesce("own_point.lat", "ld_point.lat"))
        .withColumn("longitude", F.coalesce("own_point.lon", "ld_point.lon"))
        .drop("own_point", "ld_point")
    )


def read_details(pages: DataFrame, cdn_marker: str) -> DataFrame:
    """Pages (url, html) to detail columns, with the structured and gone flags.

    Valid JSON without a listing object means the listing was withdrawn: the
    row then carries only ``page_gone``.
    """
    parsed = pages.select("url", "html", embedded_json(F.col("html")).alias("payload")).select(
        "url", "html",
        F.col("payload").isNotNull().alias("has_json"),
        variant_kind(F.col("payload"), _LISTING).startswith("OBJECT").alias("has_structured_data"),
        F.try_variant_get("payload", _LISTING, "variant").alias("listing"),
    )
    # Parts several columns read are columns of their own, so each is cut out once.
    cut = parsed.select(
        "*",
        amenity_section(F.col("html")).alias("grid"),
        text.description_section(F.col("html")).alias("description"),
        text.strip_tags(F.col("html")).alias("visible"),
        links(F.col("html")).alias("hrefs"),
    )
    located = with_coordinates(cut)
    listing, html, description = F.col("listing"), F.col("html"), F.col("description")
    gone = F.col("has_json") & ~F.col("has_structured_data")
    values: dict[str, Column] = {
        "source_id": text.listing_number(F.col("visible")),
        "description": description,
        "amenities": F.coalesce(icon_amenities(F.col("grid")), derive_amenities(description)),
        "room_types": room_list(listing),
        "images": image_list(html, cdn_marker),
        "latitude": F.col("latitude"),
        "longitude": F.col("longitude"),
        **contacts(listing, F.col("hrefs"), F.col("visible")),
        **fees(listing, html),
    }
    cols = {name: F.when(~gone, c) for name, c in values.items()}
    for name in ("amenities", "images", "room_types"):
        cols[name] = F.coalesce(cols[name], F.array().cast(schemas.DETAIL_SCHEMA[name].dataType))
    cols["has_structured_data"] = F.col("has_structured_data")
    cols["page_gone"] = gone
    return located.select(
        "url", *[cols[f.name].cast(f.dataType).alias(f.name) for f in schemas.DETAIL_SCHEMA.fields]
    )
