"""Landed list pages: embedded JSON, cards, page counts, links, text cards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetrail import dims, schemas
from lodgetrail.functions import clock, geo
from lodgetrail.functions.fees import variant_kind, variant_text
from lodgetrail.functions.price import contract_flag, format_price, parse_price_range
from lodgetrail.functions.text import (
    address_text, blank_to_null, first_match, is_verified_text, prefixed, strip, strip_tags, text_lines,
)

_EMBEDDED_JSON = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'
_HREF = r'(?i)<a\b[^>]*?\bhref="([^"]*)"'


def embedded_json(html: Column) -> Column:
    """The page's JSON payload as VARIANT; NULL if missing or malformed."""
    return F.try_parse_json(first_match(html, _EMBEDDED_JSON))


def page_count(payload: Column) -> Column:
    """Declared number of pages; digit text counts, booleans and values under 1 do not."""
    path = "$.props.pageProps.pagination.totalPages"
    kind = variant_kind(payload, path)
    text = variant_text(payload, path)
    number = F.when(kind.rlike("^(BIGINT|STRING)") & text.rlike(r"^\d+$"), text.try_cast("bigint"))
    return F.when(number >= 1, number)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(_HREF), F.lit(1))


def last_linked_page(html: Column, marker: str) -> Column:
    """Largest N over links that end in '<marker>/N'; at least 1."""
    pattern = f"{re.escape(marker)}/(\\d+)$"
    numbers = F.transform(links(html), lambda u: F.regexp_extract(u, pattern, 1).try_cast("bigint"))
    return F.greatest(F.lit(1).cast("bigint"), F.array_max(numbers))


def last_page(html: Column, marker: str) -> Column:
    return F.coalesce(page_count(embedded_json(html)), last_linked_page(html, marker))


def with_payload(pages: DataFrame) -> DataFrame:
    """Adds ``payload``, parsed once per page."""
    return pages.withColumn("payload", embedded_json(F.col("html")))


def explode_cards(pages: DataFrame) -> DataFrame:
    """One row per card with its place in the page; pages without a list give none."""
    cards = F.try_variant_get("payload", "$.props.pageProps.listings", "array<variant>")
    keep = [c for c in pages.columns if c not in ("html", "payload")]
    return pages.select(*keep, F.posexplode(cards).alias("card_no", "card"))


def _mapping_or_absent(card: Column, path: str) -> Column:
    """An object, or one of the empty values that stand for one."""
    empty = F.to_json(F.try_variant_get(card, path, "variant")).isin('""', "0", "false", "[]")
    return variant_kind(card, path).rlike("^(OBJECT|VOID|$)") | F.coalesce(empty, F.lit(False))


def _text_or_absent(card: Column, path: str) -> Column:
    return variant_kind(card, path).rlike("^(STRING|VOID)?$")


def _count_or_absent(card: Column, path: str) -> Column:
    return variant_kind(card, path).rlike("^(BIGINT|VOID)?$")


_TERMS = {"contract_monthly": "oneMonth", "contract_3_month": "threeMonth", "contract_6_month": "sixMonth"}


def card_is_valid() -> Column:
    """A card whose fields have the expected shapes; the rest is quarantined alone."""
    card = F.col("card")
    mappings = ["$.price", "$.price.monthly", "$.price.daily", "$.price.shortTerm",
                "$.promotion", "$.addressDocument"]
    mappings += [f"$.price.shortTerm.{t}" for t in _TERMS.values()]
    texts = ["$.street", "$.road", "$.subdistrict", "$.district", "$.province", "$.updatedAt", "$.modifiedAt"]
    ok = variant_kind(card, "$").startswith("OBJECT")
    for path in ("$.slug", "$.name"):
        ok = ok & (variant_kind(card, path) == "STRING") & (variant_text(card, path) != "")
    for path in mappings:
        ok = ok & _mapping_or_absent(card, path)
    for path in texts:
        ok = ok & _text_or_absent(card, path)
    for side in ("monthly", "daily"):
        unused = ~(variant_text(card, f"$.price.{side}.type").eqNullSafe("AMOUNT"))
        for end in ("minPrice", "maxPrice"):
            ok = ok & (unused | _count_or_absent(card, f"$.price.{side}.{end}"))
    for term in _TERMS.values():
        unused = ~_is_short(card, term)
        for end in ("minPrice", "maxPrice"):
            ok = ok & (unused | _count_or_absent(card, f"$.price.shortTerm.{term}.{end}"))
    return ok


def _is_short(card: Column, term: str) -> Column:
    return F.coalesce(
        F.try_variant_get(card, f"$.price.shortTerm.{term}.shortContract", "boolean"), F.lit(False)
    )


def project_cards(cards: DataFrame, base_url: str, cdn_url: str) -> DataFrame:
    """Cards with a ``card`` VARIANT to the raw listing columns, keeping the others."""
    card = F.col("card")

    def amount(path: str) -> Column:
        return F.try_variant_get(card, path, "bigint")

    cols: dict[str, Column] = {
        "name": variant_text(card, "$.name"),
        "slug": variant_text(card, "$.slug"),
    }
    cols["url"] = F.concat(F.lit(f"{base_url}/en/"), cols["slug"])
    for part in ("subdistrict", "district", "province"):
        cols[part] = variant_text(card, f"$.{part}")
    cols["address"] = address_text(
        variant_text(card, "$.street"), variant_text(card, "$.road"),
        cols["subdistrict"], cols["district"], cols["province"],
    )
    for target, side, unit in (("price_monthly", "monthly", "THB/month"), ("daily_price", "daily", "THB/day")):
        is_amount = variant_text(card, f"$.price.{side}.type") == "AMOUNT"
        low = F.when(is_amount, amount(f"$.price.{side}.minPrice"))
        high = F.when(is_amount, amount(f"$.price.{side}.maxPrice"))
        cols[f"{target}_raw"] = format_price(low, high, unit)
        cols[f"{target}_min"], cols[f"{target}_max"] = low, high
    for target, term in _TERMS.items():
        low = F.when(_is_short(card, term), amount(f"$.price.shortTerm.{term}.minPrice"))
        high = F.when(_is_short(card, term), amount(f"$.price.shortTerm.{term}.maxPrice"))
        cols[f"{target}_raw"] = format_price(low, high, "THB/month")
        cols[f"{target}_min"], cols[f"{target}_max"] = low, high
    structured = variant_kind(card, "$.price.shortTerm.oneMonth") != ""
    cols["has_monthly_contract"] = (
        F.when(~structured, "unknown")
        .when(cols["contract_monthly_raw"].isNotNull(), "true").otherwise("false")
    )
    cols["from_structured_list"] = structured
    cols["source_updated_at"] = clock.parse_iso(F.coalesce(
        F.nullif(variant_text(card, "$.updatedAt"), F.lit("")), variant_text(card, "$.modifiedAt")
    ))
    cols["thumbnail_url"] = prefixed(cdn_url, variant_text(card, "$.coverPicture"))
    cols["is_verified"] = F.coalesce(
        variant_text(card, "$.addressDocument.reviewStatus") == "VERIFIED", F.lit(False))
    promotion = variant_text(card, "$.promotion.type")
    cols["has_promotion"] = F.coalesce(promotion != "NO_PROMOTION", F.lit(False))
    keep = [F.col(c) for c in cards.columns if c != "card"]
    return cards.select(*keep, *[cols[f.name].cast(f.dataType).alias(f.name) for f in schemas.RAW_SCHEMA.fields])


def read_cards(pages: DataFrame, base_url: str, cdn_url: str) -> DataFrame:
    """Landed pages to raw listings; a malformed card is dropped, its page survives."""
    cards = explode_cards(with_payload(pages))
    return project_cards(cards.filter(card_is_valid()), base_url, cdn_url)


def read_html_cards(pages: DataFrame, base_url: str, cdn_url: str) -> DataFrame:
    """Raw listings of pages without usable embedded JSON, from their visible cards.

    A card is a list item that names a price and links to a listing; links of
    the navigation don't count. Items without a link or a name are left out.
    """
    listed = F.try_variant_get("payload", "$.props.pageProps.listings", "array<variant>")
    bare = with_payload(pages).filter(listed.isNull())
    keep = [c for c in pages.columns if c != "html"]
    items = F.regexp_extract_all("html", F.lit(r"(?is)<li\b[^>]*>(.*?)</li\s*>"), F.lit(1))
    cards = bare.select(*keep, F.posexplode(items).alias("card_no", "item")).filter(
        F.contains("item", F.lit("THB")) | F.contains("item", F.lit("Contract monthly")))
    anchors = F.regexp_extract_all("item", F.lit(r"""(?is)<a\b[^>]*?\bhref=["'](/en/[^"'/]+)["'][^>]*>.*?</a\s*>"""), F.lit(0))
    slug = lambda a: F.regexp_extract(a, r"""(?i)\bhref=["']/en/([^"'/]+)""", 1)
    own = F.get(F.filter(anchors, lambda a: ~slug(a).isin(*dims.UTILITY_SLUGS)), F.lit(0))
    heading = first_match(F.col("item"), r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>")
    named = cards.withColumn("anchor", own).filter("anchor IS NOT NULL").select(
        *keep, "card_no", slug(F.col("anchor")).alias("slug"),
        F.coalesce(blank_to_null(strip(strip_tags(F.col("anchor"), " "))), blank_to_null(strip(strip_tags(heading, " ")))).alias("name"),
        strip_tags(F.col("item")).alias("card_text"),
        first_match(F.col("item"), rf"""(?i)<img\b[^>]*?\bsrc=["']({re.escape(cdn_url)}[^"'?]*)""").alias("thumbnail_url"))
    read = read_text_cards(named.filter("name IS NOT NULL"))
    prices: dict[str, Column] = {}
    for target in ("price_monthly", "daily_price", *_TERMS):
        both = parse_price_range(F.col(f"{target}_raw"))
        prices[f"{target}_min"], prices[f"{target}_max"] = both["min"], both["max"]
    read = read.withColumns({
        **prices, "url": F.concat(F.lit(f"{base_url}/en/"), "slug"), "from_structured_list": F.col("contract_monthly_raw").isNotNull()})
    return read.select(*[c for c in keep if c not in schemas.RAW_SCHEMA.names], "card_no", *[
        F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.RAW_SCHEMA.fields])


def quarantined_cards(pages: DataFrame) -> DataFrame:
    """The cards ``read_cards`` leaves out, as JSON text."""
    cards = explode_cards(with_payload(pages)).filter(~card_is_valid())
    return cards.withColumn("card", F.to_json("card"))


# ---- text cards (pages without the embedded JSON) ---------------------------

def labelled_price(lines: Column, label: str) -> Column:
    """Line after a label; the unit may have slipped to the line after that."""
    at = F.array_position(lines, label).cast("int")
    value = F.when(at > 0, F.get(lines, at))
    unit = F.when(at > 0, F.get(lines, at + 1))
    has_unit = F.contains(F.upper(value), F.lit("THB"))
    joined = F.when(
        ~has_unit & F.startswith(F.upper(unit), F.lit("THB")), F.concat_ws(" ", value, unit)
    ).otherwise(value)
    return F.when(value == "-", value).when(value.rlike("[0-9,]"), joined)


def suffixed_price(text: Column, suffix: str) -> Column:
    return first_match(text, rf"([\d,]+(?:\s*-\s*[\d,]+)?\s*{re.escape(suffix)})")


def address_line(lines: Column, name: Column) -> Column:
    """First line that names a province and is not a label, price or the title."""
    candidates = F.filter(
        lines,
        lambda s: (s != name)
        & (F.length(s) < 150)
        & ~s.rlike(r"(?i)THB|month|day|Contract|Filter|Sort|Browse")
        & geo.names_a_province(s),
    )
    return F.get(candidates, F.lit(0))


def read_text_cards(cards: DataFrame) -> DataFrame:
    """Rows with ``name`` and ``card_text`` to price, place, date and flag columns."""
    lined = cards.withColumn("lines", text_lines(F.col("card_text")))
    text, lines = F.col("card_text"), F.col("lines")
    monthly = labelled_price(lines, "Contract monthly")
    first = lined.select(
        *cards.columns,
        monthly.alias("contract_monthly_raw"),
        labelled_price(lines, "Contract 3 month").alias("contract_3_month_raw"),
        labelled_price(lines, "Contract 6 month").alias("contract_6_month_raw"),
        suffixed_price(text, "THB/month").alias("price_monthly_raw"),
        suffixed_price(text, "THB/day").alias("daily_price_raw"),
        address_line(lines, F.col("name")).alias("address"),
        clock.parse_local(text).alias("source_updated_at"),
        is_verified_text(text).alias("is_verified"),
        F.contains(text, F.lit("PROMOTION")).alias("has_promotion"),
    )
    place = geo.location_parts(F.col("address"))
    return (
        first.withColumn("place", place)
        .withColumn("has_monthly_contract", contract_flag(F.col("contract_monthly_raw")))
        .select("*", "place.subdistrict", "place.district", "place.province")
        .drop("place", "card_text")
    )
