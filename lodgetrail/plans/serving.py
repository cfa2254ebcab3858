"""Catalogue pages, listing cards, the browser view and the maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetrail import dims
from lodgetrail.functions.price import contract_number, price_value, savings
from lodgetrail.operators import filters
from lodgetrail.operators.images import gallery, shown_images, thumbnails
from lodgetrail.plans.paging import RankIndex


def newest_first() -> list[Column]:
    return [F.col("source_updated_at").desc_nulls_last(), F.col("id").desc()]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered result: a top-k, not a full sort."""
    if not 1 <= limit <= dims.MAX_LIMIT or not 0 <= offset <= dims.MAX_OFFSET:
        raise ValueError(f"limit 1..{dims.MAX_LIMIT}, offset 0..{dims.MAX_OFFSET}")
    return df.orderBy(*order).offset(offset).limit(limit)


def catalogue_page(
    state: DataFrame, images: DataFrame, premium: bool, secret: str,
    limit: int = 50, offset: int = 0, **params,
) -> DataFrame:
    """Filter, newest first, one page, thumbnails, masked for the tier.

    The page holds at most 500 rows, so it is the broadcast side against the
    image table, and only its listings' images are aggregated.
    """
    return _shown(page(state.filter(filters.catalogue(**params)), newest_first(), limit, offset), images, premium, secret)


def indexed_page(
    index: RankIndex, images: DataFrame, premium: bool, secret: str, limit: int = 50, offset: int = 0,
    after: int | None = None, **params,
) -> DataFrame:
    """The same page out of a stored order, at any depth, or the one after a place.

    What is read are the ranges that hold the page, and of the others at most the columns of the filter.
    """
    if not 1 <= limit <= dims.MAX_LIMIT:
        raise ValueError(f"limit 1..{dims.MAX_LIMIT}")
    condition = filters.catalogue(**params) if params else None
    found = index.page(limit, offset, condition) if after is None else index.page_after(after, limit, condition)
    return _shown(found, images, premium, secret)


def _shown(chosen: DataFrame, images: DataFrame, premium: bool, secret: str) -> DataFrame:
    """A page with thumbnails, masked for the tier."""
    ids = chosen.select(F.col("id").alias("listing_id"))
    thumbs = thumbnails(images.join(F.broadcast(ids), "listing_id", "left_semi"))
    with_thumbs = chosen.join(
        thumbs.withColumnRenamed("listing_id", "id"), "id", "left")
    return filters.mask(with_thumbs, premium, secret)


def listing_card(state: DataFrame, images: DataFrame, listing_id: int, premium: bool, secret: str) -> DataFrame:
    """One listing with its gallery, one row per shown image in order."""
    card = filters.mask(state.filter(F.col("id") == listing_id), premium, secret)
    own = gallery(images.filter(F.col("listing_id") == listing_id)).select(
        F.col("listing_id").alias("id"), "gallery_no", "image_url")
    return card.join(own, "id", "left").orderBy("gallery_no")


def catalogue_order(sort: str) -> list[Column]:
    """Browser sorts; a listing without a 1-month price counts as infinitely dear."""
    price = F.coalesce(contract_number(F.col("contract_monthly_raw")).cast("double"), F.lit(float("inf")))
    orders = {
        "price_asc": [price.asc(), F.col("id").asc()],
        "price_desc": [price.desc(), F.col("id").asc()],
        "name": [F.lower(F.coalesce("name", F.lit(""))).asc(), F.col("id").asc()],
        "updated": [F.col("source_updated_at").desc_nulls_last(), F.col("id").asc()],
    }
    return orders[sort]


def map_order(sort: str) -> list[Column]:
    """Map-list sorts; a listing without a price comes last both ways."""
    orders = {
        "price_asc": [price_value().asc_nulls_last(), F.col("id").asc()],
        "price_desc": [price_value().desc_nulls_last(), F.col("id").asc()],
        "updated": [F.col("source_updated_at").desc_nulls_last(), F.col("id").asc()],
    }
    return orders[sort]


def browse_page(listings: DataFrame, sort: str = "updated", page_no: int = 1, **params) -> DataFrame:
    chosen = listings.filter(filters.browse(**params))
    return chosen.orderBy(*catalogue_order(sort)).offset((page_no - 1) * dims.PER_PAGE).limit(dims.PER_PAGE)


def map_view(listings: DataFrame, viewport=None, **params) -> DataFrame:
    """Located listings that pass the map filter, inside the viewport if given."""
    shown = listings.filter(filters.located() & filters.map_view(**params))
    return shown if viewport is None else shown.filter(filters.in_viewport(*viewport))


def extent(listings: DataFrame) -> DataFrame:
    """Bounding box of the shown points."""
    return listings.agg(
        F.min("latitude").alias("south"), F.max("latitude").alias("north"),
        F.min("longitude").alias("west"), F.max("longitude").alias("east"),
        F.count(F.lit(1)).alias("points"),
    )


def price_ceiling(listings: DataFrame) -> DataFrame:
    """Largest price rounded up to the next thousand; 0 without prices."""
    top = F.max(price_value())
    return listings.agg(F.coalesce(F.ceil(top / 1000) * 1000, F.lit(0)).cast("bigint").alias("price_ceiling"))


def city_map(
    listings: DataFrame, province: str | None = None, district: str | None = None,
    price_min: int = 0, price_max: int | None = None, monthly_only: bool = False,
) -> DataFrame:
    """Pins of one city under its price toggles.

    An untouched upper handle means no upper bound, so the ceiling (which only
    scales the widget) need not be computed first.
    """
    shown = listings.filter(
        filters.catalogue(province=province, district=district, status="active") & filters.located())
    bound = 2**62 if price_max is None else price_max + 1
    upper = 2**62 if price_max is None else price_max
    return shown.filter(filters.city_map_price(price_min, upper, bound, monthly_only))


def teaser(listings: DataFrame) -> DataFrame:
    """Local price against the short-stay estimate, for listings not removed."""
    local = F.coalesce("contract_monthly_min", "price_monthly_min")
    open_ = listings.filter(F.col("status") != "removed")
    return open_.select("id", local.alias("local_price"), *[c.alias(n) for n, c in savings(local).items()])


def funnel_matches(preferences: DataFrame, listings: DataFrame) -> DataFrame:
    """Active listings per questionnaire session, by place and budget.

    Answers are first grouped: listings are counted once per distinct
    (place, budget) answer, of which the questionnaire has a fixed number.
    """
    spark = preferences.sparkSession
    answers = (
        preferences.groupBy("location", "budget").agg(F.count(F.lit(1)).alias("sessions"))
        .join(F.broadcast(dims.location_frame(spark)), "location", "left")
        .join(F.broadcast(dims.budget_frame(spark)), "budget", "left")
    )
    # One (place, price range) row per listing and place it answers to, pre-counted.
    places = F.array(
        F.struct(F.lit("province").alias("c"), F.lower("province").alias("v")),
        F.struct(F.lit("district").alias("c"), F.lower("district").alias("v")),
        F.struct(F.lit("any").alias("c"), F.lit("any").alias("v")),
    )
    fits = F.array(*[
        F.when(filters.price_overlap(lo, hi), F.lit(name)) for name, (lo, hi) in dims.BUDGET_RANGES.items()
    ] + [F.lit("any")])
    supply = (
        listings.filter(F.col("status") == "active")
        .select(F.explode(places).alias("p"), F.array_compact(fits).alias("fits"))
        .select("p.c", "p.v", F.explode("fits").alias("fit"))
        .groupBy("c", "v", "fit").agg(F.count(F.lit(1)).alias("matches"))
    )
    wanted = answers.select(
        "location", "budget", "sessions",
        F.coalesce("filter_column", F.lit("any")).alias("c"),
        F.lower(F.coalesce("filter_value", F.lit("any"))).alias("v"),
        F.when(F.col("budget_min").isNull() & F.col("budget_max").isNull(), "any")
        .otherwise(F.col("budget")).alias("fit"),
    )
    return wanted.join(supply, ["c", "v", "fit"], "left").select(
        "location", "budget", "sessions", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"))


def shown_image_count(images: DataFrame) -> DataFrame:
    return shown_images(images).groupBy("listing_id").agg(F.count(F.lit(1)).alias("shown_images"))
