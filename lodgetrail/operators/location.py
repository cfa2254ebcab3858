"""Places of listings: coordinate fallbacks, cache misses, merged cities, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetrail import dims
from lodgetrail.functions import geo
from lodgetrail.functions.text import contains_key, place_key, strip, text_key


def spread_nulls(key: Column, row_id: Column) -> Column:
    """A join key that never matches for rows without one, and never piles them up."""
    return F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("\u0000"), row_id.cast("string")))


def place_key_of() -> Column:
    return place_key(F.col("subdistrict"), F.col("district"), F.col("province"))


def with_map_points(
    listings: DataFrame, address_cache: DataFrame, place_cache: DataFrame,
    own_precise: Column | None = None, row_id: str = "id",
) -> DataFrame:
    """Adds map_lat, map_lon, precise: own point, else the address, else the place.

    Both caches hold one row per ``place_key`` and grow with the catalogue, so
    they are joined by key and only broadcast when Spark measures them small.
    Rows that need no lookup get a key of their own.
    """
    own = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    address_key = F.when(~own, text_key(F.col("address")))
    by_address = address_cache.select(
        F.col("place_key").alias("_ak"), F.struct("lat", "lon").alias("_ap"))
    by_place = place_cache.select(
        F.col("place_key").alias("_pk"), F.struct("lat", "lon").alias("_pp"))
    first = listings.withColumn("_ak", spread_nulls(address_key, F.col(row_id))).join(by_address, "_ak", "left")
    open_key = F.when(~own & F.col("_ap").isNull(), place_key_of())
    both = first.withColumn("_pk", spread_nulls(open_key, F.col(row_id))).join(by_place, "_pk", "left")
    has_digit = F.col("address").rlike("[0-9]")
    return both.withColumns({
        "map_lat": F.when(own, F.col("latitude")).otherwise(F.coalesce("_ap.lat", "_pp.lat")),
        "map_lon": F.when(own, F.col("longitude")).otherwise(F.coalesce("_ap.lon", "_pp.lon")),
        "precise": F.when(own, F.lit(True) if own_precise is None else own_precise)
        .when(F.col("_ap").isNotNull(), has_digit)
        .when(F.col("_pp").isNotNull(), F.lit(False)),
    }).drop("_ak", "_ap", "_pk", "_pp")


def addresses_to_geocode(listings: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct address keys not in the cache, each with the text to look up."""
    wanted = (
        listings.filter(F.coalesce(F.col("address"), F.lit("")) != "")
        .groupBy(text_key(F.col("address")).alias("place_key"))
        .agg(F.min("address").alias("address"))
    )
    return wanted.join(cache.select("place_key"), "place_key", "left_anti")


def places_to_geocode(listings: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (subdistrict, district, province) keys not in the cache."""
    wanted = (
        listings.filter(F.coalesce(F.col("district"), F.lit("")) != "")
        .groupBy(place_key_of().alias("place_key"))
        .agg(*[F.min(c).alias(c) for c in ("subdistrict", "district", "province")])
    )
    return wanted.join(cache.select("place_key"), "place_key", "left_anti")


def upsert_points(cache: DataFrame, found: DataFrame) -> DataFrame:
    """The cache plus points found for keys it does not hold yet."""
    new = found.join(cache.select("place_key"), "place_key", "left_anti").dropDuplicates(["place_key"])
    return cache.unionByName(new)


def with_place_names(listings: DataFrame) -> DataFrame:
    """Adds city, region and quarter of each listing."""
    return listings.withColumns({"city": geo.city_of(), "quarter": geo.district_of()}).withColumn(
        "region", geo.region_of(F.col("city")))


def featured_counts(listings: DataFrame, names=dims.FEATURED_CITIES) -> DataFrame:
    """Listings whose city, province or district contains each name.

    The names are a constant list, so every listing emits its own matches and
    there is nothing to join; names without a match are kept by the caller.
    """
    places = [geo.city_of(), geo.raw_province(), geo.district_of()]
    hits = F.array_compact(F.array(*[
        F.when(contains_key(places[0], F.lit(n)) | contains_key(places[1], F.lit(n)) | contains_key(places[2], F.lit(n)), F.lit(n))
        for n in names
    ]))
    return (
        listings.filter(F.col("status") != "removed")
        .select(F.explode(hits).alias("featured_city"))
        .groupBy("featured_city").agg(F.count(F.lit(1)).alias("listings"))
    )


def city_facets(listings: DataFrame) -> DataFrame:
    """Active listings per city and per (city, quarter), and in total.

    ``level``: 'all', 'city' or 'quarter'. Keys are lower-cased; the shown name
    is the smallest spelling.
    """
    named = with_place_names(listings.filter(F.col("status") == "active"))
    return roll_up(named.select("city", "quarter", F.lit(1).alias("n")))


def roll_up(places: DataFrame) -> DataFrame:
    """The facets of (city, quarter, n); places without a city count nowhere."""
    keyed = places.filter(strip(F.col("city")) != "").select(
        text_key(F.col("city")).alias("city_key"), text_key(F.col("quarter")).alias("quarter_key"), "city", "quarter", "n")
    # Counted once per pair first: the rollup then triples the few groups, not the listings.
    pairs = keyed.groupBy("city_key", "quarter_key").agg(
        F.min("city").alias("city"), F.min("quarter").alias("quarter"), F.sum("n").alias("n"))
    rolled = pairs.rollup("city_key", "quarter_key").agg(
        F.grouping_id().alias("_g"),
        F.min("city").alias("city"), F.min("quarter").alias("quarter"),
        F.sum("n").alias("listings"),
    )
    level = F.when(F.col("_g") == 0, "quarter").when(F.col("_g") == 1, "city").otherwise("all")
    return rolled.filter((F.col("_g") != 0) | (F.col("quarter_key") != "")).select(
        level.alias("level"),
        F.when(F.col("_g") <= 1, F.col("city")).alias("city"),
        F.when(F.col("_g") == 0, F.col("quarter")).alias("quarter"),
        "listings",
    )
