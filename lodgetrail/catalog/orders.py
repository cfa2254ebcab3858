"""O: sorts, limits, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgetrail import adapters, dims
from lodgetrail.catalog.aggregates import FACETS
from lodgetrail.catalog.joins import FEATURED
from lodgetrail.catalog.registry import query
from lodgetrail.catalog.twins import CAT, IMG, PLACES, contract_num
from lodgetrail.functions import amenities
from lodgetrail.operators import filters, images, location, ordered
from lodgetrail.plans import exports, serving
from lodgetrail.plans.paging import RankIndex
from lodgetrail.session import new_work_dir


def numbered(df, *cols):
    """Rows with their place in the result; pages are at most a few hundred rows."""
    from pyspark.sql import Window

    return df.withColumn("_i", F.monotonically_increasing_id()).select(
        *cols, F.row_number().over(Window.orderBy("_i")).cast("bigint").alias("place"))


@query("O1_paged_catalogue", f"""
WITH {CAT}, p AS (SELECT id FROM cat ORDER BY source_updated_at DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100)
SELECT p.id, row_number() OVER (ORDER BY source_updated_at DESC NULLS LAST, p.id DESC) AS place FROM p JOIN cat ON cat.id = p.id
""")
def o1(spark, sf):
    cat = adapters.catalogue(spark, sf)
    return numbered(serving.page(cat, serving.newest_first(), 50, 100), "id")


@adapters.remembered
def newest_index(spark, sf) -> RankIndex:
    """The catalogue stored newest first."""
    return RankIndex.build(adapters.catalogue(spark, sf), serving.newest_first(), new_work_dir(spark, "rank"), rows_per_range=500)


_PLACED = "o AS (SELECT *, row_number() OVER (ORDER BY source_updated_at DESC NULLS LAST, id DESC) AS place FROM cat)"


@query("O1_deep_page", f"WITH {CAT}, {_PLACED} SELECT id, place FROM o WHERE place BETWEEN 976 AND 1025")
def o1_deep(spark, sf):
    return newest_index(spark, sf).page(50, 975).select("id", "place")


@query("O1_deep_filtered_page", f"""
WITH {CAT}, {_PLACED} SELECT id, place FROM o WHERE status = 'active' AND lower(province) = 'phuket' ORDER BY place LIMIT 20 OFFSET 10
""")
def o1_filtered(spark, sf):
    wanted = filters.catalogue(province="Phuket", status="active")
    return newest_index(spark, sf).page(20, 10, wanted).select("id", "place")


@query("O1_page_after", f"WITH {CAT}, {_PLACED} SELECT id, place FROM o WHERE place > 640 AND has_monthly_contract = 'true' ORDER BY place LIMIT 50")
def o1_after(spark, sf):
    return newest_index(spark, sf).page_after(640, 50, F.col("has_monthly_contract") == "true").select("id", "place")


@query("O2_export_order", f"WITH {CAT} SELECT id, province, price_monthly_min FROM cat WHERE status = 'active' ORDER BY province NULLS FIRST, price_monthly_min NULLS FIRST")
def o2(spark, sf):
    return exports.export_rows(adapters.catalogue(spark, sf)).select("id", "province", "price_monthly_min")


_ONE = contract_num("contract_monthly_raw")


@query("O3_catalogue_sorts", f"""
WITH {CAT}, p AS (SELECT id, COALESCE({_ONE}::DOUBLE, 'Infinity'::DOUBLE) AS price, lower(COALESCE(name, '')) AS n FROM cat),
asc_ AS (SELECT id, row_number() OVER (ORDER BY price, id) AS place FROM p),
desc_ AS (SELECT id, row_number() OVER (ORDER BY price DESC, id) AS place FROM p),
names AS (SELECT id, row_number() OVER (ORDER BY n, id) AS place FROM p)
SELECT 'price_asc' AS sort, id, place FROM asc_ UNION ALL SELECT 'price_desc', id, place FROM desc_
UNION ALL SELECT 'name', id, place FROM names
""")
def o3(spark, sf):
    cat = adapters.catalogue(spark, sf)
    parts = [
        ordered.placed(cat, *serving.catalogue_order(s)).select(F.lit(s).alias("sort"), "id", "place")
        for s in ("price_asc", "price_desc", "name")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("O4_map_list_sorts", f"""
WITH {CAT}, p AS (SELECT id, CASE WHEN COALESCE(contract_monthly_min, price_monthly_min) > 0 THEN COALESCE(contract_monthly_min, price_monthly_min) END AS price FROM cat),
asc_ AS (SELECT id, row_number() OVER (ORDER BY price NULLS LAST, id) AS place FROM p),
desc_ AS (SELECT id, row_number() OVER (ORDER BY price DESC NULLS LAST, id) AS place FROM p)
SELECT 'price_asc' AS sort, id, place FROM asc_ UNION ALL SELECT 'price_desc', id, place FROM desc_
""")
def o4(spark, sf):
    cat = adapters.catalogue(spark, sf)
    up, down = (
        ordered.placed(cat, *serving.map_order(s)).select(F.lit(s).alias("sort"), "id", "place")
        for s in ("price_asc", "price_desc")
    )
    return up.unionByName(down)


@query("O5_page_slice", f"""
WITH {CAT}
SELECT id, name FROM cat WHERE status = 'active' ORDER BY lower(COALESCE(name, '')), id LIMIT {dims.PER_PAGE} OFFSET {2 * dims.PER_PAGE}
""")
def o5(spark, sf):
    return serving.browse_page(adapters.catalogue(spark, sf), "name", 3).select("id", "name")


@query("O6_facet_order", f"""
WITH {PLACES}, {FACETS}
SELECT level, city, quarter, listings FROM facets WHERE level <> 'all' ORDER BY level, listings DESC, lower(quarter)
""")
def o6(spark, sf):
    menus = location.city_facets(adapters.catalogue(spark, sf)).filter(F.col("level") != "all")
    return menus.orderBy(
        "level", F.when(F.col("level") == "city", -F.col("listings")), F.collate("quarter", "fr_CI_AI"), "city"
    )


@query("O7_work_batch", f"""
WITH {IMG} SELECT image_id, image_url FROM img WHERE reviewed_at IS NULL ORDER BY image_id LIMIT 100
""")
def o7(spark, sf):
    return images.review_queue(adapters.images(spark, sf), limit=100).select("image_id", "image_url")


@query("O8_array_head", f"""
WITH {CAT}, c AS (SELECT id, [x FOR x IN COALESCE(amenities, []) IF x <> 'Air Conditioner'] AS chips FROM cat)
SELECT id, COALESCE(array_to_string(chips[1:3], '|'), '') AS shown, greatest(len(chips) - 3, 0)::BIGINT AS hidden FROM c
""")
def o8(spark, sf):
    order = [n for n, _, _ in adapters.AMENITY_RULES]
    chips = amenities.chips(F.col("amenities"), order)
    return adapters.catalogue(spark, sf).select(
        "id", F.array_join(amenities.shown(chips, 3), "|").alias("shown"), amenities.hidden_count(chips, 3).alias("hidden"))


@query("O9_featured_dropdown", f"WITH {PLACES} {FEATURED} ORDER BY listings DESC, featured_city")
def o9(spark, sf):
    return location.featured_counts(adapters.catalogue(spark, sf)).orderBy(F.desc("listings"), "featured_city")
