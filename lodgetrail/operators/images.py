"""Listing images: order, thumbnails, reviews, duplicates and watermarks."""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetrail import dims
from lodgetrail.operators.ordered import row_numbers
from lodgetrail.session import stage

# Ordinals per chunk when positions are numbered: a listing with millions of
# images is numbered in pieces of this size.
_ORDINALS_PER_CHUNK = 4096


def shown_images(images: DataFrame) -> DataFrame:
    """Images not excluded by a review; an unset flag keeps the image."""
    return images.filter(~F.coalesce(F.col("excluded"), F.lit(False)))


def thumbnails(images: DataFrame, listing: str = "listing_id", tie=("image_id",)) -> DataFrame:
    """First shown image per listing; equal positions go to the lowest id."""
    return shown_images(images).groupBy(listing).agg(
        F.min_by("image_url", F.struct("position", *tie)).alias("thumbnail"))


def first_positions(images: DataFrame, listing: str = "listing_id") -> DataFrame:
    return shown_images(images).groupBy(listing).agg(F.min("position").alias("first_position"))


def gallery(images: DataFrame, listing: str = "listing_id", tie=("image_id",)) -> DataFrame:
    """Shown images as numbered rows.

    Rows, not an array per listing: a listing that owns a large part of all
    images is still spread over tasks.
    """
    chunk = F.floor(F.col("position") / _ORDINALS_PER_CHUNK)
    return row_numbers(shown_images(images), [listing], ["position", *tie], chunk, "gallery_no")


def new_image_rows(batch: DataFrame, images: DataFrame) -> DataFrame:
    """Image rows a scan adds: unknown addresses, numbered after the stored ones.

    ``batch`` needs ``slug``, ``images`` (array), ``thumbnail_url`` and
    ``was_known``. A new listing without images gets its thumbnail.
    """
    only_thumbnail = (
        ~F.col("was_known")
        & (F.coalesce(F.size("images"), F.lit(0)) <= 0)
        & (F.coalesce(F.col("thumbnail_url"), F.lit("")) != "")
    )
    offered = F.when(only_thumbnail, F.array("thumbnail_url")).otherwise(F.col("images"))
    urls = batch.select("slug", F.posexplode(offered).alias("ordinal", "image_url"))
    distinct = urls.groupBy("slug", "image_url").agg(F.min("ordinal").cast("bigint").alias("ordinal"))
    return append_images(distinct, images)


def append_images(offers: DataFrame, images: DataFrame, ordinals_per_chunk: int = _ORDINALS_PER_CHUNK) -> DataFrame:
    """Offers (slug, image_url, ordinal), each address once, as rows after the stored ones."""
    fresh = offers.join(images.select("slug", "image_url"), ["slug", "image_url"], "left_anti")
    numbered = row_numbers(
        fresh, ["slug"], ["ordinal"], F.floor(F.col("ordinal") / ordinals_per_chunk), "_n")
    last = images.groupBy("slug").agg(F.max("position").alias("_last"))
    return numbered.join(last, "slug", "left").select(
        "slug", "image_url",
        (F.coalesce(F.col("_last"), F.lit(-1)) + F.col("_n")).cast("bigint").alias("position"),
        F.lit(None).cast("boolean").alias("excluded"),
        F.lit(None).cast("string").alias("exclusion_reason"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
    )


def duplicate_groups(images: DataFrame, listing: str = "listing_id") -> DataFrame:
    return images.groupBy(listing, "image_url").agg(
        F.min("image_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def deduplicate(images: DataFrame, listing: str = "listing_id") -> DataFrame:
    """Lowest id per (listing, address)."""
    rest = [c for c in images.columns if c not in (listing, "image_url")]
    kept = images.groupBy(listing, "image_url").agg(F.min_by(F.struct(*rest), "image_id").alias("_row"))
    return kept.select(*[
        F.col(c) if c in (listing, "image_url") else F.col(f"_row.{c}").alias(c) for c in images.columns])


def review_queue(images: DataFrame, listing_id=None, limit: int | None = None, listing: str = "listing_id") -> DataFrame:
    """Unreviewed images by id; a limit is the size of a work batch."""
    queue = images.filter(F.col("reviewed_at").isNull())
    if listing_id is not None:
        queue = queue.filter(F.col(listing) == listing_id)
    queue = queue.orderBy("image_id")
    return queue if limit is None else queue.limit(limit)


def pending_listings(images: DataFrame, limit: int | None = None, listing: str = "listing_id") -> DataFrame:
    queue = images.filter(F.col("reviewed_at").isNull()).select(listing).distinct().orderBy(listing)
    return queue if limit is None else queue.limit(limit)


def verdict(
    has_qr: Column, has_text: Column, watermarked: Column | None = None,
    foreign_logo: Column | None = None, error: Column | None = None,
) -> tuple[Column, Column]:
    """(excluded, reason); an error is noted but never excludes."""
    named = [("qr_code", has_qr), ("text_overlay", has_text)]
    if watermarked is not None:
        named.append(("repeated_watermark", watermarked))
    if foreign_logo is not None:
        named.append(("foreign_logo", foreign_logo))
    reasons = F.concat_ws(",", *[F.when(flag, F.lit(name)) for name, flag in named])
    failed = F.lit(False) if error is None else error.isNotNull()
    reason = F.nullif(reasons, F.lit(""))
    if error is not None:
        reason = F.coalesce(error, reason)
    return (~failed & (reasons != "")), reason


def apply_reviews(images: DataFrame, reviews: DataFrame, reviewed_at: Column, key="image_id") -> DataFrame:
    """Reviewed images take the verdict columns ``excluded`` and ``exclusion_reason``."""
    incoming = reviews.select(key, F.col("excluded").alias("_x"), F.col("exclusion_reason").alias("_r"), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    replaced = {
        "excluded": F.when(hit, F.col("_x")).otherwise(F.col("excluded")),
        "exclusion_reason": F.when(hit, F.col("_r")).otherwise(F.col("exclusion_reason")),
        "reviewed_at": F.when(hit, reviewed_at).otherwise(F.col("reviewed_at")),
    }
    return images.join(incoming, key, "left").select(*[
        replaced[c].alias(c) if c in replaced else F.col(c) for c in images.columns])


def review_counters(reviews: DataFrame) -> DataFrame:
    failed = F.col("exclusion_reason").startswith("fetch_error") | F.col("exclusion_reason").startswith("api_error")
    return reviews.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if("excluded").alias("excluded"),
        F.count_if(failed).alias("errors"),
    )


# ---- near duplicates ---------------------------------------------------------

# Blocks that two close hashes must agree on to meet.
_AGREE = 3


def agreement_masks(distance: int, agree: int, bits: int = 64) -> list[int]:
    """Masks of every choice of ``agree`` out of ``distance + agree`` bit blocks.

    Hashes at most ``distance`` bits apart differ in at most that many blocks,
    so they are equal under one of the masks at least. More blocks make longer
    keys (fewer strangers per key) but more keys per hash.
    """
    blocks = distance + agree
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(block, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _mask_array(distance: int, agree: int) -> Column:
    return F.array(*[F.lit(m).cast("bigint") for m in agreement_masks(distance, agree)])


def distinct_hashes(corners: DataFrame, group=("listing_id", "corner")) -> DataFrame:
    """Equal hashes of a group collapse to one row with their number of images."""
    return corners.groupBy(*group, "hash").agg(F.count(F.lit(1)).alias("images"))


def near_links(
    hashes: DataFrame, distance: int = dims.HASH_DISTANCE_THRESHOLD, group=("listing_id", "corner"),
    agree: int = _AGREE,
) -> DataFrame:
    """(hash, near_hash) of different hash values at most ``distance`` bits apart, both ways.

    Candidates meet on (group, mask, masked hash), never on the group alone:
    ``agree`` agreeing blocks. A pair counts only under the first mask it agrees
    on, which makes it unique without a distinct. Every close pair is found,
    whatever the size of the group.
    """
    masks = _mask_array(distance, agree)
    keys = F.transform(masks, lambda m: F.struct(m.alias("mask"), F.col("hash").bitwiseAND(m).alias("masked")))
    keyed = hashes.select(*group, "hash", F.explode(keys).alias("k")).select(*group, "hash", "k.mask", "k.masked")
    other = keyed.select(*group, F.col("hash").alias("near_hash"), "mask", "masked")
    close = keyed.join(other, [*group, "mask", "masked"]).filter(
        (F.col("hash") < F.col("near_hash"))
        & (F.bit_count(F.col("hash").bitwiseXOR(F.col("near_hash"))) <= distance))
    first = F.get(
        F.filter(masks, lambda m: F.col("hash").bitwiseXOR(F.col("near_hash")).bitwiseAND(m) == 0), F.lit(0))
    one_way = close.filter(F.col("mask") == first).select(*group, "hash", "near_hash")
    return one_way.select(*group, F.explode(F.array(
        F.struct("hash", "near_hash"),
        F.struct(F.col("near_hash").alias("hash"), F.col("hash").alias("near_hash")),
    )).alias("p")).select(*group, "p.hash", "p.near_hash")


def cluster_sizes(hashes: DataFrame, links: DataFrame, group=("listing_id", "corner")) -> DataFrame:
    """Images within reach of each hash value, its own copies included."""
    weights = hashes.select(*group, F.col("hash").alias("near_hash"), "images")
    near = links.join(weights, [*group, "near_hash"]).groupBy(*group, "hash").agg(F.sum("images").alias("_near"))
    return hashes.join(near, [*group, "hash"], "left").select(
        *group, "hash", "images", (F.col("images") + F.coalesce("_near", F.lit(0))).alias("cluster_size"))


# fixed values: corners in the order they are analysed
CORNERS = ("top_left", "top_right", "bottom_left", "bottom_right")


def watermarked_images(
    corners: DataFrame, distance: int = dims.HASH_DISTANCE_THRESHOLD, minimum: int = dims.MIN_CLUSTER_SIZE,
    order: str = "image_id",
) -> DataFrame:
    """Ids of images that a pass over their listing flags.

    Corner by corner and, within one, image by image by ``order``: an image that is not flagged yet and has at least
    ``minimum`` images (itself included) with a close hash in this corner flags them all. Links and cluster sizes are
    joins on hash values. Only hashes in large clusters go on to the pass; a listing's images that agree on all of
    these are one row, since they are only ever flagged together. So what meets in a task are a listing's different
    combinations of shared corners, not its images.
    """
    hashes = distinct_hashes(corners)
    links = near_links(hashes, distance)
    centres = cluster_sizes(hashes, links).filter(F.col("cluster_size") >= minimum).select("listing_id", "corner", "hash")
    own = centres.select("*", F.col("hash").alias("near_hash"))
    arms = stage(links.join(centres, ["listing_id", "corner", "hash"]).unionByName(own), "clusters")
    shared = arms.select("listing_id", "corner", F.col("near_hash").alias("hash")).distinct()
    met = corners.join(shared, ["listing_id", "corner", "hash"], "left_semi")
    at = [F.max(F.when(F.col("corner") == c, F.col("hash"))).alias(c) for c in CORNERS]
    combined = stage(met.groupBy("listing_id", "image_id", *([order] if order != "image_id" else [])).agg(*at), "corner-sets")
    classes = combined.groupBy("listing_id", *CORNERS).agg(F.min(order).alias("first"))

    def walk(images: pa.Table, arms: pa.Table) -> pa.Table:
        images = images.sort_by("first")
        own = [images.column(c).to_pylist() for c in CORNERS]
        close: dict[tuple[str, int], list[int]] = {}
        for corner, hash_, near in zip(*(arms.column(c).to_pylist() for c in ("corner", "hash", "near_hash"))):
            close.setdefault((corner, hash_), []).append(near)
        flagged = [False] * images.num_rows
        for corner, values in zip(CORNERS, own):
            holders: dict[int | None, list[int]] = {}
            for k, v in enumerate(values):
                holders.setdefault(v, []).append(k)
            for k, v in enumerate(values):
                if v is not None and not flagged[k]:
                    for near in close.get((corner, v), ()):
                        for other in holders.get(near, ()):
                            flagged[other] = True
        return images.select(["listing_id", *CORNERS]).filter(pa.array(flagged, pa.bool_()))

    listing = corners.schema["listing_id"].dataType.simpleString()
    found = classes.groupBy("listing_id").cogroup(arms.groupBy("listing_id")).applyInArrow(
        walk, f"listing_id {listing}, " + ", ".join(f"{c} bigint" for c in CORNERS))
    same = [combined[c].eqNullSafe(found[c]) for c in ("listing_id", *CORNERS)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return combined.join(found, on, "left_semi").select("image_id").distinct()
