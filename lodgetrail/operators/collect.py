"""From scanned cards to one merged row per listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetrail import dims, schemas
from lodgetrail.functions.price import is_short_term


def first_occurrence(cards: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row per key.

    An aggregate rather than a ranking window: repeats collapse before the
    shuffle, so a slug repeated on every page moves once per task.
    """
    rest = [c for c in cards.columns if c not in keys]
    kept = cards.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*cards.columns)


def occurrence_counts(cards: DataFrame, keys: list[str]) -> DataFrame:
    return cards.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cards"), (F.count(F.lit(1)) - 1).alias("ignored_duplicates"))


def pages_with_first_cards(
    cards: DataFrame, scan: str, slug: str, page: str, order: list[str]
) -> DataFrame:
    """Pages per scan that contributed at least one first-seen card."""
    firsts = cards.groupBy(scan, slug).agg(F.min_by(page, F.struct(*order)).alias("_page"))
    per_page = firsts.groupBy(scan, "_page").agg(F.count(F.lit(1)).alias("_n"))
    return per_page.groupBy(scan).agg(
        F.count("_page").alias("pages_scanned"), F.sum("_n").cast("bigint").alias("listings_found"))


def unseen(cards: DataFrame, known: DataFrame, key: str = "slug") -> DataFrame:
    """Cards whose key was not collected yet."""
    return cards.join(known.select(key), key, "left_anti")


def precedence_union(main: DataFrame, location: DataFrame, order: list[str]) -> DataFrame:
    """The main list, plus location cards new to it that offer a short stay.

    A slug counts as known once met, so its first location card alone decides.
    """
    extra = first_occurrence(unseen(location, main), ["slug"], order).filter(is_short_term())
    return main.unionByName(extra)


def attach_details(raw: DataFrame, details: DataFrame, key: str = "url") -> DataFrame:
    """Detail columns beside each card; cards without a detail page keep NULLs.

    A page landed twice counts once, so a card never doubles: one that was
    still there goes before one that was gone, else the choice is by content.
    """
    schemas.assert_disjoint(raw, details, key)
    rest = [c for c in details.columns if c != key]
    gone = F.coalesce("page_gone", F.lit(False)) if "page_gone" in rest else F.lit(False)
    one = details.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(gone, F.to_json(F.struct(*rest)))).alias("_row"))
    return raw.join(one.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]), key, "left")


def stale_details(cards: DataFrame, state: DataFrame, as_of: Column, refresh_days: int = dims.DETAIL_REFRESH_DAYS) -> DataFrame:
    """Cards whose detail page was never read or was last read too long ago."""
    known = state.select("slug", "detail_scraped_at")
    cutoff = as_of - F.make_dt_interval(F.lit(refresh_days))
    return (
        cards.join(known, "slug", "left")
        .filter(F.col("detail_scraped_at").isNull() | (F.col("detail_scraped_at") < cutoff))
        .drop("detail_scraped_at")
    )


def restrict_to(df: DataFrame, column: str, wanted) -> DataFrame:
    """Only the given location slugs; None means no restriction."""
    return df if wanted is None else df.filter(F.col(column).isin(*wanted))
