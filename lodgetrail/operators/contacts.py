"""Contact verdicts shared by every listing that uses the contact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetrail.operators.location import spread_nulls


def contacts_to_check(listings: DataFrame, contact: str) -> DataFrame:
    """Distinct contacts of active listings with the number of listings using each."""
    used = listings.filter((F.col("status") == "active") & F.col(contact).isNotNull())
    return used.groupBy(contact).agg(F.count(F.lit(1)).alias("listings"))


def with_verdicts(listings: DataFrame, verdicts: DataFrame, contact: str, row_id: str = "id") -> DataFrame:
    """Adds ``verdict`` to active listings that carry a checked contact.

    ``verdicts`` has one row per contact. An agency's contact may sit on a
    large share of all listings: the listing side is only ever split, because
    it is the small verdict side that adaptive skew handling repeats.
    """
    keyed = F.when(F.col("status") == "active", F.col(contact))
    right = verdicts.select(F.col(contact).alias("_key"), "verdict")
    return (
        listings.withColumn("_key", spread_nulls(keyed, F.col(row_id)))
        .join(right, "_key", "left").drop("_key")
    )


def apply_line_verdicts(listings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Sets ``line_verified``; 'unknown' and unchecked contacts leave it."""
    decided = F.col("verdict").isin("valid", "invalid")
    return with_verdicts(listings, verdicts, "line_id").withColumn(
        "line_verified",
        F.when(decided, F.col("verdict") == "valid").otherwise(F.col("line_verified")),
    ).drop("verdict")


def apply_whatsapp_verdicts(listings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Clears numbers found invalid."""
    return with_verdicts(listings, verdicts, "whatsapp").withColumn(
        "whatsapp", F.when(~F.col("verdict").eqNullSafe("invalid"), F.col("whatsapp"))
    ).drop("verdict")


def verdict_weights(listings: DataFrame, verdicts: DataFrame, contact: str) -> DataFrame:
    """Listings per verdict.

    Listings are counted per contact first, so the join moves one row per
    contact and a shared contact weighs no more than any other.
    """
    per_contact = contacts_to_check(listings, contact)
    return per_contact.join(verdicts, contact).groupBy("verdict").agg(
        F.sum("listings").alias("listings"), F.count(F.lit(1)).alias("contacts"))
