"""Change events of many scans at once, from the observations alone.

The backfill form of the scan merge: one pass over all observations instead of
one merge per scan. After ``first_occurrence`` a slug has at most one row per
scan, so a slug's window is bounded by the number of scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgetrail import dims


def price_steps(observations: DataFrame, price: str = "price") -> DataFrame:
    """Adds the previous price and scan of the slug."""
    w = Window.partitionBy("slug").orderBy("scan_no")
    return observations.withColumns({
        "old_price": F.lag(price).over(w),
        "old_scan_no": F.lag("scan_no").over(w),
    })


def classify_steps(
    steps: DataFrame, price: str = "price", threshold: int = dims.REMOVED_AFTER_MISSING_SCANS
) -> DataFrame:
    """Change class per observation; a long enough gap means it was removed before."""
    missed = F.col("scan_no") - F.col("old_scan_no") - 1
    return steps.withColumn("missed_scans", missed).withColumn(
        "change_class",
        F.when(F.col("old_scan_no").isNull(), "NEW")
        .when(~F.col(price).eqNullSafe(F.col("old_price")), "PRICE_CHANGED")
        .when(missed >= threshold, "REACTIVATED")
        .otherwise("UNCHANGED"),
    )


def removals(
    observations: DataFrame, last_scan_no, threshold: int = dims.REMOVED_AFTER_MISSING_SCANS
) -> DataFrame:
    """(slug, scan_no) of every removal: the threshold-th scan in a row without the slug."""
    w = Window.partitionBy("slug").orderBy("scan_no")
    upcoming = F.coalesce(F.lead("scan_no").over(w), last_scan_no + 1)
    gaps = observations.withColumn("_next", upcoming)
    return gaps.filter(F.col("_next") - F.col("scan_no") - 1 >= threshold).select(
        "slug", (F.col("scan_no") + threshold).alias("scan_no"))


def changes_per_scan(classified: DataFrame) -> DataFrame:
    return classified.groupBy("scan_no", "change_class").agg(F.count(F.lit(1)).alias("listings"))
