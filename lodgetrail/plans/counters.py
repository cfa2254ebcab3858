"""Counters of the public and the full statistics page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetrail import dims
from lodgetrail.functions import clock, geo
from lodgetrail.functions.price import contract_number
from lodgetrail.operators import location
from lodgetrail.operators.filters import seen_within


def _offered(raw: str) -> Column:
    return F.col(raw).isNotNull() & ~F.col(raw).isin("", "-")


def public_counters(state: DataFrame, as_of: Column, tz: str = dims.LOCAL_TZ) -> DataFrame:
    """All listing counters in one pass."""
    active = F.col("status") == "active"
    return state.agg(
        F.count_if(active).alias("total_active"),
        F.count_if(F.col("first_seen_at") >= clock.local_day_start(as_of, tz)).alias("new_today"),
        F.count_if(active & (F.col("has_monthly_contract") == "true")).alias("monthly_contract_count"),
        F.count_if(active & _offered("contract_3_month_raw")).alias("three_month_contract_count"),
        F.count_if(active & _offered("contract_6_month_raw")).alias("six_month_contract_count"),
        F.count_if(F.col("status") == "removed").alias("total_removed"),
    )


# ---- counters as differences --------------------------------------------------

TALLY = "counter string, detail string, n bigint"


def tally(state: DataFrame, sign: Column | None = None) -> DataFrame:
    """What listings add to each counter, or take from it where ``sign`` is -1.

    Counters: ``status``, ``first_seen`` (local day), and of active listings ``province``, ``place`` (city and quarter as
    spelled), ``monthly``, ``three_month`` and ``six_month``.
    """
    def item(counter: str, detail: Column | str, when: Column | None = None) -> Column:
        one = F.struct(F.lit(counter).alias("counter"), (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))
        return one if when is None else F.when(when, one)

    active = F.col("status") == "active"
    place = F.to_json(F.struct(geo.city_of().alias("city"), geo.district_of().alias("quarter")))
    items = F.array_compact(F.array(
        item("status", F.col("status")), item("first_seen", clock.local_day(F.col("first_seen_at"))),
        item("province", F.col("province"), active), item("place", place, active),
        item("monthly", "", active & (F.col("has_monthly_contract") == "true")),
        item("three_month", "", active & _offered("contract_3_month_raw")),
        item("six_month", "", active & _offered("contract_6_month_raw"))))
    each = state.select(F.explode(items).alias("c"), (F.lit(1) if sign is None else sign).alias("n"))
    return folded(each.select("c.counter", "c.detail", "n"))


def folded(differences: DataFrame) -> DataFrame:
    """Differences of any number of scans as one; what has become 0 is left out."""
    return differences.groupBy("counter", "detail").agg(F.sum("n").alias("n")).filter("n <> 0")


def public_from_tally(counts: DataFrame, as_of: Column, tz: str = dims.LOCAL_TZ) -> DataFrame:
    """The same row as :func:`public_counters`."""
    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    counter = F.col("counter")
    today = clock.local_day(clock.local_day_start(as_of, tz), tz)
    return counts.agg(
        total((counter == "status") & (F.col("detail") == "active")).alias("total_active"),
        total((counter == "first_seen") & (F.col("detail") >= today.cast("string"))).alias("new_today"),
        total(counter == "monthly").alias("monthly_contract_count"),
        total(counter == "three_month").alias("three_month_contract_count"),
        total(counter == "six_month").alias("six_month_contract_count"),
        total((counter == "status") & (F.col("detail") == "removed")).alias("total_removed"),
    )


def provinces_from_tally(counts: DataFrame) -> DataFrame:
    """The same rows as :func:`by_province`."""
    label = F.coalesce(F.nullif(F.col("detail"), F.lit("")), F.lit("Unknown"))
    return counts.filter("counter = 'province'").select(
        label.alias("province"), F.col("n").alias("listings")).orderBy(F.desc("listings"), "province")


def facets_from_tally(counts: DataFrame) -> DataFrame:
    """The same rows as :func:`lodgetrail.operators.location.city_facets`."""
    place = F.from_json("detail", "city string, quarter string")
    spelled = counts.filter("counter = 'place'").select(place.alias("p"), "n").select("p.city", "p.quarter", "n")
    return location.roll_up(spelled)


def changed_today(history: DataFrame, as_of: Column, tz: str = dims.LOCAL_TZ, listing: str = "slug") -> DataFrame:
    """Distinct listings per change type since local midnight.

    A listing's many rows collapse to one before they are counted, which also
    keeps a busy change type from landing in a single distinct set.
    """
    today = history.filter(F.col("changed_at") >= clock.local_day_start(as_of, tz))
    return today.groupBy("change_type", listing).agg(F.lit(1).alias("_one")).groupBy("change_type").agg(
        F.count(F.lit(1)).alias("listings"))


def by_province(state: DataFrame) -> DataFrame:
    """Active listings per province; those without one are shown as 'Unknown'."""
    counts = state.filter(F.col("status") == "active").groupBy("province").agg(F.count(F.lit(1)).alias("listings"))
    label = F.coalesce(F.nullif(F.col("province"), F.lit("")), F.lit("Unknown"))
    return counts.select(label.alias("province"), "listings").orderBy(F.desc("listings"), "province")


def last_completed_scan(scans: DataFrame) -> DataFrame:
    return scans.filter(F.col("status") == "completed").agg(F.max("finished_at").alias("last_scan"))


def history_mix(history: DataFrame) -> DataFrame:
    return history.groupBy("change_type").agg(F.count(F.lit(1)).alias("rows"))


def full_counters(
    state: DataFrame, history: DataFrame, scans: DataFrame, as_of: Column, tz: str = dims.LOCAL_TZ
) -> DataFrame:
    """The full statistics as (counter, detail, value) rows."""
    def rows(df: DataFrame, counter: Column, detail: Column, value: Column) -> DataFrame:
        return df.select(
            counter.alias("counter"), detail.cast("string").alias("detail"), value.cast("bigint").alias("value"))

    public = public_counters(state, as_of, tz)
    names = public.columns
    nothing = F.lit(None)
    counters = public.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("counter"), F.col(n).alias("value")) for n in names])).alias("c"))
    out = rows(counters, F.col("c.counter"), nothing, F.col("c.value"))
    changed = changed_today(history, as_of, tz).filter(F.col("change_type").isin("UPDATED", "PRICE_CHANGED"))
    out = out.unionByName(rows(changed, F.lit("changed_today"), F.col("change_type"), F.col("listings")))
    out = out.unionByName(rows(by_province(state), F.lit("by_province"), F.col("province"), F.col("listings")))
    last = last_completed_scan(scans)
    return out.unionByName(rows(last, F.lit("last_scan"), nothing, F.unix_seconds("last_scan")))


def new_in_24_hours(listings: DataFrame, as_of: Column) -> DataFrame:
    open_ = F.col("status") != "removed"
    return listings.agg(F.count_if(open_ & seen_within(as_of)).alias("new_24h"))


def cards_per_location(cards: DataFrame, slug_column: str = "province_slug") -> DataFrame:
    """Cards for each of the 77 provinces, zero included."""
    counts = cards.groupBy(slug_column).agg(F.count(F.lit(1)).alias("cards"))
    provinces = dims.province_frame(cards.sparkSession)
    # The province list is fixed: at most 77 groups meet 77 rows.
    return provinces.join(counts, provinces.province_slug == counts[slug_column], "left").select(
        provinces.province_slug, F.coalesce("cards", F.lit(0)).cast("bigint").alias("cards"))


def contract_price_range(listings: DataFrame) -> DataFrame:
    """Smallest and largest contract price of each listing."""
    n = F.array_compact(F.array(*[
        contract_number(F.col(f"{d}_raw")) for d in dims.DURATION_FIELDS.values()]))
    return listings.select("id", F.array_min(n).alias("lowest"), F.array_max(n).alias("highest"))
