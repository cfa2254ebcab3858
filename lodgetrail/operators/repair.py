"""Targeted corrections of stored listings and scan logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetrail import dims, schemas
from lodgetrail.functions.text import contact_description
from lodgetrail.operators.filters import missing_group
from lodgetrail.operators.merge import content_hash


def repair_targets(state: DataFrame, groups, only_missing: bool = False, limit: int | None = None) -> DataFrame:
    """Active listings to read again; with ``only_missing``, those lacking the first group."""
    targets = state.filter(F.col("status") == "active")
    if only_missing:
        targets = targets.filter(missing_group(next(g for g in schemas.FIELD_GROUPS if g in groups)))
    return targets if limit is None else targets.orderBy("slug").limit(limit)


def repair(state: DataFrame, details: DataFrame, groups, read_at: Column) -> DataFrame:
    """Re-applies field groups from fresh details; adds ``touched`` (changed column names)."""
    unknown = set(groups) - set(schemas.FIELD_GROUPS)
    if unknown or not groups:
        raise ValueError(f"unknown field groups: {sorted(unknown)}")
    d = {f.name: F.col(f"d.{f.name}") for f in schemas.DETAIL_SCHEMA.fields}
    hit = F.col("d.slug").isNotNull()
    new: dict[str, Column] = {}
    if "contact" in groups:
        for name in schemas.DETAIL_FIELDS:
            new[name] = F.when(d["has_structured_data"], d[name]).otherwise(
                F.coalesce(F.nullif(d[name], F.lit("")), F.col(f"s.{name}")))
    if "amenities" in groups:
        new["amenities"] = F.coalesce(F.when(F.size(d["amenities"]) > 0, d["amenities"]), F.col("s.amenities"))
    if "coords" in groups:
        both = d["latitude"].isNotNull() & d["longitude"].isNotNull()
        for name in ("latitude", "longitude"):
            new[name] = F.when(both, d[name]).otherwise(F.col(f"s.{name}"))
    if "rooms" in groups:
        new["room_types"] = F.coalesce(F.when(F.size(d["room_types"]) > 0, d["room_types"]), F.col("s.room_types"))
    new["detail_scraped_at"] = F.when(
        F.coalesce(d["source_id"], F.lit("")) != "", read_at).otherwise(F.col("s.detail_scraped_at"))

    final = {n: F.when(hit, c).otherwise(F.col(f"s.{n}")) for n, c in new.items()}
    pick = {n: final.get(n, F.col(f"s.{n}")) for n in ("deposit", "electric_price", "amenities")}
    final["description"] = F.when(
        hit, contact_description(pick["deposit"], pick["electric_price"], pick["amenities"])
    ).otherwise(F.col("s.description"))
    changed = F.array_compact(F.array(*[
        F.when(~c.eqNullSafe(F.col(f"s.{n}")), F.lit(n)) for n, c in sorted(final.items())]))
    return state.alias("s").join(details.alias("d"), "slug", "left").select(
        *[final[c].alias(c) if c in final else F.col(f"s.{c}" if c != "slug" else "slug").alias(c) for c in state.columns],
        changed.alias("touched"),
    )


def rehash(state: DataFrame) -> DataFrame:
    """Recomputes digests; ``rehashed`` marks the rows that differ. Writes no history."""
    fresh = content_hash()
    return state.withColumn("rehashed", ~F.col("content_hash").eqNullSafe(fresh)).withColumn("content_hash", fresh)


def is_stuck(as_of: Column, hours: int = dims.STUCK_AFTER_HOURS) -> Column:
    return (F.col("status") == "running") & (
        F.col("started_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def fail_stuck_scans(scans: DataFrame, as_of: Column, hours: int = dims.STUCK_AFTER_HOURS) -> DataFrame:
    """Scans running for too long become failed; their finish time is kept if set."""
    stuck = is_stuck(as_of, hours)
    return scans.select(*[
        {
            "status": F.when(stuck, F.lit("failed")).otherwise(F.col("status")),
            "finished_at": F.when(stuck, F.coalesce("finished_at", as_of)).otherwise(F.col("finished_at")),
            "error_message": F.when(stuck, F.lit("interrupted without a report")).otherwise(F.col("error_message")),
        }.get(c, F.col(c)).alias(c)
        for c in scans.columns
    ])
