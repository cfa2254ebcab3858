"""Diff of one scan against the stored listings.

``decide`` joins state and batch once on the slug. Everything a scan writes --
the new state, the history rows, the counters -- is a projection of that one
decision frame, which the caller stages before writing its parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetrail import dims, schemas
from lodgetrail.functions.text import contact_description

_OLD, _NEW = "s", "b"


def _old(name: str) -> Column:
    return F.col(f"{_OLD}.{name}")


def _new(name: str) -> Column:
    return F.col(f"{_NEW}.{name}")


def content_hash(row: dict[str, Column] | None = None) -> Column:
    """Digest of the hashed fields; NULLs and list order are part of it."""
    pick = (lambda n: row[n]) if row else F.col
    fields = [pick(n).alias(n) for n in sorted(schemas.HASH_FIELDS)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def _nonempty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def _merged(name: str, policy: str) -> Column:
    """The value an existing listing has after the scan."""
    old, new = _old(name), _new(name)
    if policy == schemas.OVERWRITE:
        return new
    if policy == schemas.KEEP_IF_EMPTY:
        return F.coalesce(F.nullif(new, F.lit("")), old)
    if policy == schemas.PAIR:
        both = _new("latitude").isNotNull() & _new("longitude").isNotNull()
        return F.when(both, new).otherwise(old)
    if policy == schemas.NONEMPTY_LIST:
        return F.coalesce(_nonempty(new), old)
    if policy == schemas.CONTRACT:
        known = F.when(new != "unknown", new) if name == "has_monthly_contract" else new
        return F.when(_new("from_structured_list"), new).otherwise(F.coalesce(known, old))
    if policy == schemas.DETAIL:
        return F.when(_new("has_structured_data"), new).otherwise(F.coalesce(F.nullif(new, F.lit("")), old))
    return old


def _inserted(name: str, policy: str) -> Column:
    return _nonempty(_new(name)) if policy == schemas.NONEMPTY_LIST else _new(name)


def upsert(state: DataFrame, batch: DataFrame, scan_time: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join of state and batch with every policy applied.

    ``carry`` names batch columns to pass through beside the state columns.

    ``batch`` has one row per slug. A row with ``row_error`` set counts as seen
    and changes nothing; if its slug is not stored, it stays in the frame for
    the counters and goes no further. Besides the state columns the result carries
    ``was_known``, ``was_seen``, ``was_applied``, ``old_status``, ``old_hash``
    and ``old_prices`` (struct).
    """
    defaults = {"row_error": F.lit(None).cast("string")}
    batch = batch.withColumns({n: c for n, c in defaults.items() if n not in batch.columns})
    joined = state.alias(_OLD).join(batch.alias(_NEW), "slug", "full_outer")

    known = _old("status").isNotNull()
    seen = _new("name").isNotNull() | _new("row_error").isNotNull()
    applied = seen & _new("row_error").isNull()
    fresh = applied & ~known
    flags = joined.withColumns({"was_known": known, "was_seen": seen, "was_applied": applied})

    row: dict[str, Column] = {}
    for name, policy in schemas.FIELD_POLICIES.items():
        row[name] = (
            F.when(fresh, _inserted(name, policy))
            .when(applied, _merged(name, policy))
            .otherwise(_old(name))
        )
    detail_read = F.coalesce((_new("source_id") != "") | _new("page_gone"), F.lit(False))
    row["source"] = F.coalesce(_old("source"), F.lit("list"))
    row["line_verified"] = _old("line_verified")
    row["status"] = F.when(applied, F.lit("active")).otherwise(_old("status"))
    row["missing_scan_count"] = (
        F.when(fresh | (applied & (_old("status") == "removed")), F.lit(0))
        .otherwise(_old("missing_scan_count")).cast("bigint")
    )
    row["first_seen_at"] = F.when(fresh, scan_time).otherwise(_old("first_seen_at"))
    for name in ("last_seen_at", "last_scraped_at"):
        row[name] = F.when(applied, scan_time).otherwise(_old(name))
    row["detail_scraped_at"] = F.when(applied & detail_read, scan_time).otherwise(_old("detail_scraped_at"))

    first = flags.select(
        "slug", "was_known", "was_seen", "was_applied",
        _new("has_monthly_contract").alias("scanned_monthly"), _new("row_error").alias("row_error"),
        _old("status").alias("old_status"),
        _old("content_hash").alias("old_hash"),
        _old("description").alias("old_description"),
        F.struct(*[_old(f).alias(f) for f in schemas.PRICE_FIELDS]).alias("old_prices"),
        *[c.alias(n) for n, c in row.items()],
        *[_new(c).alias(c) for c in carry],
    )
    return first.withColumns({
        "content_hash": F.when(F.col("was_applied"), content_hash()).otherwise(F.col("old_hash")),
        "description": F.when(
            F.col("was_applied"),
            contact_description(F.col("deposit"), F.col("electric_price"), F.col("amenities")),
        ).otherwise(F.col("old_description")),
    }).drop("old_description")


def coverage(upserted: DataFrame) -> DataFrame:
    """One row: active listings after the upserts, and distinct slugs seen."""
    return upserted.agg(
        F.count_if(F.col("status") == "active").alias("active"), F.count_if("was_seen").alias("seen"))


def covers_enough(active: Column, seen: Column, minimum: float = dims.MIN_SCAN_COVERAGE) -> Column:
    """A scan that saw too little says nothing about what is missing."""
    return (active == 0) | (seen >= active * minimum)


def count_missing(
    upserted: DataFrame, trusted: Column, threshold: int = dims.REMOVED_AFTER_MISSING_SCANS
) -> DataFrame:
    """Miss counters and removals, where the scan is ``trusted``."""
    active = F.col("status") == "active"
    missed = trusted & active & ~F.col("was_seen")
    found = trusted & active & F.col("was_seen")
    count = (
        F.when(missed, F.col("missing_scan_count") + 1)
        .when(found, F.lit(0).cast("bigint"))
        .otherwise(F.col("missing_scan_count"))
    )
    removed = missed & (F.col("missing_scan_count") + 1 >= threshold)
    return upserted.withColumns({
        "was_removed": F.coalesce(removed, F.lit(False)),
        "missing_scan_count": count,
        "status": F.when(removed, F.lit("removed")).otherwise(F.col("status")),
    })


def classify(decision: DataFrame) -> DataFrame:
    """Adds ``price_changes`` (array) and ``change_class``."""

    def as_text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("None"))

    compared = F.array(*[
        F.when(
            ~F.col(f"old_prices.{f}").eqNullSafe(F.col(f)),
            F.struct(
                F.lit(f).alias("field_name"),
                as_text(F.col(f"old_prices.{f}")).alias("old_value"),
                as_text(F.col(f)).alias("new_value"),
            ),
        )
        for f in schemas.PRICE_FIELDS
    ])
    existing = F.col("was_known") & F.col("was_applied")
    changes = F.when(existing, F.array_compact(compared))
    label = (
        F.when(~F.col("was_applied"), F.lit(None))
        .when(~F.col("was_known"), "NEW")
        .when(F.size("price_changes") > 0, "PRICE_CHANGED")
        .when(~F.col("old_hash").eqNullSafe(F.col("content_hash")), "UPDATED")
        .when(F.col("old_status") == "removed", "REACTIVATED")
        .otherwise("UNCHANGED")
    )
    return decision.withColumn("price_changes", changes).withColumn("change_class", label)


def decide(
    state: DataFrame, batch: DataFrame, scan_time: Column, complete: bool = True,
    threshold: int = dims.REMOVED_AFTER_MISSING_SCANS, minimum: float = dims.MIN_SCAN_COVERAGE,
    materialise: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The decision frame of a scan.

    The coverage test is a scalar subquery over the same join. ``materialise``
    (writing the upserts as a table) spares joining twice.
    """
    upserted = upsert(state, batch, scan_time)
    if materialise is not None:
        upserted = materialise(upserted)
    trusted = F.lit(False)
    if complete:
        verdict = coverage(upserted).select(covers_enough(F.col("active"), F.col("seen"), minimum))
        trusted = verdict.scalar()
    return classify(count_missing(upserted, trusted, threshold))


def new_state(decision: DataFrame) -> DataFrame:
    return schemas.conform(decision.filter("was_known OR was_applied"), schemas.STATE_SCHEMA)


def history_rows(decision: DataFrame, scan_time: Column) -> DataFrame:
    """Append-only events: new, each changed price, content, reactivation, removal."""
    event_type = "struct<change_type:string,field_name:string,old_value:string,new_value:string>"
    existing = F.col("was_known") & F.col("was_applied")

    def event(kind: str, field: str | None = None, old: Column | None = None, new: Column | None = None) -> Column:
        nothing = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind), F.lit(field).cast("string"),
            nothing if old is None else old, nothing if new is None else new,
        ).cast(event_type)

    prices = F.coalesce(
        F.transform(
            "price_changes",
            lambda c: F.struct(F.lit("PRICE_CHANGED"), c["field_name"], c["old_value"], c["new_value"]).cast(event_type),
        ),
        F.array().cast(f"array<{event_type}>"),
    )
    hash_differs = ~F.col("old_hash").eqNullSafe(F.col("content_hash"))
    single = F.array_compact(F.array(
        F.when(F.col("was_applied") & ~F.col("was_known"), event("NEW")),
        F.when(existing & hash_differs, event("UPDATED", "content_hash", F.col("old_hash"), F.col("content_hash"))),
        F.when(existing & (F.col("old_status") == "removed"), event("REACTIVATED")),
        F.when(
            F.col("was_removed"),
            event("REMOVED", "missing_scan_count", F.lit("active"), F.col("missing_scan_count").cast("string")),
        ),
    ))
    rows = decision.select("slug", F.explode(F.concat(prices, single)).alias("e"))
    return rows.select("slug", scan_time.alias("changed_at"), "e.*")


def scan_counters(decision: DataFrame) -> DataFrame:
    """One row of counters over the classified batch."""
    return decision.agg(*counter_columns())


def counter_columns() -> list[Column]:
    """The counters of a scan as aggregates over its decision frame."""
    cls = F.col("change_class")
    return [
        F.count_if("was_seen").alias("seen"),
        F.count_if(cls == "NEW").alias("new_count"),
        F.count_if(cls == "UPDATED").alias("updated_count"),
        F.count_if(cls == "PRICE_CHANGED").alias("price_changed_count"),
        F.count_if("was_removed").alias("removed_count"),
        F.count_if(F.col("was_applied") & (F.col("scanned_monthly") == "true")).alias("monthly_count"),
        F.count_if(F.col("was_seen") & ~F.col("was_applied")).alias("error_count"),
    ]


def invalid_rows(batch: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Adds ``row_error``: the first storage rule a row breaks, or NULL."""
    checks = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c} is empty")) for c in ("name", "url")]
    checks += [
        F.when(F.length(c) > n, F.lit(f"{c} longer than {n}"))
        for c, n in (limits or MAX_LENGTHS).items() if c in batch.columns
    ]
    return batch.withColumn("row_error", F.coalesce(*checks))


# fixed values: storage length of text columns
MAX_LENGTHS = {
    "source_id": 100, "slug": 500, "name": 500, "url": 1000, "address": 500,
    "subdistrict": 200, "district": 200, "province": 200,
    "price_monthly_raw": 100, "daily_price_raw": 100,
    "contract_monthly_raw": 100, "contract_3_month_raw": 100, "contract_6_month_raw": 100,
    "deposit": 200, "advance_payment": 200, "electric_price": 100, "water_price": 100,
    "service_fee": 200, "phone": 100, "line_id": 100, "whatsapp": 100, "email": 200,
}
