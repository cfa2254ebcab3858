"""Ordered computations per key that stay split when one key dominates.

A plain window sends every row of a key to one task. These helpers cut each
key's rows at a chunk that grows with the order (an hour, a block of
ordinals), work inside the chunks, and carry the small per-chunk results
across them. The chunk is computed from the row itself, so a recomputed task
cuts in the same places.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgetrail.session import stage


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running totals and last non-NULL values up to and including each row.

    ``order`` must be total within a key and ``chunk`` must not decrease along
    it. Keys must not be NULL.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    values = {**sums, **lasts}
    cols = df.columns
    base = df.withColumns({"_chunk": chunk, **{f"_v_{n}": c for n, c in values.items()}})

    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns(
        {f"_l_{n}": F.sum(f"_v_{n}").over(within) for n in sums}
        | {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(within) for n in lasts}
    )

    position = F.struct(*order)
    totals = base.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_t_{n}")
            for n in lasts
        ],
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_chunk",
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
    )

    out = {n: F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) for n in sums}
    out |= {n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in lasts}
    return local.join(carried, [*keys, "_chunk"]).select(*cols, *[c.alias(n) for n, c in out.items()])


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str = "row_no"
) -> DataFrame:
    """1, 2, 3 ... within each key, whatever the size of the key."""
    return running(df, keys, order, chunk, sums={name: F.lit(1).cast("bigint")})


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts))


def with_lookback(
    df: DataFrame, ts: str, window_seconds: int, chunk_seconds: int | None = None
) -> DataFrame:
    """Cut time into chunks, lending each chunk the rows just before it.

    Adds ``_us`` (micros), ``_slot`` (chunk) and ``_own``; rows with ``_own``
    false are context only. A window of ``window_seconds`` over
    (keys, _slot) then sees exactly the rows it would see over (keys).
    """
    span = max(chunk_seconds or max(3600, 10 * window_seconds), window_seconds) * 1_000_000
    reach = window_seconds * 1_000_000
    slot = F.floor(F.col("_us") / span).cast("bigint")
    lent = F.floor((F.col("_us") + reach) / span).cast("bigint")
    tagged = df.withColumn("_us", micros(ts)).withColumn("_home", slot)
    return (
        tagged.withColumn("_slot", F.explode(F.sequence(F.col("_home"), lent)))
        .withColumn("_own", F.col("_slot") == F.col("_home"))
        .drop("_home")
    )


def sliding_count(
    df: DataFrame, keys: Sequence[str], ts: str, window_seconds: int, name: str = "recent_count",
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Rows of the same key in [t - window, t], for every row."""
    w = (
        Window.partitionBy(*keys, "_slot").orderBy("_us")
        .rangeBetween(-window_seconds * 1_000_000, 0)
    )
    counted = with_lookback(df, ts, window_seconds, chunk_seconds).withColumn(
        name, F.count(F.lit(1)).over(w))
    return counted.filter("_own").select(*df.columns, name)


def placed(df: DataFrame, *order: Column, into: str = "place") -> DataFrame:
    """Every row with its place (from 1) in the whole order.

    Rows are sorted over ranges and staged; a row's place is its number in its
    range after the rows of the ranges before, of which there is one count each.
    """
    rows = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_uid", F.monotonically_increasing_id()), "placed")
    numbered = rows.withColumns({"_range": F.shiftright("_uid", 33), "_row": F.col("_uid").bitwiseAND((1 << 33) - 1)})
    counts = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return numbered.join(F.broadcast(bases), "_range").select(
        *df.columns, (F.col("_base") + F.col("_row") + 1).alias(into))
