"""Sharding by a minimax contiguous partition of atomic groups.

Equal texts are one group and stay together. Groups stand in the order of their text hash; the smallest capacity with
which a greedy walk needs no more than the given shards is found by search, and the order is cut there. The walk only asks
"which group ends last at or before this byte", which a filtered scan of the running totals answers for many trial
capacities at once, so nothing but a few numbers per step reaches the driver, at any number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgetrail.session import stage

#: Capacities tried in one walk.
TRIALS = 4096


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


@dataclass
class Cut:
    """The capacity found, and the last group of every shard but the last."""

    capacity: int
    last_groups: list[str]


class RunningTotals:
    """Group ends in bytes, in group order, staged in the shared folder."""

    def __init__(self, groups: DataFrame) -> None:
        spark = groups.sparkSession
        ordered = stage(groups.repartitionByRange("group").sortWithinPartitions("group").withColumn("_uid", F.monotonically_increasing_id()), "groups-in-order")
        ordered = ordered.withColumn("_part", F.shiftright("_uid", 33))
        base, self.total = [], 0
        for part, size in ordered.groupBy("_part").agg(F.sum("bytes")).orderBy("_part").collect():  # a row per partition
            base.append((part, self.total))
            self.total += size
        self.largest = ordered.agg(F.max("bytes")).first()[0] or 0
        bases = spark.createDataFrame(base, "_part long, _base long")
        in_part = Window.partitionBy("_part").orderBy("_uid").rowsBetween(Window.unboundedPreceding, 0)
        ends = ordered.withColumn("_sum", F.sum("bytes").over(in_part)).join(F.broadcast(bases), "_part")
        self.ends = stage(ends.select("group", (F.col("_base") + F.col("_sum")).alias("end")), "group-ends")

    def at_most(self, limits: list[int]) -> list[int]:
        """For each limit the largest group end up to it, 0 before the first.

        One scan of the ends near the limits; every task answers for all limits, so a row per limit and task is moved.
        """
        asked = np.unique(np.array(limits, dtype=np.int64))

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most = np.zeros(len(asked) + 1, dtype=np.int64)
            for batch in batches:
                ends = batch.column("end").to_numpy()
                np.maximum.at(most, np.searchsorted(asked, ends), ends)
            at = np.flatnonzero(most[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(most[at], pa.int64())], ["limit", "end"])

        near = self.ends.select("end").where(F.col("end").between(int(asked[0]) - self.largest, int(asked[-1])))
        found = np.zeros(len(asked), dtype=np.int64)
        for limit, end in near.mapInArrow(answer, "limit long, end long").groupBy("limit").agg(F.max("end")).collect():
            found[limit] = end
        found = np.maximum.accumulate(found)
        return [int(x) for x in found[np.searchsorted(asked, limits)]]

    def around(self, at: int, goal: int, most: int) -> tuple[int, int, int]:
        """The last end before ``goal``, the first from ``goal`` on, and the last up to ``most``."""
        end = F.col("end")
        row = self.ends.where(end.between(min(at, goal), max(most, goal + self.largest))).agg(
            F.max(F.when(end < goal, end)), F.min(F.when(end >= goal, end)), F.max(F.when(end <= most, end))).first()
        return row[0] or 0, row[1] or self.total, row[2] or 0

    def walks(self, capacities: list[int], shards: int) -> list[list[int]]:
        """Greedy cuts under each capacity: up to ``shards`` group ends, the last one the total if it suffices."""
        at, cuts = [0] * len(capacities), [[] for _ in capacities]
        for _ in range(shards):
            moving = [n for n in range(len(at)) if at[n] < self.total]
            if not moving:
                break
            far = [n for n in moving if at[n] + capacities[n] < self.total]
            ends = self.at_most([at[n] + capacities[n] for n in far]) if far else []
            for n in moving:
                at[n] = self.total
            for n, end in zip(far, ends, strict=True):
                at[n] = end
            for n in moving:
                cuts[n].append(at[n])
        return cuts


def smallest_capacity(totals: RunningTotals, shards: int) -> int:
    """The smallest capacity that a greedy walk meets with ``shards`` shards."""
    low = max(-(-totals.total // shards), totals.largest)
    high = max(low, -(-totals.total // shards) + totals.largest)  # always enough
    while low < high:
        step = max(1, (high - low) // (TRIALS - 1))
        tried = sorted({*range(low, high, step)})[:TRIALS]
        for capacity, cuts in zip(tried, totals.walks(tried, shards), strict=True):
            if cuts[-1] == totals.total:
                high = capacity
                break
            low = capacity + 1
    return low


def _even_cuts(totals: RunningTotals, capacity: int, shards: int) -> list[int]:
    """Cuts under the capacity that also spread what a large group leaves to the others.

    Each shard ends at the first group end at or past the mean of what is left if the capacity allows, else at the
    last one the capacity allows. Should that not suffice, the greedy cuts of the search do.
    """
    at, cuts = 0, []
    for left in range(shards, 0, -1):
        if at >= totals.total:
            break
        goal = at - (-(totals.total - at) // left)
        if left == 1 or goal >= totals.total:
            end = totals.total
        else:
            before, past, most = totals.around(at, goal, at + capacity)
            if past <= at + capacity and (past - goal <= goal - before or before <= at):
                end = past
            else:
                end = before if before > at else most
        if end - at > capacity:
            return totals.walks([capacity], shards)[0]
        cuts.append(end)
        at = end
    return cuts if at >= totals.total else totals.walks([capacity], shards)[0]


def partition(groups: DataFrame, shards: int) -> Cut:
    """Cut the groups (``group``, ``bytes``) into at most ``shards`` contiguous ranges of minimax size."""
    totals = RunningTotals(groups)
    if not totals.total:
        return Cut(0, [])
    capacity = smallest_capacity(totals, shards)
    cuts = _even_cuts(totals, capacity, shards)[:-1]
    named = {r["end"]: r["group"] for r in totals.ends.where(F.col("end").isin(cuts)).collect()} if cuts else {}
    return Cut(capacity, [named[c] for c in cuts])


def shard(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal bytes.

    Returns ``key``, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``law`` (``bytes``), ``shard`` (from
    0), ``slot`` (gapless from 0 in its shard) and ``grown_shard`` (null: the law is not about growth). Null texts count
    as empty, and all equal texts share a shard. The largest shard is as small as contiguous ranges allow. An empty
    table gives an empty table; repeated rows are rows; other columns are not looked at.
    """
    whole = _text(text)
    rows = df.select(df[key].alias(key), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"), F.md5(F.encode(whole, "UTF-8")).alias("_group"))
    rows = stage(rows.withColumn("_uid", F.monotonically_increasing_id()), "shard-rows")
    cut = partition(rows.groupBy(F.col("_group").alias("group")).agg(F.sum("size").alias("bytes")), shards)
    number = F.lit(0)
    for group in cut.last_groups:
        number = number + (F.col("_group") > group).cast("int")
    placed = rows.withColumn("shard", number).withColumn("_part", F.shiftright("_uid", 33))
    # Slots without a shard's rows in one task: by part of the input, then by place in the part.
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("_part", "shard").count().select("_part", "shard", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_base"))
    local = placed.withColumn("_row", F.row_number().over(Window.partitionBy("_part", "shard").orderBy("_uid")))
    out = local.join(base, ["_part", "shard"])
    return out.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_base") + F.col("_row") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
