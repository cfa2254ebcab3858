"""Request quotas and login-failure windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgetrail import dims
from lodgetrail.operators.ordered import sliding_count, with_lookback


def failure_window(
    attempts: DataFrame, failed: Column, succeeded: Column,
    window_seconds: int = dims.LOGIN_WINDOW_SECONDS, max_failures: int = dims.LOGIN_MAX_FAILURES,
    client: str = "client", ts: str = "ts", tie: str = "request_id",
) -> DataFrame:
    """Failures of the last window since the last success, for every attempt."""
    cols = attempts.columns
    cut = with_lookback(
        attempts.withColumns({"_failed": failed.cast("int"), "_succeeded": succeeded.cast("int")}),
        ts, window_seconds)
    run = Window.partitionBy(client, "_slot").orderBy("_us", tie).rowsBetween(Window.unboundedPreceding, 0)
    recent = (
        Window.partitionBy(client, "_slot", "_island").orderBy("_us")
        .rangeBetween(-window_seconds * 1_000_000, 0)
    )
    counted = (
        cut.withColumn("_island", F.sum("_succeeded").over(run))
        .withColumn("recent_failures", F.sum("_failed").over(recent))
        .filter("_own")
    )
    return counted.select(
        *cols, "recent_failures", (F.col("recent_failures") >= max_failures).alias("rate_limited"))


def retry_seconds(oldest_us: int, now_us: int, window_us: int) -> int:
    """Whole seconds until the oldest accepted request leaves the window; at least 1."""
    return max(1, (oldest_us + window_us - now_us) // 1_000_000 + 1)


class Admission:
    """Accepted instants of one client still inside the window."""

    def __init__(self, limit: int, window_us: int, accepted=()) -> None:
        self.limit, self.window_us, self.accepted = limit, window_us, deque(accepted)

    def offer(self, now_us: int) -> int | None:
        """None if the request passes, else the wait in seconds; a denied one leaves no trace."""
        while self.accepted and self.accepted[0] < now_us - self.window_us:
            self.accepted.popleft()
        if len(self.accepted) >= self.limit:
            return retry_seconds(self.accepted[0], now_us, self.window_us)
        self.accepted.append(now_us)
        return None


def admit_requests(
    requests: DataFrame, limit: int, window_seconds: int = dims.WINDOW_SECONDS,
    client: str = "client", ts: str = "ts", tie: str = "request_id", held: DataFrame | None = None,
) -> DataFrame:
    """Adds ``admitted`` and ``retry_after`` to every request.

    ``held`` (client, ts) names instants admitted before; they count and come out no more.

    A request with at most ``limit`` requests (itself included) in its window
    passes whatever happened before. Only stretches around the others depend
    on what was admitted, and stretches further apart than the window are
    independent. Those stretches alone are walked in order, as streams of
    Arrow batches holding no more than ``limit`` instants.
    """
    cols = requests.columns
    window_us = window_seconds * 1_000_000
    if held is not None:
        before = held.select(*[
            F.lit(None).cast(f.dataType).alias(f.name) if f.name not in (client, ts) else F.col(f.name) for f in requests.schema])
        requests = requests.withColumn("_held", F.lit(False)).unionByName(before.withColumn("_held", F.lit(True)))
    else:
        requests = requests.withColumn("_held", F.lit(False))
    counted = sliding_count(requests, [client], ts, window_seconds, "_raw").withColumn(
        "_us", F.unix_micros(ts))
    over = counted.filter(F.col("_raw") > limit)

    gap = F.lit(f"{window_us + 1} microseconds")
    stretches = (
        over.groupBy(client, F.session_window(F.col(ts).cast("timestamp"), gap).alias("_s"))
        .agg(F.min("_us").alias("_from"), F.max("_us").alias("_to"))
        .select(client, (F.col("_from") - window_us).alias("_from"), "_to")
    )
    span = max(3600, window_seconds) * 1_000_000

    def slot(c: Column) -> Column:
        return F.floor(c / span).cast("bigint")

    spread = stretches.withColumn("_slot", F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_to")))))
    # Stretches of a client do not overlap, so a request lies in one at most.
    h, s = counted.withColumn("_slot", slot(F.col("_us"))).alias("h"), spread.alias("s")
    inside = (
        (F.col(f"h.{client}") == F.col(f"s.{client}")) & (F.col("h._slot") == F.col("s._slot"))
        & F.col("h._us").between(F.col("s._from"), F.col("s._to"))
    )
    placed = h.join(s, inside, "left").select(
        *[F.col(f"h.{c}").alias(c) for c in cols], F.col("h._us").alias("_us"), F.col("h._held").alias("_held"), F.col("s._from").alias("_stretch"))

    free = placed.filter(F.col("_stretch").isNull() & ~F.col("_held")).select(
        *cols, F.lit(True).alias("admitted"), F.lit(None).cast("bigint").alias("retry_after"))
    tied = (
        placed.filter(F.col("_stretch").isNotNull())
        .repartition(client, "_stretch")
        .sortWithinPartitions(client, "_stretch", "_us", tie)
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Admission(limit, window_us)
        for pdf in batches:
            waits = []
            for c, s, us, was_held in zip(pdf[client], pdf["_stretch"], pdf["_us"], pdf["_held"]):
                if (c, s) != key:
                    key, state = (c, s), Admission(limit, window_us)
                waits.append(state.accepted.append(us) if was_held else state.offer(us))
            out = pdf[cols].copy()
            out["admitted"] = [w is None for w in waits]
            out["retry_after"] = pd.array(waits, dtype="Int64")
            yield out[~pdf["_held"]]

    return free.unionByName(tied.mapInPandas(walk, schema=free.schema))
