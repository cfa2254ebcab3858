"""Subscription events folded to current entitlements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetrail.operators.location import spread_nulls
from lodgetrail.operators.ordered import running

COMPLETED = "checkout.session.completed"
UPDATED = "customer.subscription.updated"
DELETED = "customer.subscription.deleted"
FAILED = "invoice.payment_failed"
REFUNDED = "charge.refunded"


def once(events: DataFrame, order=("ts",)) -> DataFrame:
    """Each event id once, its first delivery."""
    rest = [c for c in events.columns if c != "event_id"]
    kept = events.groupBy("event_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select("event_id", *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*events.columns)


def first_claims(claims: DataFrame, tie: str = "event_id") -> DataFrame:
    """Adds ``granted``: true for the first claim of a session id, false for replays.

    The winner comes from an aggregate; claims meet it by key, so no session's
    claims are ever gathered in one task's window.
    """
    winners = claims.groupBy("session_id").agg(F.min(F.struct("ts", tie)).alias("_first"))
    return claims.join(winners, "session_id").withColumn(
        "granted", F.struct("ts", tie) == F.col("_first")).drop("_first")


def is_entitled(status: Column) -> Column:
    return F.coalesce(status.isin("active", "trialing"), F.lit(False))


def latest_subscriptions(subscriptions: DataFrame, key: str = "customer_id") -> DataFrame:
    """Newest subscription row per customer."""
    rest = [c for c in subscriptions.columns if c != key]
    newest = subscriptions.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "subscription_id")).alias("_row"))
    return newest.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def resolve_targets(events: DataFrame) -> DataFrame:
    """Gives customer-level events the customer's newest subscription at their time.

    Payment failures and refunds name a customer only. The newest subscription
    so far is a running last value per customer, carried over day chunks.
    """
    is_creation = F.col("event_type") == COMPLETED
    at = F.struct("ts", "event_id")
    # Creations are re-delivered: only a subscription's first counts as its creation.
    firsts = (
        events.filter(is_creation & F.col("subscription_id").isNotNull())
        .groupBy(F.col("subscription_id").alias("_sk")).agg(F.min(at).alias("_first"))
    )
    keyed = events.withColumns({
        "_sk": spread_nulls(F.col("subscription_id"), F.col("event_id")),
        "_ck": spread_nulls(F.col("customer_id"), F.col("event_id")),
    })
    marked = keyed.join(firsts, "_sk", "left").withColumn(
        "_created", F.when(at == F.col("_first"), F.col("subscription_id")))
    carried = running(
        marked, ["_ck"], ["ts", "event_id"], F.to_date("ts"), lasts={"_newest": F.col("_created")})
    by_customer = F.col("event_type").isin(FAILED, REFUNDED)
    known = by_customer | F.coalesce(F.col("_first") <= at, F.lit(False))
    return carried.withColumns({
        "target_id": F.when(by_customer, F.col("_newest")).otherwise(F.col("subscription_id")),
        "_known": known,
    }).drop("_created", "_newest", "_first", "_sk", "_ck")


def fold_subscriptions(events: DataFrame) -> DataFrame:
    """One row per subscription: owner, latest status, entitlement.

    Events are ordered by (ts, event_id). Updates and deletions of a
    subscription that was never created are ignored.
    """
    status = (
        F.when(F.col("event_type").isin(COMPLETED, UPDATED), F.col("status"))
        .when(F.col("event_type") == FAILED, F.lit("past_due"))
        .when(F.col("event_type").isin(DELETED, REFUNDED), F.lit("canceled"))
    )
    usable = (
        resolve_targets(once(events))
        .filter(F.col("_known") & F.col("target_id").isNotNull())
        .withColumn("_status", status)
        .filter(F.col("_status").isNotNull())
    )
    at = F.struct("ts", "event_id")
    is_creation = F.col("event_type") == COMPLETED
    return usable.groupBy(F.col("target_id").alias("subscription_id")).agg(
        F.min_by("customer_id", at).alias("customer_id"),
        F.min_by("user_id", F.when(is_creation & F.col("user_id").isNotNull(), at)).alias("user_id"),
        F.min("ts").alias("created_at"),
        F.max_by("_status", at).alias("status"),
        F.count(F.lit(1)).alias("events"),
    ).withColumn("is_premium", is_entitled(F.col("status")))


def account_entitlements(subscriptions: DataFrame) -> DataFrame:
    """Users entitled by their newest subscription."""
    owned = subscriptions.filter(F.col("user_id").isNotNull())
    return latest_subscriptions(owned, "user_id").select(
        "user_id", "subscription_id", "status", is_entitled(F.col("status")).alias("is_premium"))
