"""One-off rewrites of stored tables from older versions. Each may be run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators.subscriptions import DEFAULT_TIME
from meterlake.schema import LEGACY


def with_device(usage: DataFrame) -> DataFrame:
    """Usage of the time before devices: every row belongs to the legacy device."""
    return usage if "device_id" in usage.columns else usage.withColumn("device_id", F.lit(LEGACY))


def visible(profiles: DataFrame, now: str) -> DataFrame:
    """Participants become public; untouched private profiles become public participants."""
    untouched = ~F.col("is_public") & ~F.col("participates") & (F.col("updated_at") == F.col("created_at"))
    new = {
        "is_public": F.col("is_public") | F.col("participates") | untouched,
        "participates": F.col("participates") | untouched,
        "updated_at": F.when(untouched, now).otherwise(F.col("updated_at")),
    }
    return profiles.select(*(new.get(c, F.col(c)).alias(c) for c in profiles.columns))


def with_zone_source(profiles: DataFrame) -> DataFrame:
    """Profiles of the time before sources of time zones: any but UTC was chosen by the user."""
    return profiles.withColumn("timezone_source", F.when(F.col("timezone") == "UTC", "default").otherwise("user"))


def zone_kept(profiles: DataFrame) -> DataFrame:
    """UTC of older profiles counts as chosen, so that no browser changes it."""
    old = (F.col("timezone") == "UTC") & (F.col("timezone_source") == "default")
    return profiles.withColumn("timezone_source", F.when(old, "user").otherwise(F.col("timezone_source")))


def with_pending_slots(subscriptions: DataFrame) -> DataFrame:
    """Retries of the time before slots get the slot of the stored time, else of the first stored one."""
    first = F.nullif(F.substring_index(F.col("schedule_times_local"), ",", 1), F.lit(""))
    slot = F.concat("pending_report_date", F.lit("T"), F.coalesce(F.nullif(F.col("schedule_time_local"), F.lit("")), first, F.lit(DEFAULT_TIME)))
    return subscriptions.withColumn("pending_schedule_slot", F.coalesce("pending_schedule_slot", slot))


def with_log_slots(log: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Daily deliveries of the time before slots get the slot of their subscription's stored time."""
    times = subscriptions.select(F.col("id").alias("subscription_id"), "schedule_time_local")
    slot = F.concat("report_date", F.lit("T"), F.coalesce("schedule_time_local", F.lit(DEFAULT_TIME)))
    rows = log.join(times, "subscription_id", "left")
    return rows.withColumn("schedule_slot", F.when((F.col("kind") == "daily") & F.col("schedule_slot").isNull(), slot).otherwise(F.col("schedule_slot"))).select(*log.columns)
