"""Schedules, due work, report visibility and history, retries, retention, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlake.functions.scalars import next_run
from meterlake.schema import unused

# Minutes before the second and third attempt, and the attempts.
RETRY_MINUTES = (5, 30)
ATTEMPTS = 3


def due_subscriptions(subscriptions: DataFrame, now: str, limit: int = 5) -> DataFrame:
    """Enabled, due and not leased, the oldest first."""
    free = F.col("locked_until").isNull() | (F.col("locked_until") <= now)
    return subscriptions.filter(F.col("enabled") & (F.col("next_run_at") <= now) & free).orderBy("next_run_at", "id").limit(limit)


def retention_cutoff(date: str, keep_days: int) -> Column:
    return F.date_sub(F.lit(date).cast("date"), keep_days - 1).cast("string")


def prune(history: DataFrame, date: str, keep_days: int, column: str = "report_date") -> DataFrame:
    """What stays within the retention."""
    return history.filter(F.col(column) >= retention_cutoff(date, keep_days))


def visible_reports(history: DataFrame, profiles: DataFrame, viewer: str | None, date: str, keep_days: int) -> DataFrame:
    """Reports in retention that the viewer owns, or that their owner shares and has not revoked."""
    owned = F.col("user_id") == viewer if viewer is not None else F.lit(False)
    rows = prune(history, date, keep_days).join(profiles.select("user_id", "share_reports"), "user_id")
    return rows.filter(owned | (F.col("share_reports") & F.col("revoked_at").isNull())).drop("share_reports")


def new_deliveries(log: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose (subscription, date, slot) has no successful daily delivery; one of equals by ordinal."""
    done = log.filter("status = 'success' and kind = 'daily'").select("subscription_id", "report_date", "slot").distinct()
    first = F.row_number().over(W.partitionBy("subscription_id", "report_date", "slot").orderBy("ordinal"))
    place = unused(candidates, "place")
    rows = candidates.withColumn(place, first).filter((F.col(place) == 1) | (F.col("status") != "success") | (F.col("kind") != "daily")).drop(place)
    daily = (F.col("status") == "success") & (F.col("kind") == "daily")
    return rows.filter(~daily).unionByName(rows.filter(daily).join(done, ["subscription_id", "report_date", "slot"], "left_anti").select(*rows.columns))


def after_attempt(rows: DataFrame, now: Column) -> DataFrame:
    """State after an attempt: sent and skipped go to the next slot; failures retry after 5 and
    30 minutes, and after the third attempt go to the next slot.

    ``rows``: outcome, attempt, timezone, slots, weekdays."""
    retry = (F.col("outcome") == "failed") & (F.col("attempt") < ATTEMPTS)
    wait = F.when(F.col("attempt") == 1, RETRY_MINUTES[0]).otherwise(RETRY_MINUTES[1])
    slot = next_run(now, F.col("timezone"), F.col("slots"), F.col("weekdays"))
    moment = F.when(retry, F.timestamp_micros(F.unix_micros(now) + wait * F.lit(60_000_000))).otherwise(slot)
    count = F.when(F.col("outcome") == "failed", F.col("attempt")).otherwise(0)
    return rows.withColumns({"retry": retry, "next_run_at": moment, "failure_count": F.when(retry, count).otherwise(F.lit(0))})


def run_counts(rows: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.agg(F.count("*").alias("checked"), count("success").alias("sent"), count("failure").alias("failed"), count("skipped"))


def rate_limited(requests: DataFrame, maximum: int, window_seconds: int) -> DataFrame:
    """Fixed windows a key: the first request opens one, the first at or after its end the next.

    Requests are ``key``, ``at`` (epoch seconds), ``id``. A window's start depends on the one before, so a
    key's requests pass one task in order of time; it holds two numbers, and works by windows, not by requests."""
    rows = requests.select("key", "at", "id").repartition("key").sortWithinPartitions("key", "at", "id")
    names = pa.schema([("key", pa.string()), ("id", pa.int64()), ("reset_at", pa.int64()), ("allowed", pa.bool_()), ("remaining", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened, seen = None, 0, 0
        for batch in batches:
            keys, at = batch.column(0), batch.column(1).to_numpy()
            n = len(at)
            if not n:
                continue
            ends = pc.run_end_encode(keys)
            opens, counts, start = np.empty(n, np.int64), np.empty(n, np.int64), 0
            for key, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
                while start < end:
                    if key != last or at[start] >= opened + window_seconds:
                        last, opened, seen = key, int(at[start]), 0
                    stop = start + int(np.searchsorted(at[start:end], opened + window_seconds))
                    opens[start:stop] = opened
                    counts[start:stop] = seen + np.arange(1, stop - start + 1)
                    seen, start = seen + stop - start, stop
            yield pa.RecordBatch.from_arrays([keys, batch.column(2), pa.array(opens + window_seconds), pa.array(counts <= maximum), pa.array(np.maximum(maximum - counts, 0))], schema=names)

    return rows.mapInArrow(run, "key string, id bigint, reset_at bigint, allowed boolean, remaining bigint")
