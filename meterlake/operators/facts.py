"""Dedupe of raw usage, its aggregation, and the effective summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlake.schema import LEGACY, LOGICAL, SUMMED, TOKENS, unused


@dataclass(frozen=True)
class Scope:
    """Predicates on the logical key; they hold on raw and summarised rows alike."""

    user: str | None = None
    on: str | None = None
    start: str | None = None
    end: str | None = None
    before: str | None = None
    source: str | None = None

    def apply(self, rows: DataFrame) -> DataFrame:
        date = F.col("usage_date")
        tests = [
            (self.user, F.col("user_id") == self.user),
            (self.on, date == self.on),
            (self.start, date >= self.start),
            (self.end, date <= self.end),
            (self.before, date < self.before),
            (None if self.source in (None, "all") else self.source, F.col("source") == self.source),
        ]
        for given, test in tests:
            if given is not None:
                rows = rows.filter(test)
        return rows


def dedupe_legacy(usage: DataFrame) -> DataFrame:
    """Rows of the legacy device go where another device has the same logical key.

    One pass: the flag is a window maximum over the logical key, through whose columns
    predicates of a scope are pushed to the scan. A key's rows are as many as a user's devices."""
    named, mark = F.max((F.col("device_id") != LEGACY).cast("int")).over(W.partitionBy(*LOGICAL)), unused(usage, "named")
    return usage.withColumn(mark, named).filter((F.col("device_id") != LEGACY) | (F.col(mark) == 0)).drop(mark)


def dedupe_legacy_anti(usage: DataFrame) -> DataFrame:
    """The same by an anti-join, for rows that are stored by logical key already."""
    named = usage.filter(F.col("device_id") != LEGACY)
    legacy = usage.filter(F.col("device_id") == LEGACY)
    return named.unionByName(legacy.join(named.select(*LOGICAL).distinct(), LOGICAL, "left_anti").select(*usage.columns))


def sums(names: list[str] = SUMMED) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


def with_net(usage: DataFrame) -> DataFrame:
    return usage.withColumn("tokens_without_cache_read", F.col("total_tokens") - F.col("cache_read_tokens"))


def summarize(deduped: DataFrame) -> DataFrame:
    """One row a logical key."""
    zone = F.coalesce(F.max("timezone"), F.lit("UTC")).alias("timezone")
    return with_net(deduped).groupBy(*LOGICAL).agg(zone, *sums(), F.max("synced_at").alias("updated_at"))


def fallback_summary(usage: DataFrame, summary: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Aggregates of raw keys that have no summary row."""
    raw = dedupe_legacy(scope.apply(usage))
    return summarize(raw).join(scope.apply(summary).select(*LOGICAL), LOGICAL, "left_anti")


def effective_summary(usage: DataFrame, summary: DataFrame, scope: Scope = Scope(), strict: bool = False) -> DataFrame:
    """Summary rows, even stale ones, and raw aggregates where there are none; strict: the summary alone."""
    columns = [*LOGICAL, "timezone", *TOKENS, "tokens_without_cache_read", "cost_micros", "session_count", "updated_at"]
    stored = scope.apply(summary).select(*columns)
    return stored if strict else stored.unionByName(fallback_summary(usage, summary, scope).select(*columns))


def legacy_exact_purge(usage: DataFrame) -> DataFrame:
    """Usage without legacy rows whose measures equal the sums of the key's other devices (cost within 1e-6)."""
    measures = [*TOKENS, "session_count"]
    others = usage.filter(F.col("device_id") != LEGACY).groupBy(*LOGICAL).agg(*(F.sum(c).alias(f"o_{c}") for c in [*measures, "cost_micros"]))
    legacy = usage.filter(F.col("device_id") == LEGACY).join(others, LOGICAL)
    equal = F.abs(F.col("cost_micros") - F.col("o_cost_micros")) < 1
    for c in measures:
        equal = equal & (F.col(c) == F.col(f"o_{c}"))
    gone = legacy.filter(equal).select(*LOGICAL, "device_id")
    return usage.join(gone, [*LOGICAL, "device_id"], "left_anti").select(*usage.columns)
