"""What to read: files active in a range, signals of sources, snapshots to send again, runs.

Launching programs and holding locks are left to the scheduler; these are the rules by which
its inputs and records are judged."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scalars import json_text
from meterlake.schema import SOURCES
from meterlake.sources.session_logs import member

#: Fixed value: days that a scan looks back.
LOOKBACK = 7


def default_since(now: datetime, zone: str, days: int = LOOKBACK) -> str:
    """The first day of a scan, as ``YYYYMMDD``: some local days before now."""
    return (now.astimezone(ZoneInfo(zone)).date() - timedelta(days=days)).strftime("%Y%m%d")


def bounds(since: str | None, until: str | None) -> tuple[str | None, str | None]:
    """Instants of a range of UTC days, the last included to its end; ``all`` is no bound."""

    def day(text: str | None) -> str | None:
        if not text or text == "all":
            return None
        compact = text.replace("-", "").strip()
        if len(compact) != 8 or not compact.isdecimal():
            raise ValueError(f"not a day: {text}")
        return f"{compact[:4]}-{compact[4:6]}-{compact[6:]}"

    first, last = day(since), day(until)
    return first and f"{first} 00:00:00", last and f"{last} 23:59:59.999"


def in_range(moment: Column, since: str | None, until: str | None) -> Column:
    test = moment.isNotNull()
    if since:
        test = test & (moment >= F.lit(since).cast("timestamp"))
    if until:
        test = test & (moment <= F.lit(until).cast("timestamp"))
    return F.coalesce(test, F.lit(False))


def token_moments(lines: DataFrame) -> DataFrame:
    """``path`` and ``moment`` of every counter event of kind A logs."""
    doc = F.try_parse_json(F.trim("value"))
    rows = lines.filter(F.contains("value", F.lit("token_count"))).select("path", doc.alias("doc"))
    event = (json_text(F.col("doc"), "type") == "event_msg") & (json_text(member(F.col("doc"), "$.payload"), "type") == "token_count")
    return rows.filter(event).select("path", F.try_to_timestamp(json_text(F.col("doc"), "timestamp")).alias("moment"))


def active_files(listing: DataFrame, lines: DataFrame, since: str | None, until: str | None = None) -> DataFrame:
    """Files (``path``, ``mtime_ms``) that a range concerns: those modified in it, and of the others those
    with a counter event in it. Only the others' lines are read."""
    if since == "all" and not until:
        return listing
    first, last = bounds(since, until)
    if first is None and last is None:
        return listing.limit(0)
    recent = in_range(F.timestamp_millis("mtime_ms"), first, last)
    rest = listing.filter(~recent)
    hit = token_moments(lines.join(rest.select("path"), "path", "left_semi")).filter(in_range(F.col("moment"), first, last))
    return listing.filter(recent).unionByName(rest.join(hit.select("path").distinct(), "path", "left_semi").select(*listing.columns))


def with_cached(fresh: DataFrame, manifest: DataFrame, cached: DataFrame, listing: DataFrame, now: str) -> DataFrame:
    """Fresh snapshots, and the cached ones (``path`` and snapshot) of pending files that vanished, collected now."""
    gone = manifest.filter("pending").join(listing.select("path"), "path", "left_anti").select("path")
    again = cached.join(gone, "path", "left_semi").withColumn("synced_at", F.lit(now))
    return fresh.unionByName(again.select(*fresh.columns))


def signal_sources(lines: DataFrame) -> DataFrame:
    """``source``, ``position``: the sources that signals (``queue`` 0 for queued files and 1 for the old file,
    ``file``, ``line_no``, ``value``) name, in the order in which they are first seen."""
    text = F.trim("value")
    named = F.when(text.isin(*SOURCES), text).otherwise(json_text(F.try_parse_json(text), "source"))
    rows = lines.withColumn("source", named).filter(F.col("source").isin(*SOURCES))
    first = rows.groupBy("source").agg(F.min(F.struct("queue", "file", "line_no")).alias("first"))
    ordered = first.agg(F.array_sort(F.collect_list(F.struct("first", "source"))).alias("s"))  # as many as there are sources
    return ordered.select(F.posexplode(F.transform("s", lambda x: x["source"])).alias("position", "source"))


def with_status(runs: DataFrame) -> DataFrame:
    """Runs (``error``, ``skipped``, ``cycle_errors``) with ``status`` and ``duration_ms``."""
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("skipped"), "skipped").when(F.col("cycle_errors") > 0, "error").otherwise("success")
    return runs.withColumns({"status": status, "duration_ms": F.col("completed_ms") - F.col("started_ms")})


def last_runs(runs: DataFrame) -> DataFrame:
    """The last run, and when the last successful one ended."""
    done = with_status(runs)
    good = F.when(F.col("status") == "success", F.col("completed_ms"))
    return done.agg(F.max_by("run_id", F.struct("completed_ms", "run_id")).alias("last_run"), F.max_by("status", F.struct("completed_ms", "run_id")).alias("last_status"), F.max(good).alias("last_success_ms"))
