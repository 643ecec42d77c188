"""Upserts by content hash and the incremental maintenance of both caches.

Changed keys are recomputed whole and replace what is stored; deltas are never added, so
a repeated or reordered batch leads to the same tables."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlake.operators.facts import dedupe_legacy, summarize, sums
from meterlake.schema import LOGICAL, PHYSICAL, SUMMED, TOKENS, unused

SUMMARY_MEASURES = SUMMED
TOTAL_MEASURES = ["total_tokens", "tokens_without_cache_read", "cost_micros", "session_count"]


def last_of_batch(incoming: DataFrame) -> DataFrame:
    """The last row of a batch for each physical key (by ``ordinal``)."""
    latest, place = F.row_number().over(W.partitionBy(*PHYSICAL).orderBy(F.desc("ordinal"))), unused(incoming, "place")
    return incoming.withColumn(place, latest).filter(F.col(place) == 1).drop(place)


def changed_rows(incoming: DataFrame, usage: DataFrame) -> DataFrame:
    """Last rows of a batch whose key is new or whose stored hash is null or differs."""
    stored = unused(incoming, "stored")
    known = usage.select(*PHYSICAL, F.struct("snapshot_hash").alias(stored))
    found = last_of_batch(incoming).join(known, PHYSICAL, "left")
    old = F.col(f"{stored}.snapshot_hash")
    return found.filter(old.isNull() | (old != F.col("snapshot_hash"))).drop(stored)


def upserted_count(incoming: DataFrame, usage: DataFrame) -> DataFrame:
    """How many rows of a batch take effect if they are applied in order."""
    known = usage.select(*PHYSICAL, F.col("snapshot_hash").alias("old_hash"))
    order = W.partitionBy(*PHYSICAL).orderBy("ordinal")
    before = F.coalesce(F.lag("snapshot_hash").over(order), F.col("old_hash"))
    rows = incoming.select(*PHYSICAL, "ordinal", "snapshot_hash").join(known, PHYSICAL, "left").withColumn("before", before)
    effect = F.col("before").isNull() | (F.col("before") != F.col("snapshot_hash"))
    return rows.agg(F.sum(effect.cast("bigint")).alias("upserted"), F.count("*").alias("received"))


def upsert(incoming: DataFrame, usage: DataFrame) -> DataFrame:
    """The table after a batch."""
    changed = changed_rows(incoming, usage).select(*usage.columns)
    return usage.join(changed.select(*PHYSICAL), PHYSICAL, "left_anti").select(*usage.columns).unionByName(changed)


def refreshed_summary(keys: DataFrame, usage: DataFrame) -> DataFrame:
    """Summary rows of the given logical keys, zeros where nothing is stored."""
    raw = usage.join(keys.select(*LOGICAL).distinct(), LOGICAL, "left_semi")
    found = summarize(dedupe_legacy(raw))
    rows = keys.select(*LOGICAL).distinct().join(found, LOGICAL, "left")
    zeros = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in SUMMED}
    return rows.withColumns(zeros | {"timezone": F.coalesce("timezone", F.lit("UTC"))})


def merged_summary(keys: DataFrame, usage: DataFrame, summary: DataFrame) -> DataFrame:
    """The summary after the keys were refreshed."""
    new = refreshed_summary(keys, usage).select(*summary.columns)
    return summary.join(new.select(*LOGICAL), LOGICAL, "left_anti").select(*summary.columns).unionByName(new)


def stale_summary_keys(keys: DataFrame, usage: DataFrame, summary: DataFrame) -> DataFrame:
    """Requested keys that are in usage and whose summary is missing or differs in a measure."""
    wanted = usage.join(keys.select(*LOGICAL).distinct(), LOGICAL, "left_semi")
    expected = summarize(dedupe_legacy(wanted))
    stored = summary.select(*LOGICAL, *(F.col(c).alias(f"s_{c}") for c in SUMMARY_MEASURES))
    same = F.lit(True)
    for c in SUMMARY_MEASURES:
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return expected.join(stored, LOGICAL, "left").filter(~same).select(*LOGICAL)


def totals_of(summary: DataFrame) -> DataFrame:
    return summary.groupBy("user_id").agg(*sums(TOTAL_MEASURES), F.max("updated_at").alias("updated_at"))


def gated(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows only while the backfill is in its totals phase or done; no state row shuts the gate."""
    mark = unused(rows, "open")
    gate = state.filter("phase = 'totals' or completed_at is not null").select(F.lit(1).alias(mark)).limit(1)
    return rows.crossJoin(F.broadcast(gate)).drop(mark)  # one row at most


def stale_totals_users(users: DataFrame, summary: DataFrame, totals: DataFrame, state: DataFrame) -> DataFrame:
    """Users whose totals are missing or differ in a measure."""
    expected = totals_of(summary.join(users.select("user_id").distinct(), "user_id", "left_semi"))
    stored = totals.select("user_id", *(F.col(c).alias(f"t_{c}") for c in TOTAL_MEASURES))
    same = F.lit(True)
    for c in TOTAL_MEASURES:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    return gated(expected.join(stored, "user_id", "left").filter(~same).select("user_id"), state)


def merged_totals(users: DataFrame, summary: DataFrame, totals: DataFrame, state: DataFrame) -> DataFrame:
    """Totals after the users were refreshed; unchanged while the gate is shut."""
    new = gated(totals_of(summary.join(users.select("user_id").distinct(), "user_id", "left_semi")), state).select(*totals.columns)
    return totals.join(new.select("user_id"), "user_id", "left_anti").select(*totals.columns).unionByName(new)


def known_hashes(keys: DataFrame, user: str, device: str, usage: DataFrame, summary: DataFrame, totals: DataFrame, state: DataFrame) -> DataFrame:
    """Stored hashes of a device's keys; withheld where a cache is stale, so that the client sends again."""
    mine = keys.withColumn("user_id", F.lit(user)).select(*LOGICAL).distinct()
    stored = usage.filter((F.col("user_id") == user) & (F.col("device_id") == device) & F.col("snapshot_hash").isNotNull())
    found = stored.join(mine, LOGICAL, "left_semi")
    stale = stale_summary_keys(mine, usage, summary)
    behind = stale_totals_users(mine.select("user_id"), summary.filter(F.col("user_id") == user), totals, state)
    return found.join(stale, LOGICAL, "left_anti").join(behind, "user_id", "left_anti").select("source", "usage_date", "model", "snapshot_hash")


def filter_changed(snapshots: DataFrame, known: DataFrame) -> DataFrame:
    """Snapshots that a server does not know with the same hash."""
    return snapshots.join(known.select("source", "usage_date", "model", "snapshot_hash"), ["source", "usage_date", "model", "snapshot_hash"], "left_anti")


def backfill_page(usage: DataFrame, after: tuple[str, str, str, str] | None, limit: int) -> DataFrame:
    """The next logical keys in (user, date, source, model) order after a cursor, and one to look ahead."""
    keys = usage.select(*LOGICAL).distinct()
    if after is not None:
        keys = keys.filter(F.struct(*LOGICAL) > F.struct(*(F.lit(x) for x in after)))
    return keys.orderBy(*LOGICAL).limit(limit + 1)


def totals_page(summary: DataFrame, after: str | None, limit: int) -> DataFrame:
    users = summary.select("user_id").distinct()
    if after is not None:
        users = users.filter(F.col("user_id") > after)
    return users.orderBy("user_id").limit(limit + 1)


def missing_keys(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """Expected (source, date, model) without a produced row; an unknown model asks for the date alone."""
    known = expected.filter(F.col("model").isNotNull()).join(produced, ["source", "usage_date", "model"], "left_anti")
    unknown = expected.filter(F.col("model").isNull()).join(produced, ["source", "usage_date"], "left_anti")
    return known.select("source", "usage_date", "model").unionByName(unknown.select("source", "usage_date", "model"))


def invalid_reasons(sources: tuple[str, ...]):
    """Why a snapshot is refused, as an array of names."""
    rules = {
        "source": F.col("source").isin(*sources),
        "usage_date": F.col("usage_date").rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "model": F.length("model").between(1, 160),
        "timezone": F.length("timezone").between(1, 80),
        "cache_read": F.col("cache_read_tokens") <= F.col("total_tokens"),
        "cost": F.col("cost_micros") >= 0,
        "sessions": F.col("session_count") >= 0,
    } | {c: F.col(c) >= 0 for c in TOKENS}
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())


def zone_names(spark) -> DataFrame:
    """The time zones that are known: some 600 names (``zone``)."""
    return spark.createDataFrame([(z,) for z in sorted(available_timezones())], "zone string")


def validated(snapshots: DataFrame, zones: DataFrame | None, sources: tuple[str, ...]) -> DataFrame:
    """Snapshots with ``reasons``; a zone that the dimension does not hold is one of them."""
    rows = snapshots.withColumn("reasons", invalid_reasons(sources))
    if zones is None:
        return rows
    mark = unused(rows, "known_zone")
    known = F.broadcast(zones.select(F.col("zone").alias("timezone"), F.lit(True).alias(mark)).distinct())  # some 600 zone names
    wrong = F.when(F.col(mark).isNull(), F.array(F.lit("zone"))).otherwise(F.array().cast("array<string>"))
    return rows.join(known, "timezone", "left").withColumn("reasons", F.concat("reasons", wrong)).drop(mark)


def accepted(snapshots: DataFrame, zones: DataFrame | None, sources: tuple[str, ...]) -> DataFrame:
    """The snapshots of a request all of whose rows are valid; one bad row fails the whole request."""
    rows = validated(snapshots, zones, sources)
    failed = F.raise_error(F.concat(F.lit("invalid snapshot: "), F.array_join("reasons", ", "))).cast("boolean")
    return rows.filter(F.when(F.size("reasons") > 0, failed).otherwise(F.lit(True))).select(*snapshots.columns)


def snapshot_text():
    """The hashed text of a snapshot: its fields as JSON in a fixed order, without the time of collection."""
    from meterlake.functions.scalars import js_number

    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c), r'(["\\])', r"\\$1"), F.lit('"'))
    fields = [
        ("source", quote("source")), ("usageDate", quote("usage_date")), ("timezone", quote("timezone")), ("model", quote("model")),
        ("inputTokens", F.col("input_tokens").cast("string")), ("outputTokens", F.col("output_tokens").cast("string")),
        ("cacheCreationTokens", F.col("cache_creation_tokens").cast("string")), ("cacheReadTokens", F.col("cache_read_tokens").cast("string")),
        ("totalTokens", F.col("total_tokens").cast("string")), ("costUsd", js_number(F.col("cost_micros") / 1e6)),
        ("sessionCount", F.col("session_count").cast("string")),
    ]
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def with_hash(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("snapshot_hash", F.sha2(snapshot_text(), 256))
