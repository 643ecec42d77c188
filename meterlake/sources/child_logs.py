"""Child sessions: their logs, their rows in session reports, and the correction of daily snapshots.

A child starts with a copy of its parent's counters. What it used itself is in its log; where
the session report says more, the difference goes from the snapshots of the days and models.

JSON objects come as variants, whose members are sorted: the models of a session stand in the
order of their names, and whole remainders of an apportionment go to the last of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scalars import json_number, json_text, local_date, report_date
from meterlake.operators import correction
from meterlake.sources.reports import rows_of
from meterlake.sources.session_logs import member

# Where session rows stand in a report, and alternative field names.
CONTAINERS = ("sessions", "data", "rows", "items")
INPUT, OUTPUT = ("inputTokens", "input_tokens"), ("outputTokens", "output_tokens")
CREATION = ("cacheCreationTokens", "cacheCreationInputTokens", "inputCacheCreationTokens", "cache_creation_tokens", "cache_creation_input_tokens", "input_cache_creation_tokens")
READ = ("cacheReadTokens", "cacheReadInputTokens", "cachedInputTokens", "cache_read_tokens", "cache_read_input_tokens", "cached_input_tokens")
TOTAL, COST = ("totalTokens", "total_tokens"), ("costUsd", "costUSD", "cost")


def number(doc: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(json_number(doc, *keys), F.lit(0.0))


def total_of(doc: Column) -> Column:
    """The explicit total if positive, else the sum of the parts."""
    explicit = number(doc, TOTAL)
    return F.when(explicit > 0, explicit).otherwise(number(doc, INPUT) + number(doc, OUTPUT) + number(doc, CREATION) + number(doc, READ))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (``path``, ``line_no``, ``value``) with ``doc``; blank ones go."""
    return lines.filter(F.trim("value") != "").withColumn("doc", F.try_parse_json(F.trim("value")))


def rejected(lines: DataFrame) -> DataFrame:
    """The malformed lines, which are passed over: ``path``, ``line_no``."""
    return parsed(lines).filter("doc is null").select("path", "line_no")


def children(records: DataFrame) -> DataFrame:
    """``session_id`` and ``started_at`` of the logs whose first telling header names a parent."""
    payload = member(F.col("doc"), "$.payload")
    spawn = member(member(member(payload, "$.source"), "$.subagent"), "$.thread_spawn")
    started = F.coalesce(json_text(payload, "timestamp"), json_text(F.col("doc"), "timestamp"))
    heads = records.filter(F.contains("value", F.lit("session_meta"))).filter(json_text(F.col("doc"), "type") == "session_meta")
    heads = heads.select("path", "line_no", json_text(spawn, "parent_thread_id").alias("parent"), started.alias("started_at")).filter("parent is not null and started_at is not null")
    return heads.groupBy(F.col("path").alias("session_id")).agg(F.min_by("started_at", "line_no").alias("started_at"))


def requests(records: DataFrame, zone: str) -> DataFrame:
    """The per-request counters of all logs, with the cumulative state that each belongs to."""
    info = member(member(F.col("doc"), "$.payload"), "$.info")
    both = records.select("path", "line_no", json_text(F.col("doc"), "timestamp").alias("ts"), member(info, "$.total_token_usage").alias("whole"), member(info, "$.last_token_usage").alias("last"))
    both = both.filter("ts is not null and whole is not null and last is not null")
    whole, last = F.col("whole"), F.col("last")
    state = F.struct(number(whole, INPUT).alias("i"), number(whole, READ).alias("r"), number(whole, OUTPUT).alias("o"), total_of(whole).alias("t"))
    moment = F.try_to_timestamp("ts")
    date = F.coalesce(local_date(moment, F.lit(zone)), report_date(F.col("ts")))
    counters = {"input_tokens": number(last, INPUT), "output_tokens": number(last, OUTPUT), "cache_creation_tokens": F.lit(0.0), "cache_read_tokens": number(last, READ), "total_tokens": total_of(last)}
    return both.select(F.col("path").alias("session_id"), "line_no", "ts", date.alias("usage_date"), state.alias("cumulative"), *(x.cast("bigint").alias(c) for c, x in counters.items()))


def inside(root: str, *parts: Column) -> Column:
    """The path of a file below ``root``, dots resolved; null for one that leads out of it."""
    whole = parts[0]
    for p in parts[1:]:
        whole = F.when(p.startswith("/"), p).otherwise(F.concat(whole, F.lit("/"), p))
    whole = F.when(whole.startswith("/"), whole).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), whole))
    step = lambda held, x: F.when(x.isin("", "."), held).when(x == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(x)))
    path = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/"))
    return F.when(path.startswith(root.rstrip("/") + "/"), path)


def session_models(reports: DataFrame, root: str) -> DataFrame:
    """Session rows by model: ``session_id`` (its log's path), ``model``, ``ordinal``, counters and cost.

    A row without a day is an error, one without a path below ``root`` is passed over."""
    rows = rows_of(reports, CONTAINERS, alone=False)
    row = F.col("row")
    by_id = inside(root, F.concat(json_text(row, "sessionId"), F.lit(".jsonl")))
    by_file = inside(root, json_text(row, "directory"), F.concat(json_text(row, "sessionFile"), F.lit(".jsonl")))
    path = F.when(json_text(row, "sessionId").isNotNull(), by_id).otherwise(by_file)
    day = json_text(row, "lastActivity", "date", "usageDate")
    rows = rows.select("row", path.alias("session_id"), day.alias("day")).filter("session_id is not null")
    entries = F.transform(F.map_entries(F.try_variant_get(member(row, "$.models"), "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("model"), e["value"].alias("metrics"), F.lit(False).alias("whole")))
    own = F.array(F.struct(F.coalesce(json_text(row, "model", "modelName", "name"), F.lit("all")).alias("model"), row.alias("metrics"), F.lit(True).alias("whole")))
    parts = rows.select("session_id", "row", "day", F.posexplode(F.coalesce(entries, own)).alias("ordinal", "part"))
    parts = parts.filter(F.schema_of_variant("part.metrics").startswith("OBJECT"))
    m = F.col("part.metrics")
    direct, above, tokens, mine = number(m, COST), number(row, COST), total_of(row), total_of(m)
    shared = F.when((above > 0) & (tokens > 0) & (mine > 0), above * (mine / tokens)).otherwise(0.0)
    cost = F.when((direct > 0) | F.col("part.whole"), direct).otherwise(shared)
    told = F.when(F.col("day").isNull(), F.raise_error(F.lit("a session row has no last activity")).cast("int")).otherwise(F.col("ordinal"))
    counters = {"input_tokens": number(m, ("inputTokens",)), "output_tokens": number(m, ("outputTokens",)), "cache_creation_tokens": number(m, CREATION), "cache_read_tokens": number(m, READ), "total_tokens": mine}
    return parts.select("session_id", F.col("part.model").alias("model"), told.alias("ordinal"), *(x.cast("bigint").alias(c) for c, x in counters.items()), (cost * 1e6).alias("cost_micros"))


def adjustments(reports: DataFrame, lines: DataFrame, root: str, zone: str = "UTC") -> DataFrame:
    """What to take from the snapshots of a day and model."""
    records = parsed(lines).filter("doc is not null")
    started = children(records)
    sessions = session_models(reports, root).join(started.select("session_id"), "session_id", "left_semi")
    return correction.corrections(sessions, correction.child_usage(requests(records, zone), started))


def corrected(snapshots: DataFrame, reports: DataFrame, lines: DataFrame, root: str, zone: str = "UTC") -> DataFrame:
    """Daily snapshots after the correction; ``adjusted`` is null where nothing was to take and false where it did not fit."""
    return correction.corrected(snapshots, adjustments(reports, lines, root, zone))
