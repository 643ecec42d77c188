"""The engine's tables as views of the generated star schema.

The statements are plain SQL that Spark and DuckDB both read, so that a query and its
oracle start from the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

USAGE = """
SELECT 'u' || CAST(user_id AS STRING) AS user_id,
       CASE WHEN event_id % 4 = 0 THEN 'legacy' ELSE 'dev_' || CAST(event_id % 3 AS STRING) END AS device_id,
       CASE WHEN event_type IN ('click', 'view') THEN 'claude-code' ELSE 'codex' END AS source,
       CAST(CAST(ts AS DATE) AS STRING) AS usage_date,
       CASE WHEN event_type IN ('click', 'signup') THEN 'model-a' ELSE 'model-b' END AS model,
       'UTC' AS timezone,
       CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS input_tokens,
       CAST(SUM(event_id % 97) AS BIGINT) AS output_tokens,
       CAST(SUM(event_id % 13) AS BIGINT) AS cache_creation_tokens,
       CAST(SUM(event_id % 50) AS BIGINT) AS cache_read_tokens,
       CAST(SUM(CAST(round(value * 100) AS BIGINT) + event_id % 97 + event_id % 13 + event_id % 50) AS BIGINT) AS total_tokens,
       CAST(SUM(CAST(round(value * 10) AS BIGINT)) * 1000 AS BIGINT) AS cost_micros,
       CAST(COUNT(*) AS BIGINT) AS session_count,
       CAST(CAST(MAX(ts) AS DATE) AS STRING) || 'T12:00:00.000Z' AS synced_at,
       'h' || CAST(MAX(event_id) AS STRING) AS snapshot_hash
FROM events GROUP BY 1, 2, 3, 4, 5
"""

DEDUPED = """
SELECT u.* FROM usage u WHERE u.device_id <> 'legacy' OR NOT EXISTS (
  SELECT 1 FROM usage c WHERE c.device_id <> 'legacy' AND c.user_id = u.user_id AND c.usage_date = u.usage_date
    AND c.source = u.source AND c.model = u.model)
"""

SUMMARIZED = """
SELECT user_id, usage_date, source, model, COALESCE(MAX(timezone), 'UTC') AS timezone,
       CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, CAST(SUM(output_tokens) AS BIGINT) AS output_tokens,
       CAST(SUM(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens, CAST(SUM(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
       CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, CAST(SUM(total_tokens - cache_read_tokens) AS BIGINT) AS tokens_without_cache_read,
       CAST(SUM(cost_micros) AS BIGINT) AS cost_micros, CAST(SUM(session_count) AS BIGINT) AS session_count, MAX(synced_at) AS updated_at
FROM deduped GROUP BY user_id, usage_date, source, model
"""

#: The stored cache: half of the month, and stale by one token on even days.
SUMMARY = """
SELECT user_id, usage_date, source, model, timezone, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens,
       total_tokens + CASE WHEN CAST(substr(usage_date, 9, 2) AS INT) % 2 = 0 THEN 1 ELSE 0 END AS total_tokens,
       tokens_without_cache_read + CASE WHEN CAST(substr(usage_date, 9, 2) AS INT) % 2 = 0 THEN 1 ELSE 0 END AS tokens_without_cache_read,
       cost_micros, session_count, updated_at
FROM summarized WHERE usage_date < '2024-01-15'
"""

PROFILES = """
SELECT 'u' || CAST(c_custkey AS STRING) AS user_id, 'user-' || CAST(c_custkey AS STRING) AS slug, c_name AS display_name,
       CASE c_nationkey % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Asia/Shanghai' ELSE 'Europe/London' END AS timezone,
       CASE WHEN c_nationkey % 4 = 0 THEN 'default' ELSE 'user' END AS timezone_source,
       c_custkey % 5 <> 0 AS is_public, c_custkey % 3 <> 0 AS participates, c_custkey % 7 <> 0 AS share_reports,
       '2024-01-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || 'T00:00:00.000Z' AS updated_at
FROM customer
"""

#: The second cache: fresh for even users, stale (and wrong) for odd ones, absent for every fifth.
TOTALS = """
SELECT user_id, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, CAST(SUM(tokens_without_cache_read) AS BIGINT) AS tokens_without_cache_read,
       CAST(SUM(cost_micros) AS BIGINT) + CASE WHEN CAST(substr(user_id, 2) AS INT) % 2 = 0 THEN 0 ELSE 7 END AS cost_micros,
       CAST(SUM(session_count) AS BIGINT) AS session_count,
       CASE WHEN CAST(substr(user_id, 2) AS INT) % 2 = 0 THEN '2024-02-01T00:00:00.000Z' ELSE '2024-01-02T00:00:00.000Z' END AS updated_at
FROM summary WHERE CAST(substr(user_id, 2) AS INT) % 5 <> 4 GROUP BY user_id
"""

DEVICES = """
SELECT 'dev_' || CAST(s_suppkey AS STRING) AS id, 'u' || CAST(s_suppkey % 15 AS STRING) AS user_id, s_name AS name,
       CASE WHEN s_suppkey % 2 = 0 THEN 'darwin' ELSE 'linux' END AS platform,
       CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE '2024-01-' || lpad(CAST(1 + s_suppkey % 27 AS STRING), 2, '0') || 'T08:00:00.000Z' END AS last_synced_at,
       '2023-12-' || lpad(CAST(1 + s_suppkey % 30 AS STRING), 2, '0') || 'T08:00:00.000Z' AS created_at
FROM supplier
"""

TOKENS = """
SELECT 'tok_' || CAST(p_partkey AS STRING) AS id, 'dev_' || CAST(p_partkey % 12 AS STRING) AS device_id, 'u' || CAST(p_partkey % 15 AS STRING) AS user_id,
       CASE WHEN p_size % 4 = 0 THEN '2024-01-10T00:00:00.000Z' END AS revoked_at
FROM part
"""

PAIRINGS = """
SELECT 'pc_' || CAST(s_suppkey AS STRING) AS id, 'u' || CAST(s_suppkey % 15 AS STRING) AS user_id, 'code' || CAST(s_suppkey AS STRING) AS code_hash,
       '2024-01-' || lpad(CAST(1 + s_suppkey % 28 AS STRING), 2, '0') || 'T08:30:00.000Z' AS expires_at,
       CASE WHEN s_suppkey % 3 = 0 THEN '2024-01-02T00:00:00.000Z' END AS consumed_at
FROM supplier
"""

#: Schedules as they are stored: some empty, some malformed, some with a retry or a lease pending.
SUBSCRIPTIONS = """
SELECT 'sub_' || CAST(c_custkey AS STRING) AS id, 'u' || CAST(c_custkey AS STRING) AS user_id, 'hook ' || c_name AS name,
       CASE c_nationkey % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Shanghai' ELSE 'America/New_York' END AS timezone,
       CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN '18:00, 09:30' WHEN 2 THEN '25:00' ELSE '09:30' END AS schedule_times_local,
       CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE '08:15' END AS schedule_time_local,
       CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN '5,1 2,3,4' WHEN 2 THEN '9' ELSE '0,1,2,3,4,5,6' END AS schedule_weekdays,
       c_custkey % 4 <> 0 AS enabled, c_custkey % 9 = 0 AS send_empty_report,
       '2024-01-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || 'T09:30:00.000Z' AS next_run_at,
       CASE WHEN c_custkey % 8 = 1 THEN '2024-01-' || lpad(CAST(1 + c_custkey % 9 AS STRING), 2, '0') END AS pending_report_date,
       CASE WHEN c_custkey % 8 = 1 AND c_custkey % 3 <> 0 THEN '2024-01-' || lpad(CAST(1 + c_custkey % 9 AS STRING), 2, '0') || 'T09:30' END AS pending_schedule_slot,
       CASE WHEN c_custkey % 3 = 0 THEN '2024-01-' || lpad(CAST(1 + c_custkey % 25 AS STRING), 2, '0') || 'T10:00:00.000Z' END AS locked_until,
       CASE WHEN c_custkey % 3 = 0 THEN '2024-01-' || lpad(CAST(1 + c_custkey % 25 AS STRING), 2, '0') || 'T09:50:00.000Z' END AS locked_at,
       CAST(c_custkey % 4 AS INT) AS failure_count, CASE WHEN c_custkey % 4 > 0 THEN 'HTTP 500' END AS last_error,
       CAST(NULL AS STRING) AS last_success_at, CAST(NULL AS STRING) AS last_failure_at,
       '2023-12-' || lpad(CAST(1 + c_custkey % 30 AS STRING), 2, '0') || 'T00:00:00.000Z' AS created_at, '2024-01-01T00:00:00.000Z' AS updated_at
FROM customer
"""

HISTORY = """
SELECT 'rep_' || CAST(event_id AS STRING) AS id, 'u' || CAST(user_id AS STRING) AS user_id, CAST(CAST(ts AS DATE) AS STRING) AS report_date,
       CAST(CAST(ts AS DATE) AS STRING) || 'T' || lpad(CAST(event_id % 24 AS STRING), 2, '0') || ':00' AS schedule_slot, CAST(event_id % 1000 AS BIGINT) AS total_tokens,
       CASE WHEN event_id % 5 = 0 THEN '2024-01-20T00:00:00.000Z' END AS share_revoked_at,
       CASE event_id % 4 WHEN 0 THEN '[' WHEN 1 THEN '{"source":"codex"}' WHEN 2 THEN '[{"source":"codex","totalTokens":5,"totalTokensWithoutCacheRead":"5"}]'
            ELSE '[{"source":"codex","totalTokens":5,"totalTokensWithoutCacheRead":4}]' END AS source_split,
       CASE event_id % 3 WHEN 0 THEN 'null' ELSE '[{"model":"m","totalTokens":5,"totalTokensWithoutCacheRead":4,"costUsd":0.5,"cacheReadRate":0.2}]' END AS top_models,
       CAST(CAST(ts AS DATE) AS STRING) || 'T' || lpad(CAST(event_id % 24 AS STRING), 2, '0') || ':05:00.000Z' AS generated_at, '2024-01-31T00:00:00.000Z' AS updated_at
FROM events WHERE event_id % 11 = 0
"""

DELIVERIES = """
SELECT 'sub_' || CAST(user_id AS STRING) AS subscription_id, 'u' || CAST(user_id AS STRING) AS user_id, CAST(CAST(ts AS DATE) AS STRING) AS report_date,
       CAST(CAST(ts AS DATE) AS STRING) || 'T' || lpad(CAST(event_id % 24 AS STRING), 2, '0') || ':00' AS schedule_slot,
       CASE WHEN event_id % 3 = 0 THEN 'failure' ELSE 'success' END AS status, CASE WHEN event_id % 7 = 0 THEN 'test' ELSE 'daily' END AS kind, event_id AS ordinal
FROM events
"""

#: Snapshots that a client sends again: every third has changed, some keys twice in one batch.
INCOMING = """
SELECT user_id, device_id, source, usage_date, model, timezone, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens,
       total_tokens + CASE WHEN session_count % 3 = 0 THEN 5 ELSE 0 END AS total_tokens, cost_micros, session_count,
       '2024-02-02T00:00:00.000Z' AS synced_at,
       CASE WHEN session_count % 3 = 0 THEN snapshot_hash || 'x' ELSE snapshot_hash END AS snapshot_hash, 1 AS ordinal
FROM usage WHERE usage_date >= '2024-01-12'
UNION ALL
SELECT user_id, device_id, source, usage_date, model, timezone, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens,
       total_tokens + 9 AS total_tokens, cost_micros, session_count, '2024-02-02T00:00:01.000Z' AS synced_at, snapshot_hash || 'y' AS snapshot_hash, 2 AS ordinal
FROM usage WHERE usage_date >= '2024-01-25' AND session_count % 2 = 0
"""

#: JSON lines of both kinds; of every 20 one that is passed over, one that only looks like usage and two
#: that may be ignored; every 50th is broken. Some hold a cost, 0 among them.
LOGS = """
SELECT event_id, 's' || CAST(user_id AS STRING) AS session_id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS kind,
  CASE WHEN event_id % 50 = 0 THEN '{"type":"broken'
       WHEN event_id % 20 = 1 THEN '{"type":"note","text":"hello"}'
       WHEN event_id % 20 = 2 THEN '{"type":"other","a":{"b":[{"c":{"input_tokens":3}}]}}'
       WHEN event_id % 20 = 3 THEN '{"type":"assistant","timestamp":"2024-01-05T10:00:00Z","message":{"model":"<synthetic>","usage":{"input_tokens":0,"output_tokens":0}}}'
       WHEN event_id % 20 = 4 THEN '{"type":"event_msg","timestamp":"2024-01-05T10:00:00Z","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":9}}}}'
       WHEN event_id % 2 = 0 THEN '{"type":"event_msg","timestamp":"' || CAST(CAST(ts AS DATE) AS STRING) || 'T23:30:00.000Z","payload":{"type":"token_count","info":{"model":"' || event_type
         || '","last_token_usage":{"input_tokens":' || CAST(event_id % 1000 AS STRING) || ',"output_tokens":' || CAST(event_id % 97 AS STRING) || ',"cached_input_tokens":' || CAST(event_id % 50 AS STRING)
         || CASE event_id % 20 WHEN 6 THEN ',"cost_usd":0' WHEN 8 THEN ',"total_cost":0.5' ELSE '' END || '}}}}'
       ELSE '{"type":"assistant","timestamp":"' || CAST(CAST(ts AS DATE) AS STRING) || 'T23:30:00.000Z"' || CASE WHEN event_id % 20 = 5 THEN ',"costUSD":0.25' ELSE '' END || ',"message":{"model":"' || event_type
         || '","usage":{"input_tokens":' || CAST(event_id % 1000 AS STRING) || ',"output_tokens":' || CAST(event_id % 97 AS STRING) || ',"cache_creation_input_tokens":' || CAST(event_id % 13 AS STRING)
         || ',"cache_read_input_tokens":' || CAST(event_id % 50 AS STRING) || '}}}' END AS value
FROM events
"""

#: In the order in which they build on each other.
VIEWS = {
    "usage": USAGE, "deduped": DEDUPED, "summarized": SUMMARIZED, "summary": SUMMARY, "profiles": PROFILES, "totals": TOTALS,
    "devices": DEVICES, "tokens": TOKENS, "incoming": INCOMING, "logs": LOGS, "pairings": PAIRINGS, "subscriptions": SUBSCRIPTIONS,
    "history": HISTORY, "deliveries": DELIVERIES,
}
BASE = {"events", "customer", "supplier", "part"}


def ctes(*names: str) -> str:
    """``WITH`` clause of the named views and those that they build on."""
    need: set[str] = set()

    def add(name: str) -> None:
        if name not in need:
            need.add(name)
            for other in VIEWS:
                if f"FROM {other} " in VIEWS[name] or f"FROM {other}\n" in VIEWS[name]:
                    add(other)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in VIEWS if n in need)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the engine's tables; only the columns it needs are read."""
    text = f"{ctes(name)} SELECT * FROM {name}"
    for base in sorted(BASE):
        if f"FROM {base}" in text:
            alias = f"facade_{base}"
            spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(alias)
            text = re.sub(rf"FROM {base}\b", f"FROM {alias}", text)
    return spark.sql(text)
