"""Uploads and the backfill of both caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import refresh
from meterlake.plans.registry import NOW, query, tables
from meterlake.sources.facade import ctes, view

_KEY = "user_id, usage_date, source, model"
_PHYSICAL = "u.user_id = i.user_id AND u.device_id = i.device_id AND u.source = i.source AND u.usage_date = i.usage_date AND u.model = i.model"
_MEASURES = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens", "tokens_without_cache_read", "cost_micros", "session_count")
_SUMS = ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in _MEASURES)
#: The tables after an upload, from the definition: shadowed rows go, keys are summed.
_AFTER = (
    ctes("usage", "incoming", "summary", "totals") + f""", last AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY user_id, device_id, source, usage_date, model ORDER BY ordinal DESC) = 1),
    chg AS (SELECT i.* EXCLUDE (ordinal) FROM last i LEFT JOIN usage u ON {_PHYSICAL} WHERE u.user_id IS NULL OR u.snapshot_hash IS NULL OR u.snapshot_hash <> i.snapshot_hash),
    us AS (SELECT u.* FROM usage u WHERE NOT EXISTS (SELECT 1 FROM chg i WHERE {_PHYSICAL}) UNION ALL BY NAME SELECT * FROM chg),
    real AS (SELECT *, total_tokens - cache_read_tokens AS tokens_without_cache_read FROM us u WHERE device_id <> 'legacy' OR NOT EXISTS (SELECT 1 FROM us c WHERE c.device_id <> 'legacy' AND c.user_id = u.user_id AND c.usage_date = u.usage_date AND c.source = u.source AND c.model = u.model)),
    fresh AS (SELECT {_KEY}, COALESCE(MAX(timezone), 'UTC') AS timezone, {_SUMS}, MAX(synced_at) AS updated_at FROM real GROUP BY {_KEY}),
    sent AS (SELECT DISTINCT {_KEY} FROM last i WHERE NOT EXISTS (SELECT 1 FROM chg u WHERE {_PHYSICAL})),
    keys AS (SELECT {_KEY} FROM chg UNION SELECT f.user_id, f.usage_date, f.source, f.model FROM fresh f JOIN sent USING ({_KEY}) LEFT JOIN summary s ON s.user_id = f.user_id AND s.usage_date = f.usage_date AND s.source = f.source AND s.model = f.model
      WHERE s.user_id IS NULL OR {' OR '.join(f's.{c} <> f.{c}' for c in _MEASURES)}),
    sm AS (SELECT * FROM summary s WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.user_id = s.user_id AND k.usage_date = s.usage_date AND k.source = s.source AND k.model = s.model) UNION ALL BY NAME SELECT fresh.* FROM fresh JOIN keys USING ({_KEY})),
    tt AS (SELECT user_id, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, CAST(SUM(tokens_without_cache_read) AS BIGINT) AS tokens_without_cache_read, CAST(SUM(cost_micros) AS BIGINT) AS cost_micros, CAST(SUM(session_count) AS BIGINT) AS session_count, MAX(updated_at) AS updated_at FROM sm GROUP BY 1),
    who AS (SELECT user_id FROM keys UNION SELECT tt.user_id FROM tt JOIN (SELECT DISTINCT user_id FROM incoming) USING (user_id) LEFT JOIN totals t ON t.user_id = tt.user_id WHERE t.user_id IS NULL OR t.total_tokens <> tt.total_tokens OR t.tokens_without_cache_read <> tt.tokens_without_cache_read OR t.cost_micros <> tt.cost_micros OR t.session_count <> tt.session_count)"""
)


def _upload(spark, d):
    usage, summary, totals, incoming = tables(spark, d, "usage", "summary", "totals", "incoming")
    gate = refresh.Backfill("totals").row(spark, NOW)
    return incoming, usage, refresh.Tables(usage, summary, totals), gate


@query("ingest_refresh_keys", _AFTER + " SELECT * FROM keys")
def _(spark, d):
    from meterlake.operators import caches

    incoming, usage, now, _ = _upload(spark, d)
    return refresh.keys_to_refresh(incoming, usage, caches.upsert(incoming, usage), now.summary)


@query("ingest_refresh_summary", _AFTER + " SELECT * FROM sm")
def _(spark, d):
    incoming, _, now, gate = _upload(spark, d)
    return refresh.uploaded(incoming, now, gate).summary


@query("ingest_refresh_totals", _AFTER + " SELECT tt.* FROM tt JOIN who USING (user_id) UNION ALL BY NAME SELECT * FROM totals WHERE user_id NOT IN (SELECT user_id FROM who)")
def _(spark, d):
    incoming, _, now, gate = _upload(spark, d)
    return refresh.uploaded(incoming, now, gate).totals


@query("ingest_refresh_gate_shut", _AFTER + " SELECT * FROM totals")
def _(spark, d):
    incoming, _, now, _ = _upload(spark, d)
    return refresh.uploaded(incoming, now, refresh.Backfill("summaries").row(spark, NOW)).totals


_FROM = ("u1", "2024-01-07", "codex", "model-a")
_PAGE = ctes("summarized", "summary") + f", pg AS (SELECT {_KEY} FROM summarized WHERE ({_KEY}) > {_FROM} ORDER BY {_KEY} LIMIT 40)"


def _start(spark, d):
    usage, summary, totals = tables(spark, d, "usage", "summary", "totals")
    return refresh.Tables(usage, summary, totals)


@query("backfill_step_summary", _PAGE + f" SELECT * FROM summary s WHERE NOT EXISTS (SELECT 1 FROM pg k WHERE k.user_id = s.user_id AND k.usage_date = s.usage_date AND k.source = s.source AND k.model = s.model) UNION ALL BY NAME SELECT summarized.* FROM summarized JOIN pg USING ({_KEY})")
def _(spark, d):
    return refresh.step(_start(spark, d), refresh.Backfill("summaries", _FROM), 40, NOW)[0].summary


@query(
    "backfill_step_state",
    _PAGE + f" SELECT 'summaries' AS phase, user_id AS cursor_user_id, usage_date AS cursor_usage_date, source AS cursor_source, model AS cursor_model, CAST(NULL AS STRING) AS completed_at, '{NOW}' AS updated_at FROM pg ORDER BY user_id DESC, usage_date DESC, source DESC, model DESC LIMIT 1",
)
def _(spark, d):
    before = refresh.Backfill("summaries", _FROM).row(spark, "2024-01-01T00:00:00.000Z")
    at = refresh.step(_start(spark, d), refresh.Backfill.of(before), 40, NOW)[1]
    return refresh.written_state(before, at, NOW)


_NEW = "SELECT user_id, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, CAST(SUM(tokens_without_cache_read) AS BIGINT) AS tokens_without_cache_read, CAST(SUM(cost_micros) AS BIGINT) AS cost_micros, CAST(SUM(session_count) AS BIGINT) AS session_count, MAX(updated_at) AS updated_at FROM {} GROUP BY 1"


@query("backfill_step_totals", ctes("totals") + f", pg AS (SELECT DISTINCT user_id FROM summary WHERE user_id > 'u10' ORDER BY 1 LIMIT 5), nw AS ({_NEW.format('summary')}) SELECT * FROM totals WHERE user_id NOT IN (SELECT user_id FROM pg) UNION ALL BY NAME SELECT nw.* FROM nw JOIN pg USING (user_id)")
def _(spark, d):
    return refresh.step(_start(spark, d), refresh.Backfill("totals", ("u10", None, None, None)), 5, NOW)[0].totals


@query("backfill_complete_summary", ctes("summarized") + " SELECT * FROM summarized")
def _(spark, d):
    done, _ = refresh.completed(_start(spark, d), NOW)
    return done.summary.select(*view(spark, d, "summarized").columns)


@query("backfill_complete_totals", ctes("summarized", "totals") + f" {_NEW.format('summarized')}")
def _(spark, d):
    done, at = refresh.completed(_start(spark, d), NOW)
    return done.totals.filter(F.lit(at.completed_at is not None))
