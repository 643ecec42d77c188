"""Scans, signals, run records, child sessions, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meterlake.functions import text
from meterlake.operators import correction
from meterlake.plans.registry import query
from meterlake.sources import child_logs, scans
from meterlake.sources.facade import ctes, view
from meterlake.streaming import ingest, jobs
from meterlake.streaming.store import VersionedTable


def _sql(spark, d: str, statement: str, **views):
    spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("facade_events")
    return spark.sql(statement.replace("FROM events", "FROM facade_events"))


# -- scans ---------------------------------------------------------------------------

@query(
    "active_files",
    ctes("logs") + f""", l AS (SELECT 's' || CAST(user_id AS STRING) AS path, epoch_ns(MIN(ts)) // 1000000 AS mtime_ms FROM events GROUP BY user_id),
    h AS (SELECT DISTINCT session_id AS path FROM logs JOIN events USING (event_id) WHERE kind = 'A' AND event_id % 50 <> 0 AND event_id % 20 <> 2 AND CASE WHEN event_id % 20 = 4 THEN DATE '2024-01-05' ELSE CAST(ts AS DATE) END BETWEEN DATE '2024-01-20' AND DATE '2024-01-20')
    SELECT l.* FROM l WHERE make_timestamp(mtime_ms * 1000) BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-20 23:59:59.999' OR path IN (SELECT path FROM h)""",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    listing = e.groupBy(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("path")).agg(F.unix_millis(F.min("ts").cast("timestamp")).alias("mtime_ms"))
    lines = view(spark, d, "logs").select(F.col("session_id").alias("path"), "value")
    return scans.active_files(listing, lines, "2024-01-20", "20240120")


_SIGNALS = """SELECT CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS queue, lpad(CAST(event_id AS STRING), 8, '0') AS file, 1 AS line_no,
  CASE event_id % 5 WHEN 0 THEN 'nothing' WHEN 1 THEN '{"source":"claude-code"}' WHEN 2 THEN ' codex ' WHEN 3 THEN '{"source":"other"}' ELSE '{"source":"codex"' END AS value FROM events"""


@query(
    "signal_sources",
    f"""WITH s AS (SELECT *, CASE trim(value) WHEN 'codex' THEN 'codex' WHEN '{{"source":"claude-code"}}' THEN 'claude-code' END AS source FROM ({_SIGNALS})), f AS (SELECT source, MIN((queue, file, line_no)) AS o FROM s WHERE source IS NOT NULL GROUP BY 1)
    SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INT) AS position, source FROM f""",
)
def _(spark, d):
    return scans.signal_sources(_sql(spark, d, _SIGNALS))


_RUNS = """SELECT CAST(event_id AS STRING) AS run_id, event_id * 1000 AS started_ms, event_id * 1000 + event_id % 700 AS completed_ms, CASE WHEN event_id % 11 = 0 THEN 'boom' END AS error, event_id % 3 = 0 AS skipped, event_id % 4 AS cycle_errors FROM events"""
_RUN_STATUS = f"r AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN skipped THEN 'skipped' WHEN cycle_errors > 0 THEN 'error' ELSE 'success' END AS status, completed_ms - started_ms AS duration_ms FROM ({_RUNS}))"


@query("run_log", f"WITH {_RUN_STATUS} SELECT * FROM r")
def _(spark, d):
    return scans.with_status(_sql(spark, d, _RUNS))


@query("last_runs", f"WITH {_RUN_STATUS} SELECT arg_max(run_id, (completed_ms, run_id)) AS last_run, arg_max(status, (completed_ms, run_id)) AS last_status, MAX(completed_ms) FILTER (status = 'success') AS last_success_ms FROM r")
def _(spark, d):
    return scans.last_runs(_sql(spark, d, _RUNS))


_CACHED = "SELECT 'f' || CAST(event_id % 40 AS STRING) AS path, 'codex' AS source, '2024-01-0' || CAST(1 + event_id % 9 AS STRING) AS usage_date, event_type AS model, event_id AS total_tokens, 'old' AS synced_at FROM events"


@query(
    "cached_replay",
    f"""WITH c AS ({_CACHED}) SELECT source, usage_date, model, total_tokens, synced_at FROM c WHERE total_tokens % 2 = 0
    UNION ALL SELECT source, usage_date, model, total_tokens, 'now' FROM c WHERE total_tokens % 2 = 1 AND CAST(substr(path, 2) AS INT) % 3 = 0 AND CAST(substr(path, 2) AS INT) >= 20""",
)
def _(spark, d):
    rows = _sql(spark, d, _CACHED)
    number = F.substring("path", 2, 9).cast("int")
    files = rows.select("path").distinct()
    manifest = files.withColumn("pending", number % 3 == 0)
    fresh = rows.filter("total_tokens % 2 = 0").drop("path")
    return scans.with_cached(fresh, manifest, rows.filter("total_tokens % 2 = 1"), files.filter(number < 20), "now")


@query("upload_batches", ctes("usage") + " SELECT user_id, device_id, source, usage_date, model, CAST((row_number() OVER (PARTITION BY user_id, device_id ORDER BY usage_date, source, model) - 1) // 30 AS INT) AS upload FROM usage")
def _(spark, d):
    return jobs.uploads(view(spark, d, "usage").select("user_id", "device_id", "source", "usage_date", "model"))


_LOG_FILES = "SELECT 'log' || CAST(event_id AS STRING) AS path, event_id * 5000 AS size, event_id * 3600000 AS mtime_ms FROM events"


@query("log_rotation", f"WITH l AS ({_LOG_FILES}) SELECT *, CASE WHEN mtime_ms < 500 * 3600000::BIGINT - 604800000 THEN 'drop' ELSE 'rotate' END AS action FROM l WHERE mtime_ms < 500 * 3600000::BIGINT - 604800000 OR size > 1048576")
def _(spark, d):
    return jobs.to_rotate(_sql(spark, d, _LOG_FILES), 500 * 3_600_000)


# -- child sessions ------------------------------------------------------------------

_COUNTERS = correction.COUNTERS
_V = "(event_id % 100 + 10)"


def _apportion(total: str, weight: str, keys: str, order: str) -> tuple[str, str]:
    """Share of a slot before the rest, and the whole expression that needs it as ``x``."""
    window = f"(PARTITION BY {keys})"
    share = f"CAST(floor({total} * ({weight} / CAST(NULLIF(SUM({weight}) OVER {window}, 0) AS DOUBLE))) AS BIGINT)"
    i, n = f"row_number() OVER (PARTITION BY {keys} ORDER BY {order})", f"COUNT(*) OVER {window}"
    value = (
        f"CAST(CASE WHEN SUM({weight}) OVER {window} = 0 THEN {total} // {n} + CASE WHEN {i} <= {total} % {n} THEN 1 ELSE 0 END "
        f"WHEN {i} = {n} THEN {total} - COALESCE(SUM(x) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE x END AS BIGINT)"
    )
    return share, value


def _correction() -> str:
    """The adjustments by their definition, a counter after the other."""
    given = {"input_tokens": "t", "output_tokens": "0", "cache_creation_tokens": "0", "cache_read_tokens": "0", "total_tokens": "t"}
    ctes_ = [
        f"rec AS (SELECT user_id AS s, event_id, CAST(CAST(ts AS DATE) AS STRING) AS d, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS m, CAST({_V} AS BIGINT) AS t, event_id % 400 AS c, CAST(ts AS TIMESTAMP) AS ts FROM events)",
        "own AS (SELECT * FROM rec WHERE ts >= TIMESTAMP '2024-01-05' QUALIFY row_number() OVER (PARTITION BY s, c ORDER BY event_id) = 1)",
        "day AS (SELECT s, d, CAST(SUM(t) AS BIGINT) AS dt FROM own GROUP BY 1, 2)",
        "ses AS (SELECT s, m, CAST(SUM(t) AS BIGINT) AS t, CAST(SUM(t) * 100 AS BIGINT) AS cost FROM rec GROUP BY 1, 2)",
        "g0 AS (SELECT ses.*, day.d, day.dt, SUM(day.dt) OVER (PARTITION BY ses.s, ses.m) AS ct, (SELECT SUM(o.t) FROM ses o WHERE o.s = ses.s) AS ot, (SELECT SUM(o.cost) FROM ses o WHERE o.s = ses.s) AS oc FROM ses JOIN day ON day.s = ses.s)",
        "g1 AS (SELECT * FROM g0 WHERE ct > 0 AND ct <= ot)",
    ]
    share, value = _apportion("t", "dt", "s, m", "d")
    ctes_ += [f"g2 AS (SELECT *, {share} AS x FROM g1)", f"g3 AS (SELECT * EXCLUDE (x), {value} AS p, cost * (dt / CAST(ct AS DOUBLE)) AS pc FROM g2)"]
    share, value = _apportion("dt", "p", "s, d", "m")
    ctes_ += [
        f"g4 AS (SELECT *, {share} AS x FROM g3)",
        f"g5 AS (SELECT * EXCLUDE (x), {value} AS q, CASE WHEN p > 0 THEN oc * (dt / CAST(ot AS DOUBLE)) * (p / CAST(SUM(p) OVER (PARTITION BY s, d) AS DOUBLE)) ELSE 0 END AS qc FROM g4)",
        "g6 AS (SELECT *, MIN(CASE WHEN p >= q AND pc - qc >= -1 THEN 1 ELSE 0 END) OVER (PARTITION BY s) AS fits FROM g5)",
    ]
    columns = ", ".join(f"CAST(SUM({'p - q' if given[c] == 't' else '0'}) AS BIGINT) AS {c}" for c in _COUNTERS)
    ctes_.append(f"adj AS (SELECT d AS usage_date, m AS model, {columns}, SUM(greatest(pc - qc, 0)) AS cost_micros FROM g6 WHERE fits = 1 GROUP BY 1, 2)")
    return "WITH " + ",\n".join(ctes_)


def _frames(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    date = F.col("ts").cast("date").cast("string").alias("usage_date")
    value = (F.col("event_id") % 100 + 10).cast("bigint")
    counters = {c: value if c in ("input_tokens", "total_tokens") else F.lit(0).cast("bigint") for c in _COUNTERS}
    model = F.when(F.col("event_id") % 3 == 0, "a").otherwise("b").alias("model")
    return e, date, model, [x.alias(c) for c, x in counters.items()]


@query("subagent_correction", _correction() + " SELECT * REPLACE (CAST(floor(cost_micros) AS BIGINT) AS cost_micros) FROM adj")
def _(spark, d):
    e, date, model, parts = _frames(spark, d)
    session = F.col("user_id").alias("session_id")
    records = e.select(session, F.col("event_id").alias("line_no"), F.col("ts").cast("string").alias("ts"), date, F.struct((F.col("event_id") % 400).alias("t")).alias("cumulative"), *parts)
    children = e.select(session).distinct().withColumn("started_at", F.lit("2024-01-05"))
    sessions = e.select(session, model, *parts).groupBy("session_id", "model").agg(*(F.sum(c).alias(c) for c in _COUNTERS), (F.sum("total_tokens") * 100).alias("cost_micros")).withColumn("ordinal", F.when(F.col("model") == "a", 0).otherwise(1))
    return correction.corrections(sessions, correction.child_usage(records, children)).withColumn("cost_micros", F.floor("cost_micros"))


#: The same sessions as logs and as a report document a session.
_CHILD_LINES = """SELECT '/home/logs/sessions/u' || CAST(user_id AS STRING) || '.jsonl' AS path, event_id AS line_no, '{"type":"event_msg","timestamp":"' || date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") || 'Z","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":'
  || CAST(event_id % 400 AS STRING) || '},"last_token_usage":{"input_tokens":' || CAST(event_id % 100 + 10 AS STRING) || '}}}}' AS value FROM events
  UNION ALL SELECT DISTINCT '/home/logs/sessions/u' || CAST(user_id AS STRING) || '.jsonl', -1, '{"type":"session_meta","payload":{"timestamp":"2024-01-05","source":{"subagent":{"thread_spawn":{"parent_thread_id":"p"}}}}}' FROM events
  UNION ALL SELECT DISTINCT '/home/logs/sessions/u' || CAST(user_id AS STRING) || '.jsonl', -2, '{"type":"session_me' FROM events"""


def _child(spark, d):
    lines = _sql(spark, d, _CHILD_LINES)
    e, _, model, parts = _frames(spark, d)
    by = e.select("user_id", model, *parts).groupBy("user_id", "model").agg(F.sum("total_tokens").alias("t"))
    metrics = F.struct(F.col("t").alias("inputTokens"), F.col("t").alias("totalTokens"), (F.col("t") * 100 / 1e6).alias("costUSD"))
    entries = by.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("model", metrics.alias("metrics")))).alias("models"))
    row = F.struct(F.concat(F.lit("../sessions/u"), F.col("user_id").cast("string")).alias("sessionId"), F.lit("2024-01-31").alias("lastActivity"), "models")
    documents = entries.select(F.col("user_id").alias("report_id"), F.to_json(F.struct(F.array(row).alias("sessions"))).alias("value"))
    return documents, lines


@query("child_session_adjustments", _correction() + " SELECT * REPLACE (CAST(floor(cost_micros + 0.5) AS BIGINT) AS cost_micros) FROM adj")
def _(spark, d):
    documents, lines = _child(spark, d)
    return child_logs.adjustments(documents, lines, "/home/logs/sessions").withColumn("cost_micros", F.floor(F.col("cost_micros") + 0.5))


@query("child_log_rejects", "SELECT DISTINCT '/home/logs/sessions/u' || CAST(user_id AS STRING) || '.jsonl' AS path, CAST(-2 AS BIGINT) AS line_no FROM events")
def _(spark, d):
    return child_logs.rejected(_child(spark, d)[1]).withColumn("line_no", F.col("line_no").cast("bigint"))


#: Daily snapshots that hold what the sessions report; those of every third day are too small to take from.
_DAILY = """snp AS (SELECT CAST(CAST(ts AS DATE) AS STRING) AS usage_date, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS model, CAST(SUM(event_id % 100 + 10) * CASE WHEN day(MIN(ts)) % 3 = 0 THEN 0 ELSE 50 END AS BIGINT) AS t FROM events GROUP BY CAST(ts AS DATE), 2)"""


@query(
    "child_session_corrected",
    _correction() + f""", {_DAILY}, jn AS (SELECT snp.*, a.total_tokens AS x, a.cost_micros AS xc, a.total_tokens IS NOT NULL AS there, t - a.total_tokens >= 0 AND t * 100 - a.cost_micros >= -1 AS fits FROM snp LEFT JOIN adj a USING (usage_date, model))
    SELECT usage_date, model, CASE WHEN there AND fits THEN t - x ELSE t END AS total_tokens, CASE WHEN there THEN fits END AS adjusted FROM jn""",
)
def _(spark, d):
    documents, lines = _child(spark, d)
    e, date, model, parts = _frames(spark, d)
    factor = F.when(F.dayofmonth(F.min("ts")) % 3 == 0, 0).otherwise(50)
    daily = e.select(date, model, "ts", *parts).groupBy("usage_date", "model").agg(*((F.sum(c) * factor).cast("bigint").alias(c) for c in _COUNTERS))
    daily = daily.withColumn("cost_micros", F.col("total_tokens") * 100)
    return child_logs.corrected(daily, documents, lines, "/home/logs/sessions").select("usage_date", "model", "total_tokens", "adjusted")


# -- streams -------------------------------------------------------------------------

_STREAMED = ctes("logs") + """, j AS (SELECT *, TRY_CAST(value AS JSON) AS doc FROM logs), r AS (SELECT session_id, kind, CASE WHEN kind = 'A' THEN doc->'$.payload.info.last_token_usage' ELSE doc->'$.message.usage' END AS u, CASE WHEN kind = 'A' THEN doc->>'$.payload.info.model' ELSE doc->>'$.message.model' END AS model, substr(doc->>'$.timestamp', 1, 10) AS usage_date, CAST(doc->>'$.costUSD' AS DOUBLE) AS own FROM j),
  n AS (SELECT *, CAST(u->>'$.input_tokens' AS BIGINT) AS i, CAST(u->>'$.output_tokens' AS BIGINT) AS o, COALESCE(CAST(u->>'$.cache_creation_input_tokens' AS BIGINT), 0) AS cc, COALESCE(CAST(u->>'$.cache_read_input_tokens' AS BIGINT), CAST(u->>'$.cached_input_tokens' AS BIGINT)) AS cr, COALESCE(CAST(u->>'$.cost_usd' AS DOUBLE), CAST(u->>'$.total_cost' AS DOUBLE), own, 0) AS cost FROM r WHERE u IS NOT NULL AND model <> '<synthetic>')
  SELECT CASE WHEN kind = 'A' THEN 'codex' ELSE 'claude-code' END AS source, usage_date, model, CAST(SUM(i) AS BIGINT) AS input_tokens, CAST(SUM(o) AS BIGINT) AS output_tokens, CAST(SUM(cc) AS BIGINT) AS cache_creation_tokens, CAST(SUM(cr) AS BIGINT) AS cache_read_tokens, CAST(SUM(i + o + cc + cr) AS BIGINT) AS total_tokens,
    CAST(SUM(floor(cost * 1000000 + 0.5)) AS BIGINT) AS cost_micros, COUNT(DISTINCT session_id) AS session_count FROM n GROUP BY 1, 2, 3"""  # fmt: skip


@query("stream_daily_usage", _STREAMED)
def _(spark, d):
    """A stream over the log lines, a file of whole sessions a micro-batch, into a versioned table."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/streams"
    home = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    view(spark, d, "logs").select("session_id", "kind", "value").repartition(3, "session_id").write.parquet(f"{home}/lines")
    table = VersionedTable(spark, f"{home}/table", ingest.CONTRIBUTIONS, buckets=8)
    lines = spark.readStream.schema("session_id string, kind string, value string").option("maxFilesPerTrigger", 2).parquet(f"{home}/lines")
    ingest.follow(lines, table, f"{home}/checkpoint").awaitTermination()
    return ingest.daily_usage(table.read())


# -- text of addresses and errors ----------------------------------------------------

_ERRORS = """SELECT event_id AS id, 'https://hooks.example.org/open-apis/bot/v2/hook/k' || CAST(event_id AS STRING) || '?x=1&key=abc' || CAST(event_id AS STRING) || '&sign=zz' AS url FROM events"""


@query(
    "address_texts",
    f"SELECT id, 'hooks.example.org/...' AS masked, 'POST https://hooks.example.org/open-apis/bot/v2/hook/[redacted]?x=1&key=[redacted]&sign=[redacted] failed' AS error, 'a &lt;b&gt; &amp; c ' || id AS escaped FROM ({_ERRORS})",
)
def _(spark, d):
    rows = _sql(spark, d, _ERRORS)
    error = F.concat(F.lit("POST "), F.col("url"), F.lit(" failed"))
    escaped = text.message_escape(F.concat(F.lit("a <b> & c\r\n"), F.col("id").cast("string")))
    return rows.select("id", text.masked_url(F.col("url")).alias("masked"), text.redacted_error(error).alias("error"), escaped.alias("escaped"))
