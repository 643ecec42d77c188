"""Rendered text: amounts, shares, cards and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions import scalars, text
from meterlake.operators import migrations
from meterlake.plans.registry import END, START, USER, query
from meterlake.sources.facade import ctes, view

_INT = "ltrim(format('{:,}', CAST(x AS BIGINT)))"
#: Numbers of every size, by powers of ten.
_NUMBERS = "SELECT event_id AS id, CAST(event_id AS BIGINT) * CAST(power(10, event_id % 13) AS BIGINT) * CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END AS x FROM events"


def _decimal(x: str, grouped: bool = True) -> str:
    """At most two decimals, no trailing zeros."""
    value = f"CAST(round(CAST({x} AS DECIMAL(30, 6)), 2) AS DECIMAL(30, 2))"
    return f"regexp_replace(format('{{:{',' if grouped else ''}}}', CAST(trunc({value}) AS BIGINT)) || substr(CAST({value} - trunc({value}) AS VARCHAR), 2), '\\.?0+$', '')"


_COMPACT = f"""CASE WHEN x < 0 THEN '-' ELSE '' END || CASE WHEN a >= 1000000000000000 OR floor(a / 1e12 * 100 + 0.5) / 100 >= 1000 THEN {_decimal('a / 1e15')} || 'P' WHEN a >= 1000000000000 OR floor(a / 1e9 * 100 + 0.5) / 100 >= 1000 THEN {_decimal('a / 1e12')} || 'T'
  WHEN a >= 1000000000 OR floor(a / 1e6 * 100 + 0.5) / 100 >= 1000 THEN {_decimal('a / 1e9')} || 'B' ELSE {_decimal('a / 1e6')} || 'M' END"""
_MAGNITUDE = f"""CASE WHEN x < 0 THEN '-' ELSE '' END || CASE WHEN a >= 10000000000000000 THEN {_decimal('a / 1e16', False)} || '京' WHEN a >= 1000000000000 THEN {_decimal('a / 1e12', False)} || '万亿' WHEN a >= 100000000 THEN {_decimal('a / 1e8', False)} || '亿' ELSE {_decimal('a / 1e4', False)} || '万' END"""


def _numbers(spark, d):
    spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("facade_events")
    return spark.sql(_NUMBERS.replace("FROM events", "FROM facade_events"))


@query("metric_text", f"WITH n AS (SELECT *, abs(x) AS a FROM ({_NUMBERS})) SELECT id, CASE WHEN a >= 1000000 THEN {_COMPACT} ELSE {_INT} END AS value, {_INT} AS exact, CASE WHEN a >= 1000000 THEN {_MAGNITUDE} END AS detail FROM n")
def _(spark, d):
    return _numbers(spark, d).select("id", text.metric_text(F.col("x")).alias("m")).select("id", "m.*")


_USD = "CASE WHEN cost_micros < 0 THEN '-' ELSE '' END || '$' || format('{:,}', cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0')"


@query(
    "usd_text",
    ctes("usage") + f", c AS (SELECT user_id, CAST(SUM(cost_micros) * 1000 AS BIGINT) AS cost_micros FROM usage GROUP BY 1), e AS (SELECT *, abs(cost_micros) // 10000 + CASE WHEN abs(cost_micros) % 10000 >= 5000 THEN 1 ELSE 0 END AS cents FROM c) SELECT user_id, {_USD} AS cost FROM e",
)
def _(spark, d):
    costs = view(spark, d, "usage").groupBy("user_id").agg((F.sum("cost_micros") * 1000).alias("m"))
    return costs.select("user_id", text.usd_text(scalars.cost_usd("m")).alias("cost"))


@query(
    "percent_text",
    ctes("summarized") + """, r AS (SELECT user_id, usage_date, source, model, cache_read_tokens / CAST(NULLIF(total_tokens, 0) * CASE WHEN session_count % 2 = 0 THEN 1 ELSE 20 END AS DOUBLE) AS x FROM summarized)
    SELECT user_id, usage_date, source, model, CASE WHEN x > 0 AND x < 0.01 THEN CAST(CAST(floor(x * 1000 + 0.5) / 10 AS DECIMAL(4, 1)) AS VARCHAR) ELSE CAST(CAST(floor(COALESCE(x, 0) * 100 + 0.5) AS BIGINT) AS VARCHAR) END || '%' AS rate FROM r""",
)
def _(spark, d):
    rows = view(spark, d, "summarized")
    share = F.col("cache_read_tokens") / (F.nullif(F.col("total_tokens"), F.lit(0)) * F.when(F.col("session_count") % 2 == 0, 1).otherwise(20))
    return rows.select("user_id", "usage_date", "source", "model", scalars.percent_text(F.coalesce(share, F.lit(0.0))).alias("rate"))


@query(
    "trend_shares",
    ctes("deduped") + f""", t AS (SELECT usage_date, CAST(SUM(total_tokens) AS BIGINT) AS v FROM deduped WHERE user_id = '{USER}' AND usage_date BETWEEN '{START}' AND '{END}' GROUP BY 1),
    w AS (SELECT *, MAX(v) OVER () AS most, SUM(v) OVER () AS total FROM t) SELECT usage_date, v AS total_tokens, CAST(floor(v / CAST(total AS DOUBLE) * 100 + 0.5) AS BIGINT) || '%' AS share,
      CAST(CASE WHEN v <= 0 THEN 2 ELSE greatest(8, floor(v / CAST(most AS DOUBLE) * 100 + 0.5)) END AS BIGINT) AS height, CAST(CASE WHEN v <= 0 THEN 0 ELSE least(100, greatest(8, floor(v / CAST(total AS DOUBLE) * 100 + 0.5))) END AS BIGINT) AS width FROM w""",
)
def _(spark, d):
    from meterlake.plans import serving

    return serving.trend_shares(serving.details_base(view(spark, d, "usage"), USER, START, END))


_PICKS = """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'totalCost,totalCost,monthTokens' WHEN 1 THEN 'todayCost,todayTokens,monthCost,monthTokens,totalCost,totalTokens,todayCost' WHEN 2 THEN 'totalCost,nothing' END AS picks,
  CASE event_id % 3 WHEN 0 THEN 'compact' WHEN 1 THEN 'wide' ELSE 'balanced' END AS layout FROM events"""


@query(
    "card_metrics",
    f"""SELECT id, layout, array_to_string(list_slice(m, 1, CASE layout WHEN 'compact' THEN 6 WHEN 'wide' THEN 3 ELSE 4 END), ',') AS shown FROM (SELECT *, CASE id % 4 WHEN 0 THEN ['totalCost', 'monthTokens']
      WHEN 1 THEN ['todayCost', 'todayTokens', 'monthCost', 'monthTokens', 'totalCost', 'totalTokens'] ELSE ['totalTokens', 'totalCost', 'monthTokens', 'monthCost'] END AS m FROM ({_PICKS}))""",
)
def _(spark, d):
    spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("facade_events")
    rows = spark.sql(_PICKS.replace("FROM events", "FROM facade_events"))
    chosen = text.chosen_metrics(F.when(F.col("picks").isNotNull(), F.split("picks", ",")))
    return rows.select("id", "layout", F.array_join(F.slice(chosen, F.lit(1), text.slot_count(F.col("layout"))), ",").alias("shown"))


@query("card_svg")
def _(spark, d):
    profiles = view(spark, d, "profiles").filter("is_public")
    totals = view(spark, d, "totals")
    rows = profiles.join(totals, "user_id")
    values = F.create_map(F.lit("totalTokens"), text.metric_text(F.col("total_tokens"))["value"], F.lit("totalCost"), text.usd_text(scalars.cost_usd("cost_micros")))
    layout = F.when(F.col("participates"), "wide").otherwise("balanced")
    return rows.select("slug", text.card(F.col("display_name"), text.chosen_metrics(F.array(F.lit("totalTokens"), F.lit("totalCost"))), values, layout).alias("svg"))


@query(
    "report_messages",
    ctes("deduped", "profiles") + f""", b AS (SELECT * FROM deduped WHERE usage_date = '2024-01-20'), p AS (SELECT * FROM profiles),
    s AS (SELECT user_id, source, SUM(total_tokens) AS t, SUM(total_tokens - cache_read_tokens) AS n, SUM(cost_micros) AS c FROM b GROUP BY 1, 2), m AS (SELECT user_id, model, SUM(total_tokens) AS t, SUM(total_tokens - cache_read_tokens) AS n, SUM(cost_micros) AS c FROM b GROUP BY 1, 2),
    u AS (SELECT user_id, SUM(total_tokens) AS t, SUM(total_tokens - cache_read_tokens) AS n, SUM(cost_micros) AS c, SUM(session_count) AS k FROM b GROUP BY 1),
    sl AS (SELECT user_id, string_agg('- ' || CASE source WHEN 'codex' THEN 'Codex' ELSE 'Claude Code' END || ': ' || LINE, chr(10) ORDER BY n DESC, t DESC, source) AS l FROM s GROUP BY 1), ml AS (SELECT user_id, string_agg('- ' || model || ': ' || LINE, chr(10) ORDER BY n DESC, t DESC, model) AS l FROM m GROUP BY 1)
    SELECT u.user_id, concat_ws(chr(10), '## ' || p.display_name || ' daily usage', '2024-01-20 / ' || p.timezone, '', 'Tokens: ' || INT(t) || ', ' || INT(n) || ' without cache reads', 'Cache rate: ' || RATE || ', Cost: ' || COST || ', Sessions: ' || k, '',
      '**Sources**', sl.l, '', '**Models**', ml.l, '', '[Open report](/reports/' || u.user_id || ')') AS message FROM u JOIN p ON p.user_id = u.user_id JOIN sl ON sl.user_id = u.user_id JOIN ml ON ml.user_id = u.user_id"""
    .replace("LINE", "INT(n) || ' (tokens ' || INT(t) || ', ' || RATE || ', ' || COST || ')'").replace("INT(t)", "format('{:,}', CAST(t AS BIGINT))").replace("INT(n)", "format('{:,}', CAST(n AS BIGINT))")
    .replace("RATE", "(CASE WHEN t > 0 AND n < t AND (t - n) / CAST(t AS DOUBLE) < 0.01 THEN CAST(CAST(floor((t - n) / CAST(t AS DOUBLE) * 1000 + 0.5) / 10 AS DECIMAL(4, 1)) AS VARCHAR) WHEN t > 0 THEN CAST(CAST(floor((t - n) / CAST(t AS DOUBLE) * 100 + 0.5) AS BIGINT) AS VARCHAR) ELSE '0' END || '%')")
    .replace("COST", "('$' || format('{:,}', CAST((c + 5000) // 10000 // 100 AS BIGINT)) || '.' || lpad(CAST(CAST((c + 5000) // 10000 % 100 AS BIGINT) AS VARCHAR), 2, '0'))"),
)
def _(spark, d):
    from meterlake.plans import serving

    rows = serving.report_rows(view(spark, d, "usage"), view(spark, d, "profiles"), "2024-01-20")
    return rows.withColumn("url", F.concat(F.lit("/reports/"), F.col("user_id"))).select("user_id", text.report_message(count_text=lambda n: n.cast("string")).alias("message"))


# -- one-off rewrites ----------------------------------------------------------------


@query("rewrite_device_column", ctes("usage") + " SELECT user_id, 'legacy' AS device_id, source, usage_date, model, total_tokens FROM usage")
def _(spark, d):
    return migrations.with_device(view(spark, d, "usage").drop("device_id")).select("user_id", "device_id", "source", "usage_date", "model", "total_tokens")


@query("rewrite_visibility", ctes("profiles") + " SELECT user_id, is_public OR participates OR updated_at = '2024-01-08T00:00:00.000Z' AS is_public, participates OR (NOT is_public AND updated_at = '2024-01-08T00:00:00.000Z') AS participates FROM profiles")
def _(spark, d):
    rows = view(spark, d, "profiles").withColumn("created_at", F.lit("2024-01-08T00:00:00.000Z"))
    return migrations.visible(rows, "2024-02-01").select("user_id", "is_public", "participates")


@query("rewrite_zone_source", ctes("profiles") + " SELECT user_id, CASE WHEN timezone = 'UTC' THEN 'default' ELSE 'user' END AS added, 'user' AS kept FROM profiles")
def _(spark, d):
    rows = migrations.with_zone_source(view(spark, d, "profiles").drop("timezone_source"))
    return rows.select("user_id", F.col("timezone_source").alias("added")).join(migrations.zone_kept(rows).select("user_id", F.col("timezone_source").alias("kept")), "user_id")


@query(
    "rewrite_pending_slots",
    ctes("subscriptions") + """ SELECT id, CASE WHEN pending_report_date IS NOT NULL AND pending_schedule_slot IS NULL THEN pending_report_date || 'T' || COALESCE(nullif(schedule_time_local, ''), nullif(split_part(schedule_times_local, ',', 1), ''), '18:00')
      ELSE pending_schedule_slot END AS pending_schedule_slot FROM subscriptions""",
)
def _(spark, d):
    return migrations.with_pending_slots(view(spark, d, "subscriptions")).select("id", "pending_schedule_slot")


@query("rewrite_log_slots", ctes("subscriptions", "deliveries") + " SELECT l.ordinal, CASE WHEN kind = 'daily' THEN l.report_date || 'T' || COALESCE(s.schedule_time_local, '18:00') END AS schedule_slot FROM deliveries l LEFT JOIN subscriptions s ON s.id = l.subscription_id")
def _(spark, d):
    log = view(spark, d, "deliveries").withColumn("schedule_slot", F.lit(None).cast("string"))
    return migrations.with_log_slots(log, view(spark, d, "subscriptions")).select("ordinal", "schedule_slot")
