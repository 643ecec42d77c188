"""Every query by name, over the facade, with its statement for DuckDB."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.scalars import local_date, report_date
from meterlake.operators import caches, correction, delivery, facts
from meterlake.operators.facts import Scope
from meterlake.plans import serving
from meterlake.plans.registry import END, MONTH, ORACLE, QUERIES, START, TODAY, USER, query, tables  # noqa: F401
from meterlake.schema import LOGICAL, SOURCES
from meterlake.sources import reports, session_logs
from meterlake.sources.facade import ctes, view

def done(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("completed", "2024-01-21T00:00:00.000Z")], "phase string, completed_at string")


EFFECTIVE = """effective AS (
  SELECT * FROM summary UNION ALL
  SELECT d.* FROM summarized d WHERE NOT EXISTS (SELECT 1 FROM summary s WHERE s.user_id = d.user_id AND s.usage_date = d.usage_date AND s.source = d.source AND s.model = d.model))"""
BASE = ctes("deduped", "summary") + ",\n" + EFFECTIVE
RATE = "CASE WHEN {p}total_tokens > 0 THEN greatest(0, {p}total_tokens - {p}tokens_without_cache_read) / CAST({p}total_tokens AS DOUBLE) ELSE 0.0 END"
SUM3 = "CAST(COALESCE(SUM(total_tokens), 0) AS BIGINT) AS total_tokens, CAST(COALESCE(SUM(tokens_without_cache_read), 0) AS BIGINT) AS tokens_without_cache_read, CAST(COALESCE(SUM(cost_micros), 0) AS BIGINT) AS cost_micros"
SUMMARY_COLUMNS = "user_id, usage_date, source, model, timezone, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, total_tokens, tokens_without_cache_read, cost_micros, session_count, updated_at"


def rate(p: str = "") -> str:
    return RATE.replace("{p}", p)


def json_list(key: str, rows: str, limit: int | None = None) -> str:
    """The ordered JSON list of :func:`serving.ordered_json`."""
    top = f"LIMIT {limit}" if limit else ""
    return (
        f"(SELECT '[' || COALESCE(string_agg('{{\"{key}\":\"' || {key} || '\",\"tokens\":' || total_tokens || ',\"net\":' || tokens_without_cache_read || '}}', ',' "
        f"ORDER BY tokens_without_cache_read DESC, total_tokens DESC, {key}), '') || ']' FROM (SELECT * FROM (SELECT {key}, {SUM3} FROM {rows} GROUP BY {key}) "
        f"ORDER BY tokens_without_cache_read DESC, total_tokens DESC, {key} {top}))"
    )


# -- facts ---------------------------------------------------------------------------

for _name, _fn in (("dedupe_legacy", facts.dedupe_legacy), ("dedupe_legacy_anti", facts.dedupe_legacy_anti)):
    query(_name, ctes("deduped") + " SELECT * FROM deduped")(lambda spark, d, fn=_fn: fn(view(spark, d, "usage")))


@query("fallback_summary", BASE + f" SELECT {SUMMARY_COLUMNS} FROM summarized d WHERE NOT EXISTS (SELECT 1 FROM summary s WHERE s.user_id = d.user_id AND s.usage_date = d.usage_date AND s.source = d.source AND s.model = d.model)")
def _(spark, d):
    return facts.fallback_summary(*tables(spark, d, "usage", "summary"))


@query("effective_summary", BASE + f" SELECT {SUMMARY_COLUMNS} FROM effective WHERE usage_date >= '2024-01-05' AND usage_date < '2024-01-25'")
def _(spark, d):
    return facts.effective_summary(*tables(spark, d, "usage", "summary"), Scope(start="2024-01-05", before="2024-01-25"))


@query("effective_summary_strict", BASE + f" SELECT {SUMMARY_COLUMNS} FROM summary")
def _(spark, d):
    return facts.effective_summary(*tables(spark, d, "usage", "summary"), strict=True)


@query(
    "legacy_exact_purge",
    ctes("usage") + """, o AS (SELECT user_id, usage_date, source, model, SUM(input_tokens) i, SUM(output_tokens) o, SUM(cache_creation_tokens) cc, SUM(cache_read_tokens) cr,
      SUM(total_tokens) t, SUM(session_count) s, SUM(cost_micros) c FROM usage WHERE device_id <> 'legacy' GROUP BY ALL)
    SELECT u.* FROM usage u WHERE NOT (u.device_id = 'legacy' AND EXISTS (SELECT 1 FROM o WHERE o.user_id = u.user_id AND o.usage_date = u.usage_date AND o.source = u.source AND o.model = u.model
      AND o.i = u.input_tokens AND o.o = u.output_tokens AND o.cc = u.cache_creation_tokens AND o.cr = u.cache_read_tokens AND o.t = u.total_tokens AND o.s = u.session_count AND abs(o.c - u.cost_micros) < 1))""",
)
def _(spark, d):
    return facts.legacy_exact_purge(view(spark, d, "usage"))


# -- serving -------------------------------------------------------------------------

_MONTH = f"m AS (SELECT * FROM effective WHERE user_id = '{USER}' AND usage_date >= '{MONTH}')"


@query(
    "dashboard_summary",
    BASE + f""", {_MONTH}, f AS (SELECT '{USER}' AS user_id,
      CAST(COALESCE(SUM(CASE WHEN usage_date = '{TODAY}' THEN total_tokens ELSE 0 END), 0) AS BIGINT) AS today_total_tokens,
      CAST(COALESCE(SUM(CASE WHEN usage_date = '{TODAY}' THEN tokens_without_cache_read ELSE 0 END), 0) AS BIGINT) AS today_tokens_without_cache_read,
      CAST(COALESCE(SUM(total_tokens), 0) AS BIGINT) AS month_total_tokens, CAST(COALESCE(SUM(tokens_without_cache_read), 0) AS BIGINT) AS month_tokens_without_cache_read,
      COALESCE(SUM(CASE WHEN usage_date = '{TODAY}' THEN cost_micros ELSE 0 END), 0) AS tc, COALESCE(SUM(cost_micros), 0) AS mc FROM m),
    v AS ({ctes('devices').removeprefix('WITH devices AS (').removesuffix(')')})
    SELECT user_id, today_total_tokens, today_tokens_without_cache_read, month_total_tokens, month_tokens_without_cache_read,
      {rate('today_')} AS today_cache_rate, {rate('month_')} AS month_cache_rate, CAST(tc AS DOUBLE) / 1000000.0 AS today_cost_usd, CAST(mc AS DOUBLE) / 1000000.0 AS month_cost_usd,
      (SELECT MAX(last_synced_at) FROM v WHERE user_id = '{USER}') AS last_synced_at, (SELECT COUNT(*) FROM v WHERE user_id = '{USER}') AS device_count, {json_list('source', 'm')} AS source_split FROM f""",
)
def _(spark, d):
    return serving.dashboard_summary(*tables(spark, d, "usage", "summary", "devices"), USER, TODAY)


@query(
    "daily_trend",
    BASE + f""", t AS (SELECT usage_date, {SUM3} FROM effective WHERE user_id = '{USER}' AND usage_date BETWEEN '{START}' AND '{END}' GROUP BY usage_date),
    s AS (SELECT CAST(CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS STRING) AS usage_date),
    j AS (SELECT s.usage_date, COALESCE(total_tokens, 0) AS total_tokens, COALESCE(tokens_without_cache_read, 0) AS tokens_without_cache_read, COALESCE(cost_micros, 0) AS c FROM s LEFT JOIN t ON s.usage_date = t.usage_date)
    SELECT usage_date, total_tokens, tokens_without_cache_read, {rate()} AS cache_rate, CAST(c AS DOUBLE) / 1000000.0 AS cost_usd FROM j""",
)
def _(spark, d):
    return serving.daily_trend(*tables(spark, d, "usage", "summary"), USER, START, END)


def _details(where: str = "", source: str = "deduped") -> str:
    return ctes("deduped") + f", b AS (SELECT *, total_tokens - cache_read_tokens AS tokens_without_cache_read FROM {source} WHERE user_id = '{USER}' AND usage_date BETWEEN '{START}' AND '{END}' {where})"


_ALL = (
    "CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, CAST(SUM(output_tokens) AS BIGINT) AS output_tokens, CAST(SUM(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens, "
    "CAST(SUM(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(SUM(session_count) AS BIGINT) AS session_count"
)
_MODELS = (
    f" SELECT usage_date, source, model, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, total_tokens, tokens_without_cache_read, session_count, {rate()} AS cache_rate, "
    f"CAST(cost_micros AS DOUBLE) / 1000000.0 AS cost_usd FROM (SELECT usage_date, source, model, {_ALL}, {SUM3} FROM b GROUP BY 1, 2, 3)"
)


@query("details_daily_source", _details() + f" SELECT usage_date, source, total_tokens, tokens_without_cache_read, session_count, {rate()} AS cache_rate, CAST(cost_micros AS DOUBLE) / 1000000.0 AS cost_usd FROM (SELECT usage_date, source, {_ALL}, {SUM3} FROM b GROUP BY 1, 2)")
def _(spark, d):
    return serving.details_daily_source(serving.details_base(view(spark, d, "usage"), USER, START, END))


@query("details_models", _details() + _MODELS)
def _(spark, d):
    return serving.details_models(serving.details_base(view(spark, d, "usage"), USER, START, END))


@query("details_single_device", _details("AND device_id = 'legacy'", "usage") + _MODELS)
def _(spark, d):
    return serving.details_models(serving.details_base(view(spark, d, "usage"), USER, START, END, device="legacy"))


@query("details_model_like", _details("AND lower(model) LIKE '%el_b%' AND source = 'codex'") + _MODELS)
def _(spark, d):
    return serving.details_models(serving.details_base(view(spark, d, "usage"), USER, END, START, source="codex", model=" EL_B "))


_DAYS = (
    _details() + f""", ms AS (SELECT usage_date, source, model, {_ALL}, {SUM3} FROM b GROUP BY 1, 2, 3),
    ss AS (SELECT usage_date, source, CAST(SUM(session_count) AS BIGINT) AS session_count, {SUM3} FROM ms GROUP BY 1, 2),
    dd AS (SELECT usage_date, CAST(SUM(session_count) AS BIGINT) AS session_count, {SUM3}, list_reduce(list_prepend(0.0::DOUBLE, list(CAST(cost_micros AS DOUBLE) / 1000000.0 ORDER BY source)), lambda a, c: floor((a + c) * 10000 + 0.5) / 10000) AS cost_usd FROM ss GROUP BY 1),
    cal AS (SELECT CAST(CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS STRING) AS usage_date)"""
)


@query(
    "details_range_summary",
    _DAYS + f""", h AS (SELECT CAST(COUNT(CASE WHEN total_tokens > 0 THEN 1 END) AS BIGINT) AS active_days, CAST(COALESCE(SUM(session_count), 0) AS BIGINT) AS session_count, COALESCE(SUM(cost_usd), 0) AS cost,
      CAST(COALESCE(SUM(total_tokens), 0) AS BIGINT) AS total_tokens, CAST(COALESCE(SUM(tokens_without_cache_read), 0) AS BIGINT) AS tokens_without_cache_read FROM dd)
    SELECT total_tokens, tokens_without_cache_read, {rate()} AS cache_rate, floor(cost * 10000 + 0.5) / 10000 AS cost_usd, session_count, active_days FROM h""",
)
def _(spark, d):
    return serving.details_range_summary(serving.details_base(view(spark, d, "usage"), USER, START, END))


@query(
    "details_days_nested",
    _DAYS + f""" SELECT usage_date, COALESCE(total_tokens, 0) AS total_tokens, COALESCE(tokens_without_cache_read, 0) AS tokens_without_cache_read, COALESCE(session_count, 0) AS session_count,
      COALESCE({rate()}, 0.0) AS cache_rate, COALESCE(cost_usd, 0.0) AS cost_usd, (SELECT COUNT(*) FROM ss WHERE ss.usage_date = cal.usage_date) AS n_sources, (SELECT COUNT(*) FROM ms WHERE ms.usage_date = cal.usage_date) AS n_models
    FROM cal LEFT JOIN dd USING (usage_date)""",
)
def _(spark, d):
    found = serving.details_days(serving.details_base(view(spark, d, "usage"), USER, START, END), START, END)
    return found.withColumns({f"n_{c}": F.size(c).cast("bigint") for c in ("sources", "models")}).drop("sources", "models")


@query("details_day_sources", _DAYS + f" SELECT usage_date, CAST(row_number() OVER (PARTITION BY usage_date ORDER BY source) - 1 AS INT) AS position, source, total_tokens, tokens_without_cache_read, {rate()} AS cache_rate FROM ss")
def _(spark, d):
    return serving.details_day_sources(serving.details_base(view(spark, d, "usage"), USER, START, END), START, END)


@query(
    "details_day_models",
    _DAYS + f""" SELECT usage_date, CAST(row_number() OVER (PARTITION BY usage_date ORDER BY total_tokens DESC, model, source) - 1 AS INT) AS position, model, source, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, total_tokens,
      tokens_without_cache_read, session_count, {rate()} AS cache_rate, CAST(cost_micros AS DOUBLE) / 1000000.0 AS cost_usd FROM ms""",
)
def _(spark, d):
    return serving.details_day_models(serving.details_base(view(spark, d, "usage"), USER, START, END), START, END)


_FILTERED = ctes("deduped") + f", b AS (SELECT *, total_tokens - cache_read_tokens AS tokens_without_cache_read FROM deduped WHERE user_id = '{USER}' AND usage_date BETWEEN '2024-01-02' AND '2024-01-31')"


@query("details_default_filters", _FILTERED + _MODELS)
def _(spark, d):
    """No dates, an unknown source, a blank device and model: the last 30 days of everything."""
    filters = serving.parse_filters({"source": "other", "start": "1/2/2024", "device": " ", "model": "  "}, date(2024, 1, 31))
    return serving.details_models(serving.details_base(view(spark, d, "usage"), USER, **filters))


_NUMBER = "CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS STRING) ELSE CAST({x} AS STRING) END"
_LINES = (
    _details() + f", m AS ({_MODELS}), l AS (SELECT CAST(0 AS INT) AS position, 'date,source,model,input_tokens,output_tokens,cache_creation_tokens,cache_read_tokens,cache_read_rate,total_tokens_without_cache_read,total_tokens,cost_usd,session_count' AS line "
    "UNION ALL SELECT CAST(row_number() OVER (ORDER BY usage_date DESC, total_tokens DESC, model, source) AS INT), concat_ws(',', usage_date, source, model, CAST(input_tokens AS STRING), CAST(output_tokens AS STRING), CAST(cache_creation_tokens AS STRING), CAST(cache_read_tokens AS STRING), "
    f"{_NUMBER.replace('{x}', 'cache_rate')}, CAST(tokens_without_cache_read AS STRING), CAST(total_tokens AS STRING), {_NUMBER.replace('{x}', 'cost_usd')}, CAST(session_count AS STRING)) FROM m)"
)


@query("details_csv", _LINES + " SELECT * FROM l")
def _(spark, d):
    return serving.details_csv_rows(serving.details_models(serving.details_base(view(spark, d, "usage"), USER, START, END)))


@query("details_csv_document", _LINES + " SELECT string_agg(line, chr(10) ORDER BY position) AS document FROM l")
def _(spark, d):
    return serving.details_csv_document(serving.details_models(serving.details_base(view(spark, d, "usage"), USER, START, END)))


def _board(where: str, first: str, then: str) -> str:
    return (
        ctes("deduped", "summary", "profiles") + ",\n" + EFFECTIVE
        + f", u AS (SELECT p.slug, p.display_name, {SUM3} FROM effective e JOIN profiles p ON p.user_id = e.user_id WHERE p.is_public AND p.participates AND {where} GROUP BY 1, 2) "
        f"SELECT CAST(row_number() OVER (ORDER BY {first} DESC, {then} DESC, slug) AS INT) AS rank, slug, display_name, total_tokens, tokens_without_cache_read, {rate()} AS cache_rate, CAST(cost_micros AS DOUBLE) / 1000000.0 AS cost_usd "
        f"FROM u ORDER BY rank LIMIT 50"
    )


_BOARDS = {
    "leaderboard_daily_tokens": (Scope(on=TODAY), "tokens", f"usage_date = '{TODAY}'", "total_tokens", "cost_micros"),
    "leaderboard_monthly_cost": (Scope(start=MONTH, before="2024-02-01"), "cost", f"usage_date >= '{MONTH}' AND usage_date < '2024-02-01'", "cost_micros", "total_tokens"),
    "leaderboard_monthly_nocache": (Scope(start=MONTH, before="2024-02-01"), "net", f"usage_date >= '{MONTH}' AND usage_date < '2024-02-01'", "tokens_without_cache_read", "total_tokens DESC, cost_micros"),
}
for _name, (_scope, _metric, _where, _first, _then) in _BOARDS.items():
    query(_name, _board(_where, _first, _then))(lambda spark, d, s=_scope, m=_metric: serving.leaderboard(*tables(spark, d, "profiles", "usage", "summary"), s, m))

_WHOLE = (
    ctes("deduped", "summary", "totals") + ",\n" + EFFECTIVE
    + f", x AS (SELECT user_id, {SUM3}, MAX(updated_at) AS latest FROM effective GROUP BY user_id), w AS (SELECT COALESCE(x.user_id, t.user_id) AS user_id, "
    + ", ".join(f"CASE WHEN t.updated_at IS NOT NULL AND (x.latest IS NULL OR x.latest <= t.updated_at) THEN t.{c} ELSE x.{c} END AS {c}" for c in ("total_tokens", "tokens_without_cache_read", "cost_micros"))
    + " FROM x FULL JOIN totals t ON x.user_id = t.user_id)"
)


@query("effective_totals", _WHOLE + " SELECT * FROM w")
def _(spark, d):
    return serving.effective_totals(*tables(spark, d, "usage", "summary", "totals"))


def _public(user: str, breakdown: bool) -> str:
    parts = [f"'{user}' AS user_id"]
    for p, test in (("lifetime", None), ("today", f"CASE WHEN usage_date = '{TODAY}' THEN {{c}} ELSE 0 END"), ("month", "{c}")):
        for c in ("total_tokens", "tokens_without_cache_read", "cost_micros"):
            parts.append(f"(SELECT CAST(COALESCE({'MAX' if test is None else 'SUM'}({(test or '{c}').format(c=c)}), 0) AS BIGINT) FROM {'w WHERE user_id = ' + chr(39) + user + chr(39) if test is None else 'm'}) AS {p}_{c}")
    split = f", {json_list('source', 'm')} AS source_split, {json_list('model', 'm', 5)} AS top_models" if breakdown else ""
    tail = ", source_split, top_models" if breakdown else ""
    columns = ", ".join(f"{p}_total_tokens, {p}_tokens_without_cache_read, CAST({p}_cost_micros AS DOUBLE) / 1000000.0 AS {p}_cost_usd" for p in ("lifetime", "today", "month"))
    return _WHOLE + f", m AS (SELECT * FROM effective WHERE user_id = '{user}' AND usage_date >= '{MONTH}'), z AS (SELECT {', '.join(parts)}{split}) SELECT user_id, {columns}, {rate('lifetime_')} AS lifetime_cache_rate{tail} FROM z"


for _name, _user, _all in (("public_totals", "u7", True), ("public_totals_fresh", "u8", True), ("public_totals_card", "u7", False)):
    query(_name, _public(_user, _all))(lambda spark, d, u=_user, b=_all: serving.public_totals(*tables(spark, d, "usage", "summary", "totals"), u, TODAY, breakdown=b))


@query(
    "public_subject_version",
    ctes("summary", "totals", "profiles") + " SELECT p.slug, greatest(p.updated_at, COALESCE(t.updated_at, ''), COALESCE((SELECT MAX(updated_at) FROM summary s WHERE s.user_id = p.user_id), '')) AS version "
    "FROM profiles p LEFT JOIN totals t ON t.user_id = p.user_id WHERE p.is_public",
)
def _(spark, d):
    return serving.subject_version(*tables(spark, d, "profiles", "summary", "totals"))


def _profile(user: str) -> str:
    """The figures of :func:`_public` beside the profile's columns."""
    parts = [f"{p}_total_tokens AS {p}_tokens, {p}_tokens_without_cache_read AS {p}_net, {rate(p + '_')} AS {p}_rate, CAST({p}_cost_micros AS DOUBLE) / 1000000.0 AS {p}_cost" for p in ("lifetime", "today", "month")]
    return _public(user, True).replace("SELECT user_id, lifetime_total_tokens", f"SELECT {', '.join(parts)}, user_id, lifetime_total_tokens")


_FIGURES = ", ".join(f"{p}_{c}" for p in ("lifetime", "today", "month") for c in ("tokens", "net", "rate", "cost"))


def _with_profile(slug: str, user: str, columns: str) -> str:
    return f"SELECT {columns} FROM ({_profile(user)}) f JOIN ({ctes('profiles')} SELECT user_id, slug, display_name, timezone FROM profiles WHERE slug = '{slug}' AND is_public) p ON p.user_id = f.user_id"


for _name, _slug, _user in (("public_profile", "user-7", "u7"), ("public_profile_fresh", "user-8", "u8"), ("public_profile_private", "user-5", "u5")):

    @query(_name, _with_profile(_slug, _user, f"slug, display_name, timezone, {_FIGURES}, source_split, top_models"))
    def _(spark, d, slug=_slug):
        found = serving.public_profile(*tables(spark, d, "profiles", "usage", "summary", "totals"), slug, TODAY)
        figures = [F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("lifetime", "today", "month") for c in ("tokens", "net", "rate", "cost")]
        return found.select("slug", "display_name", "timezone", *figures, "source_split", "top_models")


def _object(p: str) -> str:
    return f"json_object('tokens', {p}_tokens, 'tokensWithoutCacheRead', {p}_net, 'cacheReadRate', {p}_rate, 'costUsd', {p}_cost)"


@query(
    "public_document",
    _with_profile("user-7", "u7", f"slug, CAST(json_object('slug', slug, 'displayName', display_name, 'timezone', timezone, 'total', {_object('lifetime')}, 'today', {_object('today')}, 'month', {_object('month')}, 'sourceSplit', CAST(source_split AS JSON), 'topModels', CAST(top_models AS JSON)) AS STRING) AS document"),
)
def _(spark, d):
    return serving.public_document(serving.public_profile(*tables(spark, d, "profiles", "usage", "summary", "totals"), "user-7", TODAY))


@query(
    "daily_report",
    BASE + f", m AS (SELECT * FROM effective WHERE user_id = '{USER}' AND usage_date = '2024-01-12'), f AS (SELECT {SUM3}, CAST(COALESCE(SUM(session_count), 0) AS BIGINT) AS session_count FROM m) "
    f"SELECT '{USER}' AS user_id, '2024-01-12' AS usage_date, total_tokens, tokens_without_cache_read, {rate()} AS cache_rate, CAST(cost_micros AS DOUBLE) / 1000000.0 AS cost_usd, session_count, {json_list('source', 'm')} AS source_split, {json_list('model', 'm', 5)} AS top_models FROM f",
)
def _(spark, d):
    return serving.daily_report(*tables(spark, d, "usage", "summary"), USER, "2024-01-12")


@query(
    "device_list",
    ctes("devices", "tokens") + f" SELECT d.id, d.name, d.platform, d.last_synced_at, d.created_at, (SELECT COUNT(*) FROM tokens t WHERE t.device_id = d.id AND t.user_id = d.user_id AND t.revoked_at IS NULL) AS active_tokens FROM devices d WHERE user_id = '{USER}'",
)
def _(spark, d):
    return serving.device_list(*tables(spark, d, "devices", "tokens"), USER)


# -- caches --------------------------------------------------------------------------

_KEYS = "k AS (SELECT DISTINCT user_id, usage_date, source, model FROM incoming)"
_ON = " AND ".join(f"a.{c} = b.{c}" for c in LOGICAL)
_PHYSICAL_ON = " AND ".join(f"u.{c} = i.{c}" for c in ("user_id", "device_id", "source", "usage_date", "model"))
_DIFF = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in caches.SUMMARY_MEASURES)
_CHANGED = (
    "last AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY user_id, device_id, source, usage_date, model ORDER BY ordinal DESC) = 1), "
    f"changed AS (SELECT i.* FROM last i LEFT JOIN usage u ON {_PHYSICAL_ON} WHERE u.user_id IS NULL OR u.snapshot_hash IS NULL OR u.snapshot_hash <> i.snapshot_hash)"
)


@query("upsert_changed_keys", ctes("usage", "incoming") + f", {_CHANGED} SELECT * FROM changed")
def _(spark, d):
    return caches.changed_rows(*tables(spark, d, "incoming", "usage"))


@query("upsert_usage_state", ctes("usage", "incoming") + f", {_CHANGED} SELECT u.* FROM usage u WHERE NOT EXISTS (SELECT 1 FROM changed i WHERE {_PHYSICAL_ON}) UNION ALL SELECT * EXCLUDE (ordinal) FROM changed")
def _(spark, d):
    return caches.upsert(*tables(spark, d, "incoming", "usage"))


@query(
    "upsert_count",
    ctes("usage", "incoming") + f", r AS (SELECT i.snapshot_hash AS h, COALESCE(lag(i.snapshot_hash) OVER (PARTITION BY i.user_id, i.device_id, i.source, i.usage_date, i.model ORDER BY i.ordinal), u.snapshot_hash) AS b "
    f"FROM incoming i LEFT JOIN usage u ON {_PHYSICAL_ON}) SELECT CAST(SUM(CASE WHEN b IS NULL OR b <> h THEN 1 ELSE 0 END) AS BIGINT) AS upserted, COUNT(*) AS received FROM r",
)
def _(spark, d):
    return caches.upserted_count(*tables(spark, d, "incoming", "usage"))


@query("summary_refresh", ctes("summarized", "incoming") + f", {_KEYS} SELECT {', '.join('b.' + c.strip() for c in SUMMARY_COLUMNS.split(','))} FROM k a JOIN summarized b ON {_ON}")
def _(spark, d):
    return caches.refreshed_summary(*tables(spark, d, "incoming", "usage"))


@query("summary_stale_keys", ctes("summary", "summarized") + f" SELECT a.user_id, a.usage_date, a.source, a.model FROM summarized a LEFT JOIN summary b ON {_ON} WHERE a.usage_date < '2024-01-18' AND (b.user_id IS NULL OR {_DIFF})")
def _(spark, d):
    usage, summary = tables(spark, d, "usage", "summary")
    return caches.stale_summary_keys(usage.filter("usage_date < '2024-01-18'"), usage, summary)


_TOTALS_OF = "x AS (SELECT user_id, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, CAST(SUM(tokens_without_cache_read) AS BIGINT) AS tokens_without_cache_read, CAST(SUM(cost_micros) AS BIGINT) AS cost_micros, CAST(SUM(session_count) AS BIGINT) AS session_count, MAX(updated_at) AS updated_at FROM summary GROUP BY user_id)"


@query("totals_refresh", ctes("summary", "totals") + f", {_TOTALS_OF} SELECT * FROM x UNION ALL SELECT * FROM totals t WHERE t.user_id NOT IN (SELECT user_id FROM x)")
def _(spark, d):
    usage, summary, totals = tables(spark, d, "usage", "summary", "totals")
    return caches.merged_totals(usage, summary, totals, done(spark))


@query("totals_stale_users", ctes("summary", "totals") + f", {_TOTALS_OF} SELECT x.user_id FROM x LEFT JOIN totals t ON x.user_id = t.user_id WHERE t.user_id IS NULL OR x.total_tokens <> t.total_tokens OR x.tokens_without_cache_read <> t.tokens_without_cache_read OR x.cost_micros <> t.cost_micros OR x.session_count <> t.session_count")
def _(spark, d):
    usage, summary, totals = tables(spark, d, "usage", "summary", "totals")
    return caches.stale_totals_users(usage, summary, totals, done(spark))


@query("totals_gate_shut", ctes("summary") + " SELECT user_id FROM summary WHERE false")
def _(spark, d):
    usage, summary, totals = tables(spark, d, "usage", "summary", "totals")
    return caches.stale_totals_users(usage, summary, totals, spark.createDataFrame([("summaries", None)], "phase string, completed_at string"))


@query(
    "existing_hash_check",
    ctes("summary", "summarized", "totals") + f", {_TOTALS_OF}, stale AS (SELECT a.* FROM summarized a LEFT JOIN summary b ON {_ON} WHERE b.user_id IS NULL OR {_DIFF}) "
    "SELECT u.source, u.usage_date, u.model, u.snapshot_hash FROM usage u WHERE u.user_id = 'u8' AND u.device_id = 'dev_1' AND NOT EXISTS (SELECT 1 FROM stale s WHERE s.user_id = u.user_id AND s.usage_date = u.usage_date AND s.source = u.source AND s.model = u.model) "
    "AND EXISTS (SELECT 1 FROM x JOIN totals t ON x.user_id = t.user_id WHERE x.user_id = 'u8' AND x.total_tokens = t.total_tokens AND x.tokens_without_cache_read = t.tokens_without_cache_read AND x.cost_micros = t.cost_micros AND x.session_count = t.session_count)",
)
def _(spark, d):
    usage, summary, totals = tables(spark, d, "usage", "summary", "totals")
    keys = usage.filter("user_id = 'u8'").select("usage_date", "source", "model").distinct()
    return caches.known_hashes(keys, "u8", "dev_1", usage, summary, totals, done(spark))


@query("backfill_page", ctes("usage") + " SELECT DISTINCT user_id, usage_date, source, model FROM usage WHERE (user_id, usage_date, source, model) > ('u1', '2024-01-07', 'codex', 'model-a') ORDER BY 1, 2, 3, 4 LIMIT 51")
def _(spark, d):
    return caches.backfill_page(view(spark, d, "usage"), ("u1", "2024-01-07", "codex", "model-a"), 50)


@query("backfill_totals_page", ctes("summary") + " SELECT DISTINCT user_id FROM summary WHERE user_id > 'u12' ORDER BY 1 LIMIT 11")
def _(spark, d):
    return caches.totals_page(view(spark, d, "summary"), "u12", 10)


@query("reconcile_missing_keys", ctes("usage", "incoming") + ", e AS (SELECT DISTINCT source, usage_date, CASE WHEN user_id = 'u3' THEN NULL ELSE model END AS model FROM usage WHERE user_id IN ('u2', 'u3')), p AS (SELECT DISTINCT source, usage_date, model FROM usage WHERE user_id = 'u4') SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source = e.source AND p.usage_date = e.usage_date AND (e.model IS NULL OR p.model = e.model))")
def _(spark, d):
    usage = view(spark, d, "usage")
    model = F.when(F.col("user_id") == "u3", F.lit(None).cast("string")).otherwise(F.col("model")).alias("model")
    expected = usage.filter("user_id in ('u2', 'u3')").select("source", "usage_date", model).distinct()
    return caches.missing_keys(expected, usage.filter("user_id = 'u4'").select("source", "usage_date", "model").distinct())


#: A snapshot an event, whose number modulo 14 says which rule it breaks.
_CANDIDATES = """SELECT event_id, event_id % 14 AS k, CASE event_id % 14 WHEN 1 THEN 'other' ELSE 'codex' END AS source, CASE event_id % 14 WHEN 2 THEN '2024-1-5' ELSE '2024-01-05' END AS usage_date,
  CASE event_id % 14 WHEN 3 THEN repeat('m', 161) WHEN 13 THEN '' ELSE 'm' END AS model, CASE event_id % 14 WHEN 4 THEN repeat('z', 81) WHEN 5 THEN 'Mars/Base' ELSE 'UTC' END AS timezone,
  CAST(CASE event_id % 14 WHEN 6 THEN -1 ELSE 1 END AS BIGINT) AS input_tokens, CAST(CASE event_id % 14 WHEN 7 THEN -1 ELSE 1 END AS BIGINT) AS output_tokens, CAST(CASE event_id % 14 WHEN 8 THEN -1 ELSE 1 END AS BIGINT) AS cache_creation_tokens,
  CAST(CASE event_id % 14 WHEN 9 THEN 9 ELSE 1 END AS BIGINT) AS cache_read_tokens, CAST(CASE event_id % 14 WHEN 10 THEN -1 ELSE 5 END AS BIGINT) AS total_tokens, CAST(CASE event_id % 14 WHEN 11 THEN -1 ELSE 0 END AS BIGINT) AS cost_micros,
  CAST(CASE event_id % 14 WHEN 12 THEN -1 ELSE 0 END AS BIGINT) AS session_count FROM events"""
_BROKEN = ["", "source", "usage_date", "model", "timezone,zone", "zone", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read", "cache_read,total_tokens", "cost", "sessions", "model"]


@query("snapshot_validation", f"SELECT event_id, {_BROKEN}[event_id % 14 + 1] AS reasons FROM events")
def _(spark, d):
    rows = _sql(spark, d, _CANDIDATES)
    return caches.validated(rows, caches.zone_names(spark), SOURCES).select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query("snapshot_accepted", "SELECT event_id FROM events WHERE event_id % 14 = 0")
def _(spark, d):
    """The rows of a request all of whose snapshots are valid."""
    return caches.accepted(_sql(spark, d, _CANDIDATES).filter("k = 0"), caches.zone_names(spark), SOURCES).select("event_id")


@query("upload_filter", ctes("usage", "incoming") + " SELECT i.source, i.usage_date, i.model, i.snapshot_hash, i.ordinal FROM incoming i WHERE i.user_id = 'u7' AND NOT EXISTS (SELECT 1 FROM usage u WHERE u.user_id = 'u7' AND u.source = i.source AND u.usage_date = i.usage_date AND u.model = i.model AND u.snapshot_hash = i.snapshot_hash)")
def _(spark, d):
    rows = view(spark, d, "incoming").filter("user_id = 'u7'").select("source", "usage_date", "model", "snapshot_hash", "ordinal")
    return caches.filter_changed(rows, view(spark, d, "usage").filter("user_id = 'u7'"))


@query(
    "snapshot_hash",
    ctes("usage") + """ SELECT user_id, device_id, source, usage_date, model, sha256('{"source":"' || source || '","usageDate":"' || usage_date || '","timezone":"' || timezone || '","model":"' || model || '","inputTokens":' || input_tokens || ',"outputTokens":' || output_tokens
      || ',"cacheCreationTokens":' || cache_creation_tokens || ',"cacheReadTokens":' || cache_read_tokens || ',"totalTokens":' || total_tokens || ',"costUsd":' || CASE WHEN cost_micros % 1000000 = 0 THEN CAST(cost_micros // 1000000 AS STRING) ELSE CAST(cost_micros / 1000000.0 AS STRING) END || ',"sessionCount":' || session_count || '}') AS snapshot_hash FROM usage""",
)
def _(spark, d):
    return caches.with_hash(view(spark, d, "usage")).select("user_id", "device_id", "source", "usage_date", "model", "snapshot_hash")


# -- sources -------------------------------------------------------------------------

_PARSED = ctes("logs") + """, j AS (SELECT *, TRY_CAST(value AS JSON) AS doc FROM logs),
  r AS (SELECT kind, session_id, doc IS NULL AS bad, CASE WHEN kind = 'A' THEN doc->'$.payload.info.last_token_usage' ELSE doc->'$.message.usage' END AS u, CASE WHEN kind = 'A' THEN doc->>'$.payload.info.model' ELSE doc->>'$.message.model' END AS model, substr(doc->>'$.timestamp', 1, 10) AS usage_date, CAST(doc->>'$.costUSD' AS DOUBLE) AS own FROM j),
  n AS (SELECT *, CAST(u->>'$.input_tokens' AS BIGINT) AS i, CAST(u->>'$.output_tokens' AS BIGINT) AS o, COALESCE(CAST(u->>'$.cache_creation_input_tokens' AS BIGINT), 0) AS cc, COALESCE(CAST(u->>'$.cache_read_input_tokens' AS BIGINT), CAST(u->>'$.cached_input_tokens' AS BIGINT)) AS cr,
    COALESCE(CAST(u->>'$.cost_usd' AS DOUBLE), CAST(u->>'$.total_cost' AS DOUBLE), own) AS cost FROM r WHERE u IS NOT NULL AND model <> '<synthetic>')"""  # fmt: skip


def _session(kind: str, source: str) -> None:
    oracle = _PARSED + f" SELECT '{source}' AS source, usage_date, model, CAST(SUM(i) AS BIGINT) AS input_tokens, CAST(SUM(o) AS BIGINT) AS output_tokens, CAST(SUM(cc) AS BIGINT) AS cache_creation_tokens, CAST(SUM(cr) AS BIGINT) AS cache_read_tokens, CAST(SUM(i + o + cc + cr) AS BIGINT) AS total_tokens, CAST(SUM(floor(COALESCE(cost, 0) * 1000000 + 0.5)) AS BIGINT) AS cost_micros, COUNT(DISTINCT session_id) AS session_count FROM n WHERE kind = '{kind}' GROUP BY 2, 3"
    query(f"session_parse_{kind.lower()}", oracle)(lambda spark, d: session_logs.metrics(session_logs.extracted(view(spark, d, "logs").filter(F.col("kind") == kind))))


_session("A", SOURCES[1])
_session("B", SOURCES[0])


_STATUS = """CASE WHEN event_id % 50 = 0 THEN 'malformed' WHEN event_id % 20 = 1 THEN 'skipped' WHEN event_id % 20 = 2 THEN 'unparsed' WHEN event_id % 20 IN (3, 4) THEN 'ignored' ELSE 'metric' END"""


@query(
    "session_parse_quality",
    f"WITH e AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS kind, event_id % 20 IN (5, 6, 8) AS costed, {_STATUS} AS status FROM events) SELECT kind, "
    + ", ".join(f"COUNT(*) FILTER (status = '{x}') AS {x}" for x in ("metric", "ignored", "malformed", "unparsed", "skipped")) + ", bool_or(status = 'metric' AND NOT costed) AS missing_cost FROM e GROUP BY kind",
)
def _(spark, d):
    return session_logs.quality(session_logs.extracted(view(spark, d, "logs")))


@query("session_line_costs", "WITH e AS (SELECT event_id, event_id % 20 AS k, " + _STATUS + " AS status FROM events) SELECT event_id, k IN (5, 6, 8) AS found, CASE k WHEN 5 THEN 0.25 WHEN 8 THEN 0.5 ELSE 0.0 END::DOUBLE AS cost FROM e WHERE status = 'metric'")
def _(spark, d):
    """A cost counts as found even if it is 0."""
    rows = session_logs.extracted(view(spark, d, "logs")).filter("status = 'metric'")
    return rows.select("event_id", F.col("cost").isNotNull().alias("found"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


@query("snapshot_merge", ctes("usage") + " SELECT source, usage_date, timezone, model, " + _ALL + ", CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, CAST(SUM(cost_micros) AS BIGINT) AS cost_micros, MIN(synced_at) AS synced_at FROM usage GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return session_logs.merge_snapshots(view(spark, d, "usage"))


_REPORTS = """SELECT event_id AS report_id, CASE event_id % 3
  WHEN 0 THEN '{"data":[{"date":"2024-01-0' || (1 + event_id % 9) || '","breakdown":{"m1":{"inputTokens":' || event_id % 100 || ',"outputTokens":5,"cost":0.25,"sessionCount":' || event_id % 4 || '},"m2":{"inputTokens":7,"totalTokens":' || event_id % 50 || '}}}]}'
  WHEN 1 THEN '{"daily":[{"period":"Jan ' || (1 + event_id % 9) || ', 2024","modelsUsed":["a"],"inputTokens":' || event_id % 77 || ',"sessions":2,"cacheReadInputTokens":3,"totalCost":0.5}]}'
  ELSE '[{"usageDate":"2024-01-1' || event_id % 9 || 'T22:00:00Z","modelBreakdowns":[{"modelName":"b","inputTokens":"12","outputTokens":' || event_id % 31 || '}],"totalTokens":100,"cost":1}]' END AS value FROM events"""


_NORMAL = (
    "e AS (SELECT event_id AS i FROM events), r AS (SELECT i AS report_id, '2024-01-0' || (1 + i % 9) AS usage_date, 'm1' AS model, i % 100 AS a, 5 AS o, 0 AS cr, 0 AS x, 250000 AS c, i % 4 AS n FROM e WHERE i % 3 = 0 "
    "UNION ALL SELECT i, '2024-01-0' || (1 + i % 9), 'm2', 7, 0, 0, i % 50, 0, 0 FROM e WHERE i % 3 = 0 UNION ALL SELECT i, '2024-01-0' || (1 + i % 9), 'a', i % 77, 0, 3, 0, 500000, 2 FROM e WHERE i % 3 = 1 "
    "UNION ALL SELECT i, '2024-01-1' || i % 9, 'b', 0, i % 31, 0, 0, CAST(floor((i % 31) / 100.0 * 1000000 + 0.5) AS BIGINT), 0 FROM e WHERE i % 3 = 2)"
)
_NORMAL_COLUMNS = (
    "CAST(report_id AS BIGINT) AS report_id, r.usage_date, r.model, CAST(a AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cache_creation_tokens, CAST(cr AS BIGINT) AS cache_read_tokens, "
    "CAST(CASE WHEN x > 0 THEN x ELSE a + o + cr END AS BIGINT) AS total_tokens, CAST(c AS BIGINT) AS cost_micros"
)


@query("report_normalize", f"WITH {_NORMAL} SELECT {_NORMAL_COLUMNS}, CAST(n AS BIGINT) AS session_count FROM r")
def _(spark, d):
    return reports.normalize(_sql(spark, d, _REPORTS))


#: Session documents: an instant that is on the next day in the zone, a plain date, one without a day, and an
#: empty breakdown; the second model wins only with more tokens.
_SESSIONS = """SELECT event_id AS report_id, CASE event_id % 4
  WHEN 0 THEN '{"data":[{"sessionId":"s","lastActivity":"2024-01-0' || (1 + event_id % 8) || 'T16:10:00Z","modelBreakdowns":[{"modelName":"m1","inputTokens":' || event_id % 10 || '},{"modelName":"a","totalTokens":' || event_id % 7 || '}]}]}'
  WHEN 1 THEN '[{"date":"2024-01-0' || (1 + event_id % 8) || '","breakdown":{"b":{"inputTokens":1},"m2":{"inputTokens":1}}}, {"usageDate":"2024-01-03","modelBreakdowns":[],"totalTokens":1}]'
  WHEN 2 THEN '{"sessions":[{"sessionId":"x","totalTokens":3},{"lastActivity":7,"date":"2024-01-01"}]}'
  ELSE '{"data":[]}' END AS value FROM events"""
_COUNTED = (
    "c AS (SELECT usage_date, model, COUNT(*) AS session_count FROM (SELECT '2024-01-0' || (2 + event_id % 8) AS usage_date, CASE WHEN event_id % 7 > event_id % 10 THEN 'a' ELSE 'm1' END AS model FROM events WHERE event_id % 4 = 0 "
    "UNION ALL SELECT '2024-01-0' || (1 + event_id % 8), 'b' FROM events WHERE event_id % 4 = 1 UNION ALL SELECT '2024-01-03', 'all' FROM events WHERE event_id % 4 = 1) GROUP BY 1, 2)"
)


@query("session_counts", f"WITH {_COUNTED} SELECT * FROM c")
def _(spark, d):
    return reports.session_counts(_sql(spark, d, _SESSIONS), "Asia/Shanghai")


@query("report_normalize_sessions", f"WITH {_NORMAL}, {_COUNTED} SELECT {_NORMAL_COLUMNS}, COALESCE(c.session_count, 0) AS session_count FROM r LEFT JOIN c ON c.usage_date = r.usage_date AND c.model = r.model")
def _(spark, d):
    return reports.normalize(_sql(spark, d, _REPORTS), _sql(spark, d, _SESSIONS), "Asia/Shanghai")


@query("session_count_attribution", "WITH s AS (SELECT user_id AS session_id, CAST(CAST(ts AS DATE) AS STRING) AS usage_date, event_type AS model, CAST(round(value * 100) AS BIGINT) AS t, event_id AS n FROM events), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t DESC, n) = 1) SELECT usage_date, model, COUNT(*) AS session_count FROM b GROUP BY 1, 2")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("user_id").alias("session_id"), F.col("ts").cast("date").cast("string").alias("usage_date"), F.col("event_type").alias("model"), F.round(F.col("value") * 100).cast("bigint").alias("total_tokens"), F.col("event_id").alias("ordinal"))
    return reports.attribute_sessions(rows)


@query(
    "apportion_integers",
    "WITH r AS (SELECT user_id, event_id, event_id % 7 AS w FROM events), g AS (SELECT *, SUM(w) OVER (PARTITION BY user_id) AS s, COUNT(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, 1000 + user_id AS t FROM r), "
    "f AS (SELECT *, CAST(floor(t * (w / CAST(s AS DOUBLE))) AS BIGINT) AS x FROM g) SELECT user_id, event_id, CAST(CASE WHEN i = n THEN t - COALESCE(SUM(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE x END AS BIGINT) AS share FROM f",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id")
    return correction.apportion(e, ["user_id"], ["event_id"], F.col("user_id") + 1000, F.col("event_id") % 7, "share").select("user_id", "event_id", "share")


@query("local_day_bucket", ctes("profiles") + ", e AS (SELECT e.event_id, e.ts, p.timezone FROM events e JOIN profiles p ON p.user_id = 'u' || CAST(e.user_id AS STRING)) SELECT timezone, CAST(CAST(timezone(timezone, timezone('UTC', ts)) AS DATE) AS STRING) AS usage_date, COUNT(*) AS n FROM e GROUP BY 1, 2")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"))
    joined = e.join(view(spark, d, "profiles").select("user_id", "timezone"), "user_id")
    return joined.groupBy("timezone", local_date(F.col("ts"), F.col("timezone")).alias("usage_date")).agg(F.count("*").alias("n"))


#: Dates in the forms that reports write, from the events' days.
_DATES = """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(ts, "yyyy-MM-dd'T'23:59:00'Z'") WHEN 2 THEN date_format(ts, 'MMM d, yyyy')
  WHEN 3 THEN 'someday ' || CAST(event_id AS STRING) ELSE date_format(ts, "yyyy-MM-dd'T'23:30:00-02:00") END AS t FROM events"""


@query("report_dates", "SELECT event_id AS id, CASE event_id % 5 WHEN 3 THEN 'someday ' || event_id WHEN 4 THEN strftime(CAST(ts AS DATE) + 1, '%Y-%m-%d') ELSE strftime(CAST(ts AS DATE), '%Y-%m-%d') END AS usage_date FROM events")
def _(spark, d):
    return _sql(spark, d, _DATES).select("id", report_date(F.col("t")).alias("usage_date"))


# -- delivery ------------------------------------------------------------------------

_SUBS = """SELECT 'sub_' || CAST(c_custkey AS STRING) AS id, 'u' || CAST(c_custkey AS STRING) AS user_id, c_custkey % 4 <> 0 AS enabled,
  '2024-01-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || 'T09:30:00.000Z' AS next_run_at, CASE WHEN c_custkey % 3 = 0 THEN '2024-01-' || lpad(CAST(1 + c_custkey % 25 AS STRING), 2, '0') || 'T10:00:00.000Z' END AS locked_until FROM customer"""
_HISTORY = """SELECT 'rep_' || CAST(event_id AS STRING) AS id, 'u' || CAST(user_id AS STRING) AS user_id, CAST(CAST(ts AS DATE) AS STRING) AS report_date, CASE WHEN event_id % 5 = 0 THEN '2024-01-20T00:00:00.000Z' END AS revoked_at FROM events WHERE event_id % 11 = 0"""
_LOG = """SELECT 'sub_' || CAST(user_id AS STRING) AS subscription_id, CAST(CAST(ts AS DATE) AS STRING) AS report_date, CASE WHEN event_id % 2 = 0 THEN '09:30' ELSE '18:00' END AS slot, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_id % 7 = 0 THEN 'test' ELSE 'daily' END AS kind, event_id AS ordinal FROM events"""


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    for t in ("customer", "events"):
        if f"FROM {t}" in text:
            spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(f"facade_{t}")
            text = text.replace(f"FROM {t}", f"FROM facade_{t}")
    return spark.sql(text)


@query("due_subscriptions", f"WITH s AS ({_SUBS}) SELECT * FROM s WHERE enabled AND next_run_at <= '2024-01-15T12:00:00.000Z' AND (locked_until IS NULL OR locked_until <= '2024-01-15T12:00:00.000Z') ORDER BY next_run_at, id LIMIT 5")
def _(spark, d):
    return delivery.due_subscriptions(_sql(spark, d, _SUBS), "2024-01-15T12:00:00.000Z")


@query("report_visibility", ctes("profiles") + f", h AS ({_HISTORY}) SELECT h.* FROM h JOIN profiles p ON p.user_id = h.user_id WHERE report_date >= '2024-01-16' AND (h.user_id = '{USER}' OR (p.share_reports AND revoked_at IS NULL))")
def _(spark, d):
    return delivery.visible_reports(_sql(spark, d, _HISTORY), view(spark, d, "profiles"), USER, "2024-01-30", 15).select("id", "user_id", "report_date", "revoked_at")


@query("report_history_prune", f"WITH h AS ({_HISTORY}) SELECT * FROM h WHERE report_date >= '2024-01-24'")
def _(spark, d):
    return delivery.prune(_sql(spark, d, _HISTORY), "2024-01-30", 7)


@query(
    "delivery_dedupe",
    f"WITH a AS ({_LOG}), l AS (SELECT * FROM a WHERE ordinal % 2 = 0), c AS (SELECT * FROM a WHERE ordinal % 2 = 1), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY subscription_id, report_date, slot ORDER BY ordinal) = 1 OR status <> 'success' OR kind <> 'daily') "
    "SELECT * FROM f WHERE status <> 'success' OR kind <> 'daily' OR NOT EXISTS (SELECT 1 FROM l WHERE l.status = 'success' AND l.kind = 'daily' AND l.subscription_id = f.subscription_id AND l.report_date = f.report_date AND l.slot = f.slot)",
)
def _(spark, d):
    log = _sql(spark, d, _LOG)
    return delivery.new_deliveries(log.filter("ordinal % 2 = 0"), log.filter("ordinal % 2 = 1"))


@query(
    "rate_limit_fixed_window",
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS STRING) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id AS id FROM events), w(key, opened) AS (
      SELECT key, MIN(sec) FROM e GROUP BY key UNION ALL SELECT w.key, (SELECT MIN(e.sec) FROM e WHERE e.key = w.key AND e.sec >= w.opened + 86400) FROM w WHERE (SELECT MIN(e.sec) FROM e WHERE e.key = w.key AND e.sec >= w.opened + 86400) IS NOT NULL),
    x AS (SELECT e.*, MAX(w.opened) AS opened FROM e JOIN w ON w.key = e.key AND w.opened <= e.sec GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY key, opened ORDER BY sec, id) AS n FROM x)
    SELECT key, id, opened + 86400 AS reset_at, n <= 3 AS allowed, CAST(greatest(3 - n, 0) AS BIGINT) AS remaining FROM n""",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    return delivery.rate_limited(e, 3, 86_400)


_FILES = "SELECT 'f' || CAST(event_id AS STRING) AS path, event_id * 10 AS size, event_id * 1000 AS mtime_ms, 'h' || CAST(event_id % 5 AS STRING) AS sha256 FROM events"
_MANIFEST = "SELECT 'f' || CAST(event_id AS STRING) AS path, event_id * 10 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS size, event_id * 1000 AS mtime_ms, 'h' || CAST(event_id % 7 AS STRING) AS sha256, event_id % 11 = 0 AS pending, event_id % 2 AS snapshots FROM events WHERE event_id % 4 <> 0"


@query("changed_files_manifest", f"WITH l AS ({_FILES}), m AS ({_MANIFEST}) SELECT l.*, COALESCE(m.pending, false) AS pending FROM l LEFT JOIN m ON l.path = m.path WHERE COALESCE(m.pending, false) OR (l.mtime_ms >= 440000 AND NOT COALESCE(l.size = m.size AND l.mtime_ms = m.mtime_ms, false) AND NOT COALESCE(l.sha256 = m.sha256, false))")
def _(spark, d):
    return session_logs.changed_files(_sql(spark, d, _FILES), _sql(spark, d, _MANIFEST), 500_000)


@query("vanished_files", f"WITH l AS ({_FILES}), m AS ({_MANIFEST}) SELECT * FROM m WHERE path NOT IN (SELECT path FROM l WHERE size % 30 = 0) AND (NOT pending OR snapshots > 0)")
def _(spark, d):
    return session_logs.vanished_files(_sql(spark, d, _FILES).filter("size % 30 = 0"), _sql(spark, d, _MANIFEST))


# the other parts of the catalogue register their queries as they are imported
from meterlake.plans import account_queries, delivery_queries, refresh_queries, source_queries, text_queries  # noqa: E402, F401
