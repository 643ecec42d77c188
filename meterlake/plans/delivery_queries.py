"""Subscriptions, deliveries, report history and sharing."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions.scalars import next_run
from meterlake.operators import delivery, history, subscriptions
from meterlake.plans.account_queries import zones
from meterlake.plans.registry import NOW, USER, query
from meterlake.sources.facade import ctes, view

_AT = "TIMESTAMP '2024-01-15 12:00:00'"
_SPLIT = "list_filter(regexp_split_to_array(trim(COALESCE({x}, '')), '[\\s,]+'), lambda v: v <> '')"


def _times(x: str) -> str:
    found = _SPLIT.replace("{x}", x)
    return f"(CASE WHEN len({found}) = 0 THEN ['18:00'] WHEN len(list_filter({found}, lambda v: NOT regexp_full_match(v, '([01][0-9]|2[0-3]):[0-5][0-9]'))) = 0 THEN list_sort(list_distinct({found})) END)"


def _days(x: str) -> str:
    found = _SPLIT.replace("{x}", x)
    return f"(CASE WHEN len({found}) = 0 THEN [0, 1, 2, 3, 4, 5, 6] WHEN len(list_filter({found}, lambda v: NOT regexp_full_match(v, '[0-6]'))) = 0 THEN list_sort(list_transform(list_distinct({found}), lambda v: CAST(v AS INTEGER))) END)"


def _next(now: str, zone: str = "timezone", slots: str = "slots", days: str = "days") -> str:
    """Text of the least slot after ``now`` (a naive UTC moment)."""
    today = f"CAST(timezone({zone}, timezone('UTC', {now})) AS DATE)"
    wall = f"CAST(CAST({today} + CAST(i AS INTEGER) AS VARCHAR) || ' ' || s AS TIMESTAMP)"
    every = f"flatten(list_transform(range(0, 8), lambda i: list_transform({slots}, lambda s: CASE WHEN list_contains({days}, CAST(dayofweek({today} + CAST(i AS INTEGER)) AS INTEGER)) THEN timezone('UTC', timezone({zone}, {wall})) END)))"
    return f"strftime(list_min(list_filter({every}, lambda x: x > {now})), '%Y-%m-%dT%H:%M:%S.%gZ')"


_REPAIRED = f"""sch AS (SELECT *, CASE WHEN trim(COALESCE(schedule_times_local, '')) = '' THEN schedule_time_local ELSE schedule_times_local END AS stored FROM subscriptions),
  sub AS (SELECT * EXCLUDE (stored), COALESCE({_times('stored')}, {_times('schedule_time_local')}, ['18:00']) AS slots, COALESCE({_days('schedule_weekdays')}, [0, 1, 2, 3, 4, 5, 6]) AS days,
    ({_times('stored')} IS NULL OR trim(COALESCE(schedule_times_local, '')) = '' OR {_days('schedule_weekdays')} IS NULL OR trim(COALESCE(schedule_weekdays, '')) = '') AS needs_repair FROM sch)"""


@query("subscription_repair", ctes("subscriptions") + f", {_REPAIRED} SELECT id, array_to_string(slots, ',') AS slots, array_to_string(days, ',') AS days, needs_repair FROM sub")
def _(spark, d):
    found = subscriptions.scheduled(view(spark, d, "subscriptions"))
    return found.select("id", F.array_join("slots", ",").alias("slots"), F.array_join(F.transform("days", lambda x: x.cast("string")), ",").alias("days"), "needs_repair")


_DUE = f"enabled AND next_run_at <= '{NOW}' AND (locked_until IS NULL OR locked_until <= '{NOW}')"


@query("subscription_due_profile", ctes("subscriptions", "profiles") + f" SELECT s.id, s.user_id, p.display_name, p.share_reports, s.next_run_at FROM subscriptions s JOIN profiles p ON p.user_id = s.user_id WHERE {_DUE} ORDER BY s.next_run_at, s.id LIMIT 5")
def _(spark, d):
    found = subscriptions.due_with_profile(view(spark, d, "subscriptions"), view(spark, d, "profiles").filter("is_public or not is_public"), NOW)
    return found.select("id", "user_id", "display_name", "share_reports", "next_run_at")


_CLAIM = f"c AS (SELECT *, COALESCE({_DUE} AND id LIKE '%1', false) AS claimed FROM subscriptions)"


@query(
    "subscription_claim",
    ctes("subscriptions") + f""", {_CLAIM} SELECT * REPLACE (CASE WHEN claimed THEN '2024-01-15T12:10:00.000Z' ELSE locked_until END AS locked_until, CASE WHEN claimed THEN '{NOW}' ELSE locked_at END AS locked_at,
      CASE WHEN claimed THEN '{NOW}' ELSE updated_at END AS updated_at) FROM c""",
)
def _(spark, d):
    rows = view(spark, d, "subscriptions")
    return subscriptions.claimed(rows, rows.filter("id like '%1'").select("id"), NOW, "2024-01-15T12:10:00.000Z")


#: What is known of each due row's slot: every third is empty, every fourth fails, some are logged as delivered.
_FACTS = "CAST(substr(id, 5) AS INT) AS k"
_SETTLED = (
    ctes("subscriptions", "deliveries") + f""", {_REPAIRED}, due AS (SELECT *, {_FACTS}, COALESCE(pending_report_date, strftime(timezone(timezone, timezone('UTC', CAST(rtrim(next_run_at, 'Z') AS TIMESTAMP))), '%Y-%m-%d')) AS report_date,
      strftime(timezone(timezone, timezone('UTC', CAST(rtrim(next_run_at, 'Z') AS TIMESTAMP))), '%H:%M') AS wall FROM sub WHERE {_DUE}),
    tgt AS (SELECT * EXCLUDE (wall), COALESCE(pending_schedule_slot, report_date || 'T' || wall) AS slot FROM due),
    fct AS (SELECT t.*, k % 3 AS report_tokens, CASE WHEN k % 4 = 1 THEN 'HTTP 503' END AS error,
      EXISTS (SELECT 1 FROM deliveries l WHERE l.subscription_id = t.id AND l.report_date = t.report_date AND l.status = 'success' AND l.kind = 'daily') AS delivered FROM tgt t),
    st AS (SELECT *, CASE WHEN delivered OR (report_tokens <= 0 AND NOT send_empty_report) THEN 'skipped' WHEN error IS NOT NULL THEN 'failure' ELSE 'success' END AS status,
      CASE WHEN delivered THEN 'Already delivered' WHEN report_tokens <= 0 AND NOT send_empty_report THEN 'Empty report' ELSE error END AS reason,
      COALESCE(timezone('UTC', timezone(timezone, CAST(replace(slot, 'T', ' ') AS TIMESTAMP))), {_AT}) AS slot_at FROM fct),
    fin AS (SELECT *, CASE WHEN status = 'failure' AND failure_count + 1 < 3 THEN CASE failure_count WHEN 0 THEN '2024-01-15T12:05:00.000Z' ELSE '2024-01-15T12:30:00.000Z' END
      WHEN status <> 'failure' AND pending_schedule_slot IS NOT NULL AND failure_count = 0 THEN next_run_at ELSE {_next('slot_at')} END AS n_next,
      status = 'failure' AND failure_count + 1 < 3 AS again FROM st)"""
)


def _due(spark, d):
    rows = subscriptions.target(subscriptions.scheduled(delivery.due_subscriptions(view(spark, d, "subscriptions"), NOW, 1 << 30)))
    log = view(spark, d, "deliveries").filter("status = 'success' and kind = 'daily'").select(F.col("subscription_id").alias("id"), "report_date", F.lit(True).alias("logged")).distinct()
    k = F.substring("id", 5, 20).cast("int")
    rows = rows.join(log, ["id", "report_date"], "left").withColumns({"delivered": F.coalesce("logged", F.lit(False)), "report_tokens": k % 3, "error": F.when(k % 4 == 1, "HTTP 503")}).drop("logged")
    return subscriptions.settled(rows, NOW)


@query(
    "delivery_settle",
    _SETTLED + f""" SELECT id, status, reason, report_date, slot, failure_count + 1 AS attempt, n_next AS next_run_at, CASE WHEN again THEN report_date END AS pending_report_date,
      CASE WHEN again THEN COALESCE(pending_schedule_slot, slot) END AS pending_schedule_slot, CASE WHEN again THEN failure_count + 1 ELSE 0 END AS failure_count,
      CASE WHEN status <> 'success' THEN reason END AS last_error, CASE WHEN status = 'success' THEN '{NOW}' END AS last_success_at, CASE WHEN status = 'failure' THEN '{NOW}' END AS last_failure_at FROM fin""",
)
def _(spark, d):
    names = ["next_run_at", "pending_report_date", "pending_schedule_slot", "failure_count", "last_error", "last_success_at", "last_failure_at"]
    return _due(spark, d).select("id", "status", "reason", "report_date", "slot", "attempt", *(f"new.{c}" for c in names))


@query("delivery_run_counts", _SETTLED + " SELECT COUNT(*) AS checked, COUNT(*) FILTER (status = 'success') AS sent, COUNT(*) FILTER (status = 'failure') AS failed, COUNT(*) FILTER (status = 'skipped') AS skipped FROM fin")
def _(spark, d):
    return delivery.run_counts(_due(spark, d))


#: A run holds its leases for all rows; every fifth was claimed again by another run meanwhile.
_GUARDED = _SETTLED + f""", held AS (SELECT * REPLACE (CASE WHEN {_DUE} THEN CASE WHEN CAST(substr(id, 5) AS INT) % 5 = 0 THEN 'other' ELSE '{NOW}' END ELSE locked_at END AS locked_at) FROM subscriptions)"""


@query(
    "delivery_guarded_state",
    _GUARDED + f""" SELECT h.id, CASE WHEN f.id IS NULL THEN h.next_run_at ELSE n_next END AS next_run_at, CASE WHEN f.id IS NULL THEN h.locked_at END AS locked_at, CASE WHEN f.id IS NULL THEN h.failure_count WHEN again THEN h.failure_count + 1 ELSE 0 END AS failure_count,
      CASE WHEN f.id IS NULL THEN h.updated_at ELSE '{NOW}' END AS updated_at FROM held h LEFT JOIN fin f ON f.id = h.id AND h.locked_at = '{NOW}'""",
)
def _(spark, d):
    table, updates = _held(spark, d)
    return subscriptions.guarded(table, updates).select("id", "next_run_at", "locked_at", "failure_count", "updated_at")


def _held(spark, d):
    table = view(spark, d, "subscriptions")
    other = F.when(F.substring("id", 5, 20).cast("int") % 5 == 0, "other").otherwise(NOW)
    table = table.withColumn("locked_at", F.when(F.expr(_DUE), other).otherwise(F.col("locked_at")))
    return table, _due(spark, d).select("id", F.lit(NOW).alias("lease"), "new")


@query("delivery_stale_claims", _GUARDED + f" SELECT f.id FROM fin f JOIN held h ON h.id = f.id WHERE h.locked_at IS DISTINCT FROM '{NOW}'")
def _(spark, d):
    return subscriptions.stale_updates(*_held(spark, d)).select("id")


#: Edits: only the name, the zone, the slots, the switch; some not valid; some of rows that are not there.
_EDITS = """SELECT 'u' || CAST(p_partkey AS STRING) AS user_id, 'sub_' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE ' edited ' END AS name,
  CASE p_partkey % 13 WHEN 0 THEN 'Mars/Base' WHEN 1 THEN 'Europe/Berlin' ELSE 'Asia/Shanghai' END AS timezone, CASE p_partkey % 5 WHEN 0 THEN '7:00' WHEN 1 THEN '09:30 18:00 09:30' ELSE '09:30' END AS schedule_times_local,
  CASE p_partkey % 17 WHEN 0 THEN '8' WHEN 1 THEN '1,2,3,4,5' ELSE '' END AS schedule_weekdays, p_partkey % 2 = 0 AS send_empty_report, p_partkey % 4 <> 0 AS enabled FROM part"""
_JUDGED = (
    ctes("subscriptions") + f""", {_REPAIRED}, ed AS (SELECT *, {_times('schedule_times_local')} AS slots, {_days('schedule_weekdays')} AS days FROM ({_EDITS})),
    ju AS (SELECT ed.*, CASE WHEN ed.slots IS NULL OR ed.days IS NULL THEN 'schedule' WHEN length(trim(ed.name)) NOT BETWEEN 1 AND 80 THEN 'name' WHEN ed.timezone NOT IN ('UTC', 'America/New_York', 'Asia/Shanghai', 'Europe/London', 'Europe/Berlin') THEN 'timezone' WHEN sub.id IS NULL THEN 'missing' END AS error,
      sub.id IS NOT NULL AND (sub.enabled <> ed.enabled OR sub.timezone <> ed.timezone OR sub.slots <> ed.slots OR sub.days <> ed.days) AS reset FROM ed LEFT JOIN sub ON sub.id = ed.id AND sub.user_id = ed.user_id),
    up AS (SELECT *, CASE WHEN error IS NULL THEN {_next(_AT)} END AS upcoming FROM ju)"""
)


def _edits(spark, d):
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("facade_part")
    return subscriptions.judged_edits(view(spark, d, "subscriptions"), spark.sql(_EDITS.replace("FROM part", "FROM facade_part")), zones(spark), NOW)


@query("subscription_edit", _JUDGED + " SELECT user_id, id, error, CASE WHEN error IS NULL THEN reset END AS reset, upcoming FROM up")
def _(spark, d):
    return _edits(spark, d).select("user_id", "id", "error", F.when(F.col("error").isNull(), F.col("reset")).alias("reset"), "upcoming")


@query(
    "subscription_edit_state",
    _JUDGED + f""" SELECT s.id, COALESCE(trim(u.name), s.name) AS name, COALESCE(u.timezone, s.timezone) AS timezone, COALESCE(array_to_string(u.slots, ','), s.schedule_times_local) AS schedule_times_local, COALESCE(u.slots[1], s.schedule_time_local) AS schedule_time_local,
      COALESCE(array_to_string(u.days, ','), s.schedule_weekdays) AS schedule_weekdays, COALESCE(u.send_empty_report, s.send_empty_report) AS send_empty_report, COALESCE(u.enabled, s.enabled) AS enabled,
      CASE WHEN u.reset THEN u.upcoming ELSE s.next_run_at END AS next_run_at, CASE WHEN u.reset THEN NULL ELSE s.pending_schedule_slot END AS pending_schedule_slot, CASE WHEN u.reset THEN NULL ELSE s.locked_at END AS locked_at,
      CASE WHEN u.reset THEN 0 ELSE s.failure_count END AS failure_count, CASE WHEN u.id IS NULL THEN s.updated_at ELSE '{NOW}' END AS updated_at
    FROM subscriptions s LEFT JOIN (SELECT * FROM up WHERE error IS NULL) u ON u.id = s.id AND u.user_id = s.user_id""",
)
def _(spark, d):
    names = ["id", "name", "timezone", "schedule_times_local", "schedule_time_local", "schedule_weekdays", "send_empty_report", "enabled", "next_run_at", "pending_schedule_slot", "locked_at", "failure_count", "updated_at"]
    return subscriptions.edited(view(spark, d, "subscriptions"), _edits(spark, d), NOW).select(*names)


_SWITCHES = "SELECT 'u' || CAST(p_partkey AS STRING) AS user_id, 'sub_' || CAST(p_partkey AS STRING) AS id, p_partkey % 2 = 0 AS on_ FROM part WHERE p_partkey % 3 = 0"


@query(
    "subscription_switch",
    ctes("subscriptions") + f""", {_REPAIRED}, sw AS ({_SWITCHES}) SELECT sub.id, COALESCE(on_, enabled) AS enabled, CASE WHEN on_ THEN {_next(_AT)} ELSE next_run_at END AS next_run_at,
      CASE WHEN sw.id IS NULL THEN pending_report_date END AS pending_report_date, CASE WHEN sw.id IS NULL THEN locked_until END AS locked_until, CASE WHEN on_ THEN 0 ELSE failure_count END AS failure_count,
      CASE WHEN on_ THEN NULL ELSE last_error END AS last_error, CASE WHEN sw.id IS NULL THEN updated_at ELSE '{NOW}' END AS updated_at FROM sub LEFT JOIN sw ON sw.id = sub.id AND sw.user_id = sub.user_id""",
)
def _(spark, d):
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("facade_part")
    asked = spark.sql(_SWITCHES.replace("FROM part", "FROM facade_part")).withColumnRenamed("on_", "on")
    names = ["id", "enabled", "next_run_at", "pending_report_date", "locked_until", "failure_count", "last_error", "updated_at"]
    return subscriptions.switched(view(spark, d, "subscriptions"), asked, NOW).select(*names)


_FORMS = """SELECT 'new_' || CAST(p_partkey AS STRING) AS id, 'u' || CAST(p_partkey AS STRING) AS user_id, 'new' AS name, 'Asia/Shanghai' AS timezone, CASE WHEN p_partkey % 2 = 0 THEN '18:00,07:15' ELSE 'never' END AS schedule_times_local,
  '1,3' AS schedule_weekdays, false AS send_empty_report, true AS enabled FROM part"""


@query(
    "subscription_create",
    ctes("subscriptions") + f""", f AS (SELECT *, {_times('schedule_times_local')} AS slots, {_days('schedule_weekdays')} AS days FROM ({_FORMS})) SELECT id, user_id, schedule_times_local, schedule_time_local, schedule_weekdays, next_run_at, failure_count, created_at FROM subscriptions
    UNION ALL SELECT id, user_id, array_to_string(slots, ','), slots[1], array_to_string(days, ','), {_next(_AT)}, 0, '{NOW}' FROM f WHERE slots IS NOT NULL""",
)
def _(spark, d):
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("facade_part")
    found = subscriptions.created(view(spark, d, "subscriptions"), spark.sql(_FORMS.replace("FROM part", "FROM facade_part")), NOW)
    return found.select("id", "user_id", "schedule_times_local", "schedule_time_local", "schedule_weekdays", "next_run_at", "failure_count", "created_at")


@query("subscription_delete", ctes("subscriptions") + f", sw AS ({_SWITCHES}) SELECT s.* FROM subscriptions s WHERE NOT EXISTS (SELECT 1 FROM sw WHERE sw.id = s.id AND sw.user_id = s.user_id)")
def _(spark, d):
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("facade_part")
    return subscriptions.deleted(view(spark, d, "subscriptions"), spark.sql(_SWITCHES.replace("FROM part", "FROM facade_part")))


@query("next_run_schedule", ctes("subscriptions") + f", {_REPAIRED} SELECT id, {_next(_AT)} AS next_run_at FROM sub")
def _(spark, d):
    rows = subscriptions.scheduled(view(spark, d, "subscriptions"))
    moment = F.lit(NOW).cast("timestamp")
    return rows.select("id", subscriptions.iso(next_run(moment, F.col("timezone"), F.col("slots"), F.col("days"))).alias("next_run_at"))


#: Attempts with their outcomes, a subscription's slots.
_ATTEMPTS = "o AS (SELECT *, CASE CAST(substr(id, 5) AS INT) % 3 WHEN 0 THEN 'sent' ELSE 'failed' END AS outcome, failure_count + 1 AS attempt FROM sub)"


@query(
    "retry_state_transition",
    ctes("subscriptions") + f""", {_REPAIRED}, {_ATTEMPTS} SELECT id, outcome = 'failed' AND attempt < 3 AS retry, CASE WHEN outcome = 'failed' AND attempt < 3 THEN CASE attempt WHEN 1 THEN '2024-01-15T12:05:00.000Z' ELSE '2024-01-15T12:30:00.000Z' END ELSE {_next(_AT)} END AS next_run_at,
      CASE WHEN outcome = 'failed' AND attempt < 3 THEN attempt ELSE 0 END AS failure_count FROM o""",
)
def _(spark, d):
    rows = subscriptions.scheduled(view(spark, d, "subscriptions")).withColumn("weekdays", F.col("days"))
    outcome = F.when(F.substring("id", 5, 20).cast("int") % 3 == 0, "sent").otherwise("failed")
    rows = rows.withColumns({"outcome": outcome, "attempt": F.col("failure_count") + 1}).drop("next_run_at", "failure_count")
    found = delivery.after_attempt(rows, F.lit(NOW).cast("timestamp"))
    return found.select("id", "retry", subscriptions.iso(F.col("next_run_at")).alias("next_run_at"), "failure_count")


# -- history -------------------------------------------------------------------------

#: Reports that runs make: some of stored keys, some twice in a batch.
_REPORTS = """SELECT 'new_' || id || '_' || CAST(n AS STRING) AS id, user_id, CASE WHEN total_tokens % 2 = 0 THEN report_date ELSE '2024-02-0' || CAST(total_tokens % 9 + 1 AS STRING) END AS report_date, schedule_slot,
  CAST(total_tokens + 1000 * n AS BIGINT) AS total_tokens, CAST(NULL AS STRING) AS share_revoked_at, '[]' AS source_split, '[]' AS top_models, '2024-02-10' AS generated_at, '2024-02-10' AS updated_at, CAST(total_tokens * 10 + n AS BIGINT) * 100000 + CAST(substr(id, 5) AS BIGINT) AS ordinal
FROM history CROSS JOIN (SELECT explode(sequence(1, 2)) AS n) WHERE n = 1 OR total_tokens % 3 = 0"""
_REPORTS_DUCK = _REPORTS.replace("explode(sequence(1, 2))", "unnest([1, 2])")
_HKEY = "h.user_id = r.user_id AND h.report_date = r.report_date AND h.schedule_slot = r.schedule_slot"


def _one_a_key(spark, d):
    """The stored history, a row a key as its table has it."""
    from meterlake.operators.accounts import first_by

    return first_by(view(spark, d, "history"), history.KEY, F.col("id"))


_STORED = ctes("history") + ", hist AS (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY user_id, report_date, schedule_slot ORDER BY id) = 1), rep AS (" + _REPORTS_DUCK.replace("FROM history", "FROM hist") + ")"


def _reports(spark, d):
    _one_a_key(spark, d).createOrReplaceTempView("facade_history")
    return spark.sql(_REPORTS.replace("FROM history", "FROM facade_history"))


@query(
    "history_prepare",
    _STORED + f""" SELECT r.ordinal, r.user_id, r.report_date, r.schedule_slot, COALESCE(h.id, (SELECT arg_min(o.id, o.ordinal) FROM rep o WHERE o.user_id = r.user_id AND o.report_date = r.report_date AND o.schedule_slot = r.schedule_slot)) AS id, h.share_revoked_at,
      h.id IS NULL AND NOT EXISTS (SELECT 1 FROM rep o WHERE o.user_id = r.user_id AND o.report_date = r.report_date AND o.schedule_slot = r.schedule_slot AND o.ordinal < r.ordinal) AS is_new FROM rep r LEFT JOIN hist h ON {_HKEY}""",
)
def _(spark, d):
    return history.prepared(_one_a_key(spark, d), _reports(spark, d))


@query("history_insert", _STORED + f" SELECT * FROM hist UNION ALL SELECT r.* EXCLUDE (ordinal) FROM rep r WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE {_HKEY}) QUALIFY row_number() OVER (PARTITION BY user_id, report_date, schedule_slot ORDER BY ordinal) = 1")
def _(spark, d):
    return history.inserted(_one_a_key(spark, d), _reports(spark, d))


@query(
    "history_save",
    _STORED + """, lst AS (SELECT user_id, report_date, schedule_slot, arg_min(id, ordinal) AS id, arg_max(total_tokens, ordinal) AS total_tokens, arg_max(source_split, ordinal) AS source_split, arg_max(top_models, ordinal) AS top_models, arg_max(generated_at, ordinal) AS generated_at, arg_max(updated_at, ordinal) AS updated_at FROM rep GROUP BY 1, 2, 3)
    SELECT COALESCE(h.id, r.id) AS id, COALESCE(h.user_id, r.user_id) AS user_id, COALESCE(h.report_date, r.report_date) AS report_date, COALESCE(h.schedule_slot, r.schedule_slot) AS schedule_slot, COALESCE(r.total_tokens, h.total_tokens) AS total_tokens, h.share_revoked_at,
      COALESCE(r.source_split, h.source_split) AS source_split, COALESCE(r.top_models, h.top_models) AS top_models, COALESCE(r.generated_at, h.generated_at) AS generated_at, COALESCE(r.updated_at, h.updated_at) AS updated_at
    FROM hist h FULL JOIN lst r ON """ + _HKEY,
)
def _(spark, d):
    return history.saved(_one_a_key(spark, d), _reports(spark, d))


@query("history_list", ctes("history") + f" SELECT id, report_date, schedule_slot, total_tokens, generated_at FROM history WHERE user_id = '{USER}' ORDER BY generated_at DESC, schedule_slot DESC, id LIMIT 31")
def _(spark, d):
    return history.listed(view(spark, d, "history"), USER).select("id", "report_date", "schedule_slot", "total_tokens", "generated_at")


@query(
    "history_cleanup",
    ctes("history", "deliveries") + """ SELECT * FROM history h WHERE NOT (CAST(substr(id, 5) AS BIGINT) % 2 = 0 AND NOT EXISTS (SELECT 1 FROM deliveries l WHERE l.user_id = h.user_id AND l.report_date = h.report_date AND l.schedule_slot = h.schedule_slot AND l.kind = 'daily' AND l.status = 'success'))""",
)
def _(spark, d):
    rows = view(spark, d, "history")
    return history.without_undelivered(rows, rows.filter("cast(substr(id, 5) as bigint) % 2 = 0").select("user_id", "id"), view(spark, d, "deliveries"))


_REVOKES = "SELECT CASE WHEN total_tokens % 4 = 0 THEN 'u0' ELSE user_id END AS user_id, id FROM history WHERE total_tokens % 2 = 0"


@query("share_revoke", ctes("history") + f", r AS ({_REVOKES}) SELECT h.* REPLACE (COALESCE(share_revoked_at, CASE WHEN r.id IS NOT NULL THEN '{NOW}' END) AS share_revoked_at, CASE WHEN r.id IS NOT NULL AND share_revoked_at IS NULL THEN '{NOW}' ELSE updated_at END AS updated_at) FROM history h LEFT JOIN r ON r.id = h.id AND r.user_id = h.user_id")
def _(spark, d):
    view(spark, d, "history").createOrReplaceTempView("facade_history")
    return history.revoked(view(spark, d, "history"), spark.sql(_REVOKES.replace("FROM history", "FROM facade_history")), NOW)


@query("share_revoke_errors", ctes("history") + f", r AS ({_REVOKES}) SELECT r.*, CASE WHEN h.id IS NULL THEN 'missing' END AS error FROM r LEFT JOIN history h ON r.id = h.id AND r.user_id = h.user_id AND h.share_revoked_at IS NULL")
def _(spark, d):
    view(spark, d, "history").createOrReplaceTempView("facade_history")
    return history.judged_revocations(view(spark, d, "history"), spark.sql(_REVOKES.replace("FROM history", "FROM facade_history")))


@query("share_switch", ctes("profiles") + f" SELECT * REPLACE (CASE WHEN length(user_id) = 3 THEN participates ELSE share_reports END AS share_reports, CASE WHEN length(user_id) = 3 THEN '{NOW}' ELSE updated_at END AS updated_at) FROM profiles")
def _(spark, d):
    rows = view(spark, d, "profiles")
    return history.share_switched(rows, rows.filter("length(user_id) = 3").select("user_id", F.col("participates").alias("on")), NOW)


@query("rate_windows_expire", "SELECT event_id AS key, event_id * 1000 AS reset_at_ms FROM events WHERE event_id * 1000 > 500000")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("key"), (F.col("event_id") * 1000).alias("reset_at_ms"))
    return history.expired_windows(e, 500_000)


@query(
    "history_parse",
    ctes("history") + """, k AS (SELECT *, CAST(substr(id, 5) AS BIGINT) AS n FROM history) SELECT id, CASE WHEN n % 4 = 3 THEN source_split ELSE '[]' END AS source_split, CASE WHEN n % 3 <> 0 THEN top_models ELSE '[]' END AS top_models,
      nullif(concat_ws('; ', CASE WHEN n % 4 <> 3 THEN 'Invalid source_split' END, CASE WHEN n % 3 = 0 THEN 'Invalid top_models' END), '') AS parse_error FROM k""",
)
def _(spark, d):
    return history.with_parse_errors(view(spark, d, "history")).select("id", "source_split", "top_models", "parse_error")


@query("delivery_log_prune", ctes("deliveries") + " SELECT * FROM deliveries WHERE report_date >= '2024-01-20'")
def _(spark, d):
    return view(spark, d, "deliveries").filter(F.col("report_date") >= "2024-01-20")
