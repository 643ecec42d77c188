"""Report subscriptions: stored schedules, leases, the delivery state machine, edits.

Batches of commands against the table of subscriptions, as in ``accounts``. A lease is the
text of the moment at which a run claimed a row: an update that carries another is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scalars import local_date, local_time, next_run, schedule_list, wall_to_utc
from meterlake.operators.delivery import ATTEMPTS, RETRY_MINUTES, due_subscriptions

# The schedule of rows that have none, and what a slot and a weekday look like.
DEFAULT_TIME = "18:00"
TIME = r"^([01]\d|2[0-3]):[0-5]\d$"
WEEKDAY = r"^[0-6]$"
LEASE_MINUTES = 10
#: Columns that the state machine sets.
STATE = ["next_run_at", "pending_report_date", "pending_schedule_slot", "locked_until", "locked_at", "failure_count", "last_error", "last_success_at", "last_failure_at", "updated_at"]


def iso(moment: Column) -> Column:
    """A moment as text with milliseconds."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_empty(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def times_of(text: Column) -> Column:
    """Slots of a stored list, sorted; the default if it is empty, null if one is malformed."""
    found = schedule_list(F.coalesce(text, F.lit("")))
    return F.when(F.size(found) == 0, F.array(F.lit(DEFAULT_TIME))).when(F.forall(found, lambda x: x.rlike(TIME)), found)


def weekdays_of(text: Column) -> Column:
    """Weekdays of a stored list, sorted; all if it is empty, null if one is malformed."""
    found = schedule_list(F.coalesce(text, F.lit("")))
    numbers = F.array_sort(F.transform(found, lambda x: x.cast("int")))
    return F.when(F.size(found) == 0, F.sequence(F.lit(0), F.lit(6))).when(F.forall(found, lambda x: x.rlike(WEEKDAY)), numbers)


def scheduled(subscriptions: DataFrame) -> DataFrame:
    """With ``slots``, ``days`` and ``needs_repair``: a malformed list gives way to the single
    stored time, and that to the default."""
    times, single, days = (F.col(c) for c in ("schedule_times_local", "schedule_time_local", "schedule_weekdays"))
    stored = F.when(is_empty(times), single).otherwise(times)
    slots = F.coalesce(times_of(stored), times_of(single), F.array(F.lit(DEFAULT_TIME)))
    repair = times_of(stored).isNull() | is_empty(times) | weekdays_of(days).isNull() | is_empty(days)
    every = F.sequence(F.lit(0), F.lit(6))
    return subscriptions.withColumns({"slots": slots, "days": F.coalesce(weekdays_of(days), every), "needs_repair": repair})


def due_with_profile(subscriptions: DataFrame, profiles: DataFrame, now: str, limit: int = 5) -> DataFrame:
    """Due subscriptions of users with a profile, with what the report shows of it."""
    shown = profiles.select("user_id", "display_name", "share_reports")
    return due_subscriptions(subscriptions.join(shown, "user_id"), now, limit)


def claimed(subscriptions: DataFrame, wanted: DataFrame, now: str, until: str) -> DataFrame:
    """The table after a run claimed ``wanted`` (``id``); ``claimed`` tells which rows are its own."""
    asked = wanted.select("id").distinct().withColumn("asked", F.lit(True))
    free = F.col("locked_until").isNull() | (F.col("locked_until") <= now)
    mine = F.coalesce(F.col("asked") & F.col("enabled") & (F.col("next_run_at") <= now) & free, F.lit(False))
    rows = subscriptions.join(asked, "id", "left").withColumn("claimed", mine).drop("asked")
    new = {"locked_until": until, "locked_at": now, "updated_at": now}
    return rows.withColumns({c: F.when(F.col("claimed"), x).otherwise(F.col(c)) for c, x in new.items()})


def target(due: DataFrame) -> DataFrame:
    """With ``report_date`` and ``slot``: the pending ones of a retry, else those of the due moment."""
    moment = F.to_timestamp("next_run_at")
    date = F.coalesce("pending_report_date", local_date(moment, F.col("timezone")))
    slot = F.coalesce("pending_schedule_slot", F.concat(date, F.lit("T"), local_time(moment, F.col("timezone"))))
    return due.withColumns({"report_date": date, "slot": slot})


def settled(due: DataFrame, now: str) -> DataFrame:
    """The outcome and new state of deliveries.

    ``due``: :func:`scheduled` and :func:`target` rows with ``delivered`` (a success is logged for the
    slot), ``report_tokens`` and ``error`` (of sending; null if it went well). A slot that is delivered
    already or an empty report is skipped; a failure is tried again after 5 and 30 minutes, and after the
    third attempt given up for the next slot."""
    attempt = F.col("failure_count") + 1
    empty = (F.col("report_tokens") <= 0) & ~F.col("send_empty_report")
    reason = F.when(F.col("delivered"), "Already delivered").when(empty, "Empty report")
    status = F.when(reason.isNotNull(), "skipped").when(F.col("error").isNotNull(), "failure").otherwise("success")
    rows = due.withColumns({"attempt": attempt, "reason": F.coalesce(reason, F.col("error")), "status": status})
    failed, again = F.col("status") == "failure", (F.col("status") == "failure") & (F.col("attempt") < ATTEMPTS)
    moment = F.lit(now).cast("timestamp")
    wait = F.when(F.col("attempt") == 1, RETRY_MINUTES[0]).otherwise(RETRY_MINUTES[1])
    later = F.timestamp_micros(F.unix_micros(moment) + wait * F.lit(60_000_000))
    from_slot = wall_to_utc(F.try_to_timestamp("slot", F.lit("yyyy-MM-dd'T'HH:mm")), F.col("timezone"))
    after = iso(next_run(F.coalesce(from_slot, moment), F.col("timezone"), F.col("slots"), F.col("days")))
    # a retry's slot was moved on when it was left pending, unless no attempt has failed
    kept = ~failed & F.col("pending_schedule_slot").isNotNull() & (F.col("failure_count") == 0)
    new = {
        "next_run_at": F.when(again, iso(later)).when(kept, F.col("next_run_at")).otherwise(after),
        "pending_report_date": F.when(again, F.col("report_date")), "pending_schedule_slot": F.when(again, F.coalesce("pending_schedule_slot", "slot")),
        "locked_until": F.lit(None).cast("string"), "locked_at": F.lit(None).cast("string"), "failure_count": F.when(again, F.col("attempt")).otherwise(0),
        "last_error": F.when(F.col("status") == "success", None).otherwise(F.col("reason")),
        "last_success_at": F.when(F.col("status") == "success", now).otherwise(F.col("last_success_at")),
        "last_failure_at": F.when(failed, now).otherwise(F.col("last_failure_at")), "updated_at": F.lit(now),
    }
    return rows.withColumn("new", F.struct(*(new[c].alias(c) for c in STATE)))


def guarded(subscriptions: DataFrame, updates: DataFrame) -> DataFrame:
    """The table after ``updates`` (``id``, ``lease``, ``new``): only those whose lease is the row's apply."""
    fits = updates.select("id", F.col("lease").alias("locked_at"), "new")
    rows = subscriptions.join(fits, ["id", "locked_at"], "left")
    there = F.col("new").isNotNull()
    return rows.select(*((F.when(there, F.col(f"new.{c}")).otherwise(F.col(c)) if c in STATE else F.col(c)).alias(c) for c in subscriptions.columns))


def stale_updates(subscriptions: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates whose claim is no longer current."""
    return updates.join(subscriptions.select("id", F.col("locked_at").alias("lease")), ["id", "lease"], "left_anti")


def judged_edits(subscriptions: DataFrame, edits: DataFrame, zones: DataFrame, now: str) -> DataFrame:
    """``edits`` (``user_id``, ``id``, ``name``, ``timezone``, the three schedule columns, ``send_empty_report``,
    ``enabled``; one a row) with ``error``, and ``reset``: whether what schedules the row has changed."""
    old = scheduled(subscriptions).select("user_id", "id", F.struct("timezone", "enabled", "slots", "days").alias("old"))
    known = F.broadcast(zones.select(F.col("zone").alias("timezone"), F.lit(True).alias("valid")).distinct())  # some 600 zone names
    rows = edits.withColumns({"slots": times_of(F.col("schedule_times_local")), "days": weekdays_of(F.col("schedule_weekdays"))})
    rows = rows.join(known, "timezone", "left").join(old, ["user_id", "id"], "left")
    error = (
        F.when(F.col("slots").isNull() | F.col("days").isNull(), "schedule")
        .when(~F.coalesce(F.length(F.trim("name")).between(1, 80), F.lit(False)), "name")
        .when(F.col("valid").isNull(), "timezone")
        .when(F.col("old").isNull(), "missing")
    )
    reset = (F.col("old.enabled") != F.col("enabled")) | (F.col("old.timezone") != F.col("timezone")) | (F.col("old.slots") != F.col("slots")) | (F.col("old.days") != F.col("days"))
    moment = F.lit(now).cast("timestamp")
    upcoming = iso(next_run(moment, F.col("timezone"), F.col("slots"), F.col("days")))
    return rows.withColumns({"error": error, "reset": F.col("old").isNotNull() & reset}).withColumn("upcoming", F.when(F.col("error").isNull(), upcoming)).drop("old", "valid")


def edited(subscriptions: DataFrame, judged: DataFrame, now: str) -> DataFrame:
    """The table after the edits without error; a reset row forgets its retry, lease and failures."""
    fields = ["name", "timezone", "slots", "days", "send_empty_report", "enabled", "reset", "upcoming"]
    rows = subscriptions.join(judged.filter("error is null").select("user_id", "id", F.struct(*fields).alias("e")), ["user_id", "id"], "left")
    there, reset = F.col("e").isNotNull(), F.coalesce(F.col("e.reset"), F.lit(False))
    given = {
        "name": F.trim("e.name"), "timezone": F.col("e.timezone"), "schedule_time_local": F.col("e.slots")[0], "schedule_times_local": F.array_join("e.slots", ","),
        "schedule_weekdays": F.array_join(F.transform("e.days", lambda x: x.cast("string")), ","), "send_empty_report": F.col("e.send_empty_report"), "enabled": F.col("e.enabled"), "updated_at": F.lit(now),
    }
    cleared = {c: F.lit(None).cast("string") for c in ("pending_report_date", "pending_schedule_slot", "locked_until", "locked_at")}
    cleared |= {"failure_count": F.lit(0), "next_run_at": F.col("e.upcoming")}
    value = lambda c: F.when(there, given[c]).otherwise(F.col(c)) if c in given else F.when(reset, cleared[c]).otherwise(F.col(c)) if c in cleared else F.col(c)
    return rows.select(*(value(c).alias(c) for c in subscriptions.columns))


def switched(subscriptions: DataFrame, switches: DataFrame, now: str) -> DataFrame:
    """The table after ``switches`` (``user_id``, ``id``, ``on``; one a row): switching on computes the next run
    and forgets failures, either way forgets the retry and the lease."""
    rows = scheduled(subscriptions).join(switches.select("user_id", "id", F.col("on").alias("turn")), ["user_id", "id"], "left")
    there, on = F.col("turn").isNotNull(), F.coalesce(F.col("turn"), F.lit(False))
    upcoming = iso(next_run(F.lit(now).cast("timestamp"), F.col("timezone"), F.col("slots"), F.col("days")))
    new = {"enabled": F.coalesce("turn", "enabled"), "next_run_at": F.when(on, upcoming).otherwise(F.col("next_run_at")), "failure_count": F.when(on, 0).otherwise(F.col("failure_count"))}
    new |= {"last_error": F.when(on, None).otherwise(F.col("last_error")), "updated_at": F.when(there, now).otherwise(F.col("updated_at"))}
    new |= {c: F.when(there, None).otherwise(F.col(c)) for c in ("pending_report_date", "pending_schedule_slot", "locked_until", "locked_at")}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in subscriptions.columns))


def created(subscriptions: DataFrame, forms: DataFrame, now: str) -> DataFrame:
    """The table with new rows of ``forms`` (``id``, ``user_id``, ``name``, ``timezone``, the schedule, ``send_empty_report``, ``enabled``)."""
    rows = forms.withColumns({"slots": times_of(F.col("schedule_times_local")), "days": weekdays_of(F.col("schedule_weekdays"))}).filter("slots is not null and days is not null")
    new = {
        "schedule_time_local": F.col("slots")[0], "schedule_times_local": F.array_join("slots", ","), "schedule_weekdays": F.array_join(F.transform("days", lambda x: x.cast("string")), ","),
        "next_run_at": iso(next_run(F.lit(now).cast("timestamp"), F.col("timezone"), F.col("slots"), F.col("days"))), "failure_count": F.lit(0), "created_at": F.lit(now), "updated_at": F.lit(now),
    }
    given = set(forms.columns)
    made = [(new[c] if c in new else F.col(c) if c in given else F.lit(None).cast(t)).alias(c) for c, t in subscriptions.dtypes]
    return subscriptions.unionByName(rows.select(*made))


def deleted(subscriptions: DataFrame, requests: DataFrame) -> DataFrame:
    """The table without the rows that their owner deletes (``user_id``, ``id``)."""
    return subscriptions.join(requests.select("user_id", "id"), ["user_id", "id"], "left_anti").select(*subscriptions.columns)
