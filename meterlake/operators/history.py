"""Report history and its sharing, delivery log and retention.

A report is one row a (user, date, slot). Preparing a share inserts it unless it is there;
a successful delivery overwrites what it shows, but never a revocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.operators.accounts import first_by

KEY = ["user_id", "report_date", "schedule_slot"]
#: Fixed value: reports that a user's list shows.
LISTED = 31


def prepared(history: DataFrame, reports: DataFrame) -> DataFrame:
    """``reports`` (history columns and ``ordinal``) as they are shared: the id and revocation that is stored,
    and ``is_new`` for the first report of a key that is not."""
    stored = history.select(*KEY, F.struct("id", "share_revoked_at").alias("old"))
    first = reports.groupBy(*KEY).agg(F.min("ordinal").alias("first"), F.min_by("id", "ordinal").alias("first_id"))
    rows = reports.join(first, KEY).join(stored, KEY, "left")
    return rows.select(
        "ordinal", *KEY, F.coalesce("old.id", "first_id").alias("id"), F.col("old.share_revoked_at").alias("share_revoked_at"),
        (F.col("old").isNull() & (F.col("ordinal") == F.col("first"))).alias("is_new"),
    )


def inserted(history: DataFrame, reports: DataFrame) -> DataFrame:
    """The history with the first report of each key that it does not hold."""
    fresh = first_by(reports, KEY, F.col("ordinal")).join(history.select(*KEY), KEY, "left_anti")
    return history.unionByName(fresh.select(*history.columns))


def saved(history: DataFrame, reports: DataFrame) -> DataFrame:
    """The history after successful deliveries: the last report of a key is what is shown; a row that is
    there keeps its id and revocation."""
    shown = [c for c in history.columns if c not in (*KEY, "id", "share_revoked_at")]
    last = first_by(reports, KEY, -F.col("ordinal"))
    ids = reports.groupBy(*KEY).agg(F.min_by("id", "ordinal").alias("id"))
    new = last.drop("id").join(ids, KEY).select(*KEY, F.struct("id", "share_revoked_at", *shown).alias("new"))
    rows = history.withColumn("there", F.lit(True)).join(new, KEY, "full")
    value = lambda c: F.coalesce(f"new.{c}", c) if c in shown else F.when(F.col("there"), F.col(c)).otherwise(F.col(f"new.{c}"))
    return rows.select(*(F.col(c) if c in KEY else value(c).alias(c) for c in history.columns))


def listed(history: DataFrame, user: str, limit: int = LISTED) -> DataFrame:
    """A user's reports, newest first."""
    return history.filter(F.col("user_id") == user).orderBy(F.desc("generated_at"), F.desc("schedule_slot"), "id").limit(limit)


def without_undelivered(history: DataFrame, shares: DataFrame, log: DataFrame) -> DataFrame:
    """The history less prepared shares (``user_id``, ``id``) whose slot has no successful daily delivery."""
    done = log.filter("kind = 'daily' and status = 'success'").select(*KEY).distinct()
    gone = history.join(shares.select("user_id", "id"), ["user_id", "id"], "left_semi").join(done, KEY, "left_anti").select("user_id", "id")
    return history.join(gone, ["user_id", "id"], "left_anti").select(*history.columns)


def revoked(history: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """The history after its owners revoke reports (``user_id``, ``id``); a first revocation stays."""
    asked = requests.select("user_id", "id").distinct().withColumn("asked", F.lit(True))
    rows = history.join(asked, ["user_id", "id"], "left")
    hit = F.col("asked") & F.col("share_revoked_at").isNull()
    new = {"share_revoked_at": F.when(hit, now).otherwise(F.col("share_revoked_at")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in history.columns))


def judged_revocations(history: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` with ``error``: ``missing`` if there is no such report or it is revoked already."""
    live = history.filter("share_revoked_at is null").select("user_id", "id", F.lit(True).alias("live"))
    return requests.join(live, ["user_id", "id"], "left").withColumn("error", F.when(F.col("live").isNull(), "missing")).drop("live")


def share_switched(profiles: DataFrame, switches: DataFrame, now: str) -> DataFrame:
    """Profiles after users switch sharing (``user_id``, ``on``) on or off."""
    rows = profiles.join(switches.select("user_id", F.col("on").alias("turn")), "user_id", "left")
    new = {"share_reports": F.coalesce("turn", "share_reports"), "updated_at": F.when(F.col("turn").isNotNull(), now).otherwise(F.col("updated_at"))}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in profiles.columns))


def expired_windows(windows: DataFrame, now_ms: int) -> DataFrame:
    """Rate windows that are still open."""
    return windows.filter(F.col("reset_at_ms") > now_ms)


def parsed_list(text: Column, words: tuple[str, ...], numbers: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    """Whether a stored text is a JSON list of objects with these members; a null or malformed text is not."""
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")

    def kind(item: Column, name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")), F.lit("ABSENT"))

    def good(item: Column) -> Column:
        ok = F.schema_of_variant(item).startswith("OBJECT")
        for name in words:
            ok = ok & (kind(item, name) == "STRING")
        for name in (*numbers, *optional):
            number = kind(item, name).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
            ok = ok & (number | (kind(item, name) == "ABSENT") if name in optional else number)
        return F.coalesce(ok, F.lit(False))

    return F.coalesce(F.forall(items, good), F.lit(False))


def with_parse_errors(history: DataFrame) -> DataFrame:
    """Reports with ``parse_error``: which stored lists cannot be read; such reports are shown without them."""
    tokens = ("totalTokens", "totalTokensWithoutCacheRead")
    good = {
        "source_split": parsed_list(F.col("source_split"), ("source",), tokens, ("cacheReadRate",)),
        "top_models": parsed_list(F.col("top_models"), ("model",), (*tokens, "costUsd"), ("cacheReadRate",)),
    }
    bad = F.concat_ws("; ", *(F.when(~ok, F.lit(f"Invalid {c}")) for c, ok in good.items()))
    return history.withColumns({c: F.when(ok, F.col(c)).otherwise("[]") for c, ok in good.items()} | {"parse_error": F.nullif(bad, F.lit(""))})
