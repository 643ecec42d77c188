"""Profiles, devices, upload tokens and pairing codes: batches of commands against tables.

A command batch is a frame with an ``ordinal``; commands of one key take effect in that
order. Every function returns the table after the batch, or the commands with their outcome,
so that a writer stores both in one step. Single writer: two batches do not run at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Bounds of names and slugs.
NAME_LENGTH, SLUG_LENGTH, SLUG_LEAST = 80, 32, 3


def first_by(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("best"))
    return best.select("best.*")


def usable_tokens(tokens: DataFrame, hashes: DataFrame) -> DataFrame:
    """Tokens by ``token_hash`` that are not revoked."""
    return tokens.filter("revoked_at is null").join(hashes.select("token_hash").distinct(), "token_hash", "left_semi")


def usable_pairings(pairings: DataFrame, codes: DataFrame, now: str) -> DataFrame:
    """Pairing codes by ``code_hash`` that are neither consumed nor expired."""
    live = pairings.filter(F.col("consumed_at").isNull() & (F.col("expires_at") > now))
    return live.join(codes.select("code_hash").distinct(), "code_hash", "left_semi")


def consume(pairings: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (``id``, ``used_at``, ``ordinal``) with ``consumed``: true for the one that uses a code up."""
    free = pairings.filter("consumed_at is null").select("id", F.lit(True).alias("free"))
    turn = F.row_number().over(W.partitionBy("id").orderBy("ordinal"))
    rows = requests.withColumn("turn", turn).join(free, "id", "left")
    return rows.withColumn("consumed", F.coalesce(F.col("free"), F.lit(False)) & (F.col("turn") == 1)).drop("free", "turn")


def consumed_pairings(pairings: DataFrame, requests: DataFrame) -> DataFrame:
    """The pairing codes after the requests."""
    used = first_by(requests, ["id"], F.col("ordinal")).select("id", "used_at")
    return pairings.join(used, "id", "left").withColumn("consumed_at", F.coalesce("consumed_at", "used_at")).select(*pairings.columns)


def touched(table: DataFrame, syncs: DataFrame, key: str, *columns: str) -> DataFrame:
    """``table`` with ``columns`` set to the last sync (``key``, ``synced_at``, ``ordinal``) of a row."""
    last = syncs.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max_by("synced_at", "ordinal").alias("last_sync"))
    rows = table.join(last, "id", "left")
    return rows.withColumns({c: F.coalesce("last_sync", c) for c in columns}).select(*table.columns)


def name_is_valid(name: Column) -> Column:
    return F.coalesce(F.length(F.trim(name)).between(1, NAME_LENGTH), F.lit(False))


def judged_renames(devices: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (``user_id``, ``id``, ``name``, ``now``, ``ordinal``) with ``error``: null, ``name`` or ``missing``."""
    known = devices.select("user_id", "id", F.lit(True).alias("known"))
    rows = requests.join(known, ["user_id", "id"], "left")
    return rows.withColumn("error", F.when(~name_is_valid(F.col("name")), "name").when(F.col("known").isNull(), "missing")).drop("known")


def renamed_devices(devices: DataFrame, requests: DataFrame) -> DataFrame:
    valid = requests.filter(name_is_valid(F.col("name")))
    last = valid.groupBy("user_id", "id").agg(F.max_by(F.struct(F.trim("name").alias("name"), "now"), "ordinal").alias("new"))
    rows = devices.join(last, ["user_id", "id"], "left")
    return rows.withColumns({"name": F.coalesce("new.name", "name"), "updated_at": F.coalesce("new.now", "updated_at")}).select(*devices.columns)


def revoked_tokens(tokens: DataFrame, requests: DataFrame) -> DataFrame:
    """Tokens after device revocations (``user_id``, ``id`` of the device, ``now``): the first revocation stays."""
    first = requests.groupBy("user_id", F.col("id").alias("device_id")).agg(F.min_by("now", "ordinal").alias("now"))
    rows = tokens.join(first, ["user_id", "device_id"], "left")
    return rows.withColumn("revoked_at", F.coalesce("revoked_at", "now")).select(*tokens.columns)


def judged_revocations(devices: DataFrame, requests: DataFrame) -> DataFrame:
    known = devices.select("user_id", "id", F.lit(True).alias("known"))
    return requests.join(known, ["user_id", "id"], "left").withColumn("error", F.when(F.col("known").isNull(), "missing")).drop("known")


def slug_of(text: Column) -> Column:
    """Lower-case letters and digits with single hyphens between."""
    dashed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def stored_slug(*candidates: Column) -> Column:
    """The first candidate whose slug is long enough, else ``user``."""
    slugs = [slug_of(c) for c in candidates]
    return F.coalesce(*(F.when(F.length(s) >= SLUG_LEAST, F.left(s, F.lit(SLUG_LENGTH))) for s in slugs), F.lit("user"))


def new_slug(name: Column, email: Column, user_id: Column) -> Column:
    """The slug of a new profile: from the name or the mail's local part, with the id's first characters."""
    named = F.coalesce(F.nullif(name, F.lit("")), F.nullif(F.split(email, "@")[0], F.lit("")), F.lit("user"))
    base = F.left(slug_of(named), F.lit(24))
    return F.concat(F.when(base == "", "user").otherwise(base), F.lit("-"), F.lower(F.left(user_id, F.lit(8))))


def ensured_profiles(profiles: DataFrame, logins: DataFrame, zones: DataFrame) -> DataFrame:
    """Profiles after logins (``user_id``, ``name``, ``email``, ``timezone``, ``now``, ``ordinal``).

    A new user gets a private profile. A time zone that nobody chose gives way to the first
    valid one a browser reports; any other stays."""
    known = F.broadcast(zones.select(F.col("zone").alias("timezone"), F.lit(True).alias("valid")).distinct())  # some 600 zone names
    rows = logins.join(known, "timezone", "left")
    per_user = rows.groupBy("user_id").agg(
        F.min_by(F.struct("name", "email", "now"), "ordinal").alias("first"),
        F.min_by(F.when(F.col("valid"), F.struct("timezone", "now")), F.when(F.col("valid"), F.col("ordinal"))).alias("browser"),
    )
    both = profiles.join(per_user, "user_id", "left")
    moved = (F.col("timezone_source") == "default") & F.col("browser").isNotNull()
    old = both.withColumns({
        "timezone": F.when(moved, F.col("browser.timezone")).otherwise(F.col("timezone")),
        "updated_at": F.when(moved, F.col("browser.now")).otherwise(F.col("updated_at")),
        "timezone_source": F.when(moved, "browser").otherwise(F.col("timezone_source")),
    }).select(*profiles.columns)
    fresh = per_user.join(profiles.select("user_id"), "user_id", "left_anti")
    made = {
        "user_id": F.col("user_id"), "slug": new_slug(F.col("first.name"), F.col("first.email"), F.col("user_id")),
        "display_name": F.coalesce(F.nullif(F.col("first.name"), F.lit("")), F.col("first.email")), "timezone": F.coalesce("browser.timezone", F.lit("UTC")),
        "timezone_source": F.when(F.col("browser").isNull(), "default").otherwise("browser"), "updated_at": F.coalesce("browser.now", "first.now"),
    } | {c: F.lit(False) for c in ("is_public", "participates", "share_reports")}
    return old.unionByName(fresh.select(*(made[c].alias(c) for c in profiles.columns)))


def judged_updates(profiles: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (``user_id``, ``slug``, ... , ``ordinal``; one a user) with ``error``: ``slug`` if another
    user holds the slug or an earlier request of the batch takes it, ``missing`` without a profile."""
    holders = profiles.groupBy("slug").agg(F.min("user_id").alias("low"), F.max("user_id").alias("high"))
    rows = requests.join(holders, "slug", "left").join(profiles.select("user_id", F.lit(True).alias("known")), "user_id", "left")
    held = F.coalesce((F.col("low") != F.col("user_id")) | (F.col("high") != F.col("user_id")), F.lit(False))
    wanted = F.when(~held & F.col("known"), F.col("ordinal"))
    earlier = F.coalesce(F.min(wanted).over(W.partitionBy("slug")) < F.col("ordinal"), F.lit(False))
    rows = rows.withColumn("error", F.when(F.col("known").isNull(), "missing").when(held | earlier, "slug"))
    return rows.drop("low", "high", "known")


def updated_profiles(profiles: DataFrame, requests: DataFrame) -> DataFrame:
    """Profiles after the accepted requests; taking part in leaderboards makes a profile public."""
    fields = ["slug", "display_name", "timezone", "is_public", "participates", "now"]
    accepted = judged_updates(profiles, requests).filter("error is null").select("user_id", F.struct(*fields).alias("new"))
    rows = profiles.join(accepted, "user_id", "left")
    there = F.col("new").isNotNull()
    new = {c: F.when(there, F.col(f"new.{c}")).otherwise(F.col(c)) for c in ("slug", "display_name", "timezone", "participates")}
    new["is_public"] = F.when(there, F.col("new.is_public") | F.col("new.participates")).otherwise(F.col("is_public"))
    new |= {"timezone_source": F.when(there, "user").otherwise(F.col("timezone_source")), "updated_at": F.when(there, F.col("new.now")).otherwise(F.col("updated_at"))}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in profiles.columns))


def repaired_profiles(profiles: DataFrame, zones: DataFrame, unnamed: str = "Unnamed user") -> DataFrame:
    """Profiles as they can be shown, with ``needs_repair`` where what is stored differs or is not valid."""
    known = F.broadcast(zones.select(F.col("zone").alias("timezone"), F.lit(True).alias("valid_zone")).distinct())  # some 600 zone names
    rows = profiles.join(known, "timezone", "left")
    name = F.trim(F.coalesce("display_name", F.lit("")))
    shown = {
        "slug": stored_slug(F.col("slug"), F.col("display_name"), F.col("user_id")),
        "display_name": F.left(F.when(name == "", unnamed).otherwise(name), F.lit(NAME_LENGTH)),
        "timezone": F.when(F.col("valid_zone"), F.col("timezone")).otherwise("UTC"),
    }
    valid = F.rlike("slug", F.lit(f"^[a-z0-9-]{{{SLUG_LEAST},{SLUG_LENGTH}}}$"))
    same = valid
    for c, x in shown.items():
        same = same & x.eqNullSafe(F.col(c))
    rows = rows.withColumn("needs_repair", ~F.coalesce(same, F.lit(False)))
    return rows.select(*(shown.get(c, F.col(c)).alias(c) for c in profiles.columns), "needs_repair")
