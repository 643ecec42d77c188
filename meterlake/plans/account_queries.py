"""Accounts: tokens, pairing codes, devices, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import accounts
from meterlake.plans.registry import NOW, query
from meterlake.sources.facade import ctes, view


def zones(spark):
    return spark.createDataFrame([(z,) for z in ("UTC", "America/New_York", "Asia/Shanghai", "Europe/London", "Europe/Berlin")], "zone string")


_ZONES = "('UTC', 'America/New_York', 'Asia/Shanghai', 'Europe/London', 'Europe/Berlin')"


@query("usable_tokens", ctes("tokens") + " SELECT *, sha256(id) AS token_hash FROM tokens WHERE revoked_at IS NULL AND id IN (SELECT 'tok_' || CAST(p_partkey * 3 AS STRING) FROM part)")
def _(spark, d):
    tokens = view(spark, d, "tokens").withColumn("token_hash", F.sha2("id", 256))
    part = spark.read.parquet(f"{d}/part.parquet")
    asked = part.select(F.sha2(F.concat(F.lit("tok_"), (F.col("p_partkey") * 3).cast("string")), 256).alias("token_hash"))
    return accounts.usable_tokens(tokens, asked)


@query("usable_pairings", ctes("pairings") + f" SELECT * FROM pairings WHERE consumed_at IS NULL AND expires_at > '{NOW}' AND code_hash IN (SELECT 'code' || CAST(s_suppkey * 2 AS STRING) FROM supplier)")
def _(spark, d):
    asked = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("code"), (F.col("s_suppkey") * 2).cast("string")).alias("code_hash"))
    return accounts.usable_pairings(view(spark, d, "pairings"), asked, NOW)


#: Every code is asked for up to three times, some that are not there.
_ASKS = "SELECT 'pc_' || CAST(p_partkey % 40 AS STRING) AS id, '2024-01-1' || CAST(p_partkey % 10 AS STRING) AS used_at, p_partkey AS ordinal FROM part WHERE p_partkey % 2 = 0"


def _asks(spark, d):
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("facade_part")
    return spark.sql(_ASKS.replace("FROM part", "FROM facade_part"))


@query("pairing_consume", ctes("pairings") + f", a AS ({_ASKS}) SELECT a.*, COALESCE(p.id IS NOT NULL AND a.ordinal = (SELECT MIN(b.ordinal) FROM a b WHERE b.id = a.id), false) AS consumed FROM a LEFT JOIN pairings p ON p.id = a.id AND p.consumed_at IS NULL")
def _(spark, d):
    return accounts.consume(view(spark, d, "pairings"), _asks(spark, d))


@query("pairing_consume_state", ctes("pairings") + f", a AS ({_ASKS}) SELECT p.* REPLACE (COALESCE(consumed_at, (SELECT arg_min(used_at, ordinal) FROM a WHERE a.id = p.id)) AS consumed_at) FROM pairings p")
def _(spark, d):
    return accounts.consumed_pairings(view(spark, d, "pairings"), _asks(spark, d))


_SYNCS = "SELECT 'dev_' || CAST(p_partkey % 30 AS STRING) AS device_id, 'tok_' || CAST(p_partkey % 50 AS STRING) AS token_id, '2024-02-' || lpad(CAST(1 + p_partkey % 28 AS STRING), 2, '0') AS synced_at, p_partkey AS ordinal FROM part WHERE p_partkey % 3 = 0"


def _syncs(spark, d):
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("facade_part")
    return spark.sql(_SYNCS.replace("FROM part", "FROM facade_part"))


@query("device_touch", ctes("devices") + f", s AS ({_SYNCS}) SELECT d.* REPLACE (COALESCE((SELECT arg_max(synced_at, ordinal) FROM s WHERE s.device_id = d.id), last_synced_at) AS last_synced_at) FROM devices d")
def _(spark, d):
    return accounts.touched(view(spark, d, "devices"), _syncs(spark, d), "device_id", "last_synced_at")


@query("token_touch", ctes("tokens") + f", s AS ({_SYNCS}) SELECT t.*, (SELECT arg_max(synced_at, ordinal) FROM s WHERE s.token_id = t.id) AS last_used_at FROM tokens t")
def _(spark, d):
    tokens = view(spark, d, "tokens").withColumn("last_used_at", F.lit(None).cast("string"))
    return accounts.touched(tokens, _syncs(spark, d), "token_id", "last_used_at")


#: Renames: blank and overlong names, devices of others, two for one device.
_RENAMES = """SELECT 'u' || CAST((p_partkey + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END) % 15 AS STRING) AS user_id, 'dev_' || CAST(p_partkey % 40 AS STRING) AS id,
  CASE p_partkey % 5 WHEN 0 THEN '   ' WHEN 1 THEN repeat('x', 81) ELSE ' laptop ' || CAST(p_partkey AS STRING) END AS name, '2024-02-01' AS now, p_partkey AS ordinal FROM part"""


def _renames(spark, d):
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("facade_part")
    return spark.sql(_RENAMES.replace("FROM part", "FROM facade_part"))


@query("device_rename", ctes("devices") + f", r AS ({_RENAMES}) SELECT r.*, CASE WHEN length(trim(name)) NOT BETWEEN 1 AND 80 THEN 'name' WHEN NOT EXISTS (SELECT 1 FROM devices d WHERE d.id = r.id AND d.user_id = r.user_id) THEN 'missing' END AS error FROM r")
def _(spark, d):
    return accounts.judged_renames(view(spark, d, "devices"), _renames(spark, d))


@query(
    "device_rename_state",
    ctes("devices") + f", r AS ({_RENAMES}), l AS (SELECT user_id, id, arg_max(trim(name), ordinal) AS new, arg_max(now, ordinal) AS now FROM r WHERE length(trim(name)) BETWEEN 1 AND 80 GROUP BY 1, 2) "
    "SELECT d.* REPLACE (COALESCE(l.new, d.name) AS name), l.now AS updated_at FROM devices d LEFT JOIN l ON l.id = d.id AND l.user_id = d.user_id",
)
def _(spark, d):
    devices = view(spark, d, "devices").withColumn("updated_at", F.lit(None).cast("string"))
    return accounts.renamed_devices(devices, _renames(spark, d))


@query(
    "device_revoke_tokens",
    ctes("tokens") + f", r AS ({_RENAMES}) SELECT t.* REPLACE (COALESCE(revoked_at, (SELECT MIN(now) FROM r WHERE r.id = t.device_id AND r.user_id = t.user_id)) AS revoked_at) FROM tokens t",
)
def _(spark, d):
    return accounts.revoked_tokens(view(spark, d, "tokens"), _renames(spark, d))


@query("device_revoke", ctes("devices") + f", r AS ({_RENAMES}) SELECT r.*, CASE WHEN d.id IS NULL THEN 'missing' END AS error FROM r LEFT JOIN devices d ON d.id = r.id AND d.user_id = r.user_id")
def _(spark, d):
    return accounts.judged_revocations(view(spark, d, "devices"), _renames(spark, d))


#: Logins of users with a profile and without, with valid, unknown and no time zones.
_LOGINS = """SELECT 'u' || CAST(p_partkey AS STRING) AS user_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Ann ' || p_brand || '!' END AS name, 'ann.' || CAST(p_partkey AS STRING) || '@example.org' AS email,
  CASE p_partkey % 4 WHEN 0 THEN 'Europe/Berlin' WHEN 1 THEN 'Nowhere/Town' WHEN 2 THEN NULL ELSE 'Asia/Shanghai' END AS timezone, '2024-02-01' AS now, 1 AS ordinal FROM part
  UNION ALL SELECT 'u' || CAST(p_partkey AS STRING), 'Later', 'later@example.org', 'Europe/London', '2024-02-02', 2 FROM part WHERE p_partkey % 5 = 0"""


@query(
    "profile_ensure",
    ctes("profiles") + f""", l AS ({_LOGINS}), g AS (SELECT user_id, arg_min(name, ordinal) AS name, arg_min(email, ordinal) AS email, MIN(now) AS now,
      arg_min(timezone, ordinal) FILTER (timezone IN {_ZONES}) AS zone, arg_min(now, ordinal) FILTER (timezone IN {_ZONES}) AS zone_at FROM l GROUP BY 1)
    SELECT p.* REPLACE (CASE WHEN timezone_source = 'default' AND zone IS NOT NULL THEN zone ELSE timezone END AS timezone,
      CASE WHEN timezone_source = 'default' AND zone IS NOT NULL THEN 'browser' ELSE timezone_source END AS timezone_source,
      CASE WHEN timezone_source = 'default' AND zone IS NOT NULL THEN zone_at ELSE p.updated_at END AS updated_at) FROM profiles p LEFT JOIN g ON g.user_id = p.user_id
    UNION ALL SELECT user_id, left(regexp_replace(regexp_replace(lower(CASE WHEN name <> '' THEN name ELSE split_part(email, '@', 1) END), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 24) || '-' || lower(left(user_id, 8)),
      CASE WHEN name <> '' THEN name ELSE email END, COALESCE(zone, 'UTC'), CASE WHEN zone IS NULL THEN 'default' ELSE 'browser' END, false, false, false, COALESCE(zone_at, now)
    FROM g WHERE user_id NOT IN (SELECT user_id FROM profiles)""",
)
def _(spark, d):
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("facade_part")
    return accounts.ensured_profiles(view(spark, d, "profiles"), spark.sql(_LOGINS.replace("FROM part", "FROM facade_part")), zones(spark))


#: Requests for own, free, taken and twice wanted slugs.
_UPDATES = """SELECT 'u' || CAST(p_partkey AS STRING) AS user_id, CASE p_partkey % 4 WHEN 0 THEN 'user-' || CAST(p_partkey AS STRING) WHEN 1 THEN 'user-' || CAST(p_partkey + 1 AS STRING) WHEN 2 THEN 'new-' || CAST(p_partkey AS STRING) ELSE 'wanted-' || CAST(p_partkey % 16 AS STRING) END AS slug,
  'Name ' || CAST(p_partkey AS STRING) AS display_name, 'Europe/Berlin' AS timezone, p_partkey % 2 = 0 AS is_public, p_partkey % 3 = 0 AS participates, '2024-02-01' AS now, p_partkey AS ordinal FROM part"""
_JUDGED = f"""r AS ({_UPDATES}), h AS (SELECT r.*, EXISTS (SELECT 1 FROM profiles p WHERE p.slug = r.slug AND p.user_id <> r.user_id) AS held, EXISTS (SELECT 1 FROM profiles p WHERE p.user_id = r.user_id) AS known FROM r),
    j AS (SELECT h.* EXCLUDE (held, known), CASE WHEN NOT known THEN 'missing' WHEN held OR EXISTS (SELECT 1 FROM h o WHERE o.slug = h.slug AND o.ordinal < h.ordinal AND o.known AND NOT o.held) THEN 'slug' END AS error FROM h)"""


def _updates(spark, d):
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("facade_part")
    return spark.sql(_UPDATES.replace("FROM part", "FROM facade_part"))


@query("profile_update", ctes("profiles") + f", {_JUDGED} SELECT * FROM j")
def _(spark, d):
    return accounts.judged_updates(view(spark, d, "profiles"), _updates(spark, d))


@query(
    "profile_update_state",
    ctes("profiles") + f""", {_JUDGED} SELECT p.* REPLACE (COALESCE(j.slug, p.slug) AS slug, COALESCE(j.display_name, p.display_name) AS display_name, COALESCE(j.timezone, p.timezone) AS timezone,
      CASE WHEN j.user_id IS NULL THEN p.timezone_source ELSE 'user' END AS timezone_source, COALESCE(j.is_public OR j.participates, p.is_public) AS is_public, COALESCE(j.participates, p.participates) AS participates, COALESCE(j.now, p.updated_at) AS updated_at)
    FROM profiles p LEFT JOIN (SELECT * FROM j WHERE error IS NULL) j ON j.user_id = p.user_id""",
)
def _(spark, d):
    return accounts.updated_profiles(view(spark, d, "profiles"), _updates(spark, d))


#: Stored profiles that old versions left: odd slugs, blank names, unknown zones.
_STORED = """SELECT user_id, CASE WHEN length(user_id) % 2 = 0 THEN slug ELSE '--' END AS slug, CASE WHEN is_public THEN '  ' || display_name || ' ' ELSE '' END AS display_name,
  CASE WHEN participates THEN timezone ELSE 'Mars/Base' END AS timezone FROM profiles"""
_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    "profile_repair",
    ctes("profiles") + f""", s AS ({_STORED}), c AS (SELECT *, list_filter([{_SLUG.format('slug')}, {_SLUG.format('display_name')}, {_SLUG.format('user_id')}], lambda x: length(x) >= 3) AS found,
      CASE WHEN trim(display_name) = '' THEN 'Unnamed user' ELSE left(trim(display_name), 80) END AS name, CASE WHEN timezone IN {_ZONES} THEN timezone ELSE 'UTC' END AS zone FROM s)
    SELECT user_id, COALESCE(left(found[1], 32), 'user') AS slug, name AS display_name, zone AS timezone,
      NOT (regexp_full_match(slug, '[a-z0-9-]{{3,32}}') AND slug = COALESCE(left(found[1], 32), 'user') AND display_name = name AND timezone = zone) AS needs_repair FROM c""",
)
def _(spark, d):
    view(spark, d, "profiles").createOrReplaceTempView("facade_profiles")
    return accounts.repaired_profiles(spark.sql(_STORED.replace("FROM profiles", "FROM facade_profiles")), zones(spark))
