"""Dashboard, trend, details, leaderboards, public totals, reports and device lists.

``today`` and other moments are arguments; nothing here reads a clock or collects rows."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.scalars import cache_read_rate, cost_usd, csv_field, js_number, like_anywhere, round_half_up
from meterlake.functions.text import bar_height, share_text, trend_height
from meterlake.operators.facts import Scope, dedupe_legacy, effective_summary, sums, with_net
from meterlake.schema import SOURCES, SUMMED


def rate(prefix: str = "") -> Column:
    return cache_read_rate(F.col(f"{prefix}total_tokens"), F.col(f"{prefix}tokens_without_cache_read"))


def _when_sum(test: Column, name: str, alias: str) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col(name)).otherwise(0)), F.lit(0)).cast("bigint").alias(alias)


def ordered_json(rows: DataFrame, by: str, limit: int | None = None) -> Column:
    """Aggregate: JSON list of ``by`` and token sums, largest first, then by name."""
    item = F.struct((-F.col("tokens_without_cache_read")).alias("a"), (-F.col("total_tokens")).alias("b"), F.col(by).alias(by), "total_tokens", "tokens_without_cache_read")
    items = F.array_sort(F.collect_list(item))
    if limit:
        items = F.slice(items, 1, limit)
    plain = F.transform(items, lambda x: F.struct(x[by].alias(by), x["total_tokens"].alias("tokens"), x["tokens_without_cache_read"].alias("net")))
    return F.to_json(plain)


def dashboard_summary(usage: DataFrame, summary: DataFrame, devices: DataFrame, user: str, today: str, strict: bool = False) -> DataFrame:
    """One row: today, this month (without upper bound), devices, and the split by source as JSON."""
    month = today[:8] + "01"
    rows = effective_summary(usage, summary, Scope(user=user, start=month), strict)
    day = F.col("usage_date") == today
    both = rows.groupBy("source").agg(
        *sums(["total_tokens", "tokens_without_cache_read", "cost_micros"]),
        *(_when_sum(day, c, f"today_{c}") for c in ("total_tokens", "tokens_without_cache_read", "cost_micros")),
    )
    names = ["total_tokens", "tokens_without_cache_read", "cost_micros"]
    totals = both.agg(
        *(F.coalesce(F.sum(f"today_{c}"), F.lit(0)).cast("bigint").alias(f"today_{c}") for c in names),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"month_{c}") for c in names),
        ordered_json(both, "source").alias("source_split"),
    )
    mine = devices.filter(F.col("user_id") == user).agg(F.max("last_synced_at").alias("last_synced_at"), F.count("*").alias("device_count"))
    # two relations of one row each
    return totals.crossJoin(F.broadcast(mine)).select(
        F.lit(user).alias("user_id"),
        *[f"{p}_{c}" for p in ("today", "month") for c in names[:2]],
        *(rate(f"{p}_").alias(f"{p}_cache_rate") for p in ("today", "month")),
        *(cost_usd(f"{p}_cost_micros").alias(f"{p}_cost_usd") for p in ("today", "month")),
        "last_synced_at", "device_count", "source_split",
    )


def days(spark, start: str, end: str) -> DataFrame:
    """The calendar days of a range, as text."""
    every = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return every.select(F.col("day").cast("string").alias("usage_date"))


def daily_trend(usage: DataFrame, summary: DataFrame, user: str, start: str, end: str, strict: bool = False) -> DataFrame:
    """A row a day, zeros where nothing is known."""
    names = ["total_tokens", "tokens_without_cache_read", "cost_micros"]
    found = effective_summary(usage, summary, Scope(user=user, start=start, end=end), strict).groupBy("usage_date").agg(*sums(names))
    filled = days(usage.sparkSession, start, end).join(F.broadcast(found), "usage_date", "left")  # at most a row a day
    filled = filled.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in names})
    return filled.select("usage_date", *names[:2], rate().alias("cache_rate"), cost_usd("cost_micros").alias("cost_usd")).orderBy("usage_date")


def device_filter(device: str | None) -> str | None:
    """None for all devices: blank, any spelling of "all", and malformed ids."""
    text = (device or "").strip()
    return None if not text or text.lower() == "all" or not re.fullmatch(r"[A-Za-z0-9_-]{1,128}", text) else text


def details_base(usage: DataFrame, user: str, start: str, end: str, source: str = "all", device: str | None = None, model: str = "") -> DataFrame:
    """Raw rows of one device, or all devices' rows without shadowed ones."""
    if start > end:
        start, end = end, start
    scoped = Scope(user=user, start=start, end=end, source=source).apply(usage)
    one = device_filter(device)
    rows = scoped.filter(F.col("device_id") == one) if one else dedupe_legacy(scoped)
    if model.strip():
        rows = rows.filter(like_anywhere(F.col("model"), model.strip()))
    return with_net(rows)


def details_daily_source(base: DataFrame) -> DataFrame:
    found = base.groupBy("usage_date", "source").agg(*sums(["total_tokens", "tokens_without_cache_read", "cost_micros", "session_count"]))
    return found.withColumn("cache_rate", rate()).withColumn("cost_usd", cost_usd("cost_micros")).drop("cost_micros").orderBy("usage_date", "source")


def details_models(base: DataFrame) -> DataFrame:
    found = base.groupBy("usage_date", "source", "model").agg(*sums(SUMMED))
    found = found.withColumn("cache_rate", rate()).withColumn("cost_usd", cost_usd("cost_micros")).drop("cost_micros")
    return found.orderBy(F.desc("usage_date"), F.desc("total_tokens"), "model", "source")


def day_rows(base: DataFrame) -> DataFrame:
    """A row a day that has usage, with its sources and models as lists.

    A day's cost is rounded to four places after each source, in the sources' order."""
    by = base.groupBy("usage_date", "source", "model").agg(*sums(SUMMED)).withColumn("cost_usd", cost_usd("cost_micros"))
    names = ["total_tokens", "tokens_without_cache_read", "cost_micros", "session_count"]
    split = by.groupBy("usage_date", "source").agg(*sums(names)).withColumn("cost_usd", cost_usd("cost_micros"))
    entry = F.struct("source", "total_tokens", "tokens_without_cache_read", rate().alias("cache_rate"), "cost_usd")
    day = split.groupBy("usage_date").agg(*sums([n for n in names if n != "cost_micros"]), F.array_sort(F.collect_list(entry)).alias("sources"))
    parts = [c for c in SUMMED if c != "cost_micros"]
    item = F.struct((-F.col("total_tokens")).alias("order"), "model", "source", *parts, rate().alias("cache_rate"), "cost_usd")
    models = by.groupBy("usage_date").agg(F.array_sort(F.collect_list(item)).alias("models"))
    cost = F.aggregate("sources", F.lit(0.0), lambda held, x: round_half_up(held + x["cost_usd"]))
    return day.withColumns({"cost_usd": cost, "cache_rate": rate()}).join(models, "usage_date")


def details_range_summary(base: DataFrame) -> DataFrame:
    """One row over the range's days; the cost is rounded to four places."""
    found = day_rows(base)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    names = ["total_tokens", "tokens_without_cache_read", "session_count"]
    cost = round_half_up(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).alias("cost_usd")
    whole = found.agg(*map(zero, names), cost, F.count_if(F.col("total_tokens") > 0).alias("active_days"))
    return whole.select(*names[:2], rate().alias("cache_rate"), "cost_usd", "session_count", "active_days")


def details_days(base: DataFrame, start: str, end: str) -> DataFrame:
    """A row a day of the range, zeros and empty lists where nothing is known."""
    found = day_rows(base)
    filled = days(base.sparkSession, start, end).join(found, "usage_date", "left")
    number = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("total_tokens", "tokens_without_cache_read", "session_count")}
    number |= {c: F.coalesce(c, F.lit(0.0)) for c in ("cache_rate", "cost_usd")}
    kinds = dict(found.dtypes)
    lists = {c: F.coalesce(c, F.array().cast(kinds[c])) for c in ("sources", "models")}
    return filled.select("usage_date", *(x.alias(c) for c, x in (number | lists).items())).orderBy("usage_date")


def details_day_sources(base: DataFrame, start: str, end: str) -> DataFrame:
    """The days' sources, a row each."""
    rows = details_days(base, start, end).select("usage_date", F.posexplode("sources").alias("position", "x"))
    return rows.select("usage_date", "position", "x.source", "x.total_tokens", "x.tokens_without_cache_read", "x.cache_rate")


def details_day_models(base: DataFrame, start: str, end: str) -> DataFrame:
    """The days' models, a row each, the largest first."""
    rows = details_days(base, start, end).select("usage_date", F.posexplode("models").alias("position", "x"))
    return rows.select("usage_date", "position", "x.*").drop("order")


def parse_filters(asked: dict[str, str], now: date) -> dict[str, str]:
    """Arguments of :func:`details_base` from a request's text: the last 30 days unless dates are
    given, all sources for one that is not known, a reversed range turned."""
    iso = lambda name, other: text if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text := asked.get(name) or "") else other
    start, end = iso("start", str(now - timedelta(days=29))), iso("end", str(now))
    source = asked.get("source")
    return {
        "source": source if source in SOURCES else "all",
        "start": min(start, end),
        "end": max(start, end),
        "device": asked.get("device") or "",
        "model": (asked.get("model") or "").strip(),
    }


CSV_COLUMNS = {
    "date": "usage_date", "source": "source", "model": "model", "input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_creation_tokens": "cache_creation_tokens",
    "cache_read_tokens": "cache_read_tokens", "cache_read_rate": "cache_rate", "total_tokens_without_cache_read": "tokens_without_cache_read", "total_tokens": "total_tokens",
    "cost_usd": "cost_usd", "session_count": "session_count",
}
CSV_HEADER = ",".join(CSV_COLUMNS)


def details_csv_rows(models: DataFrame) -> DataFrame:
    """A CSV line a model row, in the details' order (``position`` from 1; the header is 0)."""
    from pyspark.sql import Window as W

    order = W.orderBy(F.desc("usage_date"), F.desc("total_tokens"), "model", "source")  # one user's range
    text = {"string": lambda c: csv_field(F.col(c)), "double": lambda c: js_number(F.col(c)), "bigint": lambda c: F.col(c).cast("string")}
    kinds = dict(models.dtypes)
    lines = models.select(F.row_number().over(order).alias("position"), F.concat_ws(",", *(text[kinds[c]](c) for c in CSV_COLUMNS.values())).alias("line"))
    head = models.sparkSession.range(1).select(F.lit(0).alias("position"), F.lit(CSV_HEADER).alias("line"))
    return head.unionByName(lines).orderBy("position")


def details_csv_document(models: DataFrame) -> DataFrame:
    """The whole document of one user's range: lines joined by line feeds, none at the end."""
    lines = F.array_sort(F.collect_list(F.struct("position", "line")))
    return details_csv_rows(models).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("document"))


def trend_shares(base: DataFrame) -> DataFrame:
    """The days' shares of a range's tokens as text, and the heights and widths of their bars."""
    daily = base.groupBy("usage_date").agg(F.sum("total_tokens").alias("total_tokens"))
    whole = daily.agg(F.max("total_tokens").alias("most"), F.sum("total_tokens").alias("whole"))
    rows = daily.crossJoin(F.broadcast(whole))  # one row
    value, total = F.col("total_tokens"), F.col("whole")
    return rows.select(
        "usage_date", "total_tokens", share_text(value, total).alias("share"),
        trend_height(value, F.col("most")).cast("bigint").alias("height"), bar_height(value, total).cast("bigint").alias("width"),
    )


def report_rows(usage: DataFrame, profiles: DataFrame, day: str) -> DataFrame:
    """What every user's message of a day says, a row a user with usage."""
    base = with_net(dedupe_legacy(usage.filter(F.col("usage_date") == day)))
    names = ["total_tokens", "tokens_without_cache_read", "cost_micros", "session_count"]

    def largest(key: str) -> DataFrame:
        by = base.groupBy("user_id", key).agg(*sums(names))
        order = [(-F.col(c)).alias(f"o_{c}") for c in ("tokens_without_cache_read", "total_tokens")]
        entry = F.struct(*order, F.col(key).alias("name"), F.col("total_tokens").alias("tokens"), F.col("tokens_without_cache_read").alias("net"), rate().alias("rate"), cost_usd("cost_micros").alias("cost"))
        return by.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias(f"{key}s"))  # a user's sources or models of a day

    rows = base.groupBy("user_id").agg(*sums(names)).join(profiles.select("user_id", "display_name", "timezone"), "user_id")
    rows = rows.join(largest("source"), "user_id").join(largest("model"), "user_id")
    return rows.withColumns({"report_date": F.lit(day), "cache_rate": rate(), "cost_usd": cost_usd("cost_micros")})


METRICS = {"tokens": "total_tokens", "net": "tokens_without_cache_read", "cost": "cost_micros"}


def leaderboard(profiles: DataFrame, usage: DataFrame, summary: DataFrame, scope: Scope, metric: str, limit: int = 50, strict: bool = False) -> DataFrame:
    """Ranked public participants; ties go to the other metrics and then to the slug.

    Users are summed before profiles join, and only the best ``limit`` are ranked."""
    from pyspark.sql import Window as W

    names = ["total_tokens", "tokens_without_cache_read", "cost_micros"]
    shown = profiles.filter("is_public and participates").select("user_id", "slug", "display_name")
    per_user = effective_summary(usage, summary, scope, strict).groupBy("user_id").agg(*sums(names))
    first = METRICS[metric]
    order = [F.desc(c) for c in [first, *(c for c in ("total_tokens", "cost_micros") if c != first)]] + [F.asc("slug")]
    best = per_user.join(shown, "user_id").orderBy(*order).limit(limit)
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # `limit` rows
    return ranked.select("rank", "slug", "display_name", *names[:2], rate().alias("cache_rate"), cost_usd("cost_micros").alias("cost_usd"))


def effective_totals(usage: DataFrame, summary: DataFrame, totals: DataFrame, strict: bool = False) -> DataFrame:
    """Lifetime totals of all users: the stored row unless an effective summary row is newer, else the sum."""
    names = ["total_tokens", "tokens_without_cache_read", "cost_micros"]
    sums_ = effective_summary(usage, summary, Scope(), strict).groupBy("user_id").agg(*sums(names), F.max("updated_at").alias("latest"))
    stored = totals.select("user_id", *(F.col(c).alias(f"t_{c}") for c in names), F.col("updated_at").alias("t_updated_at"))
    joined = sums_.join(stored, "user_id", "full")
    fresh = F.col("t_updated_at").isNotNull() & (F.col("latest").isNull() | (F.col("latest") <= F.col("t_updated_at")))
    return joined.select("user_id", *(F.when(fresh, F.col(f"t_{c}")).otherwise(F.col(c)).alias(c) for c in names))


def public_totals(usage: DataFrame, summary: DataFrame, totals: DataFrame, user: str, today: str, strict: bool = False, breakdown: bool = True) -> DataFrame:
    """One row: lifetime, today's and this month's figures; with ``breakdown`` the split by source and the five top models.

    The effective summary is read once: a row a (source, model) holds the lifetime's, the month's and the day's sums."""
    names = ["total_tokens", "tokens_without_cache_read", "cost_micros"]
    day, month = F.col("usage_date") == today, F.col("usage_date") >= today[:8] + "01"
    rows = effective_summary(usage, summary, Scope(user=user), strict)
    by = rows.groupBy("source", "model").agg(
        *(F.sum(c).alias(f"lifetime_{c}") for c in names), F.max("updated_at").alias("latest"), F.count_if(month).alias("in_month"),
        *(_when_sum(month, c, c) for c in names), *(_when_sum(day, c, f"today_{c}") for c in names),
    )
    out = by.agg(*_figures(names))
    if breakdown:
        # sources and models of one user: both lists from one row a (source, model)
        entry = F.struct("source", "model", "in_month", *names)
        out = by.agg(*_figures(names), F.collect_list(entry).alias("items"))
        items = F.filter("items", lambda x: x["in_month"] > 0)
        out = out.withColumns({"source_split": _grouped_json(items, "source", None), "top_models": _grouped_json(items, "model", 5)})
    stored = totals.filter(F.col("user_id") == user).agg(*(F.max(c).alias(f"t_{c}") for c in names), F.max("updated_at").alias("t_updated_at"))
    fresh = F.col("t_updated_at").isNotNull() & (F.col("latest").isNull() | (F.col("latest") <= F.col("t_updated_at")))
    whole = out.crossJoin(F.broadcast(stored))  # one row each
    columns = [F.lit(user).alias("user_id")]
    life = {c: F.when(fresh, F.col(f"t_{c}")).otherwise(F.col(f"lifetime_{c}")) for c in names}
    whole = whole.withColumns({f"lifetime_{c}": F.coalesce(x, F.lit(0).cast("bigint")) for c, x in life.items()})
    for p in ("lifetime", "today", "month"):
        columns += [F.col(f"{p}_total_tokens"), F.col(f"{p}_tokens_without_cache_read"), cost_usd(f"{p}_cost_micros").alias(f"{p}_cost_usd")]
    columns.append(rate("lifetime_").alias("lifetime_cache_rate"))
    if breakdown:
        columns += ["source_split", "top_models"]
    return whole.select(*columns)


def _figures(names: list[str]) -> list[Column]:
    zero = F.lit(0).cast("bigint")
    found = [F.sum(f"lifetime_{c}").alias(f"lifetime_{c}") for c in names] + [F.max("latest").alias("latest")]
    found += [F.coalesce(F.sum(c), zero).alias(f"month_{c}") for c in names]
    return found + [F.coalesce(F.sum(f"today_{c}"), zero).alias(f"today_{c}") for c in names]


def _grouped_json(items: Column, key: str, limit: int | None) -> Column:
    """:func:`ordered_json` of a list of (source, model) sums, by one of the two."""
    keys = F.array_distinct(F.transform(items, lambda x: x[key]))

    def entry(name: Column) -> Column:
        own = F.filter(items, lambda x: x[key] == name)
        add = lambda c: F.aggregate(own, F.lit(0).cast("bigint"), lambda held, x: held + x[c])
        net, tokens = add("tokens_without_cache_read"), add("total_tokens")
        return F.struct((-net).alias("a"), (-tokens).alias("b"), name.alias(key), tokens.alias("tokens"), net.alias("net"))

    found = F.array_sort(F.transform(keys, entry))
    if limit:
        found = F.slice(found, 1, limit)
    return F.to_json(F.transform(found, lambda x: F.struct(x[key].alias(key), x["tokens"].alias("tokens"), x["net"].alias("net"))))


def subject_version(profiles: DataFrame, summary: DataFrame, totals: DataFrame) -> DataFrame:
    """For each public profile the newest of the moments its page depends on."""
    latest = summary.groupBy("user_id").agg(F.max("updated_at").alias("summary_at"))
    found = profiles.filter("is_public").join(totals.select("user_id", F.col("updated_at").alias("totals_at")), "user_id", "left").join(latest, "user_id", "left")
    return found.select("slug", F.greatest("updated_at", F.coalesce("totals_at", F.lit("")), F.coalesce("summary_at", F.lit(""))).alias("version"))


def daily_report(usage: DataFrame, summary: DataFrame, user: str, date: str, strict: bool = False) -> DataFrame:
    """One row of totals, and the sources and five top models as JSON."""
    names = ["total_tokens", "tokens_without_cache_read", "cost_micros", "session_count"]
    by = effective_summary(usage, summary, Scope(user=user, on=date), strict).groupBy("source", "model").agg(*sums(names))
    out = by.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names))
    for key, limit, name in (("source", None, "source_split"), ("model", 5, "top_models")):
        grouped = by.groupBy(key).agg(*sums(names))
        out = out.crossJoin(F.broadcast(grouped.agg(ordered_json(grouped, key, limit).alias(name))))  # one row
    return out.select(F.lit(user).alias("user_id"), F.lit(date).alias("usage_date"), *names[:2], rate().alias("cache_rate"), cost_usd("cost_micros").alias("cost_usd"), "session_count", "source_split", "top_models")


def device_list(devices: DataFrame, tokens: DataFrame, user: str) -> DataFrame:
    """A user's devices, last synced first, with their live upload tokens."""
    live = tokens.groupBy(F.col("device_id").alias("id"), "user_id").agg(F.sum(F.when(F.col("revoked_at").isNull(), 1).otherwise(0)).alias("n"))
    mine = devices.filter(F.col("user_id") == user).join(live, ["id", "user_id"], "left")
    found = mine.select("id", "name", "platform", "last_synced_at", "created_at", F.coalesce("n", F.lit(0)).cast("bigint").alias("active_tokens"))
    return found.orderBy(F.desc_nulls_last("last_synced_at"), F.desc("created_at"), "id")


def public_profile(profiles: DataFrame, usage: DataFrame, summary: DataFrame, totals: DataFrame, slug: str, today: str) -> DataFrame:
    """The public document of a profile; no row if there is none or it is private.

    The owner is joined, not looked up first, so that the plan is made without running a job."""
    names = ["total_tokens", "tokens_without_cache_read", "cost_micros"]
    owner = F.broadcast(profiles.filter((F.col("slug") == slug) & F.col("is_public")).select("user_id", "slug", "display_name", "timezone").limit(1))  # one row
    mine = lambda df: df.join(owner.select("user_id"), "user_id", "left_semi")
    day, month = F.col("usage_date") == today, F.col("usage_date") >= today[:8] + "01"
    rows = effective_summary(mine(usage), mine(summary), Scope(), False)
    by = rows.groupBy("source", "model").agg(
        *(F.sum(c).alias(f"lifetime_{c}") for c in names), F.max("updated_at").alias("latest"), F.count_if(month).alias("in_month"),
        *(_when_sum(month, c, c) for c in names), *(_when_sum(day, c, f"today_{c}") for c in names),
    )
    figures = by.agg(*_figures(names), F.collect_list(F.struct("source", "model", "in_month", *names)).alias("items"))
    kept = mine(totals).agg(*(F.max(c).alias(f"t_{c}") for c in names), F.max("updated_at").alias("t_updated_at"))
    whole = owner.crossJoin(F.broadcast(figures)).crossJoin(F.broadcast(kept))  # one row each
    fresh = F.col("t_updated_at").isNotNull() & (F.col("latest").isNull() | (F.col("latest") <= F.col("t_updated_at")))
    whole = whole.withColumns({f"lifetime_{c}": F.coalesce(F.when(fresh, F.col(f"t_{c}")).otherwise(F.col(f"lifetime_{c}")), F.lit(0).cast("bigint")) for c in names})
    items = F.filter("items", lambda x: x["in_month"] > 0)
    shown = [F.struct(F.col(f"{p}_total_tokens").alias("tokens"), F.col(f"{p}_tokens_without_cache_read").alias("net"), rate(f"{p}_").alias("rate"), cost_usd(f"{p}_cost_micros").alias("cost")).alias(p) for p in ("lifetime", "today", "month")]
    return whole.select("slug", "display_name", "timezone", *shown, _grouped_json(items, "source", None).alias("source_split"), _grouped_json(items, "model", 5).alias("top_models"))


def public_document(profile: DataFrame) -> DataFrame:
    """``slug`` and the document as JSON."""
    parts = [F.struct(F.col(f"{p}.tokens").alias("tokens"), F.col(f"{p}.net").alias("tokensWithoutCacheRead"), F.col(f"{p}.rate").alias("cacheReadRate"), F.col(f"{p}.cost").alias("costUsd")).alias(name) for p, name in (("lifetime", "total"), ("today", "today"), ("month", "month"))]
    lists = [F.from_json(c, f"array<struct<{key}:string,tokens:bigint,net:bigint>>").alias(name) for c, key, name in (("source_split", "source", "sourceSplit"), ("top_models", "model", "topModels"))]
    return profile.select("slug", F.to_json(F.struct("slug", F.col("display_name").alias("displayName"), "timezone", *parts, *lists)).alias("document"))
