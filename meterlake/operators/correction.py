"""Correction of child sessions that inherit their parent's counters.

A child's own usage is the sum of its per-request counters after its start, each
cumulative state counted once. Where that is less than the session row reports, the
surplus is apportioned over days and models and taken from the daily snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlake.schema import unused

COUNTERS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens"]
TOLERANCE = 1e-6


def apportion(rows: DataFrame, keys: list[str], order: list[str], total: Column, weight: Column, name: str) -> DataFrame:
    """Whole shares of ``total`` by weight within ``keys``; the last slot takes the rest; no weight at all splits evenly."""
    group, running = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(*order)
    whole, n, i = F.sum(weight).over(group), F.count("*").over(group), F.row_number().over(running)
    share = F.floor(total * (weight / F.when(whole != 0, whole)))
    held = unused(rows, f"{name}_parts")
    rows = rows.withColumn(held, F.struct(total.alias("total"), whole.alias("sum"), n.alias("n"), i.alias("i"), share.alias("share")))
    x = lambda c: F.col(f"{held}.{c}")
    before = F.coalesce(F.sum(x("share")).over(running.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = F.floor(x("total") / x("n"))
    even = base + F.when(x("i") <= x("total") - base * x("n"), 1).otherwise(0)
    value = F.when(x("sum") == 0, even).when(x("i") == x("n"), x("total") - before).otherwise(x("share"))
    return rows.withColumn(name, value.cast("bigint")).drop(held)


def nonnegative(left: Column, right: Column, what: str) -> Column:
    """``left - right``; slightly below zero is zero, and further below an error."""
    less = left - right
    failed = F.raise_error(F.lit(f"the correction exceeds {what}")).cast("bigint")
    return F.when(less < -TOLERANCE, failed).otherwise(F.greatest(less, F.lit(0)))


def child_usage(records: DataFrame, children: DataFrame) -> DataFrame:
    """Per child and day: per-request counters at or after its start, the first of equal cumulative states.

    ``records``: session_id, line_no, ts (text), usage_date, cumulative (struct) and the counters;
    ``children``: session_id, started_at (text)."""
    after = records.join(children, "session_id").filter(F.col("ts") >= F.col("started_at"))
    first = F.row_number().over(W.partitionBy("session_id", "cumulative").orderBy("line_no"))
    place = unused(after, "place")
    own = after.withColumn(place, first).filter(F.col(place) == 1)
    return own.groupBy("session_id", "usage_date").agg(*(F.sum(c).alias(c) for c in COUNTERS))


def corrections(sessions: DataFrame, usage: DataFrame) -> DataFrame:
    """Adjustments by (day, model).

    ``sessions``: session_id, model, ordinal, counters and cost_micros as reported (a row a model);
    ``usage``: :func:`child_usage`. A session whose corrected part would exceed its row is left alone."""
    whole = W.partitionBy("session_id")
    reported = sessions.withColumns({"o_total": F.sum("total_tokens").over(whole), "o_cost": F.sum("cost_micros").over(whole)})
    child = usage.withColumn("c_total", F.sum("total_tokens").over(whole))
    # corrected day: input without cached, no cache creation
    day = child.select(
        "session_id", "usage_date", "c_total", nonnegative(F.col("input_tokens"), F.col("cache_read_tokens"), "a child's input").alias("d_input_tokens"), F.col("output_tokens").alias("d_output_tokens"),
        F.lit(0).cast("bigint").alias("d_cache_creation_tokens"), F.col("cache_read_tokens").alias("d_cache_read_tokens"), F.col("total_tokens").alias("d_total_tokens"),
    )
    grid = reported.join(day, "session_id").filter("c_total > 0 and c_total <= o_total")
    grid = grid.withColumn("d_cost", F.col("o_cost") * (F.col("d_total_tokens") / F.col("o_total")))
    # a model's reported counters over the days, by the days' corrected totals
    for c in COUNTERS:
        grid = apportion(grid, ["session_id", "ordinal"], ["usage_date"], F.col(c), F.col("d_total_tokens"), f"p_{c}")
    grid = grid.withColumn("p_cost", F.col("cost_micros") * (F.col("d_total_tokens") / F.col("c_total")))
    # a day's corrected counters over the models, by those parts
    for c in COUNTERS:
        grid = apportion(grid, ["session_id", "usage_date"], ["ordinal"], F.col(f"d_{c}"), F.col("p_total_tokens"), f"q_{c}")
    parts = F.sum("p_total_tokens").over(W.partitionBy("session_id", "usage_date"))
    grid = grid.withColumn("q_cost", F.when(F.col("p_total_tokens") > 0, F.col("d_cost") * (F.col("p_total_tokens") / parts)).otherwise(0.0))
    fits = F.col("p_cost") - F.col("q_cost") >= -TOLERANCE * 1e6
    for c in COUNTERS:
        fits = fits & (F.col(f"p_{c}") - F.col(f"q_{c}") >= 0)
    grid = grid.withColumn("fits", F.min(fits.cast("int")).over(whole)).filter("fits = 1")
    taken = [F.sum(F.greatest(F.col(f"p_{c}") - F.col(f"q_{c}"), F.lit(0))).alias(c) for c in COUNTERS]
    return grid.groupBy("usage_date", "model").agg(*taken, F.sum(F.greatest(F.col("p_cost") - F.col("q_cost"), F.lit(0.0))).alias("cost_micros"))


def corrected(snapshots: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Snapshots less their adjustment where every measure stays nonnegative; ``adjusted`` says which, null without one."""
    names = [*COUNTERS, "cost_micros"]
    rows = snapshots.join(adjustments.select("usage_date", "model", *(F.col(c).alias(f"a_{c}") for c in names)), ["usage_date", "model"], "left")
    fits = F.lit(True)
    for c in names:
        fits = fits & (F.col(c) - F.col(f"a_{c}") >= (-TOLERANCE * 1e6 if c == "cost_micros" else 0))
    rows = rows.withColumn("adjusted", F.when(F.col("a_total_tokens").isNotNull(), fits))
    less = {c: F.when(F.col("adjusted"), F.greatest(F.col(c) - F.col(f"a_{c}"), F.lit(0))).otherwise(F.col(c)).cast("bigint") for c in names}
    return rows.withColumns(less).drop(*(f"a_{c}" for c in names))
