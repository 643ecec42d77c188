"""Uploads and the two-phase backfill: usage, then summaries, then totals.

An upload refreshes the summary of every key it changes, and of keys it sends unchanged whose
cache is missing or stale; then the totals of the users concerned and of those whose totals are
stale. The backfill goes over all keys in bounded pages, then over all users. Both recompute
keys whole, so that the order of pages, and repeating one, does not matter."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import caches
from meterlake.schema import LOGICAL, PHYSICAL

# Keys of a page.
DEFAULT_PAGE, MOST_PAGE = 50, 500


@dataclass(frozen=True)
class Tables:
    usage: DataFrame
    summary: DataFrame
    totals: DataFrame


def keys_to_refresh(incoming: DataFrame, before: DataFrame, after: DataFrame, summary: DataFrame) -> DataFrame:
    """Logical keys whose summary an upload must recompute."""
    changed = caches.changed_rows(incoming, before).select(*LOGICAL)
    sent = incoming.join(caches.changed_rows(incoming, before).select(*PHYSICAL), PHYSICAL, "left_anti").select(*LOGICAL)
    return changed.union(caches.stale_summary_keys(sent, after, summary)).distinct()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write what a step made to the shared folder and read it again, as the tables themselves are:
    the next step's plan begins there, and a lost executor costs its own tasks alone."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def uploaded(incoming: DataFrame, tables: Tables, state: DataFrame) -> Tables:
    """The tables after an upload; totals move only while the backfill's gate is open.

    The steps are those of a writer: usage is stored before the keys are judged, and summaries before totals."""
    usage = staged(caches.upsert(incoming, tables.usage), "usage")
    keys = staged(keys_to_refresh(incoming, tables.usage, usage, tables.summary), "keys")
    summary = staged(caches.merged_summary(keys, usage, tables.summary), "summary")
    known = keys.select("user_id").distinct()
    others = incoming.select("user_id").distinct().join(known, "user_id", "left_anti")
    users = known.union(caches.stale_totals_users(others, summary, tables.totals, state))
    return Tables(usage, summary, caches.merged_totals(users, summary, tables.totals, state))


@dataclass(frozen=True)
class Backfill:
    """Where a backfill stands: the phase, the last key (or user) done, and when it ended."""

    phase: str = "summaries"
    cursor: tuple[str | None, str | None, str | None, str | None] = (None, None, None, None)
    completed_at: str | None = None

    def key(self) -> tuple[str, ...] | None:
        """The cursor of the summaries' phase; one that is partly null is an error."""
        if all(x is None for x in self.cursor):
            return None
        if not all(self.cursor):
            raise ValueError("the backfill's cursor is incomplete")
        return self.cursor

    def row(self, spark: SparkSession, now: str) -> DataFrame:
        """The state as a table of one row."""
        names = ["user_id", "usage_date", "source", "model"]
        schema = ", ".join(["phase string", *(f"cursor_{n} string" for n in names), "completed_at string", "updated_at string"])
        return spark.createDataFrame([(self.phase, *self.cursor, self.completed_at, now)], schema)

    @staticmethod
    def of(state: DataFrame) -> Backfill:
        """The state that a table holds; none is the beginning."""
        row = state.limit(1).collect()
        if not row:
            return Backfill()
        r = row[0]
        return Backfill("totals" if r["phase"] == "totals" else "summaries", tuple(r[f"cursor_{n}"] for n in ("user_id", "usage_date", "source", "model")), r["completed_at"])


def page_size(text: str | None) -> int:
    """Keys of a page from a setting's text."""
    if text is None:
        return DEFAULT_PAGE
    if not text.strip().isdecimal() or not 1 <= int(text) <= MOST_PAGE:
        raise ValueError(f"a page holds 1 to {MOST_PAGE} keys")
    return int(text)


def step(tables: Tables, at: Backfill, page: int, now: str) -> tuple[Tables, Backfill, int, int]:
    """One page: the tables and the state after it, summaries and totals refreshed.

    What the last page of summaries leaves of its size is spent on totals. A page's keys (501 at
    most) are the only rows that reach the driver."""
    if at.completed_at:
        return tables, at, 0, 0
    if at.phase == "totals":
        after, state, n = _totals(tables, at, page, now)
        return after, state, 0, n
    spark = tables.usage.sparkSession
    found = [tuple(r) for r in caches.backfill_page(tables.usage, at.key(), page).collect()]
    mine = found[:page]
    keys = spark.createDataFrame(mine, ", ".join(f"{c} string" for c in LOGICAL))
    after = replace(tables, summary=caches.merged_summary(keys, tables.usage, tables.summary))
    if len(found) > page:
        return after, Backfill("summaries", mine[-1]), len(mine), 0
    state = Backfill("totals")
    left = page - len(mine)
    if left < 1:
        return after, state, len(mine), 0
    after, state, n = _totals(after, state, left, now)
    return after, state, len(mine), n


def _totals(tables: Tables, at: Backfill, page: int, now: str) -> tuple[Tables, Backfill, int]:
    spark = tables.usage.sparkSession
    found = [r["user_id"] for r in caches.totals_page(tables.summary, at.cursor[0], page).collect()]
    mine = found[:page]
    users = spark.createDataFrame([(u,) for u in mine], "user_id string")
    open_gate = Backfill("totals").row(spark, now)
    after = replace(tables, totals=caches.merged_totals(users, tables.summary, tables.totals, open_gate))
    if len(found) > page:
        return after, Backfill("totals", (mine[-1], None, None, None)), len(mine)
    return after, Backfill("totals", completed_at=now), len(mine)


def completed(tables: Tables, now: str) -> tuple[Tables, Backfill]:
    """The whole backfill as one job of each phase: pages are for small machines, the result is the same."""
    keys = tables.usage.select(*LOGICAL).distinct()
    summary = caches.merged_summary(keys, tables.usage, tables.summary)
    users = summary.select("user_id").distinct()
    state = Backfill("totals")
    totals = caches.merged_totals(users, summary, tables.totals, state.row(summary.sparkSession, now))
    return Tables(tables.usage, summary, totals), Backfill("totals", completed_at=now)


def written_state(state: DataFrame, at: Backfill, now: str) -> DataFrame:
    """The state table after an upsert of its only row."""
    return at.row(state.sparkSession, now).select(*(F.col(c) for c in state.columns))
