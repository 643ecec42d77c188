"""Jobs that a scheduler starts: a tick of the maintenance work, uploads in batches, log rotation."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators.delivery import prune
from meterlake.operators.refresh import Backfill, Tables, step
from meterlake.streaming.ingest import isolated

# Snapshots of an upload, attempts at one, size and age at which a log is put away.
UPLOAD, ATTEMPTS = 30, 3
LOG_BYTES, LOG_DAYS = 1 << 20, 7


def tick(tables: Tables, at: Backfill, history: DataFrame, today: str, keep_days: int, page: int, now: str, deliver: Callable[[], None], store: Callable[[str, DataFrame | Backfill], None]) -> dict[str, Exception | None]:
    """One run of the maintenance work: a page of the backfill, due deliveries, expired reports. Each is
    stored by ``store`` as it is done; one that fails does not stop the others."""

    def backfill() -> None:
        after, state, summaries, totals = step(tables, at, page, now)
        if summaries:
            store("summary", after.summary)
        if totals:
            store("totals", after.totals)
        store("state", state)

    return isolated({"backfill": backfill, "delivery": deliver, "prune": lambda: store("history", prune(history, today, keep_days))})


def uploads(snapshots: DataFrame, size: int = UPLOAD) -> DataFrame:
    """Snapshots with the number of the upload that they go with: ``size`` rows of one (user, device) each, in order of key."""
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id", "device_id").orderBy("usage_date", "source", "model")
    return snapshots.withColumn("upload", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def sent(send: Callable[[], None], attempts: int = ATTEMPTS, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Call ``send`` until it goes well, waiting twice as long each time; returns the attempts, or raises the last error."""
    for attempt in range(1, attempts + 1):
        try:
            send()
            return attempt
        except (OSError, TimeoutError):
            if attempt == attempts:
                raise
            sleep(wait * 2 ** (attempt - 1))
    return 0


def to_rotate(logs: DataFrame, now_ms: int) -> DataFrame:
    """Logs (``path``, ``size``, ``mtime_ms``) that are to be put away for their size, or dropped for their age."""
    old = F.col("mtime_ms") < now_ms - LOG_DAYS * 86_400_000
    action = F.when(old, "drop").when(F.col("size") > LOG_BYTES, "rotate")
    return logs.withColumn("action", action).filter("action is not null")
