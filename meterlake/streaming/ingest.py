"""Continuous ingestion of session logs into daily usage.

The unit of replacement is the session file: logs are appended to, so that a batch that
brings a file again replaces all that the file contributed before. A replayed batch is
therefore a no-op, and late events count on their own day, however old."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.sources.session_logs import changed_files, extracted, read_lines, vanished_files
from meterlake.schema import SOURCES
from meterlake.streaming.store import VersionedTable

CONTRIBUTIONS = (
    "session_id string, source string, usage_date string, model string, input_tokens bigint, output_tokens bigint, "
    "cache_creation_tokens bigint, cache_read_tokens bigint, total_tokens bigint, cost_micros bigint"
)
COUNTERS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens"]


def contributions(lines: DataFrame, zone: str) -> DataFrame:
    """What each session adds to each (source, day, model)."""
    parsed = extracted(lines, zone).filter("status = 'metric'")
    source = F.when(F.col("kind") == "A", SOURCES[1]).otherwise(SOURCES[0]).alias("source")
    micros = F.sum(F.floor(F.coalesce("cost", F.lit(0.0)) * 1e6 + 0.5)).cast("bigint").alias("cost_micros")
    return parsed.groupBy("session_id", source, "usage_date", "model").agg(*(F.sum(c).alias(c) for c in COUNTERS), micros)


def daily_usage(held: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in [*COUNTERS, "cost_micros"]]
    return held.groupBy("source", "usage_date", "model").agg(*sums, F.countDistinct("session_id").alias("session_count"))


def refuse_damage(lines: DataFrame, zone: str, pending: DataFrame | None = None) -> None:
    """Strict mode: a malformed or unknown token-bearing line stops the batch; so does a file that is
    pending (``path``) and brings neither usage nor lines that may be ignored."""
    parsed = extracted(lines, zone)
    bad = parsed.agg(F.count_if(F.col("status") == "malformed").alias("m"), F.count_if(F.col("status") == "unparsed").alias("u")).first()
    if bad["m"] or bad["u"]:
        raise ValueError(f"{bad['m']} malformed and {bad['u']} unknown token-bearing lines")
    if pending is not None:
        good = parsed.filter("status in ('metric', 'ignored')").select(F.col("session_id").alias("path"))
        empty = pending.select("path").join(good, "path", "left_anti").count()
        if empty:
            raise ValueError(f"{empty} pending files without usage")


def apply_lines(table: VersionedTable, lines: DataFrame, zone: str, strict: bool = False) -> None:
    """Replace the contributions of the sessions whose (whole) files are in ``lines``."""
    if strict:
        refuse_damage(lines, zone)
    table.merge(contributions(lines, zone), lines.select("session_id"))


def batch_size(asked: float | None) -> int:
    """Files of a batch: 200 unless given, 1000 at most."""
    if not asked or asked < 1 or asked != asked or asked == float("inf"):
        return 200
    return min(int(asked), 1000)


def start(spark: SparkSession, folder: str, kind: str, table: VersionedTable, checkpoint: str, zone: str = "UTC", strict: bool = False, files: int | None = None, cooldown: int | None = None):
    """A streaming query from a folder of ``*.jsonl`` files; each micro-batch reads the whole files it is told of.

    With ``cooldown`` (seconds) it goes on, a batch each so many seconds at most; else it ends with what is
    there. New files arrive through the file source, which takes a path as immutable: appended files are
    found by :func:`catch_up`."""
    names = (
        spark.readStream.schema("value string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", batch_size(files)).text(folder)
        .select(F.col("_metadata.file_path").alias("session_id"), F.lit(kind).alias("kind"), "value")
    )
    return follow(names, table, checkpoint, zone, strict, cooldown)


def follow(lines: DataFrame, table: VersionedTable, checkpoint: str, zone: str = "UTC", strict: bool = False, cooldown: int | None = None):
    """A streaming query from lines (``session_id``, ``kind``, ``value``) whose batches hold whole sessions."""
    sink = lines.writeStream.foreachBatch(lambda batch, _: apply_lines(table, batch, zone, strict)).option("checkpointLocation", checkpoint)
    return sink.trigger(**({"processingTime": f"{cooldown} seconds"} if cooldown else {"availableNow": True})).start()


def reread(spark: SparkSession, paths: list[str], kind: str, table: VersionedTable, zone: str = "UTC", strict: bool = False) -> None:
    """Replace the contributions of changed files (one batch's list, bounded by the caller)."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("session_id"), F.lit(kind).alias("kind"), "value")
    apply_lines(table, lines, zone, strict)


MANIFEST = "path string, size bigint, mtime_ms bigint, sha256 string, pending boolean, snapshots bigint"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """The session files below a folder with size, time and digest, without their bytes reaching anyone but the digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(folder)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), F.sha2("content", 256).alias("sha256"))


def catch_up(spark: SparkSession, folder: str, kind: str, table: VersionedTable, manifest: VersionedTable, zone: str = "UTC", strict: bool = False, files: int | None = None) -> int:
    """Bring a table up to the files of a folder, appended ones among them; returns how many were read.

    The manifest (keyed by path) holds what was read. Its newest time, less a minute, is the high-water
    mark: files before it are not looked at again, and as rows stay it never moves back. Files are marked
    pending before a batch is written and cleared after it, so that a stopped run reads them again.
    What vanished files contributed stays."""
    known = manifest.read()
    mark = known.agg(F.max("mtime_ms")).first()[0] or 0
    found = changed_files(listing(spark, folder), known, mark).orderBy("mtime_ms", "path")
    size, done = batch_size(files), 0
    while True:
        page = [r for r in found.offset(done).limit(size).collect()]  # a batch of files
        if not page:
            break
        rows = [(r["path"], r["size"], r["mtime_ms"], r["sha256"]) for r in page]
        for pending in (True, False):
            if not pending:
                reread(spark, [r["path"] for r in page], kind, table, zone, strict)
            manifest.merge(spark.createDataFrame([(*r, pending, 0 if pending else 1) for r in rows], MANIFEST))
        done += len(page)
    gone = known.join(vanished_files(listing(spark, folder), known).select("path"), "path", "left_semi")
    lost = known.filter("pending and snapshots = 0").join(listing(spark, folder).select("path"), "path", "left_anti")
    if not lost.isEmpty():
        manifest.merge(gone.limit(0), lost.select("path"))
    return done


def isolated(runs: dict, strict: bool = False) -> dict[str, Exception | None]:
    """Run each source's function; a failing one does not stop the others. ``strict`` fails after all ran."""
    found: dict[str, Exception | None] = {}
    for name, run in runs.items():
        try:
            run()
            found[name] = None
        except Exception as error:  # noqa: BLE001 - reported by source
            found[name] = error
    failed = [name for name, error in found.items() if error is not None]
    if strict and failed:
        raise RuntimeError(f"sources failed: {', '.join(failed)}") from found[failed[0]]
    return found


def batch_usage(spark: SparkSession, folder: str, kind: str, zone: str = "UTC") -> DataFrame:
    """The same result by one batch read."""
    return daily_usage(contributions(read_lines(spark, folder, kind), zone))
