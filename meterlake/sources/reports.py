"""Daily usage reports: JSON documents of drifting shapes, one a row, as snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlake.functions.scalars import json_number, json_text, local_date, report_date, total_tokens
from meterlake.sources.session_logs import member

# Where rows stand in a document, and alternative field names.
CONTAINERS = ("data", "daily", "rows", "items", "sessions")
PARTS = (
    ("inputTokens",), ("outputTokens",), ("cacheCreationTokens", "cacheCreationInputTokens", "inputCacheCreationTokens"),
    ("cacheReadTokens", "cacheReadInputTokens", "cachedInputTokens"),
)
COST = ("costUsd", "costUSD", "totalCost", "cost")
NAMES = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]


def array_of(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "array<variant>")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON files as rows: ``report_id`` (the file's path) and ``value`` (the whole document)."""
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path)
    return text.select(F.col("_metadata.file_path").alias("report_id"), "value")


def rows_of(reports: DataFrame, containers: tuple[str, ...] = CONTAINERS, alone: bool = True) -> DataFrame:
    """One row an entry: the document itself if it is a list, else its first list, else (if ``alone``)
    the document if it has metrics."""
    doc = F.try_parse_json("value")
    rows = reports.withColumn("doc", doc)
    single = F.when(F.coalesce(*(json_number(F.col("doc"), k) for k in ("totalTokens", "inputTokens", "outputTokens"))).isNotNull(), F.array("doc"))
    entries = F.coalesce(array_of(F.col("doc"), "$"), *(array_of(F.col("doc"), f"$.{k}") for k in containers), *[single] * alone)
    found = rows.select("report_id", F.posexplode(entries).alias("row_no", "row"))
    return found.filter(F.schema_of_variant("row").startswith("OBJECT"))


def model_of(row: Column) -> Column:
    named = json_text(row, "model", "modelName", "name")
    lists = [F.when(F.size(a) == 1, a[0]) for a in (F.try_variant_get(row, f"$.{k}", "array<string>") for k in ("models", "modelsUsed"))]
    return F.coalesce(named, *lists, F.lit("all"))


def metrics_of(row: Column) -> list[Column]:
    return [F.coalesce(json_number(row, *keys), F.lit(0.0)).cast("bigint") for keys in PARTS]


def total_of(row: Column) -> Column:
    return total_tokens(F.coalesce(json_number(row, "totalTokens"), F.lit(0.0)).cast("bigint"), *metrics_of(row))


def model_rows(rows: DataFrame) -> DataFrame:
    """One row an entry and model: from a map or a list of breakdowns, else the entry itself."""
    as_map = lambda path: F.when(F.size(m := F.try_variant_get(F.col("row"), path, "map<string,variant>")) > 0, F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("model"), e["value"].alias("metrics"))))
    listed = array_of(F.col("row"), "$.modelBreakdowns")
    as_list = F.when(F.size(listed) > 0, F.transform(listed, lambda v: F.struct(F.lit(None).cast("string").alias("model"), v.alias("metrics"))))
    own = F.array(F.struct(F.lit(None).cast("string").alias("model"), F.col("row").alias("metrics")))
    parts = F.coalesce(as_map("$.breakdown"), as_list, as_map("$.modelBreakdowns"), as_map("$.models"), own)
    whole = F.coalesce(as_map("$.breakdown"), as_list, as_map("$.modelBreakdowns"), as_map("$.models")).isNull()
    return rows.select("report_id", "row_no", "row", whole.alias("whole"), F.posexplode(parts).alias("part_no", "part")).select("report_id", "row_no", "row", "whole", "part_no", F.coalesce("part.model", model_of(F.col("part.metrics"))).alias("model"), F.col("part.metrics").alias("metrics"))


def cost_of(metrics: Column, row: Column, whole: Column) -> Column:
    """Own cost if positive, else the entry's cost in proportion to tokens."""
    direct = F.coalesce(json_number(metrics, *COST), F.lit(0.0))
    parent, tokens, own = F.coalesce(json_number(row, *COST), F.lit(0.0)), F.coalesce(json_number(row, "totalTokens"), F.lit(0.0)), total_of(metrics)
    shared = F.when((parent > 0) & (tokens > 0) & (own > 0), parent * (own / tokens)).otherwise(0.0)
    return F.when((direct > 0) | whole, direct).otherwise(shared)


def normalize(reports: DataFrame, sessions: DataFrame | None = None, zone: str = "UTC") -> DataFrame:
    """Snapshots of reports (``report_id``, ``value``).

    With ``sessions`` (documents of the same kind) the sessions of a day and model are counted from
    them alone, 0 where they hold none; without, a row's own count is taken."""
    found = model_rows(rows_of(reports))
    date = report_date(F.coalesce(*(json_text(F.col("row"), k) for k in ("date", "usageDate", "period"))))
    parts = [m.alias(n) for m, n in zip(metrics_of(F.col("metrics")), NAMES)]
    micros = F.floor(cost_of(F.col("metrics"), F.col("row"), F.col("whole")) * 1e6 + 0.5).cast("bigint").alias("cost_micros")
    own = F.coalesce(json_number(F.col("metrics"), "sessionCount", "sessions"), F.lit(0.0)).cast("bigint").alias("session_count")
    out = found.select("report_id", date.alias("usage_date"), "model", *parts, total_of(F.col("metrics")).alias("total_tokens"), micros, own)
    if sessions is None:
        return out
    counted = session_counts(sessions, zone)
    return out.drop("session_count").join(counted, ["usage_date", "model"], "left").withColumn("session_count", F.coalesce("session_count", F.lit(0).cast("bigint")))


def session_date(row: Column, zone: str) -> Column:
    """A session's day: that of its last activity in the zone."""
    fields = [F.try_variant_get(row, f"$.{k}", "variant") for k in ("lastActivity", "date", "usageDate")]
    first = F.coalesce(*(F.when(~F.is_variant_null(v), v) for v in fields))
    text = F.when(F.schema_of_variant(first) == "STRING", F.try_variant_get(first, "$", "string"))
    instant = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(text))
    return F.coalesce(local_date(instant, F.lit(zone)), report_date(text))


def session_counts(sessions: DataFrame, zone: str = "UTC") -> DataFrame:
    """Sessions by day and dominant model: of each session's models the one of most tokens, the first of equals."""
    rows = rows_of(sessions).withColumn("day", session_date(F.col("row"), zone)).filter("day is not null")
    days = rows.select("report_id", "row_no", "day")
    parts = model_rows(rows.drop("day")).select("report_id", "row_no", "part_no", "model", total_of(F.col("metrics")).alias("total_tokens"))
    best = parts.groupBy("report_id", "row_no").agg(F.max_by("model", F.struct("total_tokens", -F.col("part_no"))).alias("model"))
    return best.join(days, ["report_id", "row_no"]).groupBy(F.col("day").alias("usage_date"), "model").agg(F.count("*").alias("session_count"))


def attribute_sessions(rows: DataFrame) -> DataFrame:
    """Counts sessions by day and dominant model: of each session's rows
    (``session_id``, ``usage_date``, ``model``, ``total_tokens``, ``ordinal``) the largest, the first of equals."""
    best = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("total_tokens"), "ordinal"))
    return rows.select("usage_date", "model", best.alias("place")).filter("place = 1").groupBy("usage_date", "model").agg(F.count("*").alias("session_count"))
