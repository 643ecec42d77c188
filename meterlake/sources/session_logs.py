"""Session logs: JSON lines of two kinds, read as variants.

Kind A writes ``event_msg`` records with per-request counters, kind B messages with a
usage object. Lines that are neither usage nor known to be ignorable but hold token
fields are counted, so that a changed format is noticed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.scalars import json_text, local_date, total_tokens
from meterlake.schema import SOURCES

# Alternative field names of the counters.
INPUT = ("input_tokens", "inputTokens")
OUTPUT = ("output_tokens", "outputTokens")
CREATION = ("cache_creation_input_tokens", "cacheCreationInputTokens", "cacheCreationTokens")
READ = ("cache_read_input_tokens", "cached_input_tokens", "cacheReadInputTokens", "cachedInputTokens", "cacheReadTokens")
TOTAL = ("total_tokens", "totalTokens")
COST = ("cost_usd", "costUsd", "costUSD", "total_cost", "totalCost")
# The fields that make a line look like usage.
TOKEN_FIELDS = (
    "input_tokens", "output_tokens", "total_tokens", "cache_creation_input_tokens", "cache_read_input_tokens",
    "inputTokens", "outputTokens", "totalTokens", "cacheCreationTokens", "cacheReadTokens",
)
DEPTH = 5
#: Every counter and cost that a usage object may hold.
NUMBERS = (*INPUT, *OUTPUT, *CREATION, *READ, *TOTAL, *COST)


def read_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Lines of all ``*.jsonl`` files below a folder; the file's path stands for the session."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    return text.select(F.col("_metadata.file_path").alias("session_id"), F.lit(kind).alias("kind"), "value")


def member(doc: Column, path: str) -> Column:
    """An object member, null unless it is an object itself."""
    value = F.try_variant_get(doc, path, "variant")
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def is_null(doc: Column) -> Column:
    return doc.isNull() | F.is_variant_null(doc)


def first_object(doc: Column, first: str, doc2: Column, second: str) -> Column:
    """The first member unless it is absent or null, else the second; null unless it is an object."""
    value = F.try_variant_get(doc, first, "variant")
    return F.when(is_null(value), member(doc2, second)).when(F.schema_of_variant(value).startswith("OBJECT"), value)


def has_token_field(doc: Column) -> Column:
    """Whether an object within ``DEPTH`` levels below the document (objects and lists count) has a token field."""
    fields, level, found = F.array(*map(F.lit, TOKEN_FIELDS)), F.array(doc), F.lit(False)
    members = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    for _ in range(DEPTH + 1):
        found = found | F.exists(level, lambda v: F.coalesce(F.arrays_overlap(F.map_keys(members(v)), fields), F.lit(False)))
        level = F.flatten(F.transform(level, lambda v: F.coalesce(F.map_values(members(v)), F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))))
    return found


def numbers_of(text: Column, names: tuple[str, ...]) -> Column:
    """Members of a JSON object that are numbers, in one pass; numbers in strings do not count."""
    return F.from_json(text, ", ".join(f"`{n}` double" for n in names), {"allowNonNumericNumbers": "false"})


def told_apart(names: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Names in two groups, in each of which no two differ by case alone: columns are not told apart by it."""
    first = tuple(n for i, n in enumerate(names) if n.lower() not in {x.lower() for x in names[:i]})
    return first, tuple(n for n in names if n not in first)


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once a row: a generator of one row stands between
    them and what is built on them, where a projection would be copied into each use."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def extracted(lines: DataFrame, zone: str | Column = "UTC") -> DataFrame:
    """Each line with its parsed record, usage object, model, moment and status."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    doc = F.try_parse_json("value")
    rows = once(lines, {"doc": doc})
    rows = once(rows, {"object": F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))})
    a = F.col("kind") == "A"
    # what only one kind has is looked for in that kind, and what few lines hold behind a search of the text
    counter = a & F.contains("value", F.lit("token_count"))
    payload = F.when(counter, member(F.col("doc"), "$.payload"))
    info = F.when(counter, F.try_variant_get(F.col("doc"), "$.payload.info", "variant"))
    counted = F.when(counter, (json_text(F.col("doc"), "type") == "event_msg") & (json_text(payload, "type") == "token_count"))
    rows = once(rows, {"payload": payload, "info": info, "counted": F.coalesce(counted, F.lit(False)), "message": F.when(~a, F.coalesce(member(F.col("doc"), "$.message"), F.col("doc")))})
    usage_a = F.when(F.col("counted"), first_object(F.col("info"), "$.last_token_usage", F.col("payload"), "$.usage"))
    usage_b = first_object(F.col("message"), "$.usage", F.col("doc"), "$.usage")
    rows = once(rows, {"usage": F.when(F.col("object"), F.when(a, usage_a).otherwise(usage_b))})
    model_a = F.coalesce(json_text(F.col("info"), "model"), json_text(F.col("usage"), "model"), F.lit("all"))
    model_b = F.coalesce(json_text(F.col("message"), "model", "modelName"), json_text(F.col("doc"), "model"), F.lit("all"))
    moment = F.try_to_timestamp(json_text(F.col("doc"), "timestamp"))
    rows = once(rows, {"model": F.when(a, model_a).otherwise(model_b), "moment": moment})
    u = F.col("usage")
    costly = F.contains("value", F.lit("cost")) | F.contains("value", F.lit("Cost"))
    rows = once(rows, {"text": F.to_json(u)})
    behind = {("n", 0): u.isNotNull(), ("n", 1): F.contains("text", F.lit("USD")), ("own", 0): costly, ("own", 1): costly}
    texts = {"n": (F.col("text"), NUMBERS), "own": (F.col("value"), COST)}
    rows = once(rows, {f"{name}{i}": F.when(behind[name, i], numbers_of(texts[name][0], group)) for name, (_, names) in texts.items() for i, group in enumerate(told_apart(names))})
    held = {(name, k): F.col(f"{name}{i}.{k}") for name, names in (("n", NUMBERS), ("own", COST)) for i, group in enumerate(told_apart(names)) for k in group}
    zero = F.lit(True)
    for key in (*INPUT, *OUTPUT, *CREATION, *READ, *TOTAL):
        zero = zero & (F.coalesce(held["n", key], F.lit(0.0)) == 0)
    synthetic = ~a & u.isNotNull() & (F.col("model") == "<synthetic>") & zero
    totals_only = a & F.col("counted") & u.isNull() & (
        member(F.col("info"), "$.total_token_usage").isNotNull() | member(F.col("doc"), "$.payload.total_token_usage").isNotNull()
    )
    # the text is searched first: few lines hold such a field at all
    named = F.col("value").rlike('"(' + "|".join(TOKEN_FIELDS) + r')"\s*:')
    tokenish = F.when(named, has_token_field(F.when(a, F.col("doc")).otherwise(u))).otherwise(F.lit(False))
    status = (
        F.when(F.trim("value") == "", "blank")
        .when(F.col("doc").isNull(), "malformed")
        .when(~F.col("object"), "skipped")
        .when(synthetic | totals_only, "ignored")
        .when(u.isNotNull() & F.col("moment").isNotNull(), "metric")
        .when(tokenish, "unparsed")
        .otherwise("skipped")
    )
    rows = once(rows, {"status": status})
    number = lambda *keys: F.coalesce(*(held["n", k] for k in keys), F.lit(0.0)).cast("bigint")
    parts = {"input_tokens": number(*INPUT), "output_tokens": number(*OUTPUT), "cache_creation_tokens": number(*CREATION), "cache_read_tokens": number(*READ)}
    cost = F.coalesce(*(held[name, k] for name in ("n", "own") for k in COST))
    rows = once(rows, parts | {"explicit": number(*TOTAL), "cost": cost, "usage_date": local_date(F.col("moment"), zone)})
    return rows.withColumn("total_tokens", total_tokens(F.col("explicit"), *(F.col(c) for c in parts)))


def metrics(parsed: DataFrame) -> DataFrame:
    """Per source, day and model: sums, and the distinct sessions."""
    names = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens"]
    source = F.when(F.col("kind") == "A", SOURCES[1]).otherwise(SOURCES[0]).alias("source")
    micros = F.sum(F.floor(F.coalesce("cost", F.lit(0.0)) * 1e6 + 0.5)).cast("bigint").alias("cost_micros")
    grouped = parsed.filter("status = 'metric'").groupBy(source, "usage_date", "model")
    return grouped.agg(*(F.sum(c).alias(c) for c in names), micros, F.countDistinct("session_id").alias("session_count"))


def quality(parsed: DataFrame) -> DataFrame:
    """Per kind: lines by status, and whether a metric had no cost."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("metric", "ignored", "malformed", "unparsed", "skipped")]
    missing = F.coalesce(F.bool_or((F.col("status") == "metric") & F.col("cost").isNull()), F.lit(False)).alias("missing_cost")
    return parsed.groupBy("kind").agg(*counts, missing)


def merge_snapshots(snapshots: DataFrame) -> DataFrame:
    """One snapshot a (source, day, zone, model): sums, and the earliest time of collection."""
    names = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens", "cost_micros", "session_count"]
    return snapshots.groupBy("source", "usage_date", "timezone", "model").agg(*(F.sum(c).alias(c) for c in names), F.min("synced_at").alias("synced_at"))


def changed_files(listing: DataFrame, manifest: DataFrame, high_water_ms: int, overlap_ms: int = 60_000) -> DataFrame:
    """Files to read again: pending ones, and those modified after the high-water mark (less
    an overlap) whose size, time or digest differ from the manifest."""
    known = manifest.select("path", F.col("size").alias("k_size"), F.col("mtime_ms").alias("k_mtime"), F.col("sha256").alias("k_sha"), "pending")
    rows = listing.join(known, "path", "left")
    pending = F.coalesce(F.col("pending"), F.lit(False))
    same_stat = (F.col("size") == F.col("k_size")) & (F.col("mtime_ms") == F.col("k_mtime"))
    moved = ~F.coalesce(same_stat, F.lit(False)) & ~F.coalesce(F.col("sha256") == F.col("k_sha"), F.lit(False))
    return rows.filter(pending | ((F.col("mtime_ms") >= high_water_ms - overlap_ms) & moved)).select("path", "size", "mtime_ms", "sha256", pending.alias("pending"))


def vanished_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows without a file; pending ones without cached snapshots go."""
    return manifest.join(listing.select("path"), "path", "left_anti").filter("not pending or snapshots > 0")
