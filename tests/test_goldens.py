"""Worked examples: rates, number text, zones and schedules, parsing, reports, corrections, caches, streams."""

import base64
import hashlib
import hmac
import json
from datetime import date, datetime, timezone
from xml.etree import ElementTree

import duckdb
import pytest
from pyspark.sql import functions as F

from meterlake.functions import scalars as S
from meterlake.functions import text
from meterlake.operators import caches, correction, facts, refresh
from meterlake.plans import catalogue, serving
from meterlake.schema import USAGE
from meterlake.sources import child_logs, reports, scans, session_logs
from meterlake.streaming import ingest, jobs
from meterlake.streaming.store import VersionedTable


def values(spark, ddl, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, ddl).coalesce(1).select(column).collect()]


def test_rates_and_rounding(spark):
    rate = S.cache_read_rate(F.col("t"), F.col("w"))
    assert values(spark, "t long, w long", [(100, 75), (0, 0), (100, 120)], rate) == [0.25, 0.0, 0.0]
    assert values(spark, "x double", [(0.25,), (0.004,), (0.0,)], S.percent_text(F.col("x"))) == ["25%", "0.4%", "0%"]
    assert values(spark, "x double", [(0.00145,), (-2.5,)], S.round_half_up(F.col("x"))) == [0.0014, -2.5]


def test_tenths_of_a_percent_at_ties(spark):
    rows = [(k / 2000,) for k in range(1, 20, 2)] + [(0.00049,)]
    assert values(spark, "x double", rows, S.percent_text(F.col("x"))) == [f"{k / 10}%" for k in range(1, 11)] + ["0.0%"]


def test_report_messages_of_busy_days_equal_their_statement(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT 11 AS event_id, TIMESTAMP '2024-01-20 08:00:00' AS ts, 5 AS user_id, 'click' AS event_type, 19.67 :: DOUBLE AS value UNION ALL SELECT 1000 + i, TIMESTAMP '2024-01-20 09:00:00', 7, 'click', 1.0 FROM range(2000) r(i)")
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, 'c' || i AS c_name, 0 :: INT AS c_nationkey FROM range(10) r(i)")
    for t in ("events", "customer"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = sorted((r["user_id"], r["message"]) for r in catalogue.QUERIES["report_messages"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(f"SELECT user_id, message FROM ({catalogue.ORACLE['report_messages']})").fetchall())
    assert "Cache rate: 0.6%" in got[0][1] and "Sessions: 1500" in got[1][1]


def test_number_text(spark):
    rows = [(1.0,), (0.01,), (1e-7,), (1e21,), (0.0,), (12345678.5,), (0.000123,), (0.00019786307874950534,), (-0.0005,), (123456789012345680000.0,)]
    assert values(spark, "x double", rows, S.js_number(F.col("x"))) == ["1", "0.01", "1e-7", "1e+21", "0", "12345678.5", "0.000123", "0.00019786307874950534", "-0.0005", "123456789012345680000"]


@pytest.mark.parametrize(
    "zone, wall, utc",
    [("Asia/Shanghai", "2026-04-29 09:30", "2026-04-29 01:30"), ("Europe/London", "2026-03-29 01:30", "2026-03-29 00:30"), ("Europe/London", "2026-10-25 01:30", "2026-10-25 01:30"), ("America/New_York", "2026-03-08 02:30", "2026-03-08 07:30")],
)
def test_wall_time(spark, zone, wall, utc):
    found = values(spark, "w string", [(wall,)], S.wall_to_utc(F.to_timestamp("w"), F.lit(zone)).cast("string"))[0]
    assert found[:16] == utc


def test_local_date(spark):
    assert values(spark, "t string", [("2026-04-28T16:30:00Z",)], S.local_date(F.to_timestamp("t"), F.lit("Asia/Shanghai"))) == ["2026-04-29"]


A_USAGE = {"input_tokens": 10, "output_tokens": 5, "cache_creation_input_tokens": 2, "cache_read_input_tokens": 3, "total_tokens": 20}


def a_line(info, **more):
    return json.dumps({"type": "event_msg", "timestamp": "2026-04-28T10:00:00Z", "payload": {"type": "token_count", "info": info}} | more)


LINES = [
    ("A", a_line({"model": "m", "last_token_usage": A_USAGE | {"cost_usd": 0.04}}), "metric", 20),
    ("A", a_line({"total_token_usage": A_USAGE}), "ignored", 0),
    ("A", json.dumps({"type": "other", "usage": {"input_tokens": 3}}), "unparsed", 0),
    ("A", '{"type":', "malformed", 0),
    ("A", "  ", "blank", 0),
    ("A", "[1, 2]", "skipped", 0),
    ("B", json.dumps({"type": "assistant", "timestamp": "2026-04-28T10:00:00Z", "costUSD": 0.12, "message": {"model": "c", "usage": {"input_tokens": 8, "output_tokens": 13, "cache_creation_input_tokens": 21, "cache_read_input_tokens": 34}}}), "metric", 76),
    ("B", json.dumps({"type": "user", "timestamp": "2026-04-28T10:00:00Z", "toolUseResult": {"input_tokens": 5}, "message": {"role": "user"}}), "skipped", 0),
    ("B", json.dumps({"type": "assistant", "timestamp": "2026-04-28T10:00:00Z", "message": {"model": "<synthetic>", "usage": {"input_tokens": 0, "output_tokens": 0}}}), "ignored", 0),
    ("B", json.dumps({"timestamp": "2026-04-28T10:00:00Z", "message": {"model": "c", "usage": {"input_tokens": "8", "output_tokens": 1}}}), "metric", 1),
]


def test_log_lines(spark):
    rows = [(f"s{i}", kind, value, i) for i, (kind, value, _, _) in enumerate(LINES)]
    got = {r["i"]: r for r in session_logs.extracted(spark.createDataFrame(rows, "session_id string, kind string, value string, i int")).collect()}
    for i, (_, _, status, total) in enumerate(LINES):
        assert got[i]["status"] == status, LINES[i]
        if status == "metric":
            assert got[i]["total_tokens"] == total
    assert got[0]["cost"] == 0.04 and got[6]["cost"] == 0.12


def test_reports(spark):
    docs = [
        {"data": [{"date": "2026-04-28", "breakdown": {"m": {"inputTokens": 100, "outputTokens": 50, "cacheCreationTokens": 10, "cacheReadTokens": 5, "totalTokens": 165, "costUsd": 0.12}}}]},
        {"daily": [{"date": "2026-04-28", "inputTokens": 1, "modelsUsed": ["a", "b"]}]},
        {"daily": [{"period": "2026-04-28", "modelBreakdowns": [{"modelName": "x", "inputTokens": 2, "cost": 1}]}]},
        {"data": [{"date": "2026-04-28", "models": ["x"], "inputTokens": 120, "outputTokens": 80, "cacheCreationInputTokens": 7, "cacheReadInputTokens": 11}]},
    ]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    got = sorted((r["report_id"], r["usage_date"], r["model"], r["total_tokens"], r["cost_micros"]) for r in reports.normalize(spark.createDataFrame(rows, "report_id int, value string")).collect())
    assert got == [(0, "2026-04-28", "m", 165, 120000), (1, "2026-04-28", "all", 1, 0), (2, "2026-04-28", "x", 2, 1000000), (3, "2026-04-28", "x", 218, 0)]


def test_child_correction(spark):
    counters = "input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, total_tokens long"
    sessions = spark.createDataFrame([("s", "m", 0, 1100, 120, 0, 1950, 3170, 3_170_000)], f"session_id string, model string, ordinal int, {counters}, cost_micros long")
    records = [
        ("s", 1, "2026-04-28T09:00:00Z", "2026-04-28", (1000,), 900, 100, 0, 0, 1000),
        ("s", 2, "2026-04-28T10:00:00Z", "2026-04-28", (2000,), 120, 10, 0, 90, 130),
        ("s", 3, "2026-04-28T10:00:01Z", "2026-04-28", (2000,), 120, 10, 0, 90, 130),
        ("s", 4, "2026-04-28T10:05:00Z", "2026-04-28", (2090,), 80, 10, 0, 60, 90),
    ]
    lines = spark.createDataFrame(records, f"session_id string, line_no int, ts string, usage_date string, cumulative struct<t:long>, {counters}")
    children = spark.createDataFrame([("s", "2026-04-28T09:30:00Z")], "session_id string, started_at string")
    usage = correction.child_usage(lines, children)
    assert usage.first()["total_tokens"] == 220
    adjust = correction.corrections(sessions, usage)
    snapshots = spark.createDataFrame([("2026-04-28", "m", 1100, 120, 0, 1950, 3170, 3_170_000)], f"usage_date string, model string, {counters}, cost_micros long")
    r = correction.corrected(snapshots, adjust).first()
    assert (r["input_tokens"], r["cache_read_tokens"], r["output_tokens"], r["total_tokens"], r["cost_micros"], r["adjusted"]) == (50, 150, 20, 220, 220_000, True)


def usage_rows(spark, rows):
    full = [(u, d, s, day, m, "UTC", t, 0, 0, 0, t, t * 1000, 1, at, h) for u, d, s, day, m, t, at, h in rows]
    return spark.createDataFrame(full, USAGE)


def test_incremental_equals_recompute(spark):
    old = usage_rows(spark, [("u", "legacy", "codex", "2026-01-01", "m", 5, "t1", "a"), ("u", "d1", "codex", "2026-01-02", "m", 7, "t1", "b"), ("v", "d1", "codex", "2026-01-01", "m", 9, "t1", None)])
    new = usage_rows(spark, [("u", "d1", "codex", "2026-01-01", "m", 6, "t2", "c"), ("u", "d1", "codex", "2026-01-02", "m", 7, "t2", "b"), ("v", "d1", "codex", "2026-01-01", "m", 9, "t2", "e")]).withColumn("ordinal", F.lit(1))
    summary = facts.summarize(facts.dedupe_legacy(old))
    assert caches.changed_rows(new, old).count() == 2
    after = caches.upsert(new, old)
    merged = caches.merged_summary(caches.changed_rows(new, old), after, summary)
    expected = facts.summarize(facts.dedupe_legacy(after)).select(*merged.columns)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, expected.collect()))
    again = caches.upsert(new, after)
    assert caches.changed_rows(new, after).count() == 0 and again.count() == after.count()


def test_hash_ignores_time_of_collection(spark):
    rows = usage_rows(spark, [("u", "d", "codex", "2026-01-01", "m", 17, "t1", None), ("u", "d", "codex", "2026-01-01", "m", 17, "t2", None)])
    got = [r["snapshot_hash"] for r in caches.with_hash(rows).collect()]
    text = '{"source":"codex","usageDate":"2026-01-01","timezone":"UTC","model":"m","inputTokens":17,"outputTokens":0,"cacheCreationTokens":0,"cacheReadTokens":0,"totalTokens":17,"costUsd":0.017,"sessionCount":1}'
    assert got == [hashlib.sha256(text.encode()).hexdigest()] * 2


def test_validation(spark):
    rows = usage_rows(spark, [("u", "d", "codex", "2026-01-01", "m", 17, "t", "h"), ("u", "d", "other", "26-1-1", "m" * 161, 17, "t", "h")])
    zones = spark.createDataFrame([("UTC",)], "zone string")
    got = sorted(tuple(r["reasons"]) for r in caches.validated(rows, zones, ("codex",)).collect())
    assert got == [(), ("source", "usage_date", "model")]


def test_stream_equals_batch_and_replays_are_idle(spark, tmp_path):
    folder = tmp_path / "logs" / "deep"
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"s{i}.jsonl").write_text("\n".join(LINES[j][1] for j in (0, 1)) + "\n")
    table = VersionedTable(spark, str(tmp_path / "table"), ingest.CONTRIBUTIONS, buckets=4)
    run = lambda: ingest.start(spark, str(tmp_path / "logs"), "A", table, str(tmp_path / "checkpoint")).awaitTermination()
    run()
    rows = lambda df: sorted(map(tuple, df.collect()))
    batch = rows(ingest.batch_usage(spark, str(tmp_path / "logs"), "A"))
    assert rows(ingest.daily_usage(table.read())) == batch and batch[0][-1] == 3
    version = table.version()
    run()
    assert table.version() == version
    with (folder / "s0.jsonl").open("a") as f:
        f.write(LINES[0][1] + "\n")
    for _ in range(2):
        ingest.reread(spark, [str(folder / "s0.jsonl")], "A", table)
    assert rows(ingest.daily_usage(table.read())) == rows(ingest.batch_usage(spark, str(tmp_path / "logs"), "A"))
    with pytest.raises(ValueError):
        ingest.apply_lines(table, spark.createDataFrame([("x", "A", LINES[2][1])], "session_id string, kind string, value string"), "UTC", strict=True)


def test_appended_files_are_caught_up(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for i in range(5):
        (folder / f"s{i}.jsonl").write_text(LINES[0][1] + "\n")
    table = VersionedTable(spark, str(tmp_path / "table"), ingest.CONTRIBUTIONS, buckets=4)
    manifest = VersionedTable(spark, str(tmp_path / "manifest"), ingest.MANIFEST, key="path", buckets=2)
    run = lambda: ingest.catch_up(spark, str(folder), "A", table, manifest, files=2)
    usage = lambda: sorted(map(tuple, ingest.daily_usage(table.read()).collect()))
    assert run() == 5 and run() == 0 and usage()[0][-1] == 5
    with (folder / "s1.jsonl").open("a") as f:
        f.write(LINES[0][1] + "\n")
    assert run() == 1 and usage() == sorted(map(tuple, ingest.batch_usage(spark, str(folder), "A").collect()))
    (folder / "s2.jsonl").unlink()
    before = usage()
    assert run() == 0 and usage() == before  # what a vanished file brought stays
    held = manifest.read()
    assert held.count() == 5 and held.filter("pending").count() == 0
    (folder / "s9.jsonl").write_text(LINES[3][1] + "\n")
    with pytest.raises(ValueError):
        ingest.catch_up(spark, str(folder), "A", table, manifest, strict=True)
    assert manifest.read().filter("pending").count() == 1  # to be read again


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "session_id string, n int", buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, "session_id string, n int")
    rows = lambda: sorted(map(tuple, table.read().collect()))
    assert rows() == []
    table.merge(frame([(f"s{i}", i) for i in range(40)]))
    table.merge(frame([("s3", 33), ("s3", 34)]))
    assert rows() == sorted([(f"s{i}", i) for i in range(40) if i != 3] + [("s3", 33), ("s3", 34)])
    assert len(set(table.held(table.version()).values())) == 2  # one bucket moved, the others stay where they were
    table.merge(frame([]), frame([("s3", 0)]).select("session_id"))
    assert len(rows()) == 39
    for i in range(5):
        table.merge(frame([("s1", i)]))
    before = rows()
    table.vacuum(keep=2)
    assert rows() == before
    again = VersionedTable(spark, str(tmp_path / "t"), "session_id string, n int", buckets=8)
    again.version = lambda: table.version() - 1  # another writer that has not seen the last version
    with pytest.raises(RuntimeError):
        again.write(frame([("x", 1)]), [0])


def test_sources_fail_alone():
    ran = []

    def bad():
        raise ValueError("no")

    got = ingest.isolated({"a": bad, "b": lambda: ran.append(1)})
    assert ran == [1] and isinstance(got["a"], ValueError) and got["b"] is None
    with pytest.raises(RuntimeError):
        ingest.isolated({"a": bad, "b": lambda: ran.append(2)}, strict=True)
    assert ran == [1, 2]
    assert [ingest.batch_size(x) for x in (None, 0, 0.5, 7.9, 5000, float("nan"), float("inf"))] == [200, 200, 200, 7, 1000, 200, 200]


def test_session_counts_of_reports(spark):
    row = lambda **x: json.dumps({"data": [x]})
    several = {"a": {"totalTokens": 5}, "b": {"totalTokens": 9}}
    docs = [row(sessionId="1", lastActivity="2026-04-27T16:10:00.000Z", modelBreakdowns=several), row(sessionId="2", date="2026-04-28", model="b"), row(sessionId="3", lastActivity="2026-04-28", modelBreakdowns=[]), row(sessionId="4")]
    sessions = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "report_id int, value string")
    assert sorted(map(tuple, reports.session_counts(sessions, "Asia/Shanghai").collect())) == [("2026-04-28", "all", 1), ("2026-04-28", "b", 2)]
    daily = spark.createDataFrame([(0, json.dumps({"daily": [{"date": "2026-04-28", "model": "b", "inputTokens": 1, "sessionCount": 7}]}))], "report_id int, value string")
    assert reports.normalize(daily).first()["session_count"] == 7
    assert reports.normalize(daily, sessions, "Asia/Shanghai").first()["session_count"] == 2
    assert reports.normalize(daily, sessions.limit(0)).first()["session_count"] == 0  # none given is not none told


def test_drift_is_looked_for_to_a_depth(spark):
    nest = lambda n: '{"type":"x","v":' + '{"k":' * n + '{"input_tokens":1}' + "}" * n + "}"
    lines = [nest(n) for n in range(7)] + ['{"type":"x","text":"\\"input_tokens\\": 3"}', '{"type":"x","v":[[{"totalTokens":1}]]}']
    rows = spark.createDataFrame([(i, "A", t) for i, t in enumerate(lines)], "session_id int, kind string, value string")
    got = {r["session_id"]: r["status"] for r in session_logs.extracted(rows).collect()}
    assert [got[i] for i in range(9)] == ["unparsed"] * 5 + ["skipped"] * 3 + ["unparsed"]


def test_child_usage_below_its_cached_part_is_an_error(spark):
    counters = "input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, total_tokens long"
    sessions = spark.createDataFrame([("s", "m", 0, 100, 0, 0, 0, 100, 0)], f"session_id string, model string, ordinal int, {counters}, cost_micros long")
    usage = spark.createDataFrame([("s", "2026-04-28", 10, 0, 0, 11, 21)], f"session_id string, usage_date string, {counters}")
    with pytest.raises(Exception, match="exceeds"):
        correction.corrections(sessions, usage).collect()


def test_child_session_logs(spark, tmp_path):
    use = lambda i, o, c, t: {"input_tokens": i, "output_tokens": o, "cached_input_tokens": c, "total_tokens": t}
    event = lambda ts, whole, last: json.dumps({"type": "event_msg", "timestamp": ts, "payload": {"type": "token_count", "info": {"total_token_usage": whole, "last_token_usage": last}}})
    head = json.dumps({"type": "session_meta", "timestamp": "x", "payload": {"timestamp": "2026-04-28T09:30:00Z", "source": {"subagent": {"thread_spawn": {"parent_thread_id": "p"}}}}})
    lines = [head, event("2026-04-28T09:00:00Z", use(1000, 100, 0, 1100), use(1000, 100, 0, 1100)), "{broken", event("2026-04-28T10:00:00Z", use(2000, 110, 90, 2110), use(120, 10, 90, 130)), event("2026-04-28T10:00:01Z", use(2000, 110, 90, 2110), use(120, 10, 90, 130)), event("2026-04-28T10:05:00Z", use(2080, 120, 150, 2200), use(80, 10, 60, 90))]
    logs = spark.createDataFrame([("/h/sessions/a/c.jsonl", i, t) for i, t in enumerate(lines)], "path string, line_no int, value string")
    row = {"sessionId": "a/c", "lastActivity": "2026-04-28T10:05:00Z", "models": {"m": {"inputTokens": 1100, "outputTokens": 120, "cachedInputTokens": 1950, "totalTokens": 3170}}, "totalTokens": 3170, "costUSD": 3.17}
    report = lambda *rows: spark.createDataFrame([(0, json.dumps({"sessions": list(rows)}))], "report_id int, value string")
    counters = "input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, total_tokens long"
    snapshots = spark.createDataFrame([("2026-04-28", "m", 1100, 120, 0, 1950, 3170, 3_170_000)], f"usage_date string, model string, {counters}, cost_micros long")
    take = lambda *rows: child_logs.corrected(snapshots, report(*rows), logs, "/h/sessions").first()
    r = take(row)
    assert (r["input_tokens"], r["cache_read_tokens"], r["output_tokens"], r["total_tokens"], r["cost_micros"], r["adjusted"]) == (50, 150, 20, 220, 220_000, True)
    assert take(row | {"sessionId": "", "directory": "a/x/..", "sessionFile": "c"})["total_tokens"] == 220
    for away in ("../../etc/passwd", "/etc/passwd", "other"):
        assert take(row | {"sessionId": away})["adjusted"] is None
    with pytest.raises(Exception, match="last activity"):
        take({k: v for k, v in row.items() if k != "lastActivity"})
    assert [tuple(x) for x in child_logs.rejected(logs).collect()] == [("/h/sessions/a/c.jsonl", 2)]


def test_request_filters():
    parse = lambda **asked: serving.parse_filters(asked, date(2026, 4, 29))
    assert parse() == {"source": "all", "start": "2026-03-31", "end": "2026-04-29", "device": "", "model": ""}
    assert parse(source="codex", start="2026-04-09", end="2026-04-01", model=" x ") == {"source": "codex", "start": "2026-04-01", "end": "2026-04-09", "device": "", "model": "x"}
    assert parse(source="all", start="yesterday")["start"] == "2026-03-31"
    assert [serving.device_filter(x) for x in (None, " ", "ALL", "a b", "legacy", "x" * 129)] == [None, None, None, None, "legacy", None]


def test_backfill_pages_lead_to_the_whole(spark):
    usage = usage_rows(spark, [(f"u{i % 3}", "d", "codex", f"2026-01-0{1 + i % 4}", f"m{i % 2}", 5 + i, "t1", "a") for i in range(12)]).dropDuplicates(["user_id", "usage_date", "model"])
    empty_summary = facts.summarize(usage.limit(0))
    start = refresh.Tables(usage, empty_summary, caches.totals_of(empty_summary))
    tables, at, moved = start, refresh.Backfill(), []
    for _ in range(12):
        tables, at, n, users = refresh.step(tables, at, 5, "now")
        tables = refresh.Tables(usage, refresh.staged(tables.summary, "s"), refresh.staged(tables.totals, "t"))
        moved.append((n, users))
        if at.completed_at:
            break
    whole, _ = refresh.completed(start, "now")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.summary) == rows(whole.summary) and rows(tables.totals.select("user_id", "total_tokens")) == rows(whole.totals.select("user_id", "total_tokens"))
    assert moved[-1][1] == 3 or sum(u for _, u in moved) == 3
    assert refresh.step(tables, at, 5, "later")[1:] == (at, 0, 0)
    with pytest.raises(ValueError):
        refresh.step(start, refresh.Backfill("summaries", ("u", None, None, None)), 5, "now")
    assert [refresh.page_size(x) for x in (None, " 7 ", "500")] == [50, 7, 500]
    for bad in ("0", "501", "x", "", "-1"):
        with pytest.raises(ValueError):
            refresh.page_size(bad)


def test_one_bad_snapshot_fails_the_request(spark):
    rows = usage_rows(spark, [("u", "d", "codex", "2026-01-01", "m", 17, "t", "h"), ("u", "d", "other", "2026-01-01", "m", 17, "t", "h")])
    zones = caches.zone_names(spark)
    assert caches.accepted(rows.limit(1), zones, ("codex",)).count() == 1
    with pytest.raises(Exception, match="invalid snapshot: source"):
        caches.accepted(rows, zones, ("codex",)).collect()


def test_texts_are_cut_between_characters(spark):
    texts = ["short", "é" * 10, "a" + "é" * 10, "漢" * 10, "ab" + "😀" * 10, "x  " + "y" * 30]
    got = values(spark, "s string", [(t,) for t in texts], text.truncated(F.col("s"), 12, "..."))
    for t, g in zip(texts, got):
        kept = t
        if len(t.encode()) > 12:
            kept = t.encode()[:9].decode("utf-8", "ignore").rstrip() + "..."
        assert g == kept
    assert values(spark, "x long", [(999_999,), (999_995_000,), (1_234_567,), (-5_000_000_000,)], text.compact_text(F.col("x")))[1:] == ["1B", "1.23M", "-5B"]
    assert values(spark, "x double", [(1234.5,), (-0.005,), (-2.0,)], text.usd_text(F.col("x"))) == ["$1,234.50", "-$0.01", "-$2.00"]


def test_sealed_texts_and_signatures(spark):
    key, nonce = F.lit(b"k" * 32), F.lit(b"n" * 12)
    sealed = text.sealed(F.col("s"), key, nonce)
    assert values(spark, "s string", [("secret é",)], text.opened(sealed, key)) == ["secret é"]
    assert values(spark, "s string", [("secret",)], text.opened(sealed, F.lit(b"x" * 32))) == [None]
    for secret in ("s", "k" * 100):
        want = base64.b64encode(hmac.new(secret.encode(), "m\né".encode(), hashlib.sha256).digest()).decode()
        assert values(spark, "s string", [("m\né",)], text.signature(F.col("s"), F.lit(secret))) == [want]


def test_card_is_well_formed(spark):
    shown = text.card(F.col("s"), F.array(F.lit("totalTokens"), F.lit("totalCost")), F.create_map(F.lit("totalTokens"), F.lit("5 < 6")), F.lit("wide"))
    svg = values(spark, "s string", [('<A & "B">',)], shown)[0]
    root = ElementTree.fromstring(svg)
    assert [e.text for e in root] == ['<A & "B">', "totalTokens: 5 < 6", "totalCost: 0"]


def test_scan_bounds():
    assert scans.bounds("2026-04-01", "20260402") == ("2026-04-01 00:00:00", "2026-04-02 23:59:59.999") and scans.bounds("all", None) == (None, None)
    with pytest.raises(ValueError):
        scans.bounds("April", None)
    assert scans.default_since(datetime(2026, 4, 29, 20, tzinfo=timezone.utc), "Asia/Shanghai") == "20260423"


def test_report_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "r.json").write_text('{"data":[\n{"date":"2026-04-28","model":"m","inputTokens":3}]}')
    (tmp_path / "note.txt").write_text("{}")
    got = reports.normalize(reports.read_documents(spark, str(tmp_path))).collect()
    assert [(r["usage_date"], r["model"], r["total_tokens"]) for r in got] == [("2026-04-28", "m", 3)]


def test_a_tick_goes_on_after_a_failure(spark):
    usage = usage_rows(spark, [("u", "d", "codex", "2026-01-01", "m", 5, "t1", "a")])
    summary = facts.summarize(usage.limit(0))
    stored = {}

    def deliver():
        raise OSError("down")

    history = spark.createDataFrame([("2026-01-01",), ("2026-01-20",)], "report_date string")
    got = jobs.tick(refresh.Tables(usage, summary, caches.totals_of(summary)), refresh.Backfill(), history, "2026-01-20", 7, 50, "now", deliver, stored.__setitem__)
    assert isinstance(got["delivery"], OSError) and got["backfill"] is None and got["prune"] is None
    assert stored["state"].completed_at == "now" and stored["summary"].count() == 1 and stored["totals"].count() == 1 and stored["history"].count() == 1


def test_uploads_are_tried_again():
    waits, left = [], [OSError(), TimeoutError()]

    def send():
        if left:
            raise left.pop()

    assert jobs.sent(send, sleep=waits.append) == 3 and waits == [1.0, 2.0]
    left[:] = [OSError(), OSError(), OSError()]
    with pytest.raises(OSError):
        jobs.sent(send, sleep=waits.append)
