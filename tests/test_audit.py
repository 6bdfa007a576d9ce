"""Audit log text, its stream, and seeding."""

from datetime import datetime

from pyspark.sql import functions as F

from deskloom.operators import audit as A
from deskloom.operators import filters as FI
from deskloom.sources.audit_log import parse_audit_lines, read_audit_log
from deskloom.streaming.audit_stream import stream_audit_log, write_available

STAMP = "2026-01-02 03:04:05,678 [INFO] "


def parse(spark, *lines):
    return parse_audit_lines(spark.createDataFrame([(line,) for line in lines], "value string")).collect()


def test_golden_line(spark):
    line = STAMP + "user_updated | {'user_id': 3, 'email': None, 'role': \"O'Brien\", 'is_active': True, 'updated_fields': ['names']}"
    (row,) = parse(spark, line)
    assert row["timestamp"] == datetime(2026, 1, 2, 3, 4, 5, 678000) and row["level"] == "INFO"
    assert row["action"] == "user_updated" and row["message"] is None
    assert (row["user_id"], row["email"], row["role"], row["is_active"]) == (3, None, "O'Brien", True)
    assert row["updated_fields"] == ["names"]


def test_any_printed_dict(spark):
    """Texts with quotes, escapes and constants survive, as printed by Python."""
    texts = ["it's", 'say "x"', "both ' and \"", "a, None, b", "back\\slash", "line\nbreak", "\x1b[0m\x1b", "\\x41", "é—"]
    lines = [STAMP + f"ticket_created | {{'user_id': None, 'store_name': {t!r}, 'ua': {[t][0]!r}, 'ticket_pk': 7}}" for t in texts]
    rows = parse(spark, *lines)
    assert [r["store_name"] for r in rows] == texts and [r["ua"] for r in rows] == texts
    assert {(r["user_id"], r["ticket_pk"]) for r in rows} == {(None, 7)}


def test_free_text_and_broken_lines(spark):
    rows = parse(spark, STAMP + "Form data: {'a': 1}", "Traceback", STAMP + "logout | {'user_id': oops", "9999-99-99 00:00:00,000 [INFO] x")
    assert [(r["action"], r["message"]) for r in rows] == [
        (None, "Form data: {'a': 1}"),
        (None, "Traceback"),
        (None, "logout | {'user_id': oops"),
        (None, "x"),
    ]
    assert rows[0]["timestamp"] is not None and rows[1]["timestamp"] is None and rows[3]["timestamp"] is None


def test_stream_equals_batch(spark, tmp_path):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir()

    def segment(name, ids):
        text = "".join(f"{STAMP}login_success | {{'user_id': {i}, 'email': None, 'ip': '10.0.0.1'}}\n" for i in ids)
        (logs / name).write_text(text + "free text\n")

    segment("app.log.2", range(5))
    write_available(stream_audit_log(spark, str(logs)), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 6
    segment("app.log.1", range(5, 9))
    write_available(stream_audit_log(spark, str(logs)), out, state).awaitTermination()
    batch, streamed = read_audit_log(spark, str(logs)), spark.read.parquet(out)
    assert streamed.columns == batch.columns
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert batch.count() == 11


def test_seeding(spark):
    pairs = [("system_startup", "{}"), ("app_deployed", '{"version": 1}')]
    seeds = A.seed_rows(spark, pairs)
    empty = spark.createDataFrame([], "action string, payload string")
    assert [tuple(r) for r in A.seed_if_absent(seeds, empty).collect()] == pairs
    once = seeds.where("action = 'app_deployed'").withColumn("action", F.upper("action"))
    assert A.seed_if_absent(seeds, once).count() == 0
    other = A.seed_rows(spark, [("first_run", "{}")])
    assert A.seed_if_absent(other, once).count() == 1 and A.seed_if_absent(other, other).count() == 0
    assert FI.by_action(seeds, ["APP_deployed"]).count() == 1 and FI.by_action(seeds, []).count() == 0


def test_latest(spark):
    df = spark.createDataFrame([(1, None), (2, "2026-01-02"), (3, "2026-01-03")], "id int, timestamp string")
    df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert [r["id"] for r in A.latest_audit(df, 2).collect()] == [3, 2]
