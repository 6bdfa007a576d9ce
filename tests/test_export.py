"""CSV export: dialect, order, titles, names and the way back."""

import csv
import glob
import io

import pytest
from pyspark.sql import functions as F

from deskloom.operators import export as X
from deskloom.sources.derived import view


@pytest.fixture
def tickets(spark):
    rows = [
        (1, 'a"b', "2026-01-02 03:04:05", "5", " pad ", "x"),
        (2, None, None, None, "l1\nl2", "y"),
        (3, "c,d", "2026-01-03 00:00:00", "0", "", "z"),
    ]
    df = spark.createDataFrame(rows, "ticket_no int, store_name string, date string, labor_fee string, status string, foo_bar string")
    return df.withColumns({"date": F.col("date").cast("timestamp_ntz"), "labor_fee": F.col("labor_fee").cast("decimal(10,2)")})


def read(path):
    rows = []
    for part in sorted(glob.glob(f"{path}/part-*.csv")):
        with open(part, newline="", encoding="utf-8") as f:
            rows.append(list(csv.reader(io.StringIO(f.read()))))
    return rows[0][0], [r for part in rows for r in part[1:]]


def test_export_all(tickets, tmp_path):
    path = X.export_csv(tickets, str(tmp_path), status="ignored", everything=True)
    assert path.endswith("/tickets-all")
    header, rows = read(path)
    assert header == ["Ticket No", "Store Name", "Labor Fee", "Status", "Date", "Foo Bar"]
    assert rows == [
        ["3", "c,d", "0.00", "", "2026-01-03 00:00:00", "z"],
        ["1", 'a"b', "5.00", " pad ", "2026-01-02 03:04:05", "x"],
        ["2", "", "", "l1\nl2", "", "y"],
    ]
    raw = "".join(open(p, newline="").read() for p in glob.glob(f"{path}/part-*.csv"))
    assert '"a""b"' in raw and '"c,d"' in raw and "\r" not in raw


def test_filtered_and_empty_exports(tickets, tmp_path):
    path = X.export_csv(tickets, str(tmp_path), day="2026-01-02", store=" A\"B ")
    assert [r[0] for r in read(path)[1]] == ["1"]
    path = X.export_csv(tickets, str(tmp_path), status="nothing")
    assert read(path) == (["Ticket No", "Store Name", "Labor Fee", "Status", "Date", "Foo Bar"], [])
    with pytest.raises(ValueError):
        X.export_csv(tickets, str(tmp_path), status=" ")


def test_names():
    assert X.export_name("2026-01-02", "Done", "Big Store") == "tickets-2026-01-02-status-Done-store-big-store"
    assert X.export_name() == "tickets-all"
    assert X.export_title("assigned_it") == "Assigned IT" and X.export_title("foo_bar") == "Foo Bar"


def test_order_keeps_unknown_columns_last():
    assert X.export_order(["x", "remedy", "date_completed", "ticket_no", "a"]) == ["ticket_no", "date_completed", "remedy", "x", "a"]


def test_round_trip(spark, tmp_path):
    """What is read back equals the formatted rows."""
    df = view(spark, "/root/testdata/sf0.001", "tickets")
    path = X.export_csv(df, str(tmp_path), everything=True)
    formatted = X.export_rows(df)
    back = (
        spark.read.schema(", ".join(f"`{c}` string" for c in formatted.columns))
        .options(header=True, multiLine=True, escape='"', nullValue="", emptyValue="")
        .csv(path)
        .fillna("")
    )
    assert back.exceptAll(formatted).count() == 0 and formatted.exceptAll(back).count() == 0


def joined(path):
    return b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_parts_are_one_file(spark, tickets, tmp_path):
    """The parts one after the other are the file that a single writer would have made."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = tickets.crossJoin(spark.range(300).select((F.col("id") * 10).alias("k"))).withColumn("ticket_no", F.col("ticket_no") + F.col("k")).drop("k")
        manifest = X.export_parts(many, str(tmp_path), everything=True).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = joined(tmp_path / "tickets-all")
    got = list(csv.reader(io.StringIO(text.decode(), newline="")))
    titles = X.export_rows(many).columns
    assert got[0] == titles and got[1:] == [list(r) for r in X.export_rows(many).collect()]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerow(titles)
    assert text.startswith(out.getvalue().encode()) and text.count(b"Ticket No") == 1
    assert len(manifest) > 2 and sum(r["rows"] for r in manifest) == 900 and sum(r["bytes"] for r in manifest) == len(text)
    for r in manifest:
        part = next(p for p in glob.glob(f"{tmp_path}/tickets-all/*") if p.endswith(r["part"]))
        assert text[r["start"] : r["start"] + r["bytes"]] == open(part, "rb").read()


def test_parts_of_nothing_are_the_header(spark, tickets, tmp_path):
    manifest = X.export_parts(tickets, str(tmp_path), status="nothing").collect()
    assert [(r["rows"], r["start"]) for r in manifest] == [(0, 0)]
    assert joined(tmp_path / "tickets-status-nothing") == b"Ticket No,Store Name,Labor Fee,Status,Date,Foo Bar\n"
    with pytest.raises(ValueError):
        X.export_parts(tickets, str(tmp_path))
