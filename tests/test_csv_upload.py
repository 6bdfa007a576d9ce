"""CSV uploads: record boundaries, cells and validation."""

import csv
import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from deskloom.operators import ingest as I
from deskloom.schema import UPLOAD_COLUMNS
from deskloom.sources import csv_upload as U

HEADER = "store_name,contact_number,email,subject,reported_concern,assigned_to,status"


def write(folder, name, text):
    (folder / name).write_bytes(text.encode())
    return str(folder)


def test_golden_upload(spark, tmp_path):
    long = "s" * 46
    text = "\r\n".join(
        [
            HEADER,
            "Uno,0917,,Printer,broken,Ann,Complete",
            "",
            '"Dos\nTres",,d@x.y,Printer,"say ""hi"", please",,',
            "Uno,0917,, ,broken,Ann,",
            "Uno,,,Printer,broken,Ann,",
            "Uno,0917",
            f"{long},0917,,Printer,broken,,",
            "Ocho,0917,,Printer,broken,,ongoing,extra",
            "Nueve,0917,a+b@x.y,Printer,<script>&'\",Ann,weird",
        ]
    )
    checked = I.validate(U.read_ticket_csv(spark, write(tmp_path, "a.csv", text)))
    rows = {r["row_num"]: r for r in checked.collect()}
    assert sorted(rows) == list(range(2, 10))
    assert {n: r["error"] for n, r in rows.items() if r["error"]} == {
        4: "Row 4: Missing required fields",
        5: "Row 5: At least one of contact_number or email is required",
        6: "Row 6: Row is shorter than the header",
        7: "Row 7: Data too long for column store_name",
    }
    assert rows[2]["status"] == "completed" and rows[9]["status"] == "pending"
    assert rows[3]["store_name"] == "Dos\nTres" and rows[3]["reported_concern"] == 'say "hi", please'
    assert rows[9]["reported_concern"] == "<script>&'\"" and rows[9]["email"] == "a+b@x.y"

    accepted, rejected = I.split_valid(checked)
    tickets = spark.createDataFrame(
        [(7, "jo-0012", "x"), (9, "draft", "y"), (8, None, "z")], "ticket_no int, job_order string, concern string"
    ).withColumns({"status": F.lit("pending"), "store_name": F.lit("s"), "assigned_it": F.lit("i")})
    new = I.new_tickets(accepted, tickets, "2026-01-01 00:00:00", [F.asc("file"), F.asc("row_num")])
    got = [(r["ticket_no"], r["job_order"], r["store_name"]) for r in new.orderBy("ticket_no").collect()]
    assert got == [(10, "jo-0013", "Uno"), (11, "jo-0014", "Dos\nTres"), (12, "jo-0015", "Ocho"), (13, "jo-0016", "Nueve")]
    assert rejected.count() == 4

    summary = I.ingest_summary(checked).first()
    assert (summary["created"], summary["failed"], summary["more_errors"]) == (4, 4, 0)
    assert summary["errors"].split("; ")[0] == "Row 4: Missing required fields"


def test_refused_header(spark, tmp_path):
    write(tmp_path, "bad.csv", "store_name,Subject,reported_concern\nA,b,c\n")
    write(tmp_path, "good.csv", "﻿store_name,subject,reported_concern,email\nA,b,c,d@e.f\n")
    lines = U.upload_lines(spark, str(tmp_path))
    refused = U.refused_uploads(lines).collect()
    assert [r["message"] for r in refused] == ["Missing required columns: subject"]
    rows = I.validate(U.parse_uploads(lines)).collect()
    assert [(r["store_name"], r["status"], r["error"]) for r in rows] == [("A", "pending", None)]


def as_lines(spark, texts, block_size):
    """Lines of several files with small blocks, as a scan of a large file would give them."""
    rows = []
    for file, text in texts.items():
        for i, line in enumerate(text.split("\n")):
            rows.append((file, i // block_size, i, line))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "file string, block bigint, pos bigint, value string")


def random_text(seed):
    rnd = random.Random(seed)
    pieces = ["a", "b c", '"', '""', ",", "\n", "\n", "x", '",', ',"', '"\n']
    rows = []
    for _ in range(40):
        if rnd.random() < 0.7:
            cells = ["".join(rnd.choice(["a", '"', ",", "\n", "é", " "]) for _ in range(rnd.randint(0, 6))) for _ in range(7)]
            out = io.StringIO()
            csv.writer(out, lineterminator="\n").writerow(cells)
            rows.append(out.getvalue())
        else:
            rows.append("".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9))) + "\n")
    return HEADER + "\n" + "".join(rows)


@pytest.mark.parametrize("block_size", [1, 3, 1000])
def test_records_equal_pythons_reader(spark, block_size):
    texts = {f"f{seed}": random_text(seed) for seed in range(12)}
    got = {}
    for r in U.parse_uploads(as_lines(spark, texts, block_size)).collect():
        got.setdefault(r["file"], []).append(r)
    for file, text in texts.items():
        expected = list(csv.DictReader(io.StringIO(text)))
        mine = sorted(got.get(file, []), key=lambda r: r["row_num"])
        assert [r["row_num"] for r in mine] == list(range(2, len(expected) + 2))
        for row, want in zip(mine, expected):
            assert {c: row[c] for c in UPLOAD_COLUMNS} == {c: want[c] for c in UPLOAD_COLUMNS}
            assert row["short"] == any(want[c] is None for c in UPLOAD_COLUMNS)


def errors_of(spark, text, block_size):
    rows = I.validate(U.parse_uploads(as_lines(spark, {"f": text}, block_size))).orderBy("row_num").collect()
    return [(r["row_num"], r["error"]) for r in rows]


@pytest.mark.parametrize("block_size", [1, 7, 1000])
def test_endless_quote_rejects_its_row(spark, monkeypatch, block_size):
    monkeypatch.setattr(U, "AS_IT_IS", 50)
    body = "\n".join(f"line, {i}" for i in range(100))
    text = f'{HEADER}\nA,1,,s,c,,\nB,1,,s,"open,\n{body}'
    assert errors_of(spark, text, block_size) == [(2, None), (3, "Row 3: Row is shorter than the header")]
    # In the last column, a long text is no known status; before it, it is over the width.
    assert errors_of(spark, f'{HEADER}\nB,1,,s,c,,"pending\n{body}', block_size) == [(2, None)]
    wide = f'reported_concern,subject,store_name,assigned_to,contact_number,email,status\nc,s,t,"\n{body}",1,,\nc,s,t,a,1,,'
    assert errors_of(spark, wide, block_size) == [(2, "Row 2: Data too long for column assigned_to"), (3, None)]


@pytest.mark.parametrize("block_size", [2, 50])
def test_long_cells_that_fit_without_their_blanks(spark, monkeypatch, block_size):
    monkeypatch.setattr(U, "AS_IT_IS", 20)
    blank = "\n   \t" * 30
    rows = [
        ["A", "1", "", "s" + blank, blank + "two\n" + "lines" + blank, blank, blank + " Complete" + blank],
        ["B", "1", "", "s", blank + "x" * 255 + blank, "", "y" * 30 + "\n"],
        ["C", "1", "", "s", blank + "x" * 100 + "\n" + "x" * 155 + blank, "", ""],
        ["D", blank, "", "s", "c", "", ""],
        ["E\n", "1", "", "s", "c", "a\n\n b", "", "more" + blank],
    ]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    got = I.validate(U.parse_uploads(as_lines(spark, {"f": HEADER + "\n" + out.getvalue()}, block_size)))
    got = {r["row_num"]: r for r in got.collect()}
    assert (got[2]["subject"], got[2]["reported_concern"], got[2]["assigned_to"], got[2]["status"]) == ("s", "two\nlines", None, "completed")
    assert (got[3]["reported_concern"], got[3]["status"], got[3]["error"]) == ("x" * 255, "pending", None)
    assert got[4]["error"] == "Row 4: Data too long for column reported_concern"
    assert got[5]["error"] == "Row 5: At least one of contact_number or email is required"
    assert (got[6]["store_name"], got[6]["assigned_to"], got[6]["error"]) == ("E", "a\n\n b", None)


def test_records_beyond_any_old_limit(spark):
    """20 million characters in an extra cell, on one line and over many, are no reason to refuse a row."""
    many = "\n".join("x" * 99 for _ in range(200_000))
    text = f'{HEADER},note\nA,1,,s,c,,,"{many}"\nB,1,,s,c,,,{"y" * 20_000_000}\nC,1,,s,c,,ongoing,'
    rows = spark.createDataFrame(
        [("f", i // 5000, i, line) for i, line in enumerate(text.split("\n"))], "file string, block bigint, pos bigint, value string"
    )
    got = [(r["row_num"], r["store_name"], r["error"]) for r in I.validate(U.parse_uploads(rows)).orderBy("row_num").collect()]
    assert got == [(2, "A", None), (3, "B", None), (4, "C", None)]


def test_a_file_that_cannot_be_split_is_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(U, "BLOCK_LINES", 64)
    rows = "".join(f'Store {i},0917,,"multi\nline, {i}",c,,\n' for i in range(1000))
    (tmp_path / "big.csv.gz").write_bytes(gzip.compress((HEADER + "\n" + rows).encode()))
    lines = U.upload_lines(spark, str(tmp_path))
    assert lines.select("block").distinct().count() == 32
    got = U.parse_uploads(lines).agg(F.count("*"), F.max("row_num"), F.min("subject")).first()
    assert tuple(got) == (1000, 1001, "multi\nline, 0")


def test_lines_are_read_once(spark, tmp_path):
    write(tmp_path, "a.csv", HEADER + "\nA,1,,s,c,,\n")
    plan = U.parse_uploads(U.upload_lines(spark, str(tmp_path)))._jdf.queryExecution().toString()
    assert "FileScan text" not in plan


def test_a_very_long_extra_cell_is_accepted(spark):
    text = f'{HEADER},note\nA,1,,s,c,,,{"x" * 140_000}'
    row = U.parse_uploads(as_lines(spark, {"f": text}, 1000)).first()
    assert (row["store_name"], row["short"]) == ("A", False)


def test_large_file_is_split(spark, tmp_path):
    """Several scan splits of one file give the same rows as one."""
    rows = "".join(f'Store {i},0917,,"multi\nline, {i}",c,,\n' for i in range(3000))
    write(tmp_path, "big.csv", HEADER + "\n" + rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = U.upload_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 3
        got = U.parse_uploads(lines).agg(F.count("*"), F.max("row_num"), F.count_if("short"), F.min("subject")).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(got) == (3000, 3001, 0, "multi\nline, 0")
