"""Number ranges of uploads that run at the same time, stop half-way or are repeated."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from deskloom.operators import ingest as I
from deskloom.operators import ledger as L
from deskloom.sources.tables import tickets as stored_tickets

UPLOAD = "row_num bigint, store_name string, contact_number string, email string, subject string, reported_concern string, assigned_to string, status string"
AS_OF = "2026-01-02 03:04:05"


@pytest.fixture
def tickets(spark):
    kind = "ticket_no bigint, job_order string, concern string, status string, store_name string, assigned_it string"
    return spark.createDataFrame([(7, "jo-0012", "x", "pending", "s", "i"), (9, "draft", "y", "pending", "s", "i")], kind)


def upload(spark, n, bad=()):
    rows = [(i, "" if i in bad else f"Store {i}", "09", None, "Printer", f"c{i}", "", "") for i in range(2, n + 2)]
    return spark.createDataFrame(rows, UPLOAD).repartition(3)


def test_claims_follow_each_other(spark, tickets, tmp_path):
    folder = str(tmp_path / "ledger")
    assert L.reserve(folder, "a/1", 5, tickets) == ("a/1", 9, 12, 5)
    assert L.reserve(folder, "b", 0, tickets) == ("b", 14, 17, 0)
    assert L.reserve(folder, "c", 2, tickets) == ("c", 14, 17, 2)
    assert L.reserve(folder, "a/1", 5, tickets) == ("a/1", 9, 12, 5)
    with pytest.raises(ValueError, match="reserved numbers for 5"):
        L.reserve(folder, "a/1", 6, tickets)
    higher = tickets.withColumn("job_order", F.lit("jo-0500"))  # an edit may have gone ahead of the ledger
    assert L.reserve(folder, "d", 1, higher) == ("d", 16, 500, 1)
    for i in range(9):
        assert L.reserve(folder, f"more {i}", 1, tickets).ticket_no == 17 + i


def test_no_number_is_drawn_twice(spark, tickets, tmp_path):
    """Many claims at once, all made before any upload is appended."""
    folder = str(tmp_path / "ledger")
    with ThreadPoolExecutor(8) as pool:
        claims = list(pool.map(lambda i: L.reserve(folder, f"u{i}", i % 4 + 1, tickets), range(24)))
    drawn = [c.ticket_no + k for c in claims for k in range(c.rows)]
    assert sorted(drawn) == list(range(9, 9 + len(drawn)))


def test_an_upload_that_stopped_gets_its_claim_back(spark, tickets, tmp_path, monkeypatch):
    folder = str(tmp_path / "ledger")
    create = L._Files.create

    def stops(self, name, text):
        if name.endswith(".done"):
            raise KeyboardInterrupt
        return create(self, name, text)

    monkeypatch.setattr(L._Files, "create", stops)
    with pytest.raises(KeyboardInterrupt):
        L.reserve(folder, "a", 3, tickets)
    monkeypatch.setattr(L._Files, "create", create)
    assert L.reserve(folder, "b", 1, tickets).ticket_no == 12
    assert L.reserve(folder, "a", 3, tickets) == ("a", 9, 12, 3)


def test_a_claim_without_its_text_is_not_passed_over(spark, tickets, tmp_path, monkeypatch):
    folder = tmp_path / "ledger"
    L.reserve(str(folder), "a", 3, tickets)
    (folder / "claims" / "000000000002.json").write_text("")
    monkeypatch.setattr(L, "PATIENCE", 0.1)
    with pytest.raises(RuntimeError, match="not finished"):
        L.reserve(str(folder), "b", 3, tickets)


def test_interleaved_and_repeated_uploads(spark, tickets, tmp_path):
    path, folder = str(tmp_path / "entries"), str(tmp_path / "ledger")
    I.append_tickets(tickets, path, "before")
    order = [F.asc("row_num")]
    one, two = upload(spark, 40, bad={3, 8}), upload(spark, 25, bad={2})
    stored = stored_tickets(spark, path)
    claim = L.reserve(folder, "one", 38, stored)  # reserved, but appended last
    I.ingest_upload(two, stored, path, folder, "two", AS_OF, order)
    staged = I.ingest_upload(one, stored_tickets(spark, path), path, folder, "one", AS_OF, order)
    I.ingest_upload(two, stored_tickets(spark, path), path, folder, "two", AS_OF, order)
    rows = stored_tickets(spark, path).orderBy("ticket_no").collect()
    assert [r["ticket_no"] for r in rows] == [7, 9, *range(10, 10 + 38 + 24)]
    assert [r["job_order"] for r in rows[2:]] == [f"jo-{n:04d}" for n in range(13, 13 + 62)]
    assert [r["concern"] for r in rows[2:40]] == [f"c{i}" for i in range(2, 42) if i not in (3, 8)]
    assert claim.rows == 38 and I.ingest_summary(staged.withColumn("file", F.lit("f"))).first()["failed"] == 2


def test_staged_rows_are_written_once(spark, monkeypatch):
    from deskloom.operators import numbering as N

    written = []
    monkeypatch.setattr(N, "pin", lambda df, *names, plain=N.pin: written.append(1) or plain(df, *names))
    staged = I.stage_in_order(upload(spark, 500, bad=set(range(2, 500, 3))), [F.asc("row_num")])
    accepted = I.split_valid(staged)[0]
    numbered = N.with_sequence(accepted, [F.asc("row_num")]).orderBy("seq").collect()
    assert len(written) == 1 and [r["seq"] for r in numbered] == list(range(1, len(numbered) + 1))
    assert [r["row_num"] for r in numbered] == sorted(r["row_num"] for r in numbered)
