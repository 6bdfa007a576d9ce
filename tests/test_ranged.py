"""The ticket table in key ranges: what a batch rewrites, and what it leaves alone."""

import os

import pytest
from pyspark.sql import functions as F

from deskloom.operators import changes as C
from deskloom.operators import ranged as RG
from deskloom.session import freeing, pin, scratch, shared_dir

EDITABLE = ("store_name", "contact_number", "email", "subject", "job_order", "reported_concern", "assigned_to", "status", "service_done", "labor_fee")


@pytest.fixture
def tickets(spark):
    return spark.range(1, 1001).select(
        F.col("id").alias("ticket_no"), F.concat(F.lit("Store "), "id").alias("store_name"), F.lit("09").alias("contact_number"),
        F.lit("Printer").alias("subject"), F.lit("Ann").alias("assigned_it"), F.lit("e@x").alias("email"), F.lit("c").alias("concern"),
        F.lit("pending").alias("status"), F.format_string("jo-%04d", "id").alias("job_order"), F.lit(None).cast("string").alias("service_done"),
        F.lit(None).cast("decimal(10,2)").alias("labor_fee"),
    )


def edits_of(spark, rows):
    empty = {c: F.lit("") for c in EDITABLE if c not in ("job_order", "store_name")}
    return spark.createDataFrame(rows, "ticket_no bigint, seq int, store_name string, job_order string").withColumns(empty)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def by_range(found):
    return {int(p.split("key_range=")[1].split("/")[0]) for p in found}


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_edits_rewrite_their_ranges_only(spark, tickets, tmp_path):
    path = str(tmp_path / "entries")
    RG.write_ranged(tickets, path, width=100)
    before = files(path)
    assert by_range(before) == set(range(11))
    # Of these, the second is refused, as ticket 900 has that job order, and the third is of no ticket.
    edits = edits_of(spark, [(150, 1, "new", "jo-0150"), (450, 2, "no", "jo-0900"), (5000, 3, "no", "x"), (151, 4, "moved", "JO-free"), (199, 5, "a", "")])
    assert RG.update_ranged(spark, path, edits, ["seq"], width=100) == [1]
    after = files(path)
    assert by_range(set(before) - set(after)) == {1} and by_range(after) == set(range(11))
    assert all(after[f] == before[f] for f in before if f in after)
    assert same(RG.read_ranged(spark, path), C.apply_updates(tickets, edits, ["seq"]))
    assert RG.update_ranged(spark, path, edits, ["seq"], width=100) == [1]  # once more changes nothing
    assert same(RG.read_ranged(spark, path), C.apply_updates(tickets, edits, ["seq"]))


def test_deletes_rewrite_their_ranges_only(spark, tickets, tmp_path):
    path = str(tmp_path / "entries")
    RG.write_ranged(tickets, path, width=100)
    before = files(path)
    keys = spark.createDataFrame([(i,) for i in (7, 7, 250, *range(300, 400), 9999)], "ticket_no bigint")
    assert RG.delete_ranged(spark, path, keys, width=100) == [0, 2, 3]
    after = files(path)
    assert by_range(set(before) - set(after)) == {0, 2, 3} and by_range(after) == set(range(11)) - {3}
    assert same(RG.read_ranged(spark, path), C.apply_deletes(tickets, keys, "ticket_no"))
    assert RG.delete_ranged(spark, path, keys, width=100) == []


def test_a_batch_of_nothing_writes_nothing(spark, tickets, tmp_path):
    path = str(tmp_path / "entries")
    RG.write_ranged(tickets, path)
    before = files(path)
    assert RG.update_ranged(spark, path, edits_of(spark, [(5000, 1, "x", "y")]), ["seq"]) == []
    assert files(path) == before


def test_touched_rows_are_written_once(spark, tickets, tmp_path, monkeypatch):
    path, pinned = str(tmp_path / "entries"), []
    monkeypatch.setattr(RG, "pin", lambda df, name, plain=RG.pin: pinned.append(name) or plain(df, name))
    RG.write_ranged(tickets, path, width=100)
    RG.update_ranged(spark, path, edits_of(spark, [(150, 1, "new", "jo-0150")]), ["seq"], width=100)
    keys = tickets.where("ticket_no < 250 or ticket_no = 999").select("ticket_no")
    assert RG.delete_ranged(spark, path, keys, width=100) == [0, 1, 2, 9]
    assert pinned == ["last-edits"]
    assert by_range(files(path)) == set(range(2, 11)) and RG.read_ranged(spark, path).count() == 750
    assert RG.delete_ranged(spark, path, tickets.select("ticket_no"), width=100) == list(range(2, 11)) and files(path) == {}


def test_a_rewritten_range_is_one_file_however_many_tasks_there_are(spark, tickets, tmp_path, monkeypatch):
    path, inside = str(tmp_path / "entries"), RG.SLICE
    RG.write_ranged(tickets, path, width=100)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        edits = edits_of(spark, [(i, 1, f"new {i}", f"JO-new-{i}") for i in range(1, 1001, 3)])
        assert RG.update_ranged(spark, path, edits, ["seq"], width=100) == list(range(11))
        assert len(files(path)) == 11 and same(RG.read_ranged(spark, path), C.apply_updates(tickets, edits, ["seq"]))
        keys = tickets.where("ticket_no % 7 = 0").select("ticket_no")
        assert RG.delete_ranged(spark, path, keys, width=100) == list(range(10))
        want = C.apply_deletes(C.apply_updates(tickets, edits, ["seq"]), keys, "ticket_no")
        assert len(files(path)) == 11 and same(RG.read_ranged(spark, path), want)
        monkeypatch.setattr(RG, "SLICE", 30)
        assert RG.delete_ranged(spark, path, tickets.where("ticket_no = 150").select("ticket_no"), width=100) == [1]
        per_range = [f.split("key_range=")[1].split("/")[0] for f in files(path)]
        assert 1 < per_range.count("1") <= 4 and same(RG.read_ranged(spark, path), want.where("ticket_no <> 150"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert inside >= 100_000


def test_a_batch_leaves_only_its_table_behind(spark, tickets, tmp_path):
    path = str(tmp_path / "entries")
    RG.write_ranged(tickets, path, width=100)
    top = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(top))
    edits = edits_of(spark, [(150, 1, "new", "jo-0900"), (900, 2, "b", "x"), (450, 3, "c", "JO-0900")])
    assert RG.update_ranged(spark, path, edits, ["seq"], width=100) == [4, 9]
    assert set(os.listdir(top)) == before
    assert same(RG.read_ranged(spark, path), C.apply_updates(tickets, edits, ["seq"]))


def test_written_jobs_free_their_shuffle_files_and_blocks_their_tables(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, other = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    with freeing(spark, spark__sql__shuffle__partitions="3"):
        assert spark.conf.get(key) == "true" and spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get(key) == before and spark.conf.get("spark.sql.shuffle.partitions") == other
    with scratch(spark):
        with scratch(spark, keep=1):
            first = pin(spark.range(5), "first")
            second = pin(first.selectExpr("id + 1 as id"), "second", compression="zstd")
        gone, there = (os.path.exists(t.inputFiles()[0].removeprefix("file://")) for t in (first, second))
        assert (gone, there) == (False, True) and second.count() == 5
        path = second.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(path)
    with pytest.raises(ZeroDivisionError):
        with scratch(spark, keep=1):
            path = pin(spark.range(5), "third").inputFiles()[0].removeprefix("file://")
            raise ZeroDivisionError
    assert not os.path.exists(path)
