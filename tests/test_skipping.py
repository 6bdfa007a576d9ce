"""Searches over stored tables: the same rows as without bitmaps, from fewer files."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskloom.functions.text import literal_runs
from deskloom.operators import filters as FI
from deskloom.operators import ingest as I
from deskloom.operators import skipping as SK
from deskloom.sources.tables import tickets as stored_tickets

KIND = "ticket_no bigint, store_name string, subject string, status string, job_order string, contact_number string, email string, concern string, assigned_it string, date timestamp_ntz"
STORES = ["Café Ñandú", "cafe nandu 2", "ÉCOLE №5", "İstanbul", "ΟΔΟΣ ΑΣ", "Straße 😀 x", None, "ab", "100% Fresh_Mart", "a\\b shop"]


def rows(names, start):
    rng = random.Random(start)
    return [
        (start + i, n, f"Printer {rng.randrange(50)}", "pending", f"jo-{start + i:04d}", None, f"u{i}@x", f"concern {n} {i}", f"Technician {i % 7}", None)
        for i, n in enumerate(names)
    ]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table") / "entries")
    for k, name in enumerate(STORES):
        SK.append_indexed(spark.createDataFrame(rows([name, f"Plain {k}", f"Other {k * 11}"], k * 100), KIND).coalesce(1), path, f"u{k}")
    return path


def files_opened(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    return plan.collectLeaves().head().metrics().apply("numFiles").value()


def same(a, b):
    return sorted(r["ticket_no"] for r in a.collect()) == sorted(r["ticket_no"] for r in b.collect())


@pytest.mark.parametrize("text", ["ñandú", "NANDU", "école", "№5", "istanbul", "οδος ας", "straße", "😀 x", "jo-0301", "Plain 7", "n 4 t", "ab", "", "zzz", "concern"])
def test_search_finds_the_same_rows(spark, table, text):
    assert same(SK.search(spark, table, text), FI.search(stored_tickets(spark, table), text))


@pytest.mark.parametrize("text", ["cafe", "CAFÉ%nandu", "n_nd", "%", "_", "100\\% fresh", "\\_mart", "a\\\\b", "οδοσ", "İSTANBUL", "plain %7", "%%%other 11%%", "nothing at all"])
def test_store_filter_finds_the_same_rows(spark, table, text):
    assert same(SK.by_store(spark, table, text), FI.by_store(stored_tickets(spark, table), text))


def test_few_files_are_read(spark, table):
    assert files_opened(FI.search(stored_tickets(spark, table), "Other 55")) == 10
    assert files_opened(SK.search(spark, table, "Other 55")) == 1
    assert files_opened(SK.by_store(spark, table, "caf%nandu")) == 2
    assert SK.files_to_read(spark, table, "search", ["not there"]) == []


def test_files_without_bitmaps_are_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "entries")
    one, two = (spark.createDataFrame(rows(["One Store", "Two Store"], k), KIND).coalesce(1) for k in (0, 100))
    SK.append_indexed(one, path, "a")
    I.append_tickets(two, path, "b")  # an upload whose bitmaps are not there yet
    assert {r["ticket_no"] for r in SK.search(spark, path, "one store").collect()} == {0, 100}
    assert len(SK.files_to_read(spark, path, "search", ["zzz"])) == 1
    SK.append_indexed(two, path, "b")
    SK.append_indexed(two, path, "b")
    assert SK.files_to_read(spark, path, "search", ["zzz"]) == []
    assert {r["ticket_no"] for r in SK.search(spark, path, "one store").collect()} == {0, 100}
    monkeypatch.setattr(SK, "MOST_FILES", 1)
    assert SK.files_to_read(spark, path, "search", ["one store"]) is None
    assert {r["ticket_no"] for r in SK.search(spark, path, "one store").collect()} == {0, 100}


def test_literal_runs():
    assert literal_runs("%ab_c\\%d%%\\\\e\\f_") == ["ab", "c%d", "\\ef"]


def test_bitmaps_of_long_texts_hold_their_trigrams_and_take_time_in_proportion(spark, monkeypatch):
    rng = random.Random(5)
    long = ["".join(rng.choices("abcé😀 xyz", k=5000)) for _ in range(40)] + ["", "a", "ab", "abc"]
    names = [None, "ab", *(t[:k] for t, k in zip(long[:40], range(40)))] + [""] * 2
    made = [(i, n, None, None, None, None, None, c, None, None) for i, (n, c) in enumerate(zip(names, long))]
    stored = spark.createDataFrame(made, KIND).withColumn("file", F.concat(F.lit("f"), F.floor(F.col("ticket_no") / 20)))
    texts = {"store": lambda r: (r["store_name"] or "").lower().replace("é", "e")}
    plain = {(r["ticket_no"]): r["h"] for r in stored.select("ticket_no", FI.haystack(stored).alias("h")).collect()}
    wanted = set()
    for r in stored.drop("concern").collect():
        for kind, text in (("store", texts["store"](r)), ("search", plain[r["ticket_no"]])):
            wanted |= {(r["file"], kind, text[i : i + 3]) for i in range(len(text) - 2)}
    placed = spark.createDataFrame(list(wanted), "file string, kind string, t string").withColumn("p", SK._position(F.col("t")))
    placed = placed.select("file", "kind", F.bitmap_bucket_number("p"), F.bitmap_bit_position("p")).collect()
    began = time.time()
    found = SK.bitmaps(stored.repartition(2, "file")).collect()
    assert time.time() - began < 20  # cutting each text anew for each of its characters took minutes
    bits = {(r["file"], r["kind"], r["part"], 8 * i + b) for r in found for i, byte in enumerate(r["bits"]) for b in range(8) if byte >> b & 1}
    assert bits == {tuple(r) for r in placed}


@pytest.mark.parametrize("seen", [1, 4, SK.SEEN])
def test_trigrams_that_a_task_forgets_come_again(monkeypatch, seen):
    monkeypatch.setattr(SK, "SEEN", seen)
    texts = ["abcabc", "", "ab", "é😀x\0\0", "bcab", "😀x\0"]
    batch = pa.record_batch({"file": ["f", "f", "g", "g", "f", "f"], "search": texts, "store": texts[::-1]})
    found = [(r["file"], r["kind"], r["trigram"]) for b in SK._runs(iter([batch, batch.slice(0, 0), batch])) for r in b.to_pylist()]
    assert set(found) == {
        (r["file"], kind, r[kind][i : i + 3]) for r in batch.to_pylist() for kind in ("search", "store") for i in range(len(r[kind]) - 2)
    }
