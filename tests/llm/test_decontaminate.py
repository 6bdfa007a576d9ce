import re

import pytest

from deskloom.llm import decontaminate as dec
from deskloom.llm.common import ship

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=10):
    wins = {}
    for item, text in items:
        w = words(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, own = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    own |= wins[tuple(w[i : i + k])]
        out.append((doc, len(w), sorted(hit), sorted(own - {None})))
    return sorted(out, key=str)


def run(df, benchmark, **options):
    ship(df.sparkSession)
    rows = dec.scan(df, benchmark, **options).collect()
    return sorted(
        ((r["doc_id"], r["_n_words"], [p for s in r["_spans"] for p in range(s["first"], s["end"])], r["_items"]) for r in rows), key=str
    )


@pytest.fixture(scope="module")
def bench(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")


def plain(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_equals_brute_force(docs, bench):
    got = run(docs, bench)
    assert got == brute(plain(docs, "doc_id", "text"), plain(bench, "item_id", "text"))
    assert any(r[2] for r in got) and not all(r[2] for r in got)


def test_blocks_find_the_same(docs, bench, monkeypatch):
    whole = run(docs, bench)
    monkeypatch.setattr(dec, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(dec, "PIECE", 7)
    assert run(docs, bench) == whole


ITEMS = [
    (1, "One two-three FOUR"),
    (1, "One two-three FOUR"),
    (2, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"),
    (3, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"),
    (4, None),
    (5, " .,; "),
    (None, "été x 😀"),
    (6, "long"),
    (7, "no such words anywhere"),
]


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert run(odd_docs, items) == brute(plain(odd_docs, "doc_id", "text"), ITEMS)
    assert run(odd_docs, items.where("false")) == brute(plain(odd_docs, "doc_id", "text"), [])
    assert run(no_docs, items) == []


def test_windows_stay_inside_documents(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three four"), (3, "ONE, two... three four!")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "one two three four")], "item_id long, text string")
    assert run(docs.coalesce(1), items) == [(1, 2, [], []), (2, 2, [], []), (3, 4, [0, 1, 2, 3], [9])]


def test_removal(spark):
    rows = [(1, "Ä start. One two-three FOUR! The éend", 7), (2, "  one two  ", 7), (3, None, 7), (4, "one TWO three four", 7), (5, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _Spans int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    ship(spark)
    cut = {r["doc_id"]: r["text"] for r in dec.decontaminate(docs, items).collect()}
    assert cut == {1: "Ä start. ! The éend", 2: "  one two  ", 3: None, 4: "", 5: ""}
    left = dec.decontaminate(docs, items, remove="documents")
    assert {r["doc_id"] for r in left.collect()} == {2, 3, 5} and left.columns == ["doc_id", "text"]
    with pytest.raises(ValueError):
        dec.decontaminate(docs, items, remove="all")
