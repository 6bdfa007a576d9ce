"""Stages of the pipeline on the smallest table and on odd rows."""

from collections import Counter

import pytest
from test_ngram_join import shingle_set

import corpus_pipeline as P
from deskloom.llm.common import labels
from deskloom.llm.packing import pack
from deskloom.llm.quality import score_quality

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the written rows of each stage, over the whole table."""
    from deskloom.llm.common import documents, pin

    out = [documents(spark, SF)]
    for name, stage in P.STAGES:
        out.append(pin(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_quality_keeps_clean_documents(spark, stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    known = labels(spark, SF).collect()
    good = [r["doc_id"] in kept for r in known if r["quality"] == 1]
    bad = [r["doc_id"] in kept for r in known if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    accepted = score_quality(stages[0], labels(spark, SF)).where("predicted = 1").count()
    assert len(kept) == accepted and set(rows_of(stages[1])) <= set(rows_of(stages[0]))


def test_lines_keep_every_document(stages):
    before = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    after = {r["doc_id"]: r for r in stages[2].collect()}
    assert set(before) == set(after)
    for i, r in after.items():
        assert r["n_chars"] == len(r["text"])
        assert not Counter(r["text"].split("\n")) - Counter(before[i].split("\n"))


def test_one_of_each_group_stays(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages[2].collect())
    sets = [shingle_set(t) for _, t in rows]
    index = {}
    for i, s in enumerate(sets):
        for token in s:
            index.setdefault(token, []).append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for token in s for j in index[token] if j < i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = {rows[i][0] for i in range(len(rows)) if find(i) == i}
    assert {r["doc_id"] for r in stages[3].collect()} == want


def test_mix_and_packing(stages):
    assert set(rows_of(stages[4])) <= set(rows_of(stages[3]))
    got = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in stages[5].collect())
    assert got == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in pack(stages[4]).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    """Every stage by itself on odd rows, and on none."""
    for name, stage in P.STAGES:
        out = stage(spark, odd_docs, SF)
        assert out.count() >= 1 and (name == "packing" or out.columns == odd_docs.columns)
        assert stage(spark, no_docs, SF).count() == 0
    left = P.one_of_each_group(spark, odd_docs, SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left).most_common(1)[0][1] == 1
    assert {r["doc_id"] for r in left} >= {1, 4, 5, 8} and 2 not in {r["doc_id"] for r in left}
