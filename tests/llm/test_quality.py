import zlib

import numpy as np
import pytest

from deskloom.llm.common import documents, labels
from deskloom.llm.quality import descend, score_quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return score_quality(documents(spark, SF), labels(spark, SF)).cache()


def test_held_out_accuracy(spark, scored):
    rows = scored.join(labels(spark, SF), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    assert np.mean(right) >= 0.97 and np.mean(good) >= 0.99
    ranks = [(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in rows if a["quality"] for b in rows if not b["quality"]]
    assert np.mean(ranks) >= 0.98


def test_shape(spark, scored):
    rows = scored.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in documents(spark, SF).collect())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_other_columns_and_held_out_labels_do_not_matter(spark, docs):
    own = labels(spark, "/root/testdata/sf0.001")
    first = score_quality(docs, own).collect()
    flipped = own.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    other = docs.selectExpr("doc_id", "text", "'zz' as lang", "'s' as source", "1 as label", "2 as id")
    second = score_quality(other, flipped).collect()
    assert {r["doc_id"]: round(r["score"], 9) for r in first} == {r["doc_id"]: round(r["score"], 9) for r in second}


def test_odd_rows(spark, odd_docs, no_docs):
    own = spark.createDataFrame([(1, 1), (3, 0), (9, 1), (10, 0), (None, 1), (5, None), (3, 0)], "doc_id long, quality int")
    rows = score_quality(odd_docs, own).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (4, 5)}
    assert len(empty) == 1
    assert score_quality(no_docs, own).collect() == []
    assert {r["score"] for r in score_quality(odd_docs, own.where("false")).collect()} == {0.5}


def test_descent_meets_its_conditions():
    """The duality gap of the fitted model is small."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 12)) for _ in range(80)]
    ratio = rng.normal(size=50)
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    weight, bias = descend(rows, y, ratio, rounds=3000)
    x = np.zeros((80, 51))
    for i, own in enumerate(rows):
        x[i, own] = ratio[own] / np.sqrt((ratio[own] ** 2).sum())
        x[i, 50] = 1
    w = np.append(weight, bias)
    primal = 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    for _ in range(200):
        near = w + rng.normal(size=51) * 0.05
        assert 0.5 * near @ near + np.maximum(0, 1 - y * (x @ near)).sum() >= primal - 0.05
