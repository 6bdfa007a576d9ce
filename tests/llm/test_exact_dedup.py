import hashlib
from collections import Counter, defaultdict

from deskloom.llm.exact_dedup import exact_dedup, frequent

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def digest(text):
    return hashlib.sha256((text or "").translate(UPPER).encode()).hexdigest()


def check(df, **options):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    groups = defaultdict(list)
    for i, text in rows:
        groups[digest(text)].append(i)
    out = exact_dedup(df, **options).collect()
    assert Counter((r["doc_id"], r["text_sha256"]) for r in out) == Counter((i, digest(t)) for i, t in rows)
    for r in out:
        ids = [i for i in groups[r["text_sha256"]] if i is not None]
        assert r["keep_id"] == (max(ids) if ids else None)
        assert r["group_size"] == len(groups[r["text_sha256"]])
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert Counter(r["text_sha256"] for r in out if r["kept"]) == Counter(dict.fromkeys(groups, 1))
    return out


def test_equals_brute_force(docs):
    check(docs)


def test_hot_and_cold_agree(docs):
    hot = check(docs, hot_share=1e-9)
    cold = check(docs, hot_share=2.0)
    assert sorted(map(tuple, hot)) == sorted(map(tuple, cold))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert exact_dedup(no_docs).collect() == []


def test_sketch_finds_every_frequent_value(spark):
    from pyspark.sql import functions as F

    df = spark.range(20000).repartition(8).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, "b").otherwise(F.col("id").cast("string")).alias("k")
    )
    found = {r["k"] for r in frequent(df, "k", 256).collect()}
    assert {"a", "b"} <= found and len(found) <= 128
