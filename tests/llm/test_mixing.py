import math
from collections import Counter

from pyspark.sql import functions as F

from deskloom.llm.mixing import cumulative, mix, rates


def test_cumulative_sums(spark):
    for mean in (0.0, 0.3, 7.5, 480.0):
        sums = spark.range(1).select(cumulative(F.lit(mean)).alias("c")).first()["c"]
        p = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean else float(k == 0) for k in range(len(sums))]
        assert all(abs(s - sum(p[: k + 1])) < 1e-9 for k, s in enumerate(sums))
        assert sums[-1] > 1 - 1e-9


def test_rates_meet_the_weights(docs):
    weights = {"src0": 3.0, "src1": 1.0}
    table = {r["src"]: r for r in rates(docs, weights=weights, epochs=2.0).collect()}
    total = sum(r["bytes"] for r in table.values())
    assert abs(table["src0"]["rate"] * table["src0"]["bytes"] - 1.5 * total) < 1e-6 * total
    assert abs(table["src1"]["rate"] * table["src1"]["bytes"] - 0.5 * total) < 1e-6 * total
    assert all(r["rate"] == 0 for s, r in table.items() if s not in weights)


def test_copies_follow_the_mean(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "'x' as text", "if(id % 10 < 9, 'a', 'b') as source")
    out = mix(df, {"a": 1.0, "b": 1.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in out}  # 10,000 expected of each
    assert all(abs(n[s] - 10000) < 5 * math.sqrt(10000 * 5) for s in "ab")
    assert abs(n["a"] - 10000) < 500


def test_a_mean_beyond_one_part(spark):
    df = spark.range(40).selectExpr("id as doc_id", "'x' as text", "if(id = 0, 'a', 'b') as source")
    out = mix(df, {"a": 1.0}, epochs=40.0).groupBy("doc_id").count().collect()
    assert [r["doc_id"] for r in out] == [0] and abs(out[0]["count"] - 1600) < 5 * 40


def test_rows_are_kept_whole(odd_docs, no_docs):
    clash = odd_docs.withColumnRenamed("digest", "copy")
    out = mix(clash, epochs=3.0)
    assert out.columns == [c for c in clash.columns if c != "copy"] + ["copy", "order_key"]
    rows = out.collect()
    whole = Counter((r["doc_id"], r["text"], r["source"]) for r in clash.collect())
    assert {(r["doc_id"], r["text"], r["source"]) for r in rows} <= set(whole)
    drawn = Counter((r["doc_id"], r["text"], r["source"]) for r in rows)
    assert all(n % whole[k] == 0 for k, n in drawn.items())
    assert mix(no_docs).collect() == []


def test_order_is_global(docs):
    rows = mix(docs).collect()
    assert len({r["order_key"] for r in rows}) == len(rows)
    assert rows == mix(docs.repartition(7)).collect()
