import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from deskloom.llm import merkle
from deskloom.llm.common import col, ship

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    parts = [row[f] for f in FIELDS[:-1]] + [text]
    return h("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def up(nodes):
    return [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]


def walk(levels, at):
    """Runs of siblings from a leaf to the top, as (nodes, own place)."""
    out = []
    for nodes in levels[:-1]:
        out.append((nodes[at - at % 3 : at - at % 3 + 3], at % 3))
        at //= 3
    return out


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append(up(out[-1]))
    return out


def brute(rows, cut):
    groups = defaultdict(list)
    for r in rows:
        text = r["text"]
        other = text.replace("\n", "") if cut(r["doc_id"]) and text is not None else text
        groups[r["source"]].append((r["doc_id"], leaf_of(r, text), leaf_of(r, other)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((own, levels_of([x[1] for x in own])))
    top = levels_of([levels[-1][0] for _, levels in trees])
    root, out = top[-1][0], []
    for t, (own, levels) in enumerate(trees):
        for i, (doc, leaf, other) in enumerate(own):
            proof, got = "", other
            for run, at in walk(levels, i) + walk(top, t):
                proof += "".join(d for j, d in enumerate(run) if j != at)
                got = h("".join(got if j == at else d for j, d in enumerate(run)))
            out.append((doc, leaf, levels[-1][0], root, h(proof), got, got == root))
    return sorted(out, key=str)


def odd(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0


def run(df):
    ship(df.sparkSession)
    no_lines = F.replace(col("text"), F.lit("\n"), F.lit(""))
    text = F.when(F.crc32(F.encode(col("doc_id").cast("string"), "UTF-8")) % 2 == 0, no_lines).otherwise(col("text"))
    return sorted((tuple(r) for r in merkle.manifest(df, tampered={"text": text}).collect()), key=str)


def test_equals_brute_force(docs):
    got = run(docs)
    assert got == brute(docs.collect(), odd)
    assert {r[-1] for r in got} == {True, False}


def test_odd_rows(odd_docs, no_docs):
    assert run(odd_docs) == brute(odd_docs.collect(), odd)
    assert run(no_docs) == []


@pytest.mark.parametrize("n", [1, 2, 4, 10])
def test_small_trees(spark, n):
    kind = "doc_id long, text string, lang string, source string, n_chars long, range string, Digest int"
    rows = [(i, f"line\n{i}", "en", ["a", None, "é", ""][i % 4] if n > 4 else "a", 6, "x", 1) for i in range(n)]
    df = spark.createDataFrame(rows, kind)
    assert run(df) == brute(df.collect(), odd)


def test_many_sources_and_ranges(spark, monkeypatch):
    """Folding in several rounds, and as many sources as rows beside a hot one."""
    monkeypatch.setattr(merkle, "FOLDED", 3)
    monkeypatch.setattr(merkle, "SUBROOTS", 9)
    df = spark.range(600).select(
        F.col("id").alias("doc_id"), F.lit("a\nb").alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("source"),
        F.lit(3).cast("long").alias("n_chars"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    try:
        assert run(df) == brute(df.collect(), odd)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_untampered_rows_verify(docs):
    ship(docs.sparkSession)
    assert merkle.manifest(docs).where("not verified").count() == 0


def test_least_set_is_what_proofs_lack():
    for n in (1, 2, 3, 7, 27, 40):
        wide = merkle.widths(n)
        for first in range(n):
            for end in range(first + 1, n + 1):
                need, have = set(), set()
                for i in range(first, end):
                    for level in range(len(wide) - 1):
                        have.add((level, i // 3**level))
                        need |= {(level, j) for j in merkle.run_of(i // 3**level, wide[level])}
                assert set(merkle.lacking(first, end, wide)) == need - have
