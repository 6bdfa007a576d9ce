import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deskloom.llm import collocations as co
from deskloom.llm.common import ship

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, max_words, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, max_words + 1) for i in range(len(w) - m + 1))
    candidates = {g: a for g, a in f.items() if len(g[1]) >= 2 and a >= min_count}
    covered = set()
    for (lang, g), a in candidates.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                if 100 * a >= 100 * candidates[lang, g[i : i + m]]:
                    covered.add((lang, g[i : i + m]))
    by_lang = {}
    for (lang, g), a in candidates.items():
        if (lang, g) not in covered:
            cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    out = []
    for lang, own in by_lang.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def run(df, *limits):
    ship(df.sparkSession)
    return sorted(tuple(r) for r in co.collocations(df, *limits).collect())


def rows_of(df):
    return [(r["lang"], r["text"]) for r in df.collect()]


def test_equals_brute_force(docs):
    got = run(docs, 5, 5, 300)
    assert got == brute(rows_of(docs), 5, 5, 300) and len(got) > 300


def test_odd_rows(odd_docs, no_docs):
    assert run(odd_docs, 2, 5, 2000) == brute(rows_of(odd_docs), 2, 5, 2000)
    assert run(odd_docs, 3, 2, 5) == brute(rows_of(odd_docs), 3, 2, 5)
    assert run(no_docs, 1, 5, 10) == []
    assert run(odd_docs, 10**6, 5, 10) == []


def test_pieces_cases_and_languages(spark):
    rows = [
        ("en", "A b, a B. a\tb\x0ba  b é É"),
        ("en", "a b\x0ca b\ra b!b a;b a:b a?x\x1fy a b"),
        (None, "a b a b c . , a b"),
        ("und", "a b\n\n"),
        ("", "a b a b"),
        ("en", None),
        ("en", "a.b a.b"),
    ]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for limits in ((1, 5, 100), (2, 3, 3), (3, 5, 100)):
        assert run(df, *limits) == brute(rows, *limits)


def test_shards_of_any_size(docs, spark, monkeypatch):
    """One document per shard, slices of a few words and many blocks give the same counts."""
    some = docs.where("doc_id < 60")
    whole = run(some, 4, 4, 500)
    monkeypatch.setattr(co, "BLOCK_WORDS", 50)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert run(some.repartition(40), 4, 4, 500) == whole == brute(rows_of(some), 4, 4, 500)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_slices_part_no_word(monkeypatch):
    monkeypatch.setattr(co, "_SLICE", 3)
    shard = co._Shard()
    shard.add("One two. three  one,two-three é")
    words = list(shard.ids)
    seq = [words[i] for i in np.concatenate(shard.parts)]
    assert seq == [b"one", b"two", b".", b"three", b"one", b".", b"two-three", "é".encode(), b"."]


@settings(max_examples=60, deadline=None)
@given(m=st.integers(2, 5), bits=st.integers(1, 40), blocks=st.integers(0, 8), seed=st.integers(0, 10**6))
def test_filters_lose_nothing(m, bits, blocks, seed):
    rng = random.Random(seed)
    grams = [tuple(rng.randrange(1 << bits) for _ in range(m)) for _ in range(rng.randrange(1, 300))]
    grams += grams[:1] * 700 + grams[: rng.randrange(len(grams))]
    packing = co.Packing(m, bits)
    ids = [np.array(c, np.uint64) for c in zip(*grams)]
    assert [c.tolist() for c in packing.unpack(packing.pack(ids))] == [c.tolist() for c in ids]
    lanes, counts = co.tally(packing, packing.pack(ids))
    own = co.block_bits(packing, blocks)
    block = lanes[0] >> np.uint64(packing.width - own)
    got = Counter()
    for b in np.unique(block).tolist():
        data = co.to_filter(packing, [lane[block == b] for lane in lanes], counts[block == b], own)
        back, sums = co.from_filter(packing, data, b, own)
        assert [x.tolist() for x in back] == [lane[block == b].tolist() for lane in lanes]
        for g, c in zip(zip(*(x.tolist() for x in packing.unpack(back))), sums.tolist()):
            got[g] += c
    assert got == Counter(grams)
    some = co.tally(packing, packing.pack([c[::2] for c in ids]))[0]
    wanted = {g for g in grams[::2]}
    assert co.members(packing, packing.pack(ids), some).tolist() == [g in wanted for g in grams]


@pytest.mark.parametrize("count", [1, 254, 255, 256, 10**12])
def test_counters_of_any_size(count):
    packing = co.Packing(2, 5)
    lanes = packing.pack([np.array([7]), np.array([9])])
    back, sums = co.from_filter(packing, co.to_filter(packing, lanes, np.array([count]), 0), 0, 0)
    assert sums.tolist() == [count] and [c.tolist() for c in packing.unpack(back)] == [[7], [9]]
