import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from deskloom.llm import hashing as H
from deskloom.llm.components import components
from deskloom.llm.ngram_join import jaccard_components

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_force(rows, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def check(df, **options):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = jaccard_components(df, **options).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_force(rows, options.get("percent", 75))


def test_equals_brute_force(docs):
    check(docs)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert jaccard_components(no_docs).collect() == []


@pytest.mark.parametrize("seed, percent", [(1, 75), (2, 60)])
def test_edited_copies_of_hubs(spark, seed, percent):
    """Chains, hubs whose copies do not link with each other, shared passages and sizes at the border."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(4):
        base = [word() for _ in range(rng.choice([30, 90, 200]))]
        texts.append(base)
        for _ in range(18):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[: rng.randrange(len(copy) * 7 // 10, len(copy))]
            texts.append(copy)
    texts += [[word() for _ in range(20)] + passage + [word() for _ in range(rng.randrange(40))] for _ in range(25)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=percent)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    rng.shuffle(edges)
    found = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert found == least


def test_hashes_follow_the_words():
    texts = ["A b  c\td\ne f", "", None, "x", "a B c d e", "é ".ljust(3) * 4, "z" * 5000 + " a b c d e"]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    for limit in (1, 20, 1 << 20):
        sets = [s for _, _, data, offsets in H.slices(batch, "text", limit) for s in H.distinct_sets(data, offsets)]
        assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
        assert len(np.intersect1d(sets[0], sets[4])) == 1


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    for n, kept, m in itertools.product((0, 1, 5, 64, 65, 1000), (0.0, 0.5, 0.9, 1.0), (0, 3, 70, 3000)):
        x = np.unique(draw(n))
        y = np.unique(np.concatenate([x[: int(n * kept)], draw(m)]))
        true = len(np.setxor1d(x, y))
        for a, b in ((x, y), (y, x)):
            assert H.least_difference(H.parity(a), H.parity(b)) <= true
        assert H.least_difference(H.parity(x), H.parity(x)) == 0
    x, y = np.unique(draw(800)), np.unique(draw(800))
    assert 7 * H.least_difference(H.parity(x), H.parity(y)) > len(x) + len(y)  # strangers are refused
