import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskloom.llm import hashing as H
from deskloom.llm.substring_dedup import bands, paragraphs, remove_passages, repeated_passages

RNG = random.Random(11)


def sentence(n=None):
    return " ".join(f"{RNG.choice('abcdefghkmnprst')}{RNG.randrange(3000)}" for _ in range(n or RNG.randrange(5, 13))).capitalize() + "."


def text(sentences):
    return " ".join(sentence() for _ in range(sentences))


@pytest.fixture(scope="module")
def planted():
    passages = [" ".join(sentence(n) for n in (9, 12, 10, 8, 11, 9)) for _ in range(4)]
    docs = [text(12) for _ in range(30)]
    where = {}
    for p, passage in enumerate(passages):
        for d in range(p, 30, 5):
            cut = RNG.randrange(len(docs[d]))
            cut = docs[d].index(" ", cut) if " " in docs[d][cut:] else len(docs[d])
            docs[d] = docs[d][:cut] + " " + passage + docs[d][cut:]
            where.setdefault(d, []).append(passage)
    words = passages[0].split()
    words[30] = "changed"
    docs.append(text(4) + "\n" + " ".join(words) + "\n" + text(4))
    where[30] = [passages[0]]
    return docs, where


def test_planted_passages_are_found_and_clean_text_stays(spark, planted):
    docs, where = planted
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    spans = repeated_passages(df)
    rows = spans.collect()
    assert {r["doc_id"] for r in rows} == set(where)
    for d, own in where.items():
        covered = sum(r["span_end"] - r["span_start"] for r in rows if r["doc_id"] == d)
        whole = sum(map(len, own))
        assert 0.5 * whole <= covered <= 1.6 * whole  # paragraphs may be alike beyond the passage
        for r in rows:
            if r["doc_id"] == d and d != 30:
                assert any(len(set(docs[d][r["span_start"] : r["span_end"]].split()) & set(p.split())) > 15 for p in own)
    first = {min(d for d in where if p in where[d]) for p in {p for own in where.values() for p in own}}
    assert {r["doc_id"] for r in rows if not r["removed"]} >= first
    assert all(r["removed"] == (r["doc_id"] != r["keep_doc_id"]) for r in rows)
    left = {r["doc_id"]: r["text"] for r in remove_passages(df, spans).collect()}
    for i, t in enumerate(docs):
        cut = [(r["span_start"], r["span_end"]) for r in rows if r["doc_id"] == i and r["removed"]]
        want = "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in cut))
        assert left[i] == want


def brute_paragraphs(t, least=20):
    """Word lists of all paragraphs of lines whose sentences end in a mark; no breaks by hash."""
    out = []
    for line in t.split("\n"):
        words = line.split()
        heads = [i for i in range(len(words)) if i == 0 or words[i - 1][-1] in ".!?"] + [len(words)]
        for i in heads[:-1]:
            stop = next((h for h in heads if h - i >= least), len(words))
            if stop - i >= least:
                out.append((i, stop))
    return out


def test_paragraphs_begin_at_sentences(monkeypatch):
    import deskloom.llm.substring_dedup as S

    monkeypatch.setattr(S, "BREAK", 1 << 62)
    texts = [text(9) + "\n" + text(2) + "\n" + text(7) for _ in range(6)] + ["", "a b.", text(4).replace(".", "é.")]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    for limit in (1, 1 << 20):
        got = [[] for _ in texts]
        for row, _, data, offsets in H.slices(batch, "text", limit):
            found = paragraphs(data, offsets, 20, 5)
            for d, a, b, n in zip(found["document"], found["start"], found["end"], found["words"]):
                raw = data[a:b].tobytes().decode()
                assert len(raw.split()) == n
                got[row + d].append(raw)
        for t, own in zip(texts, got):
            want = []
            for line in t.split("\n"):
                spots = [m.span() for m in re.finditer(r"\S+", line)]
                want += [line[spots[i][0] : spots[j - 1][1]] for i, j in brute_paragraphs(line)]
            assert own == want


def test_equal_word_sequences_have_equal_digests():
    t = text(8)
    batch = pa.record_batch([pa.array([t, "Xyz. " + t.upper(), t + " " + text(3)])], names=["text"])
    (_, _, data, offsets), = H.slices(batch, "text")
    found = paragraphs(data, offsets, 20, 5)
    own = [set(found["digest"][found["document"] == d].tolist()) for d in range(3)]
    assert len(own[0] & own[2]) >= 3 and own[0] <= own[1]
    assert len(np.unique(found["digest"])) > 5


def test_band_count_meets_the_recall():
    for percent, rows, recall in ((75, 2, 0.9), (75, 4, 0.95), (50, 3, 0.8)):
        b = bands(percent, rows, recall)
        meet = lambda n: 1 - (1 - (percent / 100) ** rows) ** n
        assert meet(b) >= recall > meet(b - 1)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = repeated_passages(odd_docs).collect()
    assert {r["doc_id"] for r in rows} <= {1, 2, 3, 10}
    assert {r["doc_id"] for r in rows} >= {1, 2}
    assert {r["keep_doc_id"] for r in rows if r["doc_id"] == 2} == {1}
    assert repeated_passages(no_docs).collect() == []
    whole = remove_passages(odd_docs, repeated_passages(odd_docs))
    assert whole.columns == odd_docs.columns and whole.count() == odd_docs.count()


def test_a_document_that_repeats_itself_is_left_alone(spark):
    first, second = text(6), text(6)
    words = first.split()
    words[20] = "changed"
    docs = [first + "\n" + " ".join(words) + "\n" + first, second, text(6)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert repeated_passages(df).collect() == []
    both = df.union(spark.createDataFrame([(7, text(5) + "\n" + " ".join(words))], df.schema))
    rows = repeated_passages(both).collect()
    assert {(r["doc_id"], r["removed"]) for r in rows} == {(0, False), (7, True)}
    (end,) = {r["span_end"] for r in rows if r["removed"]}
    assert end == len(both.where("doc_id = 7").first()["text"])


def shared_digests(one, two):
    batch = pa.record_batch([pa.array([one, two])], names=["text"])
    (_, _, data, offsets), = H.slices(batch, "text")
    found = paragraphs(data, offsets, 20, 5, over_lines=True)
    own = [set(found["digest"][found["document"] == d].tolist()) for d in range(2)]
    return own[0] & own[1]


def plain_words(n):
    return [f"{RNG.choice('abcdefghkmnprst')}{RNG.randrange(3000)}" for _ in range(n)]


def in_lines(words, width):
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_fifty_equal_words_hold_a_paragraph():
    for n in [*range(50, 61)] * 20:
        passage = plain_words(n)
        for shape in (" ".join, lambda w: in_lines(w, 12)):
            around = [" ".join(plain_words(RNG.randrange(1, 40))) + RNG.choice(["", "."]) for _ in range(4)]
            gap = RNG.choice([" ", "\n"])
            assert shared_digests(*[a + gap + shape(passage) + gap + b for a, b in (around[:2], around[2:])])
        assert shared_digests(" ".join(plain_words(9) + passage), in_lines(passage, 12))  # set in other lines


def test_short_lines_are_found(spark):
    passage = in_lines(plain_words(54), 12)
    docs = [in_lines(plain_words(70), 14) + "\n" + passage + "\n" + in_lines(plain_words(30), 9) for _ in range(3)]
    rows = repeated_passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["removed"], r["n_docs"]) for r in rows} == {(0, False, 3), (1, True, 3), (2, True, 3)}


def test_closing_signs_after_a_mark(monkeypatch):
    import deskloom.llm.substring_dedup as S

    monkeypatch.setattr(S, "BREAK", 1 << 62)
    for sign in ('"', "')", "”", "’", "»]"):
        head, passage = plain_words(9), plain_words(20)
        one, two = (f"{' '.join(w)} he said.{sign} {' '.join(passage)} end.{sign} {' '.join(plain_words(3))}" for w in (head, plain_words(4)))
        assert shared_digests(one, two)


def test_bands_find_what_brute_force_finds():
    """Of all pairs of paragraphs at the threshold, by brute force, hardly any share no band."""
    from deskloom.llm.substring_dedup import PERCENT, RECALL, ROWS, band_keys

    texts = []
    for _ in range(400):
        words = plain_words(RNG.randrange(30, 70))
        texts.append(" ".join(words))
        for changes in (1, 1, 2, 3):
            copy = words.copy()
            for i in RNG.sample(range(len(words)), changes):
                copy[i] = f"z{RNG.randrange(10**6)}"
            texts.append(" ".join(copy))
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    close = met = 0
    for _, _, data, offsets in H.slices(batch, "text"):
        found = paragraphs(data, offsets, 20, 5, over_lines=True)
        keys = band_keys(found, bands(PERCENT, ROWS, RECALL), ROWS, 5)
        sets = [set(found["runs"][a : a + n - 4].tolist()) for a, n in zip(found["at"], found["words"])]
        groups = found["document"] // 5  # texts of other groups have no run of words in common
        for g in range(400):
            own = np.flatnonzero(groups == g)
            for x, i in enumerate(own):
                for j in own[x + 1 :]:
                    shared = len(sets[i] & sets[j])
                    if found["digest"][i] != found["digest"][j] and 100 * shared >= PERCENT * (len(sets[i]) + len(sets[j]) - shared):
                        close += 1
                        met += bool((keys[i] == keys[j]).any())
    print(f"{met} of {close} pairs")
    assert close > 500 and met >= 0.99 * close


@pytest.mark.parametrize("together", [4096, 40, 3])
def test_lists_are_filtered_as_by_brute_force(monkeypatch, together):
    import deskloom.llm.substring_dedup as S

    monkeypatch.setattr(S, "TOGETHER", together)
    rng = random.Random(together)
    rows = set()
    sizes = {}
    for token in range(-60, 60):
        centre = rng.randrange(1 << 32)
        for _ in range(rng.choice([1, 1, 2, 3, 8, 60, 150])):
            sketch = centre
            for _ in range(rng.choice([0, 1, 3, 9])):
                sketch ^= 1 << rng.randrange(32)
            key = sketch << 32 | rng.randrange(3)
            key -= (key >> 63) << 64
            rows.update((token, key, rng.randrange(40), sizes.setdefault(key, rng.randrange(16, 30))) for _ in range(rng.choice([1, 1, 2, 30])))
    rows = sorted(rows)
    batches = [pa.record_batch([pa.array(c) for c in zip(*rows[i : i + 37])], names=["token", "set", "source", "size"]) for i in range(0, len(rows), 37)]
    got = {}
    for b in S._meeting(iter(batches), 75):
        for r in b.to_pylist():
            assert (r["token"], r["set"]) not in got  # once
            got[r["token"], r["set"]] = (r["source"], r["size"], r["again"], r["met"])
    lists = {}
    for token, key, source, size in rows:
        lists.setdefault(token, {}).setdefault(key, []).append((source, size))
    for token, own in lists.items():
        whole = sum(map(len, own.values())) <= together
        for key, places in own.items():
            least = min(places)[0]
            again = len({s for s, _ in places}) > 1
            met = any(
                min(others)[0] != least and 175 * ((key ^ other) >> 32 & 0xFFFFFFFF).bit_count() <= 25 * (places[0][1] + others[0][1])
                for other, others in own.items() if other != key
            )
            found = got.get((token, key))
            if whole:
                assert found == ((least, places[0][1], again, met) if again or met else None)
            elif again or met:
                assert found[:3] == (least, places[0][1], again) and (found[3] or not met)


def test_sketches_never_refuse_what_is_alike():
    texts = []
    for _ in range(200):
        words = [RNG.choice("abc") for _ in range(RNG.randrange(20, 34))] if RNG.random() < 0.5 else plain_words(RNG.randrange(20, 34))
        texts.append(" ".join(words))
        words[RNG.choice([0, -1, 10])] = "z"
        texts.append(" ".join(words))
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    (_, _, data, offsets), = H.slices(batch, "text")
    found = paragraphs(data, offsets, 20, 5, over_lines=True)
    sets = [set(found["runs"][a : a + n - 4].tolist()) for a, n in zip(found["at"], found["words"])]
    assert [len(s) for s in sets] == found["size"].tolist()
    alike = 0
    for i in range(len(sets)):
        for j in range(i + 1, min(i + 8, len(sets))):
            shared = len(sets[i] & sets[j])
            if 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                alike += 1
                differ = (int(found["digest"][i]) ^ int(found["digest"][j])) >> 32
                assert 175 * differ.bit_count() <= 25 * (len(sets[i]) + len(sets[j]))
    assert alike > 50


def test_spans_and_clusters_equal_brute_force(spark):
    """Variants of neighbouring paragraphs in many documents, against all pairs of paragraphs."""
    docs = [" ".join(sentence(RNG.randrange(7, 12)) for _ in range(8)) for _ in range(48)]
    for _ in range(3):
        passage = [sentence(RNG.randrange(7, 12)) for _ in range(9)]
        for d in RNG.sample(range(48), 14):
            words = " ".join(passage).split()
            for _ in range(RNG.choice([0, 0, 1, 2])):
                words[RNG.randrange(1, len(words))] = f"z{RNG.randrange(10**6)}"
            docs[d] += RNG.choice([" ", "\n"]) + " ".join(words) + " " + sentence(9)
    batch = pa.record_batch([pa.array(docs)], names=["text"])
    places, sets = [], {}
    (_, _, data, offsets), = H.slices(batch, "text")
    found = paragraphs(data, offsets, 20, 5, over_lines=True)
    for d, a, b, at, n in zip(*(found[c].tolist() for c in ("document", "start", "end", "at", "words"))):
        words = tuple(data[a:b].tobytes().decode().lower().split())
        places.append((d, a - int(offsets[d]), b - int(offsets[d]), words))
        sets[words] = {words[i : i + 5] for i in range(n - 4)}
    owners = {}
    for d, _, _, words in places:
        owners.setdefault(words, set()).add(d)
    comp = {w: w for w in sets}

    def root(w):
        while comp[w] != w:
            w = comp[w]
        return w

    keys = list(sets)
    for i, x in enumerate(keys):
        for y in keys[i + 1 :]:
            shared = len(sets[x] & sets[y])
            if not owners[x] & owners[y] and 100 * shared >= 75 * len(sets[x] | sets[y]):
                comp[root(x)] = root(y)
    members = {}
    for d, _, _, words in places:
        members.setdefault(root(words), set()).add(d)
    want = set()
    for d in range(len(docs)):
        for removed in (False, True):
            own = sorted((a, b) for e, a, b, w in places if e == d and len(members[root(w)]) > 1 and (min(members[root(w)]) != d) == removed)
            islands = []
            for a, b in own:
                if islands and a <= islands[-1][1]:
                    islands[-1][1] = max(islands[-1][1], b)
                else:
                    islands.append([a, b])
            want |= {(d, a, b, removed) for a, b in islands}
    rows = repeated_passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert len(want) > 40 and {(r["doc_id"], r["span_start"], r["span_end"], r["removed"]) for r in rows} == want


def wanted_runs(texts):
    """The rows of ``_wanted_runs`` for all paragraphs of some texts, and the sets of runs by brute force."""
    import deskloom.llm.substring_dedup as S

    (_, _, data, offsets), = H.slices(pa.record_batch([pa.array(texts)], names=["text"]), "text")
    found = paragraphs(data, offsets, 20, 5, over_lines=True)
    digests = H.signed(found["digest"]).tolist()
    sets = {g: set(found["runs"][a : a + n - 4].tolist()) for g, a, n in zip(digests, found["at"], found["words"])}
    wanted = [[g for g, e in zip(digests, found["document"]) if e == d] for d in range(len(texts))]
    batch = pa.record_batch([pa.array(texts), pa.array(wanted, pa.list_(pa.int64()))], names=["text", "wanted"])
    return [r for b in S._wanted_runs(iter([batch.slice(0, 3), batch.slice(3)]), 20, 5) for r in b.to_pylist()], sets


def test_second_sketches_refuse_nearly_all_that_is_not_alike():
    """Variants of one paragraph meet in one list; hardly more pairs than those that link may leave it."""
    import deskloom.llm.substring_dedup as S

    words = plain_words(30)
    texts = [" ".join(words[: (n := RNG.randrange(12, 30))] + plain_words(30 - n)) for _ in range(300)]
    rows, sets = wanted_runs(texts + ["a b " * 15, "short"])
    assert {r["set"] for r in rows} == set(sets)
    for r in rows:
        assert sorted(sets[r["set"]]) == np.frombuffer(r["runs"], np.uint64).tolist()
    first = second = alike = 0
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            own, other = sets[x["set"]], sets[y["set"]]
            most = 25 * (len(own) + len(other))
            if len(own & other) and x["set"] != y["set"]:
                shared = 100 * len(own & other) >= 75 * len(own | other)
                bits = sum(((x[c] ^ y[c]) & (1 << 64) - 1).bit_count() for c in ("even", "odd"))
                alike += shared
                first += 175 * ((x["set"] ^ y["set"]) >> 32 & 0xFFFFFFFF).bit_count() <= most
                second += 175 * bits <= most
                assert not shared or 175 * bits <= most
    assert alike > 100 and second <= 1.25 * alike < first
    pairs = [(x, y) for x in rows[:40] for y in rows[:40] if x["set"] < y["set"]]
    batch = pa.record_batch([pa.array([p[e][c] for p in pairs], t) for c, t in (("set", pa.int64()), ("runs", pa.binary())) for e in (0, 1)], names=["a", "b", "ra", "rb"])
    got = {(r["a"], r["b"]) for b in S._alike(iter([batch.slice(0, 5), batch.slice(5), batch.slice(0, 0)]), 75) for r in b.to_pylist()}
    brute = lambda x, y: 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])
    assert got == {(x["set"], y["set"]) for x, y in pairs if brute(x["set"], y["set"])}


@pytest.mark.parametrize("size", [1, 4, 500])
def test_only_tokens_of_several_sources_go_on(size):
    import deskloom.llm.substring_dedup as S

    rng = random.Random(size)
    rows = []
    for token in range(-80, 80):
        own = [rng.randrange(5) for _ in range(rng.choice([1, 1, 2, 9]))]
        rows += [(token, s, [(rng.randrange(1 << 64), rng.randrange(16, 30)) for _ in range(rng.randrange(1, 4))]) for s in own]
    batches = []
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        entries = np.array([e for r in part for e in r[2]], S._ENTRY)
        packed = S._binary(entries, np.cumsum([0, *[len(r[2]) for r in part]]))
        batches.append(pa.record_batch([pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), packed], names=["token", "source", "entries"]))
    got = [tuple(r.values()) for b in S._several(iter(batches)) for r in b.to_pylist()]
    sources = {}
    for token, source, _ in rows:
        sources.setdefault(token, set()).add(source)
    want = [(t, e - (e >> 63 << 64), s, n) for t, s, own in rows if len(sources[t]) > 1 for e, n in own]
    assert got == want


@pytest.mark.parametrize("size", [1, 7, 5000])
def test_entries_ask_the_closest_and_the_next_of_their_block(size):
    import deskloom.llm.substring_dedup as S

    rng = random.Random(size)
    rows, key = [], 0
    for token in range(-20, 20):
        for block in range(rng.choice([1, 1, 3])):
            centre = [rng.randrange(1 << 64) for _ in range(4)]
            for _ in range(rng.choice([1, 2, 9, 60, 300 if token == 0 else 5])):
                parts = [x ^ sum({1 << rng.randrange(64) for _ in range(rng.choice([0, 0, 1, 4]))}) for x in centre]
                key += 1
                rows.append((token, block, key, rng.randrange(9), rng.randrange(12), rng.randrange(16, 30), *parts, rng.random() < 0.7))
    names = ["token", "block", "set", "source", "comp", "size", *S._PARITY, "asks"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.bool_()]
    low = lambda r: (*r[:6], *[x - (x >> 63 << 64) for x in r[6:10]], r[10])
    batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*map(low, rows[i : i + size])), types)], names=names) for i in range(0, len(rows), size)]
    got = {}
    for b in S._asked(iter(batches), 75):
        for r in b.to_pylist():
            got.setdefault((r["token"], r["set"]), []).append(r["other"])

    def room(x, y):
        (e, o, e2, o2), (f, p, f2, p2) = x[6:10], y[6:10]
        return 25 * (x[5] + y[5]) - 175 * sum(d.bit_count() for d in (e2 ^ f2, e ^ f ^ e2 ^ f2, o2 ^ p2, o ^ p ^ o2 ^ p2))

    blocks = {}
    for r in rows:
        blocks.setdefault(r[:2], []).append(r)
    want = {}
    for own in blocks.values():
        for i, x in enumerate(own):
            ring = [y for y in own[i + 1 :] + own[:i] if x[3] != y[3] and x[4] != y[4] and room(x, y) >= 0]
            if x[10] and ring:
                want[x[0], x[2]] = (ring[0][2], max(room(x, y) for y in ring))
    by_key = {r[2]: r for r in rows}
    assert len(want) > 100 and set(got) == set(want)
    for (token, key), (following, most) in want.items():
        closest, second = got[token, key]
        assert second == following and room(by_key[key], by_key[closest]) == most


def test_pairs_of_a_group_do_not_grow_with_its_square(spark, monkeypatch):
    """A leader that is like nobody leaves a group of variants open; each of them is judged with a few others only."""
    import deskloom.llm.linking as L
    import deskloom.llm.substring_dedup as S

    n = 120
    sets = [*range(1, 2 * n + 1), 10**6]  # two groups and the leader of the list
    even = {s: (0 if s <= n else -1) if s < 10**6 else 0x0F0F0F0F0F0F for s in sets}
    lead = (0, 10**6, 10**6, 20)
    rows = [(5, s, s, 20, False, len(sets), lead) for s in sets]
    lists = spark.createDataFrame(rows, "token long, set long, source long, size int, again boolean, n long, lead struct<rank:int,set:long,source:long,size:int>")
    details = spark.createDataFrame([(s, even[s], 0, 0, 0) for s in sets], "set long, even long, odd long, even2 long, odd2 long")
    alike = lambda a, b: a // n != 10**6 // n and b // n != 10**6 // n and (a <= n) == (b <= n) and (a + b) % 7

    def run(near):
        judged = []

        def link(pairs):
            rows = [tuple(r) for r in pairs.collect()]
            judged.append(len(rows))
            return spark.createDataFrame([r for r in rows if alike(*r)], "a long, b long")

        labels = L.linked_components(lists, lambda a, b: f"{a}source <> {b}source", lambda p: p, [], link, details, lambda a, b: S._differ(a, b, 75), near)
        groups = {}
        for r in labels.collect():
            groups.setdefault(r["comp"], set()).add(r["node"])
        return judged, groups

    want = {1: set(range(1, n + 1)), n + 1: set(range(n + 1, 2 * n + 1))}
    judged, groups = run(None)
    assert groups == want and sum(judged) > n * (n - 1) * 0.9
    for block in (L.BLOCK, 50):
        monkeypatch.setattr(L, "BLOCK", block)
        judged, groups = run(lambda e: S._near(e, 75))
        assert groups == want and sum(judged) < 14 * n


@pytest.mark.parametrize("common", [[], [5, 1, 9, 3, 70, 2]])
def test_sets_that_are_alike_share_one_of_their_rarest_runs(common):
    import deskloom.llm.substring_dedup as S

    rng = random.Random(4)
    pool = [*range(40), *(rng.randrange(1 << 64) for _ in range(60))]
    sets = [set(rng.sample(pool, rng.choice([1, 2, 3, 8, 16, 17, 30]))) for _ in range(150)]
    sets += [(s | set(rng.sample(pool, rng.randrange(3)))) - set(rng.sample(sorted(s), rng.randrange(len(s) // 4 + 1))) for s in sets]
    sets = [s for s in sets if s]
    own = [np.array(sorted(s), np.uint64) for s in sets]
    packed = S._binary(np.concatenate(own), np.cumsum([0, *map(len, own)]))
    batch = pa.record_batch([pa.array(range(len(sets))), packed], names=["set", "runs"])
    known = np.sort(np.array(common, np.uint64))
    told = type("Told", (), {"value": (known, np.arange(len(known), 0, -1))})
    rows = [r for b in S._rarest(iter([batch.slice(0, 7), batch.slice(7), batch.slice(0, 0)]), 75, told) for r in b.to_pylist()]
    parts = {r["set"]: {p & (1 << 64) - 1 for p in r["parts"]} for r in rows}
    assert len(rows) == len(sets) == len(parts)
    rank = dict(zip(known.tolist(), range(len(known), 0, -1)))
    for s, mine in zip(sets, (parts[i] for i in range(len(sets)))):
        in_order = sorted(s, key=lambda x: (rank.get(x, 0), x))
        assert mine == set(in_order[: len(s) - -(-75 * len(s) // 100) + 1])
    alike = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 100 * len(x & y) >= 75 * len(x | y)]
    assert len(alike) > 50 and all(parts[i] & parts[j] for i, j in alike)


def test_long_lists_are_compared_by_the_parts_that_they_share(spark, monkeypatch):
    """Entries that are alike in nothing but their token are not compared with each other once more."""
    import deskloom.llm.linking as L

    monkeypatch.setattr(L, "BLOCK", 50)
    long, short = [*range(1, 301), 1000], [*range(2001, 2041), 3000]
    rows = [(t, s, s, 20, False, len(own), (0, own[-1], own[-1], 20)) for t, own in ((5, long), (6, short)) for s in own]
    lists = spark.createDataFrame(rows, "token long, set long, source long, size int, again boolean, n long, lead struct<rank:int,set:long,source:long,size:int>")
    linked, judged, asked = {(10, 20), (20, 30), (100, 200), (2001, 2002)}, [], []

    def parts(sets):
        asked.extend(r["set"] for r in sets.collect())
        rows = [(s, [s, *[1000 + a + b for a, b in linked if s in (a, b)]]) for s in asked]
        return spark.createDataFrame(rows, "set long, parts array<long>")

    def link(pairs):
        judged.append({tuple(r) for r in pairs.collect()})
        return spark.createDataFrame([p for p in judged[-1] if p in linked], "a long, b long")

    def near(entries):  # nobody of a long list, and all of a short one, finds somebody to ask
        return entries.where("token = 6 and set < 2040").select("token", "set", F.lit(2040).cast("long").alias("other"))

    labels = L.linked_components(lists, lambda a, b: f"{a}source <> {b}source", lambda p: p, [], link, near=near, parts=parts)
    assert {r["node"]: r["comp"] for r in labels.collect()} == {10: 10, 20: 10, 30: 10, 100: 100, 200: 100, 2001: 2001, 2002: 2001}
    assert set(asked) <= set(long) and {10, 20, 30, 100, 200} <= set(asked)
    assert {p for p in judged[-1] if p[1] <= 1000} == {p for p in linked if p[1] <= 1000}
    assert len({p for p in judged[-1] if p[1] > 1000}) == 39 * 38 // 2


def test_long_lists_give_the_passages_that_short_ones_give(spark, monkeypatch):
    """Variants around one passage share a token; in parts of a list they are found as well."""
    import deskloom.llm.linking as L

    common = plain_words(8)
    base = [plain_words(20) for _ in range(40)]
    variants = [[*own[: (n := RNG.randrange(21))], *plain_words(1), *own[n:]] if i % 3 else plain_words(20) for i, own in enumerate(base)]
    docs = [(i, " ".join(common + own)) for i, own in enumerate(base + variants)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    found = lambda: sorted(map(tuple, repeated_passages(df).drop("doc_key").collect()))
    want = found()
    monkeypatch.setattr(L, "BLOCK", 4)
    assert found() == want and len(want) > 5


def test_rows_that_come_again_change_nothing(spark):
    """A repeated row is one document, in one task and in several."""
    passage = " ".join(plain_words(60))
    docs = [(1, passage), (2, passage), (None, passage), (4, " ".join(plain_words(60)))]
    once = spark.createDataFrame(docs, "doc_id int, text string")
    again = spark.createDataFrame(docs * 6, "doc_id int, text string").repartition(5)
    found = lambda df: sorted(map(str, repeated_passages(df).collect()))
    assert found(again) == found(once) and len(found(once)) == 3
