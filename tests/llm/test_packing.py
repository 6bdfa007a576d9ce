import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from deskloom.llm import hashing as H
from deskloom.llm.packing import END, VOCABULARY, encoder, pack, plan

PATH = public_tokenizers.path(VOCABULARY)
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, END]


def check(df, capacity):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = pack(df, capacity).collect()
    expected = Counter()
    for i, text in rows:
        ids = ids_of(text)
        head = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
    filled = defaultdict(list)
    for r in out:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in own) <= 2
    return len(filled), sum(r["length"] for r in out)


def test_whole_table(docs):
    sequences, tokens = check(docs, 1024)
    assert sequences <= 1.01 * tokens / 1024 + 1


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, 1024)
    check(odd_docs, 4)
    assert pack(no_docs).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(0, 30)), st.just(24))
def test_plan_places_every_piece_once(counts, capacity):
    runs = plan(counts, capacity)
    used = Counter()
    filled = defaultdict(list)
    for i, (length, rank, sequence, offset, each) in enumerate(zip(*runs.values())):
        after = [r for s, r in zip(runs["length"][i + 1 :], runs["rank"][i + 1 :]) if s == length]
        end = after[0] if after else counts[length]
        for k in range(end - rank):
            filled[sequence + k // each].append((offset + k % each * length, length))
            used[length] += 1
    assert used == Counter({s: n for s, n in counts.items() if n})
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(filled) == list(range(len(filled)))


def test_plan_is_close_to_the_bound():
    rng = random.Random(5)
    counts = Counter(min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(20000))
    runs = plan(counts, 1024)
    need = -(-sum(s * n for s, n in counts.items()) // 1024)
    assert runs["sequence"].max() + 1 <= 1.005 * need + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t.,'sabé1  \x1c　…×😀Z-")), max_size=30), max_size=4))
def test_cut_texts_have_the_same_ids(texts):
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    words = encoder(PATH)
    for _ in range(2):  # then from memory
        for row, end, data, offsets in H.slices(batch, "text"):
            ids, first = words.encode(data, offsets)
            for d in range(end - row):
                assert ids[first[d] : first[d + 1]].tolist() == ids_of(texts[row + d])[:-1]


SPECIAL = "<|endoftext|>"
PLAIN = Tokenizer.from_file(PATH)


def test_a_special_token_in_a_text_has_its_own_id(spark):
    texts = [f"a {SPECIAL} b", SPECIAL, f"x{SPECIAL}\n{SPECIAL}  y", "a <|endoftext |> b"]
    out = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in out:
        ids = [*PLAIN.encode(texts[r["doc_id"]], add_special_tokens=False).ids, END]
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert len(out) == len(texts)
    assert PLAIN.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([SPECIAL, "<|", "|>", " ", "\n", "a", "é", "'s", "9", "\t"]), max_size=12).map("".join), max_size=4))
def test_cuts_keep_special_tokens(texts):
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    words = encoder(PATH)
    for row, end, data, offsets in H.slices(batch, "text"):
        ids, first = words.encode(data, offsets)
        for d in range(end - row):
            assert ids[first[d] : first[d + 1]].tolist() == PLAIN.encode(texts[row + d], add_special_tokens=False).ids
