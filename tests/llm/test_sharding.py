import zlib
from collections import defaultdict

from deskloom.llm.sharding import shard_by_bytes


def check(df, shards):
    rows = sorted((r["doc_id"] or -1, r["text"] or "") for r in df.collect())
    out = shard_by_bytes(df, shards).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == sorted(
        (i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows
    )
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in out:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append((r["slot"], r["text_crc32"]))
        sizes[r["shard"]] += r["size"]
    for own in slots.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
    last = -1
    for k in sorted(slots):  # contiguous in the order of the text's checksum
        checksums = [c for _, c in sorted(slots[k])]
        assert checksums == sorted(checksums) and checksums[0] >= last
        last = checksums[-1]
    largest = max((r["size"] for r in out), default=0)
    if len(out) > shards:
        assert all(abs(sizes[k] - sum(sizes.values()) / shards) <= 2 * largest for k in range(shards))
    return out


def test_balanced_contiguous_shards(docs):
    check(docs, 16)
    check(docs, 3)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, 4)
    assert shard_by_bytes(no_docs).collect() == []


def test_same_shards_each_time(docs):
    first = {tuple(r) for r in shard_by_bytes(docs).collect()}
    assert first == {tuple(r) for r in shard_by_bytes(docs.repartition(5)).collect()}
