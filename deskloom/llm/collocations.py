"""Operator 12, phrase collocation mining: exact n-gram counts in counting quotient filters.

Texts become shards: the words of one task's documents of one language as numbers, with breaks where
a phrase cannot pass. Words are counted by blocks of their checksums; those that reach the threshold
get ids, all others become breaks as well, since no phrase with them can reach it. For each length, a shard packs its n-grams' word ids into one number, permutes it by a
Feistel network (invertible, so nothing is lost) and counts it in a quotient filter: the high bits
(quotients) are kept as run lengths, the rest (remainders) in full, in order, with counters of one
byte and wide ones apart. A block of quotients of all shards is merged in one group; the permutation
makes blocks even however often an n-gram occurs. The merge tells each shard which of its n-grams
reached the threshold, and only runs of these are counted at the next length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskloom.llm.common import col, documents, partitions, pin, text_of
from deskloom.llm.hashing import mix

#: Least occurrences of a phrase, most words of one, and phrases per language.
MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Text bytes of a shard; documents are not cut, so a longer one makes a longer shard.
SHARD_BYTES = 8 << 20
#: Words of the corpus per block of quotients.
BLOCK_WORDS = 1 << 23
_SLICE = 1 << 20
_BREAK = b"."  # stands for all signs that end a piece, so no word holds it
_PLAIN = bytes(
    ord(_BREAK) if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_SHARDS = "shard long, lang string, n long, seq binary, block int, words array<string>, pos binary, counts binary"
_WORDS = "shard long, pos binary, num binary, lang string, word string, a long, rank long, block int"
_LEVEL = "shard long, seq binary, block long, filter binary"
_MERGED = "shard long, block long, filter binary, ids array<long>, a long"


# ---- packed n-grams -------------------------------------------------------------------------


class Packing:
    """``m`` word ids of ``bits`` bits each as lanes of ``width`` bits, permuted invertibly."""

    def __init__(self, m: int, bits: int):
        self.m, self.bits = m, bits
        self.lanes = max(2, -(-m * bits // 64))
        self.width = -(-m * bits // self.lanes)
        self.mask = np.uint64((1 << self.width) - 1)

    def _round(self, lanes: list[np.ndarray], r: int) -> None:
        i = r % self.lanes
        lanes[i] ^= mix(lanes[(i + 1) % self.lanes] + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)) & self.mask

    def pack(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Lanes of the permuted numbers of n-grams, whose i-th ids are ``ids[i]``."""
        lanes = [np.zeros(len(ids[0]), np.uint64) for _ in range(self.lanes)]
        for i, word in enumerate(ids):
            word = word.astype(np.uint64)
            lane, shift = divmod(i * self.bits, self.width)
            lanes[lane] |= (word << np.uint64(shift)) & self.mask
            if shift + self.bits > self.width:
                lanes[lane + 1] |= word >> np.uint64(self.width - shift)
        for r in range(2 * self.lanes):
            self._round(lanes, r)
        return lanes

    def unpack(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        lanes = [lane.copy() for lane in lanes]
        for r in reversed(range(2 * self.lanes)):
            self._round(lanes, r)
        out, own = [], np.uint64((1 << self.bits) - 1)
        for i in range(self.m):
            lane, shift = divmod(i * self.bits, self.width)
            word = lanes[lane] >> np.uint64(shift)
            if shift + self.bits > self.width:
                word |= lanes[lane + 1] << np.uint64(self.width - shift)
            out.append(word & own)
        return out

    def joined(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        """The same numbers, in one lane if they fit."""
        if self.lanes * self.width > 64:
            return lanes
        one = lanes[0]
        for lane in lanes[1:]:
            one = (one << np.uint64(self.width)) | lane
        return [one]


def order_of(lanes: list[np.ndarray]) -> np.ndarray:
    """A stable order by the lanes; runs that are in order already are merged."""
    return np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])


def heads(lanes: list[np.ndarray]) -> np.ndarray:
    """Where a new value begins in sorted lanes."""
    new = np.zeros(len(lanes[0]), np.bool_)
    new[:1] = True
    for lane in lanes:
        new[1:] |= lane[1:] != lane[:-1]
    return np.flatnonzero(new)


def tally(packing: Packing, lanes: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct numbers in order, and how often each occurs."""
    order = order_of(packing.joined(lanes))
    lanes = [lane[order] for lane in lanes]
    first = heads(lanes)
    if not len(first):
        return lanes, np.empty(0, np.int64)
    sums = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first)
    return [lane[first] for lane in lanes], sums


def members(packing: Packing, lanes: list[np.ndarray], known: list[np.ndarray]) -> np.ndarray:
    """Which numbers are among the known ones."""
    lanes, known = packing.joined(lanes), packing.joined(known)
    if not len(known[0]):
        return np.zeros(len(lanes[0]), np.bool_)

    def key(parts: list[np.ndarray]) -> np.ndarray:
        out = parts[0]
        for part in parts[1:]:
            out = mix(out) ^ part
        return out

    order = np.argsort(key(known), kind="stable")
    known = [lane[order] for lane in known]
    keys, wanted = key(known), key(lanes)
    at = np.searchsorted(keys, wanted, "left")
    longest = int(np.diff(np.append(heads([keys]), len(keys))).max())
    found = np.zeros(len(wanted), np.bool_)
    for step in range(longest):  # more than one only where several lanes share a key
        near = np.minimum(at + step, len(keys) - 1)
        same = np.ones(len(wanted), np.bool_)
        for lane, other in zip(lanes, known):
            same &= lane == other[near]
        found |= same
    return found


# ---- counting quotient filters ----------------------------------------------------------------


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers, compressed as planes of bytes, so that wide types cost little."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    size = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([size]) + len(values).to_bytes(8, "little") + pa.compress(planes[:size].tobytes(), "zstd", asbytes=True)


def stretched(data: bytes) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((8, n), np.uint8)
    out[:size] = np.frombuffer(pa.decompress(data[9:], size * n, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(out.T).view("<i8").reshape(n)


def to_filter(packing: Packing, lanes: list[np.ndarray], counts: np.ndarray, block_bits: int) -> bytes:
    """The filter of sorted distinct numbers that share their first ``block_bits`` bits."""
    n, rest = len(counts), packing.width - block_bits
    q = min(rest, max(0, n.bit_length() - 5))
    low = lanes[0] & np.uint64((1 << rest) - 1)
    runs = np.bincount((low >> np.uint64(rest - q)).astype(np.int64), minlength=1 << q) if q else np.array([n])
    parts = [runs, low & np.uint64((1 << rest - q) - 1), *lanes[1:], np.minimum(counts, 255), counts[counts >= 255]]
    parts = [squeezed(part) for part in parts]
    return b"".join([bytes([q]), *[len(part).to_bytes(4, "little") + part for part in parts]])


def from_filter(packing: Packing, data: bytes, block: int, block_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    q, rest, at, parts = data[0], packing.width - block_bits, 1, []
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at : at + 4], "little")
        parts.append(stretched(data[at + 4 : end]))
        at = end
    runs, low, *lanes, counts, wide = parts
    low = low.astype(np.uint64) | np.repeat(np.arange(1 << q, dtype=np.uint64), runs) << np.uint64(rest - q) if q else low.astype(np.uint64)
    counts[counts == 255] = wide
    return [low | np.uint64(block << rest), *[lane.astype(np.uint64) for lane in lanes]], counts


def block_bits(packing: Packing, bits: int) -> int:
    """Bits of a number that name its block, no more than its first lane has."""
    return min(bits, packing.width - 1)


# ---- shards -----------------------------------------------------------------------------------


def _cuts(data: bytes) -> Iterator[bytes]:
    """Slices that end behind a space, so that the list of words stays short."""
    at = 0
    while at < len(data):
        end = at + _SLICE
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end + 1
        yield data[at:end]
        at = end


class _Shard:
    """Words of one language: local ids in order of appearance from 1, 0 where a piece ends."""

    def __init__(self):
        self.ids: dict[bytes, int] = defaultdict(count().__next__)
        self.ids[_BREAK]  # noqa: B018  (its id is 0)
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        data = text.encode().translate(_PLAIN).replace(_BREAK, b" . ")
        for part in _cuts(data):
            words = part.split()
            self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(data)

    def rows(self, number: int, lang: str, blocks: int) -> Iterator[pa.RecordBatch]:
        """One row of the text's words, and one of distinct words per block of checksums."""
        seq = np.concatenate(self.parts)
        counts = np.bincount(seq, minlength=len(self.ids))
        words = list(self.ids)[1:]
        yield _batch(_SHARD_TYPES, [(number, lang, int(counts[1:].sum()), squeezed(seq), None, None, None, None)])
        block = np.fromiter((crc32(w) % blocks for w in words), np.int64, len(words))
        order = np.argsort(block, kind="stable")
        rows = []
        for part in np.split(order, heads([block[order]])[1:]) if len(order) else []:
            own = [words[i].decode() for i in part]
            rows.append((number, lang, None, None, int(block[part[0]]), own, squeezed(part + 1), squeezed(counts[part + 1])))
        yield _batch(_SHARD_TYPES, rows)


_SHARD_TYPES = {
    "shard": pa.int64(), "lang": pa.string(), "n": pa.int64(), "seq": pa.binary(),
    "block": pa.int32(), "words": pa.list_(pa.string()), "pos": pa.binary(), "counts": pa.binary(),
}
_WORD_TYPES = {
    "shard": pa.int64(), "pos": pa.binary(), "num": pa.binary(),
    "lang": pa.string(), "word": pa.string(), "a": pa.int64(), "rank": pa.int64(), "block": pa.int32(),
}


def _batch(types: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))


def _shards(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        open_: dict[str, _Shard] = defaultdict(_Shard)
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                name = lang.as_py()
                open_[name].add(text.as_py())
                if open_[name].size >= SHARD_BYTES or sum(s.size for s in open_.values()) >= 2 * SHARD_BYTES:
                    largest = max(open_, key=lambda k: open_[k].size)
                    yield from open_.pop(largest).rows(next(numbers), largest, blocks)
        for name, shard in open_.items():
            yield from shard.rows(next(numbers), name, blocks)

    return run


def _merge_words(min_count: int):
    """Sum one block's words over all shards: frequent ones with their rank, and each shard's share."""

    def run(rows: pa.Table) -> pa.Table:
        block, out, rank = rows.column("block")[0].as_py(), [], 0
        by_lang = defaultdict(list)
        for i, lang in enumerate(rows.column("lang").to_pylist()):
            by_lang[lang].append(i)
        shards, pos, counts = (rows.column(c).to_pylist() for c in ("shard", "pos", "counts"))
        for lang, own in by_lang.items():
            words = rows.column("words").take(pa.array(own)).combine_chunks().flatten().dictionary_encode()
            places = [stretched(counts[i]) for i in own]
            number = words.indices.to_numpy()
            sums = np.zeros(len(words.dictionary), np.int64)
            np.add.at(sums, number, np.concatenate(places))
            frequent = np.flatnonzero(sums >= min_count)
            ranks = np.full(len(sums), -1, np.int64)
            ranks[frequent] = np.arange(rank, rank + len(frequent))
            rank += len(frequent)
            at = 0
            for i, counted in zip(own, places):
                num = ranks[number[at : at + len(counted)]]
                at += len(counted)
                if (num >= 0).any():
                    out.append((shards[i], squeezed(stretched(pos[i])[num >= 0]), squeezed(num[num >= 0]), None, None, None, None, block))
            for word, a, r in zip(words.dictionary.take(pa.array(frequent)).to_pylist(), sums[frequent].tolist(), ranks[frequent].tolist()):
                out.append((None, None, None, lang, word, a, r, block))
        return pa.Table.from_batches([_batch(_WORD_TYPES, out)])

    return run


def _no_runs(seq: np.ndarray) -> np.ndarray:
    """Breaks in a row become one."""
    keep = seq != 0
    keep[1:] |= seq[:-1] != 0
    return seq[keep]


def _filters(shard: int, seq: np.ndarray, at: np.ndarray, m: int, bits: int, blocks: int, keep: bool) -> pa.Table:
    """Filters of the n-grams that begin at the places ``at``, one per block, and the shard's words."""
    packing = Packing(m, bits)
    lanes, counts = tally(packing, packing.pack([seq[at + i] for i in range(m)]))
    own = block_bits(packing, blocks)
    block = (lanes[0] >> np.uint64(packing.width - own)).astype(np.int64)
    first = heads([block])
    ends = np.append(first, len(block))
    rows = [
        (shard, None, int(block[a]), to_filter(packing, [lane[a:b] for lane in lanes], counts[a:b], own)) for a, b in zip(first, ends[1:])
    ]
    if keep:
        rows.append((shard, squeezed(seq), None, None))
    columns = list(zip(*rows)) if rows else [()] * 4
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    return pa.table({k: pa.array(c, t) for k, c, t in zip(("shard", "seq", "block", "filter"), columns, kinds)})


def _whole(seq: np.ndarray, m: int) -> np.ndarray:
    """Places where ``m`` words in a row begin."""
    n = max(0, len(seq) - m + 1)
    ok = np.ones(n, np.bool_)
    for i in range(m):
        ok &= seq[i : i + n] != 0
    return np.flatnonzero(ok)


def _encode(bits: int, blocks: int, keep: bool):
    """A shard's words by their ids in the corpus, rare ones as breaks, and its pairs counted."""

    def run(shards: pa.Table, words: pa.Table) -> pa.Table:
        # One row per shard; without any frequent word there is nothing to count.
        local = stretched(shards.column("seq")[0].as_py())
        ids = np.zeros(int(local.max(initial=0)) + 1, np.int64)
        for pos, num, first in zip(*(words.column(c).to_pylist() for c in ("pos", "num", "first"))):
            ids[stretched(pos)] = stretched(num) + first
        seq = _no_runs(ids[local])
        return _filters(shards.column("shard")[0].as_py(), seq, _whole(seq, 2), 2, bits, blocks, keep)

    return run


def _known(packing: Packing, rows: pa.Table, blocks: int) -> list[np.ndarray]:
    own = block_bits(packing, blocks)
    parts = [from_filter(packing, f.as_py(), b.as_py(), own)[0] for b, f in zip(rows.column("block"), rows.column("filter"))]
    return [np.concatenate(p) for p in zip(*parts)] if parts else [np.empty(0, np.uint64) for _ in range(packing.lanes)]


def _lengthen(m: int, bits: int, blocks: int, keep: bool):
    """Count a shard's n-grams of ``m`` words both of whose parts of ``m - 1`` words are frequent."""

    def run(shards: pa.Table, frequent: pa.Table) -> pa.Table:
        if not shards.num_rows or not frequent.num_rows:
            return _filters(0, np.empty(0, np.int64), np.empty(0, np.int64), m, bits, blocks, False)
        seq = stretched(shards.column("seq")[0].as_py())
        packing, at = Packing(m - 1, bits), _whole(seq, m - 1)
        alive = np.zeros(len(seq) + 1, np.bool_)
        alive[at] = members(packing, packing.pack([seq[at + i] for i in range(m - 1)]), _known(packing, frequent, blocks))
        begins = alive[:-1] & alive[1:]
        inside = np.zeros(len(seq) + m, np.bool_)
        for i in range(m):
            inside[i : i + len(seq)] |= begins
        # Breaks replace what no frequent run needs. Two runs that only touch may then make an
        # n-gram that was not counted here, which the next length's look at frequent ones refuses.
        left = np.where(inside[: len(seq)], seq, 0)
        table = _filters(shards.column("shard")[0].as_py(), seq, np.flatnonzero(begins), m, bits, blocks, False)
        if keep:
            row = {"shard": shards.column("shard")[:1], "seq": pa.array([squeezed(_no_runs(left))], pa.binary())}
            more = pa.table({**row, "block": pa.array([None], pa.int64()), "filter": pa.array([None], pa.binary())})
            table = pa.concat_tables([table, more.cast(table.schema)])
        return table

    return run


def _merge(m: int, bits: int, blocks: int, min_count: int):
    """Merge one block's filters of all shards: frequent n-grams, and each shard's share of them."""

    def run(rows: pa.Table) -> pa.Table:
        packing = Packing(m, bits)
        own = block_bits(packing, blocks)
        block = rows.column("block")[0].as_py()
        filters = [from_filter(packing, f.as_py(), block, own) for f in rows.column("filter")]
        lanes = [np.concatenate(p) for p in zip(*(lanes for lanes, _ in filters))]
        distinct, sums = tally(packing, lanes, np.concatenate([counts for _, counts in filters]))
        frequent = [lane[sums >= min_count] for lane in distinct]
        out = []
        for shard, (own_lanes, counts) in zip(rows.column("shard"), filters):
            keep = members(packing, own_lanes, frequent)
            if keep.any():
                kept = [lane[keep] for lane in own_lanes]
                out.append((shard.as_py(), block, to_filter(packing, kept, np.ones(int(keep.sum()), np.int64), own), None, None))
        ids = np.stack(packing.unpack(frequent), axis=1).astype(np.int64)
        out += [(None, None, None, i, a) for i, a in zip(ids.tolist(), sums[sums >= min_count].tolist())]
        columns = list(zip(*out)) if out else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("shard", "block", "filter", "ids", "a"), columns, kinds)})

    return run


def phrase_counts(
    df: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words ``lang, word, a, id``, frequent phrases ``ids, a``, and totals ``lang, n``.

    Words are runs of characters other than space and tab, A-Z lower-cased; phrases do not pass
    ``.,;:!?`` or line ends. A null language is ``und``, a null text empty.
    """
    spark = df.sparkSession
    texts = df.select(F.coalesce(col(lang_col), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    pieces = pin(texts.mapInArrow(_shards(partitions(spark)), _SHARDS), "word-shards")
    totals = pin(pieces.where("n is not null").groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    lexicon = pieces.where("block is not null").select("shard", "lang", "block", "words", "pos", "counts")
    merged = pin(lexicon.groupBy("block").applyInArrow(_merge_words(min_count), _WORDS), "merged-1")
    words = merged.where("word is not null").select("lang", "word", "a", "rank", "block")
    sizes = words.groupBy("block").agg(F.count("*").alias("size"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    firsts = F.broadcast(pin(sizes.select("block", (F.coalesce(F.sum("size").over(before), F.lit(0)) + 1).alias("first")), "word-blocks"))
    words = pin(words.join(firsts, "block").select("lang", "word", "a", (F.col("first") + F.col("rank")).alias("id")), "frequent-words")
    known, all_words = words.count(), totals.agg(F.sum("n")).first()[0] or 0
    phrases = spark.createDataFrame([], "ids array<long>, a long")
    if not known:
        return words, phrases, totals
    bits = int(known).bit_length()
    blocks = (max(partitions(spark), all_words // BLOCK_WORDS) - 1).bit_length()

    places = merged.where("shard is not null").join(firsts, "block").select(F.col("shard").alias("of"), "pos", "num", "first")
    level = pieces.where("seq is not null").select("shard", "seq").groupBy("shard").cogroup(places.groupBy("of"))
    level = pin(level.applyInArrow(_encode(bits, blocks, max_words > 2), _LEVEL), "phrases-2")
    for m in range(2, max_words + 1):
        counted = level.where("block is not null").select("shard", "block", "filter").groupBy("block")
        merged = pin(counted.applyInArrow(_merge(m, bits, blocks, min_count), _MERGED), f"merged-{m}")
        phrases = phrases.unionByName(merged.where("ids is not null").select("ids", "a"))
        if m == max_words:
            break
        own = merged.where("shard is not null").select("shard", "block", "filter").groupBy("shard")
        level = level.where("seq is not null").select("shard", "seq").groupBy("shard").cogroup(own)
        level = pin(level.applyInArrow(_lengthen(m + 1, bits, blocks, m + 1 < max_words), _LEVEL), f"phrases-{m + 1}")
    return words, phrases, totals


def collocations(
    df: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of each language.

    A phrase of 2 to ``max_words`` words with at least ``min_count`` occurrences scores
    ``floor(1000 a n / (l r))`` at its worst cut into a first part (``l`` occurrences) and a rest
    (``r``), among cuts of one score the first. Phrases inside a longer one that is as frequent
    are dropped. Ties of score go by occurrences, then by the phrase's bytes.

    Repeated rows count as often as they occur; null texts, empty ones and those without a phrase
    give nothing, and so does an empty table. Very long texts are counted whole. Other columns are
    ignored. Numbers multiply as decimals of 38 digits.
    """
    words, phrases, totals = phrase_counts(df, min_count, max_words, text_col, lang_col)
    phrases = pin(phrases, "phrases")
    # A longer phrase as frequent as one inside it implies one of one word more, as frequent as both.
    size = F.size("ids")
    inner = phrases.where(size > 2).select(
        F.explode(F.array(F.slice("ids", 1, size - 1), F.slice("ids", 2, size - 1))).alias("ids"), F.col("a").alias("longer")
    )
    inner = inner.groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = pin(phrases.join(inner, "ids", "left").where("longer is null or longer < a").select("ids", "a"), "kept-phrases")

    parts = phrases.unionByName(words.select(F.array("id").alias("ids"), "a"))
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")).withColumns(
        {"left": F.slice("ids", F.lit(1), F.col("k")), "rest": F.slice("ids", F.col("k") + 1, F.size("ids"))}
    )
    cuts = cuts.join(parts.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left")
    cuts = cuts.join(parts.select(F.col("ids").alias("rest"), F.col("a").alias("r")), "rest")
    spelled = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ids").agg(  # at most max_words words
        F.first("lang").alias("lang"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"),
    )
    wide = {k: F.col(k).cast("decimal(38,0)") for k in ("a", "l", "r", "n")}
    found = cuts.join(spelled, "ids").join(totals, "lang")
    found = found.withColumn("score", F.call_function("div", wide["a"] * wide["n"] * 1000, wide["l"] * wide["r"]).cast("long"))
    worst = found.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ranked = worst.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = ranked.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long"), "phrase", *[F.col(c).cast("long") for c in ("a", "l", "r", "n", "score")])


def op12_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir))


OP12_SQL = rf"""
with pieces as (
  select lang, regexp_extract_all(piece, '[^ \t]+') as w from (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) as piece
    from documents)),
totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
grams as (
  select lang, w[i:i + m - 1] as g
  from (select lang, w, m, unnest(range(1, greatest(len(w) - m + 1, 0) + 1)) as i from pieces, (select unnest(range(1, {MAX_WORDS} + 1)) as m))),
f as (select lang, g, count(*) as a from grams group by lang, g having count(*) >= {MIN_COUNT}),
inner_ as (
  select lang, unnest([g[:len(g) - 1], g[2:]]) as g, a from f where len(g) > 2),
kept as (
  select lang, g, f.a from f left join (select lang, g, max(a) as longer from inner_ group by lang, g) using (lang, g)
  where len(g) >= 2 and (longer is null or longer < f.a)),
cuts as (select lang, g, a, unnest(range(1, len(g))) as k from kept),
scored as (
  select c.lang, c.g, c.a, k, x.a as l, y.a as r, n, (1000::hugeint * c.a * n // (x.a::hugeint * y.a))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.g = c.g[:k] join f y on y.lang = c.lang and y.g = c.g[k + 1:] join totals t on t.lang = c.lang),
worst as (
  select lang, array_to_string(g, ' ') as phrase, a, l, r, n, score from scored
  qualify row_number() over (partition by lang, g order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from worst qualify rank <= {TOP}
"""
