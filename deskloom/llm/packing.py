"""Operator 3, best-fit packing with large-item matching.

Documents become token ids and then pieces of at most one sequence. A piece's length is all that
packing needs, so the plan is made from the number of pieces of each length - a table as long as a
sequence, whatever the corpus - and says, for runs of pieces of one length, where they go. Pieces
longer than a third of a sequence are matched greedily, the longest with the longest that fits, so
at most two of them share a sequence; shorter ones, the longest first, go to the tightest gap that
holds them. Every piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from deskloom.llm import hashing as H
from deskloom.llm.common import col, documents, pin, text_of

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
#: Words beyond this many bytes are not remembered, and at most so many words are.
_LONG_WORD = 64
_REMEMBERED = 4_000_000


class Encoder:
    """Token ids of whole texts, with the ids of words met before remembered.

    The vocabulary's pre-tokenizer never joins a solid character with what follows a single space
    or newline, so a text may be cut before such a one, and each part encoded by itself. That holds
    for special tokens written out in a text too, as they have no white space.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        empty = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32))
        self.known, self.recent = empty, empty
        self.ids = np.empty(0, np.uint32)

    @staticmethod
    def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the parts of a slice begin."""
        starts = offsets[:-1][np.diff(offsets) > 0]
        if len(data) < 4:
            return starts
        two_bytes = (data >= 0xC3) & (data <= 0xDF)  # leads of characters that are no white space
        ascii_solid = (data > 0x20) & (data < 0x7F)
        solid_end = ascii_solid.copy()
        solid_end[1:] |= two_bytes[:-1]
        cut = ((data == 0x20) | (data == 0x0A))
        cut[0] = cut[-1] = False
        cut[1:] &= solid_end[:-1]
        cut[:-1] &= (ascii_solid | two_bytes)[1:]
        cut[starts] = True
        return np.flatnonzero(cut)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start among the ids or -1, count) of sorted hashes."""
        start, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for keys, at, n in (self.known, self.recent):
            if len(keys):
                place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[place] == hashes
                start[hit], count[hit] = at[place[hit]], n[place[hit]]
        return start, count

    def _remember(self, hashes: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        def merged(one, two):
            keys = np.concatenate((one[0], two[0]))
            order = np.argsort(keys, kind="stable")
            return tuple(np.concatenate((a, b))[order] for a, b in zip(one, two))

        self.recent = merged(self.recent, (hashes, start, count.astype(np.int32)))
        if len(self.recent[0]) > max(50_000, len(self.known[0]) // 4):
            self.known = merged(self.known, self.recent)
            self.recent = tuple(a[:0] for a in self.recent)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice and the first id of each document."""
        starts = self.cuts(data, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = H.segments(data, starts, np.ones(len(data), bool))
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known[0]) + len(self.recent[0]) > _REMEMBERED:
            self.forget()
        at, count = self._find(unique)
        ids = self.ids
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = data.tobytes()
            lo, hi = starts[first[new]], ends[first[new]]
            found = self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(lo.tolist(), hi.tolist())], add_special_tokens=False)
            found = [x.ids for x in found]
            sizes = np.array([len(x) for x in found])
            count[new] = sizes
            at[new] = len(ids) + np.cumsum(sizes) - sizes
            ids = np.concatenate((ids, np.array([i for x in found for i in x], np.uint32)))
            short = hi - lo <= _LONG_WORD
            if short.all():
                self._remember(unique[new], at[new], count[new])
                self.ids = ids
            else:
                kept = np.repeat(short, sizes)
                moved = len(self.ids) + np.cumsum(np.where(short, sizes, 0)) - np.where(short, sizes, 0)
                self._remember(unique[new][short], moved[short], sizes[short])
                self.ids = np.concatenate((self.ids, ids[len(self.ids) :][kept]))
        n = count[inverse]
        before = np.cumsum(n) - n
        out = ids[np.repeat(at[inverse] - before, n) + np.arange(int(n.sum()))]
        part = np.searchsorted(starts, offsets)
        return out, np.append(before, len(out))[part]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    """Cut documents; ``rank`` counts the task's pieces of each length."""
    words = encoder(public_tokenizers.path(vocabulary))
    task = TaskContext.get().partitionId()
    met = np.zeros(capacity + 1, np.int64)
    for batch in batches:
        for row, last, data, offsets in H.slices(batch, "text"):
            ids, first = words.encode(data, offsets)
            rows = []
            for d in range(last - row):
                own = np.append(ids[first[d] : first[d + 1]], np.uint32(end)).astype("<u4")
                head = (len(own) - 1) % capacity + 1
                bounds = [0, *range(head, len(own) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    rows.append((row + d, piece, a, b - a, zlib.crc32(own[a:b].tobytes()), met[b - a]))
                    met[b - a] += 1
            which, piece, start, length, crc, rank = (np.array(x, np.int64) for x in zip(*rows))
            yield pa.record_batch([
                batch.column("doc_id").take(pa.array(which)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                pa.array(crc), pa.array(np.full(len(which), task, np.int32)), pa.array(rank),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Runs of placements, sorted by (length, rank), for ``counts`` pieces of each length.

    The ``k``-th piece of a run goes to sequence ``sequence + k // each`` at ``offset + k % each *
    length``. Sequences of one filling are handled together, so the work depends on the number of
    different lengths, not of pieces.
    """
    left = Counter({s: n for s, n in counts.items() if n})
    used: Counter = Counter()  # pieces of a length that have a place
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, how many, filled)
    opened = 0

    def place(length: int, n: int, sequence: int, offset: int, each: int) -> None:
        runs.append((length, used[length], sequence, offset, each))
        used[length] += n
        left[length] -= n

    def open_new(n: int) -> int:
        nonlocal opened
        opened += n
        return opened - n

    for big in sorted((s for s in left if 3 * s > capacity), reverse=True):
        while left[big]:
            fits = capacity - big
            partner = max((s for s, n in left.items() if 3 * s > capacity and s <= fits and n > (s == big)), default=None)
            if partner is None:
                n = left[big]
                first = open_new(n)
                place(big, n, first, 0, 1)
                gaps[fits].append((first, n, big))
            elif partner == big:
                n = left[big] // 2
                first = open_new(n)
                place(big, 2 * n, first, 0, 2)
                gaps[capacity - 2 * big].append((first, n, 2 * big))
            else:
                n = min(left[big], left[partner])
                first = open_new(n)
                place(big, n, first, 0, 1)
                place(partner, n, first, big, 1)
                gaps[fits - partner].append((first, n, big + partner))
    for small in sorted((s for s, n in left.items() if n), reverse=True):
        while left[small]:
            gap = next((g for g in range(small, capacity + 1) if gaps[g]), None)
            if gap is None:
                gap = capacity
                need = -(-left[small] // (capacity // small))
                gaps[gap].append((open_new(need), need, 0))
            first, n, filled = gaps[gap].pop()
            each = gap // small
            whole = min(n, left[small] // each)
            if whole:
                place(small, whole * each, first, filled, each)
                gaps[gap - each * small].append((first, whole, filled + each * small))
            first, n = first + whole, n - whole
            if n and 0 < left[small] < each:
                some = left[small]
                place(small, some, first, filled, some)
                gaps[gap - some * small].append((first, 1, filled + some * small))
                first, n = first + 1, n - 1
            if n:
                gaps[gap].append((first, n, filled))
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "offset", "each"), table.T))


def _placed(batches: Iterator[pa.RecordBatch], runs) -> Iterator[pa.RecordBatch]:
    table = runs.value
    key = (table["length"] << 48) | table["rank"]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        at = np.searchsorted(key, (length << 48) | rank, "right") - 1
        k, each = rank - table["rank"][at], table["each"][at]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.record_batch(
            [*[batch.column(c) for c in names], pa.array(table["sequence"][at] + k // each), pa.array(table["offset"][at] + k % each * length)],
            names=[*names, "sequence_id", "offset"],
        )


def pack(
    df: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its text's ids, then ``end``; a null text counts as empty and is the one id
    ``end``. Longer documents than ``capacity`` are cut into pieces of that length, the first of
    which may be shorter. Repeated rows and rows with a null id are packed each. An empty table
    gives an empty result. Other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    cut = partial(_pieces, vocabulary=vocabulary, capacity=capacity, end=end)
    pieces = pin(df.select(col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(cut, schema), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = df.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(pin(earlier, "ranks"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        partial(_placed, runs=runs), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op3_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))
