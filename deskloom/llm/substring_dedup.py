"""Operator 8, substring dedup: paragraph MinHash banding.

A paragraph begins at every sentence and line and takes whole sentences until it has enough words,
so a passage that is set into other text still begins paragraphs of its own. It ends with its line
if it has enough words there, else it runs on over line ends. Where no sentence begins in a run of
words, one of them is taken as a beginning by its hash, so that any 50 equal words hold a paragraph.
Paragraphs get
MinHash signatures over runs of five words; bands of them are tuned for recall. Paragraphs that
meet in a band are held against a bound from parity sketches, which only refuses pairs that cannot be
alike, then verified on exact Jaccard similarity; linked ones are clustered by components,
and a cluster that spans documents keeps its paragraphs in the first of them and removes the others.

Paragraphs of one document overlap, so most that meet are neighbours. Two paragraphs that both
occur in one document are not compared: any other document that has either of them repeats that
document anyway.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.llm import hashing as H
from deskloom.llm.common import col, documents, few, pin, text_of
from deskloom.llm.linking import index_lists, linked_components

WORDS = 5
PERCENT = 75
#: Least words of a paragraph.
PARAGRAPH = 20
#: Rows of a band, and the share of pairs at the threshold that must meet. A near copy on one line may
#: hold one paragraph only, so each pair by itself has to meet.
ROWS = 1
RECALL = 0.999
#: Bits of a paragraph's parity sketch, the upper half of its identity.
SKETCH = 32
#: Entries of a band that are compared by their sketches as soon as they are together; those of longer lists
#: are all kept for the joins behind.
TOGETHER = 4096
#: The most sets that tasks are sent to find their places by; beyond that they are joined by a shuffle.
MOST_SETS = 2_000_000
#: In any so many words of a document without a beginning of a sentence, the word of the least hash is one.
#: A first beginning, the least words of a paragraph and the next beginning fit in 2 * 15 + 20 words.
BREAK = 15
#: Signs that may follow the mark that ends a sentence.
_CLOSING = [c.encode() for c in "\"')]}\u201d\u2019\u00bb"]
_ENDS_CLOSING = np.isin(np.arange(256), [c[-1] for c in _CLOSING])
_ENDS_SENTENCE = np.isin(np.arange(256), list(b".!?"))
#: An entry of a band beside its token and source.
_ENTRY = np.dtype([("set", "<u8"), ("size", "<u4")])
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Runs of words that are in so many paragraphs of long lists come last in the order of a paragraph's runs, the most common ones
#: behind all others; of the commonest this many are told apart, 1 MB.
COMMON = 64
MOST_COMMON = 1 << 16
#: Columns of the second sketches.
_PARITY = ["even", "odd", "even2", "odd2"]


def bands(percent: int = PERCENT, rows: int = ROWS, recall: float = RECALL) -> int:
    """The least number of bands with which pairs at the threshold meet with this probability."""
    return ceil(log(1 - recall) / log(1 - (percent / 100) ** rows))


def _sentence_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether words end in a mark, closing quotes and brackets behind it aside."""
    last = ends - 1
    at = np.flatnonzero(_ENDS_CLOSING[data[last]])
    own, first = last[at], starts[at]
    for _ in range(4):
        for sign in _CLOSING:
            size = len(sign)
            hit = own - size >= first
            for i, byte in enumerate(sign):
                hit &= data[np.maximum(own - size + 1 + i, 0)] == byte
            own = np.where(hit, own - size, own)
    last[at] = own
    return _ENDS_SENTENCE[data[last]]


def _picked(hashes: np.ndarray, document: np.ndarray, marked: np.ndarray, window: int) -> np.ndarray:
    """The word of the least hash in each run of ``window`` words of a document without a marked one."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) >= window:
        count = np.concatenate(([0], np.cumsum(marked)))
        at = np.flatnonzero((count[window:] == count[:-window]) & (document[window - 1 :] == document[: len(document) - window + 1]))
        least = np.lib.stride_tricks.sliding_window_view(H.mix(hashes), window)[at].argmin(axis=1)
        out[at + least] = True
    return out


def paragraphs(data: np.ndarray, offsets: np.ndarray, least: int, k: int, over_lines: bool = False) -> dict[str, np.ndarray]:
    """Per paragraph of a slice: its document, first byte and byte after the last, words and digest.

    With ``over_lines``, one whose line ends too soon runs on to the next beginning of a sentence
    that gives it enough words, wherever lines end, or to the end of its document.
    """
    hashes, starts, first = H.words(data, offsets)
    n = len(hashes)
    runs = np.zeros(max(0, n - k + 1), np.uint64)
    for i, f in enumerate(H.weights(k, 2)):
        runs += hashes[i : i + len(runs)] * f
    runs = H.mix(runs + np.uint64(k))
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    empty = {c: np.empty(0, np.int64) for c in ("document", "start", "end", "words", "at", "size")} | {"digest": np.empty(0, np.uint64), "runs": runs}
    if n < least:
        return empty
    inside = H.word_mask(data)
    final = inside.copy()  # a word ends at white space or with its document
    final[:-1] &= ~inside[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    final[tails] = inside[tails]
    ends = np.flatnonzero(final) + 1
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, starts) + document * (1 + len(breaks))  # no word begins at a line's end
    marked = np.ones(n, bool)
    marked[1:] = _sentence_ends(data, starts[:-1], ends[:-1]) | (document[1:] != document[:-1])
    marked |= _picked(hashes, document, marked, BREAK)
    begins = marked.copy()
    begins[1:] |= line[1:] != line[:-1]
    last = np.append(np.flatnonzero(line[1:] != line[:-1]) + 1, n)  # first word after each line
    after_line = np.repeat(last, np.diff(np.append(0, last)))

    def stops(begins: np.ndarray) -> np.ndarray:
        heads = np.append(np.flatnonzero(begins), n)
        before = np.append(0, np.cumsum(begins))
        return heads[before[np.minimum(at + least, n)]]

    at = np.flatnonzero(begins)
    stop = np.minimum(stops(begins), after_line[at])
    if over_lines:
        stop = np.where(stop - at >= least, stop, np.minimum(stops(marked), first[document[at] + 1]))
    long = stop - at >= least
    at, stop = at[long], stop[long]
    if not len(at):
        return empty
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(H.mix(runs ^ np.uint64(0x5BD1E995)))))
    digest = H.mix(total[stop - k + 1] - total[at] + (stop - at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sketch, size = _sketches(runs, at, stop - k + 1)
    digest = sketch << np.uint64(32) | digest >> np.uint64(32)
    return {"document": document[at], "start": starts[at], "end": ends[stop - 1], "words": stop - at, "at": at, "size": size, "digest": digest, "runs": runs}


def _spread(at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of some spans one after another, and where each span starts among them."""
    ends = np.cumsum(end - at)
    starts = ends - (end - at)
    return starts, np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - starts, end - at)


def _sketches(runs: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per paragraph a parity sketch of ``SKETCH`` bits of its distinct runs of words, and their number."""
    bits = np.uint64(1) << (runs >> np.uint64(20)) % np.uint64(SKETCH)
    up_to = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bits)))
    sketch, size = up_to[end] ^ up_to[at], end - at
    order = np.argsort(runs)
    same = runs[order[1:]] == runs[order[:-1]]
    if same.any():
        several = np.append(same, False) | np.append(False, same)
        which, own = np.cumsum(np.append(True, ~same))[several], order[several]
        own = own[np.lexsort((own, which))]
        again = np.flatnonzero(which[1:] == which[:-1])
        before = np.full(len(runs) + 1, -1)  # where the same run was last
        before[own[again + 1]] = own[again]
        span = np.empty(2 * len(at), np.int64)
        span[::2], span[1::2] = at, end
        some = np.flatnonzero(np.maximum.reduceat(before, span)[::2] >= at)
        if len(some):
            starts, place = _spread(at[some], end[some])
            repeated = before[place] >= np.repeat(at[some], end[some] - at[some])
            sketch[some] ^= np.bitwise_xor.reduceat(np.where(repeated, bits[place], np.uint64(0)), starts)
            size[some] -= np.add.reduceat(repeated.astype(np.int64), starts)
    return sketch, size


def band_keys(found: dict[str, np.ndarray], count: int, rows: int, k: int) -> np.ndarray:
    """One column per band: a hash of the band's minima over each paragraph's runs of words."""
    span = np.empty(2 * len(found["at"]), np.int64)
    span[::2], span[1::2] = found["at"], found["at"] + found["words"] - k + 1
    seeds = H.weights(count * rows, 3)
    keys = np.empty((len(found["at"]), count), np.uint64)
    for b in range(count):
        key = np.full(len(found["at"]), b, np.uint64)
        for r in range(rows):
            hashed = np.append(H.mix(found["runs"] ^ seeds[b * rows + r]), np.uint64(0xFFFFFFFFFFFFFFFF))
            key = H.mix(key * np.uint64(31) + np.minimum.reduceat(hashed, span)[::2])
        keys[:, b] = key
    return keys


def _banded(batches: Iterator[pa.RecordBatch], least: int, k: int, count: int, rows: int) -> Iterator[pa.RecordBatch]:
    """``token, source, entries`` of the bands of paragraphs; equal paragraphs of a task for two documents at most.

    Paragraphs that begin one after another often share a band's key and travel in one row (``_ENTRY``).
    """
    seen: dict[int, int | None] = {}  # the first document; none after the second
    for batch in batches:
        keys = batch.column("doc_key").to_numpy()
        for row, _, data, offsets in H.slices(batch, "text"):
            found = paragraphs(data, offsets, least, k, over_lines=True)
            source = keys[row + found["document"]]
            fresh = np.zeros(len(source), bool)
            for i, (digest, own) in enumerate(zip(found["digest"].tolist(), source.tolist())):
                if digest not in seen:
                    seen[digest] = own
                    fresh[i] = True
                elif seen[digest] not in (None, own):
                    seen[digest] = None
                    fresh[i] = True
            if fresh.any():
                part = {c: found[c][fresh] for c in ("at", "words", "size", "digest")} | {"runs": found["runs"]}
                tokens, owner = np.ascontiguousarray(band_keys(part, count, rows, k).T), source[fresh]
                new = np.ones(tokens.shape, bool)
                new[:, 1:] = (tokens[:, 1:] != tokens[:, :-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                entries = np.empty(tokens.shape, _ENTRY)
                entries["set"], entries["size"] = part["digest"], part["size"]
                yield pa.record_batch([
                    pa.array(H.signed(tokens.reshape(-1)[first])), pa.array(np.tile(owner, count)[first]), _binary(entries, np.append(first, tokens.size)),
                ], names=["token", "source", "entries"])


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of values from one bound to the next as bytes."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _values(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """What ``_binary`` has packed: all values, and how many each row has."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return values.view(dtype), np.diff(offsets) // np.dtype(dtype).itemsize


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, set, source, size`` of the tokens that several sources have; rows come in the order of tokens."""
    held: pa.RecordBatch | None = None  # rows of the last token, of one source so far
    known = None  # a token that several sources have
    for batch in batches:
        if held is not None and len(held):
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not len(batch):
            continue
        token, source = (batch.column(c).to_numpy() for c in ("token", "source"))
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        lengths = np.diff(np.append(starts, len(token)))
        several = np.logical_or.reduceat(source != np.repeat(source[starts], lengths), starts)
        several[0] |= known is not None and token[0] == known
        known = token[-1] if several[-1] else None
        held = None if several[-1] else batch.slice(int(starts[-1]))
        keep = np.repeat(several, lengths)
        if keep.any():
            entries, counts = _values(batch.column("entries"), _ENTRY)
            entries, counts = entries[np.repeat(keep, counts)], counts[keep]
            yield pa.record_batch([
                pa.array(np.repeat(token[keep], counts)), pa.array(H.signed(np.ascontiguousarray(entries["set"]))),
                pa.array(np.repeat(source[keep], counts)), pa.array(entries["size"].astype(np.int32)),
            ], names=["token", "set", "source", "size"])


def _occurrences(batches: Iterator[pa.RecordBatch], least: int, k: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, doc_key, set, start, end`` of every paragraph, places counted in characters. A row that comes again in its
    task is passed over."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for key in batch.column("doc_key").to_pylist():
            fresh.append(key not in seen)
            seen.add(key)
        batch = batch.filter(pa.array(fresh, pa.bool_()))
        for row, _, data, offsets in H.slices(batch, "text"):
            found = paragraphs(data, offsets, least, k, over_lines=True)
            behind = np.flatnonzero((data & 0xC0) == 0x80)  # bytes of a character but its first
            first = offsets[found["document"]]
            start, end = (found[c] - first - np.searchsorted(behind, found[c]) + np.searchsorted(behind, first) for c in ("start", "end"))
            yield pa.record_batch([
                *[batch.column(c).take(pa.array(row + found["document"])) for c in ("doc_id", "doc_key")], pa.array(H.signed(found["digest"])),
                pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)),
            ], names=["doc_id", "doc_key", "set", "start", "end"])


def _wanted_runs(batches: Iterator[pa.RecordBatch], least: int, k: int) -> Iterator[pa.RecordBatch]:
    """``set, runs, even, odd, even2, odd2`` of the wanted paragraphs of each document: their distinct runs of words, a
    parity sketch of 128 bits of these, and the parts of its halves that make it one of 256 bits."""
    for batch in batches:
        wanted = batch.column("wanted")
        for row, end, data, offsets in H.slices(batch, "text"):
            found = paragraphs(data, offsets, least, k, over_lines=True)
            lists = wanted.slice(row, end - row)
            document = np.repeat(np.arange(end - row), lists.value_lengths().to_numpy(zero_copy_only=False))
            asked = lists.flatten().to_numpy().view(np.uint64) ^ H.mix(document.astype(np.uint64))
            keys, first = np.unique(found["digest"] ^ H.mix(found["document"].astype(np.uint64)), return_index=True)
            own = first[np.isin(keys, asked)]
            if not len(own):
                continue
            at, count = found["at"][own], found["words"][own] - k + 1
            runs = _rows(found["runs"][_spread(at, at + count)[1]], count)
            runs.sort(axis=1)
            runs[:, 1:][runs[:, 1:] == runs[:, :-1]] = _NONE
            told = runs != _NONE
            bits = np.where(told, np.uint64(1) << (runs & np.uint64(63)), np.uint64(0))
            half, quarter = (runs & np.uint64(64)) > 0, (runs & np.uint64(128)) > 0
            yield pa.record_batch([
                pa.array(H.signed(found["digest"][own])), _binary(runs[told], np.append(0, np.cumsum(told.sum(axis=1)))),
                *[pa.array(H.signed(np.bitwise_xor.reduce(np.where(side, bits, np.uint64(0)), axis=1))) for side in (~half, half, ~half & quarter, half & quarter)],
            ], names=["set", "runs", *_PARITY])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``run, n`` of all runs of words of a batch of sets."""
    for batch in batches:
        runs, n = np.unique(_values(batch.column("runs"), np.dtype("<u8"))[0], return_counts=True)
        yield pa.record_batch([pa.array(H.signed(runs)), pa.array(n)], names=["run", "n"])


def _rarest(batches: Iterator[pa.RecordBatch], percent: int, common: Broadcast) -> Iterator[pa.RecordBatch]:
    """``set, parts``: of each set its rarest runs, so many that sets at the threshold share one: they have at least
    ``percent`` of either set in common, and all order runs in one way."""
    known, often = common.value
    for batch in batches:
        for row in range(0, len(batch), 2048):
            part = batch.slice(row, 2048)
            values, sizes = _values(part.column("runs"), np.dtype("<u8"))
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            n = np.where(known[at] == values, often[at], 0) if len(known) else np.zeros(len(values), np.int64)
            inside = np.arange(int(sizes.max(initial=0))) < sizes[:, None]
            order = np.full(inside.shape, np.iinfo(np.int64).max)
            order[inside] = n
            runs = np.take_along_axis(_rows(values, sizes), np.argsort(order, axis=1, kind="stable"), axis=1)  # they are in order
            count = sizes - -(-percent * sizes.astype(np.int64) // 100) + 1
            some = runs[np.arange(runs.shape[1]) < count[:, None]]
            bounds = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
            yield pa.record_batch([part.column("set"), pa.ListArray.from_arrays(bounds, pa.array(H.signed(some)))], names=["set", "parts"])


def _parts(runs: DataFrame, percent: int, sets: DataFrame) -> DataFrame:
    """``_rarest`` of some sets. What is common is counted among them only."""
    own = runs.join(few(sets), "set", "left_semi").select("set", "runs")
    often = (
        own.mapInArrow(_frequent, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
        .orderBy(F.desc("n"), "run").limit(MOST_COMMON).toPandas()
    )  # at most MOST_COMMON rows of 16 bytes
    known = often["run"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    common = runs.sparkSession.sparkContext.broadcast((known[order], often["n"].to_numpy(np.int64)[order]))
    return own.mapInArrow(partial(_rarest, percent=percent, common=common), "set long, parts array<long>")


def _rows(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row per run of so many values, filled up with ``_NONE``. Paragraphs are about equally long."""
    out = np.full((len(counts), int(counts.max(initial=0))), _NONE)
    out[np.arange(out.shape[1]) < counts[:, None]] = values
    return out


def _alike(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs ``a, b`` whose sets of runs of words reach the threshold."""
    for batch in batches:
        for row in range(0, len(batch), 2048):
            part = batch.slice(row, 2048)
            (x, nx), (y, ny) = (_values(part.column(c), np.dtype("<u8")) for c in ("ra", "rb"))
            both = np.concatenate((_rows(x, nx), _rows(y, ny)), axis=1)
            both.sort(axis=1)
            shared = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)).sum(axis=1)
            linked = pa.array(100 * shared >= percent * (nx.astype(np.int64) + ny - shared))
            yield pa.record_batch([part.column("a").filter(linked), part.column("b").filter(linked)], names=["a", "b"])


def _close(sets: np.ndarray, sources: np.ndarray, sizes: np.ndarray, i, j, percent: int) -> np.ndarray:
    """``_fits`` of the entries ``i`` and ``j``."""
    apart = np.bitwise_count((sets[i] ^ sets[j]) >> np.uint64(64 - SKETCH)).astype(np.int64)
    return (sources[i] != sources[j]) & ((100 + percent) * apart <= (100 - percent) * (sizes[i] + sizes[j]))


def _any_close(starts: np.ndarray, ends: np.ndarray, sets: np.ndarray, sources: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether entries fit any other one of their list; lists run from ``starts`` to ``ends``."""
    met = np.zeros(len(sets), bool)
    last = np.repeat(ends, ends - starts)
    place = np.arange(len(sets))
    far = int((ends - starts).max(initial=0))
    for step in range(1, min(far, 33)):
        i = place[place + step < last]
        i = i[_close(sets, sources, sizes, i, i + step, percent)]
        met[i] = met[i + step] = True
    for start, end in zip(starts[ends - starts > 33], ends[ends - starts > 33]):
        own = np.arange(start, end)
        for block in range(start, end, 256):
            met[block : min(block + 256, end)] |= _close(sets, sources, sizes, own[block - start :][:256, None], own[None, :], percent).any(axis=1)
    return met


def _meeting(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of entries in the order of token, set and source: each set of a list once, for its least source, if
    the set has several sources (``again``) or fits another one of its list (``met``)."""
    names = ["token", "set", "source", "size"]
    held = [np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]
    long = None  # token of a list that is passed on as it comes

    def told(part: list[np.ndarray], whole: bool) -> pa.RecordBatch:
        token, sets, sources, sizes = part
        new = np.append(True, (token[1:] != token[:-1]) | (sets[1:] != sets[:-1]))
        first = np.flatnonzero(new)
        again = np.maximum.reduceat(sources != sources[first][np.cumsum(new) - 1], first)
        token, sets, sources, sizes = (x[first] for x in part)
        if whole:
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            met = _any_close(starts, np.append(starts[1:], len(token)), sets, sources, sizes, percent)
        else:
            met = np.ones(len(token), bool)
        keep = again | met
        columns = [H.signed(token[keep]), H.signed(sets[keep]), sources[keep], sizes[keep].astype(np.int32), again[keep], met[keep]]
        return pa.record_batch([pa.array(c) for c in columns], names=[*names, "again", "met"])

    for batch in batches:
        fresh = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        fresh = [fresh[0].view(np.uint64), fresh[1].view(np.uint64), fresh[2], fresh[3].astype(np.int64)]
        held = [np.concatenate(pair) for pair in zip(held, fresh)]
        token = held[0]
        if not len(token):
            continue
        if long is not None:
            end = int((token == long).sum())  # its rows come first
            if end == len(token):
                if end > TOGETHER:  # but for the last set, whose other sources may follow
                    end = int(np.flatnonzero(held[1] != held[1][-1])[-1:].sum() + 1) if held[1][0] != held[1][-1] else 0
                    if end:
                        yield told([x[:end] for x in held], False)
                        held = [x[end:] for x in held]
                    else:
                        held = _least_and_other(held)
                continue
            if end:
                yield told([x[:end] for x in held], False)
                held = [x[end:] for x in held]
                token = held[0]
            long = None
        end = int(np.flatnonzero(token != token[-1])[-1:].sum() + 1) if token[0] != token[-1] else 0
        if end:
            yield told([x[:end] for x in held], True)
            held = [x[end:] for x in held]
        if len(held[0]) > TOGETHER:
            long = held[0][0]
    if len(held[0]):
        yield told(held, long is None)


def _least_and_other(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Of one set's rows in the order of their sources, the first and one of another source, if any."""
    return [x[np.unique([0, len(x) - 1])] for x in rows]


def _fits(a: str, b: str, percent: int) -> str:
    """Whether two paragraphs of different documents could be alike: where their sketches differ, only one has a run."""
    return f"""{a}source <> {b}source
        and {100 + percent} * bit_count(shiftrightunsigned({a}set ^ {b}set, {64 - SKETCH})) <= {100 - percent} * ({a}size + {b}size)"""


def _differ(a: str, b: str, percent: int) -> str:
    """``_fits`` by the sketches of 128 and 256 bits too; the shorter ones refuse most, at less cost."""
    short = " + ".join(f"bit_count({a}{c} ^ {b}{c})" for c in ("even", "odd"))
    whole = " + ".join(f"bit_count({a}{c}2 ^ {b}{c}2) + bit_count({a}{c} ^ {b}{c} ^ {a}{c}2 ^ {b}{c}2)" for c in ("even", "odd"))
    return " and ".join([_fits(a, b, percent), *[f"{100 + percent} * ({x}) <= {100 - percent} * ({a}size + {b}size)" for x in (short, whole)]])


def _asked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """``token, set, other``: for each entry that ``asks`` two of its block that have another component and that
    the sketches of 256 bits allow, the closest by the sketches and the next one in a ring. The rows of a block are together."""
    held: pa.RecordBatch | None = None  # rows of the last block

    def told(part: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
        """Of whole blocks, which run from one bound to the next; small ones are compared in one go."""
        token, sets, source, comp, *sketch = (part.column(c).to_numpy() for c in ("token", "set", "source", "comp", *_PARITY))
        size, asks = part.column("size").to_numpy().astype(np.int32), part.column("asks").to_numpy(zero_copy_only=False)
        even, odd, even2, odd2 = (x.view(np.uint64) for x in sketch)
        sketch = [even ^ even2, even2, odd ^ odd2, odd2]
        block = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        cuts = np.unique(bounds[np.searchsorted(bounds, np.append(np.arange(0, len(part), 128), len(part)))])
        x, y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]  # who asks whom
        for start, end in zip(cuts[:-1], cuts[1:]):
            other = np.arange(start, end)
            asking = other[asks[start:end]]
            for at in range(0, len(asking), 256):
                own = asking[at : at + 256, None]
                apart = sum(np.bitwise_count(x[own] ^ x[other]).astype(np.int32) for x in sketch)
                room = (100 - percent) * (size[own] + size[other]) - (100 + percent) * apart
                room[(block[own] != block[other]) | (source[own] == source[other]) | (comp[own] == comp[other])] = -1
                fits = room >= 0
                behind = fits & (other > own)
                following = np.where(behind.any(axis=1), behind.argmax(axis=1), fits.argmax(axis=1))
                some = fits.any(axis=1)
                for chosen in (room.argmax(axis=1), following):
                    x.append(own[some, 0])
                    y.append(other[chosen[some]])
        x, y = np.concatenate(x), np.concatenate(y)
        return pa.record_batch([pa.array(token[x]), pa.array(sets[x]), pa.array(sets[y])], names=["token", "set", "other"])

    for batch in batches:
        if held is not None and len(held):
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not len(batch):
            continue
        token, block = batch.column("token").to_numpy(), batch.column("block").to_numpy()
        bounds = np.append(0, np.flatnonzero((token[1:] != token[:-1]) | (block[1:] != block[:-1])) + 1)
        held = batch.slice(int(bounds[-1]))
        yield told(batch.slice(0, int(bounds[-1])), bounds)
    if held is not None:
        yield told(held, np.array([0, len(held)]))


def _near(entries: DataFrame, percent: int) -> DataFrame:
    columns = ["token", "block", "set", "source", "comp", "size", *_PARITY, "asks"]
    return entries.select(*columns).mapInArrow(partial(_asked, percent=percent), "token long, set long, other long")


def _runs(docs: DataFrame, lists: DataFrame, least: int, k: int) -> DataFrame:
    """``_wanted_runs`` of every set of the lists, each out of one document."""
    chosen = lists.groupBy("set").agg(F.min("source").alias("doc_key"))
    wanted = pin(chosen.groupBy("doc_key").agg(F.collect_set("set").alias("wanted")), "wanted")  # a document's own paragraphs
    texts = docs.select("doc_key", "text").join(few(wanted.select("doc_key")), "doc_key", "left_semi").dropDuplicates(["doc_key"])
    found = texts.join(wanted, "doc_key").select("text", "wanted")
    return pin(found.mapInArrow(partial(_wanted_runs, least=least, k=k), "set long, runs binary, even long, odd long, even2 long, odd2 long"), "paragraph-runs")


def _linked(runs: DataFrame, percent: int, pairs: DataFrame) -> DataFrame:
    of_a, of_b = (runs.select(F.col("set").alias(e), F.col("runs").alias(f"r{e}")) for e in "ab")
    both = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "ra", "rb")
    return both.mapInArrow(partial(_alike, percent=percent), "a long, b long")


def repeated_passages(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = PARAGRAPH, words: int = WORDS,
    percent: int = PERCENT, rows: int = ROWS, recall: float = RECALL,
) -> DataFrame:
    """The spans of text that repeat across documents: one row per span.

    ``doc_id, doc_key, span_start, span_end`` (characters, end excluded), ``removed``,
    ``cluster_id, keep_doc_id, n_docs``. Overlapping paragraphs of a document make one span; its
    cluster is the least of theirs, with the document that keeps it and the most documents that
    share one of its paragraphs. A cluster's paragraphs in the document of the least id stay
    (``removed`` false; null ids come first, then the least hash). Repeated rows count as one
    document. Documents without a repeated passage, without text or with texts shorter than a
    paragraph have no row; an empty table gives an empty result. Other columns are ignored.
    """
    docs = df.select(col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("doc_key", F.xxhash64("doc_id", "text"))
    count = bands(percent, rows, recall)
    entries = docs.select("doc_key", "text").mapInArrow(
        partial(_banded, least=least, k=words, count=count, rows=rows), "token long, source long, entries binary"
    )
    by_token = entries.repartition("token").sortWithinPartitions("token")
    several = by_token.mapInArrow(_several, "token long, set long, source long, size int")
    in_order = several.sortWithinPartitions("token", "set", "source")  # a token's rows are together already
    met = pin(in_order.mapInArrow(partial(_meeting, percent=percent), "token long, set long, source long, size int, again boolean, met boolean"), "met")
    lists = pin(index_lists(met.where("met").select("token", "set", "source", "size"), F.lit(0), "source"), "band-lists")
    lists = lists.where("n > 1")
    runs = _runs(docs, lists, least, words)
    labels = linked_components(
        lists, partial(_fits, percent=percent), lambda probes: probes, [], partial(_linked, runs, percent),
        runs.select("set", *_PARITY), partial(_differ, percent=percent), partial(_near, percent=percent), partial(_parts, runs, percent),
    )
    again = met.where("again").select("set", F.lit(None).cast("bigint").alias("comp"))
    active = pin(again.union(labels).groupBy("set").agg(F.coalesce(F.max("comp"), "set").alias("cluster")), "active")
    fields = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("doc_key long, set long, start int, end int")])
    places = docs.mapInArrow(partial(_occurrences, least=least, k=words), fields)
    # Repeated rows in other tasks give places again, which changes nothing below.
    clustered = pin(places.join(few(active, MOST_SETS), "set").select("doc_id", "doc_key", "cluster", "start", "end"), "clustered")
    keep = (
        clustered.select("cluster", "doc_key", "doc_id").distinct()
        .groupBy("cluster").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "doc_key")).alias("keep")).where("n_docs > 1")
    )
    kept = clustered.join(pin(keep, "keepers"), "cluster")
    kept = kept.withColumn("removed", F.col("doc_key") != F.col("keep.doc_key"))
    by_doc = Window.partitionBy("doc_key", "removed").orderBy("start", "end")  # a document's own paragraphs
    reach = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = kept.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("island", F.sum("new").over(by_doc))
    return islands.groupBy("doc_key", "removed", "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("span_start"), F.max("end").alias("span_end"),
        F.min(F.struct("cluster", "keep.doc_id")).alias("c"), F.max("n_docs").alias("n_docs"),
    ).select(
        "doc_id", "doc_key", "span_start", "span_end", "removed", F.col("c.cluster").alias("cluster_id"), F.col("c.doc_id").alias("keep_doc_id"), "n_docs"
    )


def remove_passages(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows with the removed spans cut out of the text; a null text stays null."""
    cut = spans.where("removed").groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("cuts"))
    packed = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), F.xxhash64(col(id_col), text_of(text_col)).alias("doc_key"))
    text = F.col("row").getField(text_col)
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    kept = F.aggregate(
        "cuts", begin,
        lambda s, c: F.struct(F.concat(s.out, F.substring(text, s.at + 1, c.span_start - s.at)).alias("out"), c.span_end.alias("at")),
        lambda s: F.concat(s.out, F.substring(text, s.at + 1, F.length(text))),
    )
    joined = packed.join(cut, "doc_key", "left")
    return joined.select(*[
        (F.when(F.col("cuts").isNull(), text).otherwise(kept) if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns
    ])


def op8_substring_dedup(spark, sf_dir):
    return repeated_passages(documents(spark, sf_dir)).drop("doc_key")
