"""Operator 13, benchmark decontamination: a broadcast hash set of the test items' n-grams.

The windows of the items (runs of consecutive words) are hashed; every task looks its documents'
windows up in the sorted hashes, compares the words of each hit with the item's, and keeps the
spans of words inside true hits. The items travel in blocks of bounded size. With more than one
block the documents pass through them one after the other, so test sets of any size are looked
for in full and no block outgrows a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskloom.llm import hashing
from deskloom.llm.common import col, documents, pin, text_of
from deskloom.llm.sharding import prefix_sums

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: UTF-8 bytes of item words in one broadcast, but for the last piece of a block.
BLOCK_BYTES = 8 << 20
#: Windows of one piece of a long item.
PIECE = 4096
_FOUND = "_n_words long, _spans array<struct<first:int,end:int,low:int,high:int>>, _items array<long>"


def word_mask(data: np.ndarray) -> np.ndarray:
    """Bytes of words: digits, letters and all beyond ASCII."""
    return (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122))


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word of lower-cased texts, and first word per text."""
    inside = word_mask(data)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    start[heads] = inside[heads]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    lasts = offsets[1:][np.diff(offsets) > 0] - 1
    stop[lasts] = inside[lasts]
    starts = np.flatnonzero(start)
    return hashing.segments(data, starts, inside), starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words, over the borders of texts too."""
    factor = hashing.weights(k, 3)
    out = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k):
        out += hashes[i : i + len(out)] * factor[i]
    return hashing.mix(out + np.uint64(k))


class Windows:
    """The windows of one block of items: per length, sorted hashes and where the words of each lie."""

    def __init__(self, block: list[tuple[int | None, str]], size: int):
        self.items = [item for item, _ in block]
        texts = [words.encode() for _, words in block]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        hashes, self.starts, self.ends, first = word_runs(self.data, offsets)
        counts = np.diff(first)
        self.by_length = {}
        for k in np.unique(np.minimum(counts, size)).tolist():
            own = np.flatnonzero(np.minimum(counts, size) == k)
            sizes = counts[own] - k + 1
            item = np.repeat(own, sizes)
            at = np.arange(int(sizes.sum())) + np.repeat(first[own] - (np.cumsum(sizes) - sizes), sizes)
            hashed = windows(hashes, k)[at]
            order = np.argsort(hashed, kind="stable")
            # A bit per low end of a hash: most windows of documents are refused by one look.
            bits = np.zeros(1 << max(16, len(at).bit_length() + 4), np.bool_)
            bits[(hashed & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            self.by_length[k] = (hashed[order], at[order], item[order], bits)

    def hits(self, data: np.ndarray, found: tuple, n_texts: int) -> list[list[tuple[int, int, set]]]:
        """Per text, the true hits as (first word, word after the last, items)."""
        hashes, starts, ends, first = found
        out: list[list[tuple[int, int, set]]] = [[] for _ in range(n_texts)]
        for k, (known, places, items, bits) in self.by_length.items():
            runs = windows(hashes, k)
            maybe = np.flatnonzero(bits[(runs & np.uint64(len(bits) - 1)).astype(np.int64)])
            text = np.searchsorted(first, maybe, "right") - 1
            keep = maybe + k <= first[text + 1]
            maybe, text = maybe[keep], text[keep]
            low, high = np.searchsorted(known, runs[maybe], "left"), np.searchsorted(known, runs[maybe], "right")
            for i in np.flatnonzero(low < high):
                at = int(maybe[i])
                words = [data[starts[j] : ends[j]].tobytes() for j in range(at, at + k)]
                ids = {self.items[items[j]] for j in range(low[i], high[i]) if self._words(int(places[j]), k) == words}
                if ids:
                    out[text[i]].append((at - int(first[text[i]]), at - int(first[text[i]]) + k, ids))
        return out

    def _words(self, at: int, k: int) -> list[bytes]:
        return [self.data[self.starts[j] : self.ends[j]].tobytes() for j in range(at, at + k)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as disjoint spans in order; touching ones become one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _pieces(size: int):
    """Words of items, long ones in pieces that share ``size - 1`` words, so that no window is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                data = hashing.lower(raw)
                _, starts, ends, _ = word_runs(data, np.array([0, len(data)]))
                words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
                for at in range(0, max(1, len(words) - size + 1) if words else 0, PIECE):
                    items.append(item)
                    texts.append(" ".join(words[at : at + PIECE + size - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(texts, pa.string())], ["item", "words"])

    return run


def _scan(block, size: int, text_col: str):
    """Look a block's windows up in documents, adding to what earlier blocks found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Windows(block.value, size)
        for batch in batches:
            old_spans, old_items = batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()
            counts, spans, items = [], [], []
            for row, end, raw, offsets in hashing.slices(batch, text_col):
                data = hashing.lower(raw)
                found = word_runs(data, offsets)
                _, starts, ends, first = found
                counts += np.diff(first).tolist()
                for i, own in enumerate(known.hits(data, found, end - row)):
                    earlier = [(s["first"], s["end"]) for s in old_spans[row + i] or ()]
                    whole = merged([(low, high) for low, high, _ in own] + earlier)
                    at, base = int(first[i]), int(offsets[i])
                    spans.append(
                        [
                            {"first": low, "end": high, "low": int(starts[at + low]) - base, "high": int(ends[at + high - 1]) - base}
                            for low, high in whole
                        ]
                    )
                    ids = set(old_items[row + i] or ()).union(*(ids for *_, ids in own))
                    items.append(sorted(ids - {None}))
            span = pa.struct([(k, pa.int32()) for k in ("first", "end", "low", "high")])
            new = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.int64()))]
            kept = [batch.column(c) for c in batch.schema.names[:-3]]
            yield pa.RecordBatch.from_arrays([*kept, *new], batch.schema.names)

    return run


def _blocks(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The items' words in blocks; the driver holds one at a time."""
    texts = benchmark.select(col(item_col).cast("long").alias("item"), text_of(text_col).alias("text"))
    pieces = texts.mapInArrow(_pieces(size), "item long, words string").distinct()
    sized = pieces.withColumn("bytes", F.octet_length("words").cast("long"))
    placed = prefix_sums(sized, ["item", "words"], {"start": "bytes"})
    placed = pin(placed.withColumn("block", F.expr(f"start div {BLOCK_BYTES}")), "benchmark-pieces")
    last = placed.agg(F.max("block")).first()[0]
    for block in range(0 if last is None else last + 1):
        yield [(r["item"], r["words"]) for r in placed.where(F.col("block") == block).select("item", "words").toLocalIterator()]


def scan(
    df: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The input's rows with ``_n_words``, ``_spans`` and ``_items``.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A span is a
    maximal run of words inside occurrences of windows: ``first`` and ``end`` count words, ``low``
    and ``high`` UTF-8 bytes of the text. ``_items`` are the ids, in order, of items with a window
    there; an item without an id has spans but is not listed.

    A null or empty text has no words. Each repeated row is judged alike, repeated items count
    once. An empty benchmark finds nothing, an empty table gives an empty result. Very long texts
    and items are scanned whole. Other columns are kept; input columns named like the three new
    ones, in any case, are replaced.
    """
    new = ["_n_words", "_spans", "_items"]
    names = [c for c in df.columns if c.lower() not in new]
    nothing = T._parse_datatype_string(_FOUND)
    found = df.select(*[col(c) for c in names], *[F.lit(None).cast(f.dataType).alias(f.name) for f in nothing])
    blocks = _blocks(benchmark, size, item_col, item_text)
    block, later = next(blocks, []), next(blocks, None)
    while True:
        sent = df.sparkSession.sparkContext.broadcast(block)
        found = found.mapInArrow(_scan(sent, size, text_col), found.schema)
        if later is None:
            return found
        found, block, later = pin(found, "decontaminated"), later, next(blocks, None)


def _without(text: Column, spans: Column) -> Column:
    """``text`` without the bytes of ``spans``; what stays on both sides of one is parted by a space."""
    data = F.encode(text, "UTF-8")
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["high"]))
    begins = F.concat(F.transform(spans, lambda s: s["low"]), F.array(F.octet_length(text)))
    parts = F.zip_with(ends, begins, lambda a, b: F.btrim(F.decode(F.substring(data, a + 1, b - a), "UTF-8")))
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def decontaminate(df: DataFrame, benchmark: DataFrame, remove: str = "spans", text_col: str = "text", **options) -> DataFrame:
    """The input's columns without the benchmark: ``remove`` is ``spans`` or ``documents``.

    Removing spans cuts the words of each span and what lies between them; texts without a hit stay
    as they are, character for character, nulls included. Removing documents drops rows with a hit.
    """
    found = scan(df, benchmark, text_col=text_col, **options)
    hit = F.size("_spans") > 0
    if remove == "documents":
        return found.where(~hit).drop("_n_words", "_spans", "_items")
    if remove != "spans":
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    cut = F.when(hit, _without(col(text_col), F.col("_spans"))).otherwise(col(text_col))
    return found.withColumn(text_col, cut).drop("_n_words", "_spans", "_items")


def op13_decontamination(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("_spans", F.lit(0), lambda n, s: n + s["end"] - s["first"]).cast("long")
    ids = F.array_sort(F.transform("_items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
with items as (select item_id, {_WORDS} as w from benchmark where text is not null),
wins as (
  select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as win
  from (select item_id, w, least({WINDOW}, len(w)) as k, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as i from items where len(w) > 0)),
docs as (select doc_id, {_WORDS} as w from (select doc_id, coalesce(text, '') as text from documents)),
lengths as (select distinct k from wins),
spots as (
  select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as win
  from (select doc_id, w, k, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) as i from docs, lengths)),
hits as (select doc_id, spots.k, i, item_id from spots join wins using (k, win)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
own as (
  select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
  from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(o.n_items, 0)::bigint as n_items,
       sha256(coalesce(o.ids, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from docs d left join covered c using (doc_id) left join own o using (doc_id)
"""
