"""Operator 6, n-gram Jaccard join: exact set similarity with set-relation skipping.

Documents with equal shingle sets are one class. The index is a list per shingle of the classes
that have it in their prefix; shingles are ordered rare first, so passages that many documents
share come last and seldom reach a prefix. Three relations between sets save work:

- *Blocks of a list.* An index entry carries its set's size and the shingle's position. Lists are
  cut into blocks by size and position. A probe is sent only to the blocks in which some entry
  could still reach the threshold; the join key holds the block, so the others are never read.
- *Answers of a similar set.* Each list elects as leader the class with the most of its prefix
  shared, as a rule the text that the others are copies of. Leaders are answered first, over the
  whole lists. A class linked with a leader inherits the leader's component, so only pairs whose
  members do not already lie in one component are looked at again.
- Every remaining pair is verified on the whole sets, so no link between different texts is lost.
  Before texts travel, a pair is held against a bound from sketches of about a bit per shingle; it
  only refuses pairs that cannot link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm import hashing as H
from deskloom.llm.common import col, documents, few, pin, text_of
from deskloom.llm.linking import index_lists, linked_components, verified

WORDS = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles counted this often within blocks of documents are ordered by count, after all others.
COMMON = 16
#: The most common shingles that tasks are sent, at 16 bytes each. Any fixed order is exact; a
#: shingle beyond this bound only keeps its place among the rare ones.
MOST_COMMON = 1 << 20
_BLOCK_TOKENS = 1 << 21
_POSITIONS = 8  # blocks of positions per list


def set_key(tokens: np.ndarray) -> int:
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _survey(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Per document ``doc_key, set, n``, and ``sketch`` once per set of the task; per block of distinct
    sets, ``token, n`` of repeated shingles, the token as ``set``."""
    seen: set[int] = set()
    held: list[np.ndarray] = []
    count = 0

    def repeated() -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
        often = n > 1
        size = int(often.sum())
        return pa.record_batch([
            pa.nulls(size, pa.int64()), pa.array(H.signed(tokens[often])), pa.array(n[often].astype(np.int64)), pa.array(np.zeros(size, bool)),
            pa.nulls(size, pa.binary()),
        ], names=["doc_key", "set", "n", "is_doc", "sketch"])

    for batch in batches:
        keys = batch.column("doc_key")
        for row, end, data, offsets in H.slices(batch, "text"):
            sets = H.distinct_sets(data, offsets, k)
            ids = [set_key(s) for s in sets]
            sketches: list[bytes | None] = [None] * len(sets)
            for i, (key, tokens) in enumerate(zip(ids, sets)):
                if key not in seen:
                    seen.add(key)
                    sketches[i] = H.parity(tokens)
                    held.append(tokens)
                    count += len(tokens)
            yield pa.record_batch([
                keys.slice(row, end - row), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.ones(len(sets), bool)),
                pa.array(sketches, pa.binary()),
            ], names=["doc_key", "set", "n", "is_doc", "sketch"])
            if count >= _BLOCK_TOKENS:
                yield repeated()
                held, count = [], 0
    yield repeated()


def prefix_length(size, percent: int):
    """Shingles of which two linked sets must share one: size - ceil(percent * size / 100) + 1."""
    return size - (size * percent + 99) // 100 + 1


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, percent: int, common) -> Iterator[pa.RecordBatch]:
    """Index entries ``token, set, size, pos`` of every distinct set of the task.

    ``share`` is how much of its prefix is common, in thousandths.
    """
    tokens, counts = common.value
    seen: set[int] = set()
    for batch in batches:
        for _, _, data, offsets in H.slices(batch, "text"):
            out: list[tuple] = []
            for own in H.distinct_sets(data, offsets, k):
                key = set_key(own)
                if not len(own) or key in seen:
                    continue
                seen.add(key)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                    count = np.where(tokens[at] == own, counts[at], 0)
                    order = np.argsort(count, kind="stable")
                    own, count = own[order], count[order]
                else:
                    count = np.zeros(len(own), np.int64)
                head = own[: prefix_length(len(own), percent)]
                out.append((head, key, len(own), int(1000 * np.mean(count[: len(head)] > 0))))
            if out:
                sizes = [len(h) for h, *_ in out]
                spread = lambda i, kind: pa.array(np.repeat(np.array([x[i] for x in out], kind), sizes))
                yield pa.record_batch([
                    pa.array(H.signed(np.concatenate([h for h, *_ in out]))), spread(1, np.int64), spread(2, np.int32),
                    pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])), spread(3, np.int16),
                ], names=["token", "set", "size", "pos", "share"])


def _sets(batch: pa.RecordBatch, column: str, k: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in H.slices(batch, column):
        yield from H.distinct_sets(data, offsets, k)


def _blocked(entries: DataFrame) -> DataFrame:
    """Add the block of an index entry: size class and position class."""
    return entries.withColumns({
        "by_size": F.floor(F.log("size") / F.log(F.lit(4 / 3))).cast("int"),
        "by_pos": F.floor(_POSITIONS * F.col("pos") / F.col("size")).cast("int"),
    })


def _possible_blocks(size: Column, pos: Column, by_size: Column, percent: int) -> Column:
    """The blocks in which an entry could reach the threshold with a probe of this size and position.

    With r the shingles from the shared one on, overlap <= min(r, r') and a link needs
    (100 + percent) * overlap >= percent * (size + size'). Block borders are widened a little
    against rounding.
    """
    span = 2 if percent >= 75 else int(np.ceil(np.log(100 / percent) / np.log(4 / 3))) + 1
    found = []
    for d in range(-span, span + 1):
        least = F.pow(F.lit(4 / 3), by_size + d) * 0.999
        most = F.pow(F.lit(4 / 3), by_size + d + 1) * 1.001
        for p in range(_POSITIONS + 1):
            rest = (100 + percent) * (1 - p / _POSITIONS) - percent
            fits = ((100 + percent) * (size - pos) >= percent * (size + least)) & (most * rest >= percent * size)
            found.append(F.when(fits, F.struct((by_size + d).cast("int").alias("by_size"), F.lit(p).alias("by_pos"))))
    return F.array_compact(F.array(*found))


def _probe(entries: DataFrame, percent: int) -> DataFrame:
    """Entries once for each block of their list that they could reach."""
    possible = _possible_blocks(F.col("psize"), F.col("ppos"), F.col("pby_size"), percent)
    sent = entries.withColumn("block", F.explode(possible)).drop("pby_size", "pby_pos")
    return sent.select("*", "block.by_size", "block.by_pos").drop("block")


def _fits(a: str, b: str, percent: int) -> str:
    """Whether two entries' sets could still reach the threshold, by their sizes and positions."""
    return f"""{100 + percent} * least({a}size - {a}pos, {b}size - {b}pos) >= {percent} * ({a}size + {b}size)
        and 100 * least({a}size, {b}size) >= {percent} * greatest({a}size, {b}size)"""


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    A document's set holds its distinct runs of ``words`` words; with fewer words, the whole
    sequence; without words nothing, and it is linked with nothing. Documents link when
    ``100 * intersection >= percent * union``; ``component_id`` is the least id reachable, the own
    one included. Null ids are ignored by that minimum; a component of null ids has a null one.
    Repeated rows are copies and share a component. An empty table gives an empty result. Other
    columns are ignored. Sets are of 64-bit hashes, their classes keyed by 64 bits.
    """
    return _components(df, id_col, text_col, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _components(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    spark = df.sparkSession
    docs = df.select(col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    docs = docs.withColumn("doc_key", F.xxhash64("doc_id", "text"))
    seen = pin(
        docs.select("doc_key", "text").mapInArrow(partial(_survey, k=words), "doc_key long, set long, n long, is_doc boolean, sketch binary"),
        "survey",
    )
    sets = seen.where("is_doc").select("doc_key", "set", "n")
    sketches = seen.where("sketch is not null").select("set", "n", "sketch")
    often = (
        seen.where("not is_doc").groupBy("set").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
        .orderBy(F.desc("n"), "set").limit(MOST_COMMON).toPandas()
    )  # at most MOST_COMMON rows of 16 bytes
    tokens = often["set"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    common = spark.sparkContext.broadcast((tokens[order], often["n"].to_numpy(np.int64)[order]))
    entries = docs.select("text").mapInArrow(
        partial(_prefixes, k=words, percent=percent, common=common), "token long, set long, size int, pos int, share short"
    )
    lists = pin(_blocked(index_lists(entries, F.col("share")).drop("share")), "lists")
    labels = linked_components(
        lists.withColumn("lead", F.struct("lead.set", "lead.size", "lead.pos", F.lit(0).alias("by_size"), F.lit(0).alias("by_pos"))),
        partial(_fits, percent=percent), partial(_probe, percent=percent), ["by_size", "by_pos"], partial(_link, docs, sets, sketches, words, percent),
    )
    return _by_document(docs.select("doc_id", "doc_key"), sets, labels)


def _may_link(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, na, nb, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "xa", "xb"))
        # A link needs (100 + percent) * difference <= (100 - percent) * (size + size').
        keep = [(100 + percent) * H.least_difference(p, q) <= (100 - percent) * (m + n) for p, q, m, n in zip(x, y, na, nb)]
        kept = pa.array(keep, pa.bool_())
        yield pa.record_batch([pa.array(a, pa.int64()).filter(kept), pa.array(b, pa.int64()).filter(kept)], names=["a", "b"])


def _link(docs: DataFrame, sets: DataFrame, sketches: DataFrame, words: int, percent: int, pairs: DataFrame) -> DataFrame:
    """The pairs that link: those that their sketches allow, judged on whole sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    known = pin(sketches.join(ends, "set", "left_semi").dropDuplicates(["set"]), "sketches")
    of_a, of_b = (known.withColumnsRenamed({"set": e, "n": f"n{e}", "sketch": f"x{e}"}) for e in "ab")
    pairs = pin(pairs.join(of_b, "b").join(of_a, "a").mapInArrow(partial(_may_link, percent=percent), "a long, b long"), "likely-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    chosen = pin(sets.join(ends, "set", "left_semi").groupBy("set").agg(F.min("doc_key").alias("doc_key")), "chosen")
    texts = docs.select("doc_key", "text").join(few(chosen), "doc_key").dropDuplicates(["set"]).select("set", "text")
    return verified(pairs, pin(texts, "texts"), percent, partial(_sets, k=words))


def _by_document(docs: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, doc_key, n, component_id, keeper`` per row. Joins have a written, unique side, so
    hot classes split. ``keeper`` is the key of the component's least document."""
    grouped = sets.dropDuplicates(["doc_key"]).join(labels.withColumnRenamed("node", "set"), "set", "left")
    bare = F.col("n") == 0  # alone in its group: keys of empty documents cover their ids
    group = F.when(bare, F.col("doc_key")).otherwise(F.coalesce("comp", "set"))
    by_key = pin(grouped.select("doc_key", "n", group.alias("grp"), bare.alias("bare")), "grouped")
    placed = pin(docs.join(by_key, "doc_key"), "placed")
    least = placed.groupBy("grp", "bare").agg(
        F.min("doc_id").alias("component_id"), F.min_by("doc_key", F.struct(F.col("doc_id").isNull(), "doc_id", "doc_key")).alias("keeper")
    )
    return placed.join(pin(least, "least"), ["grp", "bare"])


def representatives(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row of each component, whole: that of the least id (nulls last, then the least hash).

    Of repeated rows one stays. Documents without words are linked with nothing, so all ids stay.
    """
    found = _components(df, id_col, text_col, words, percent)
    keepers = pin(found.where("doc_key = keeper").select("doc_key").distinct(), "keepers")
    packed = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), F.xxhash64(col(id_col), text_of(text_col)).alias("doc_key"))
    return packed.join(keepers, "doc_key").dropDuplicates(["doc_key"]).select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def op6_ngram_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir))
