"""Components of the pairs that share an index list, without emitting every pair of a list.

Each list elects a leader, which is compared with the whole list. Members linked with their leader
share its component; only the others are compared with the list again, and there only with entries
of other components. So each pair of a list is either compared or already known to be connected.

A leader may be like few of its list, and then the pairs left are as many as the square of a group
of variants. Given ``near``, each entry that its leader has left open first asks a few likely ones of
its list, block by block, and what that links counts as connected too. Given ``parts``, a list beyond
a block is compared once more only where entries share a part, so its pairs do not grow with its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskloom.llm.common import few, pin
from deskloom.llm.components import components, extended

#: Entries of a list among which each asks for a likely one; longer lists are dealt into blocks by hash, twice.
BLOCK = 1024


def index_lists(entries: DataFrame, rank: Column, source: str | None = None) -> DataFrame:
    """Lists of ``token, set`` and other columns, each set once: its entries with ``n``, the list's
    number of sets, ``lead``, the entry of the highest rank, and ``again``, whether the set came from
    several tasks. Entries alone in their list are left out unless they came again.

    ``source`` names a column that says where an entry comes from, for lists that are to link
    different sources only. A set's entry is then that of its least source, ``again`` tells of
    several sources, and lists of a single source are left out.

    One shuffle by token serves all of it.
    """
    columns = [c for c in entries.columns if c not in ("token", "set")]
    alike = Window.partitionBy("token")
    own = [source] if source else []
    in_order = alike.orderBy("set", *own)
    again = F.max(source).over(Window.partitionBy("token", "set")) > F.col(source) if source else F.lead("set").over(in_order) == F.col("set")
    once = entries.withColumns({"prev": F.lag("set").over(in_order), "again": again}).where("prev is null or prev <> set")
    led = once.select(
        "token", "set", *columns, F.coalesce("again", F.lit(False)).alias("again"), F.count("*").over(alike).alias("n"),
        F.max(F.struct(rank.alias("rank"), "set", *columns)).over(alike).alias("lead"),
        *[(F.min(c).over(alike) < F.max(c).over(alike)).alias("several") for c in own],
    )
    return led.where("several or again").drop("several") if source else led.where("n > 1 or again")


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("set", "pset").alias("a"), F.greatest("set", "pset").alias("b")).distinct()


def linked_components(
    lists: DataFrame, fits: Callable[[str, str], str], probe: Callable[[DataFrame], DataFrame], keys: list[str], link: Callable[[DataFrame], DataFrame],
    details: DataFrame | None = None, fits_closely: Callable[[str, str], str] | None = None, near: Callable[[DataFrame], DataFrame] | None = None,
    parts: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``node, comp`` of every set with a link, from written ``index_lists``.

    ``fits(a, b)`` is the condition, in the entries' columns with these prefixes, under which a
    pair of a list may link. ``probe(entries)`` prepares entries, with columns prefixed ``p``, to
    meet others on ``keys``; ``link(pairs)`` gives the pairs ``a < b`` that do link.
    ``details`` may have more columns per set, for ``fits_closely``, a stricter ``fits`` of the pairs without a leader.
    ``near(entries)`` gives ``token, set, other``, pairs likely to link: for each of the entries that ``asks`` at least one
    of its ``token, block`` that has another component and ``fits_closely``, if there is any. A block's rows come together.
    ``parts(sets)`` gives ``set, parts`` for given sets, longs of which any two that link have one in common. It goes with ``near``.
    """
    columns = [c for c in lists.columns if c not in ("token", "set", "again", "n", "lead")]
    star = lists.where("set <> lead.set").select("set", *columns, F.col("lead.set").alias("pset"), *[F.col(f"lead.{c}").alias(f"p{c}") for c in columns])
    first = pin(_pairs(star.where(fits("", "p"))), "first-pairs")
    links = pin(link(first), "first-links")
    labels = components(links)
    # In a list of two sets, its leader has answered for both.
    larger = lists.where("n > 2").select("token", "set", *columns, "n", F.col("lead.set").alias("lead"))
    labelled = labels.select(F.col("node").alias("set"), "comp")
    lead = labels.select(F.col("node").alias("lead"), F.col("comp").alias("led"))
    named = (
        larger.join(labelled, "set", "left").join(lead, "lead", "left")
        .withColumns({"comp": F.coalesce("comp", "set"), "led": F.coalesce("led", "lead")})
    )
    named = pin(named if near is not None else named.drop("lead", "n"), "named")
    if details is not None:
        open_lists = pin(named.where("comp <> led").select("token").distinct(), "open-lists")
        columns += [c for c in details.columns if c != "set"]
        named = pin(named.join(few(open_lists), "token", "left_semi").join(details, "set"), "detailed")
    known, in_question = first, F.lit(True)
    if near is not None:
        asked = pin(near(_dealt(named)), "asked")
        likely = pin(_pairs(asked.withColumnRenamed("other", "pset")).join(first, ["a", "b"], "left_anti"), "near-pairs")
        known = first.union(likely)
        labels, moved = extended(labels, pin(link(likely), "near-links"))
        moved = few(moved.withColumnRenamed("comp", "up"))
        for c in ("comp", "led"):
            named = named.join(moved.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("up", c)).drop("up")
        # One that found nobody to ask in a list of one block has no pair left there.
        answered = pin(asked.select("token", "set").distinct(), "answered")
        named = named.join(few(answered.select("token", F.lit(True).alias("open")).distinct()), "token", "left").where(f"open or n > {BLOCK}").drop("open")
        in_question = F.expr(f"open or n > {BLOCK}")
        named = named.join(few(answered.withColumn("open", F.lit(True))), ["token", "set"], "left")
    own = []
    if parts is not None:
        long = F.col("n") > BLOCK
        sets = pin(named.where(long).select("set").distinct(), "long-sets")
        shared = named.where(long).join(pin(parts(sets), "parts"), "set").withColumn("part", F.explode("parts")).drop("parts")
        named, own = named.where(~long).withColumn("part", F.lit(0).cast("bigint")).unionByName(shared), ["part"]
    apart = named.where("comp <> led").where(in_question).select("token", "set", "comp", *columns, *own)
    probes = probe(apart.withColumnsRenamed({c: f"p{c}" for c in ("set", "comp", *columns)}))
    # Two probes of a list meet once, in the order of their sets.
    met = named.join(probes, ["token", *keys, *own]).where(f"(comp = led or set < pset) and set <> pset and comp <> pcomp and {(fits_closely or fits)('', 'p')}")
    second = pin(_pairs(met).join(known, ["a", "b"], "left_anti"), "second-pairs")
    if second.isEmpty():
        return labels
    return extended(labels, pin(link(second), "second-links"))[0]


def _dealt(named: DataFrame) -> DataFrame:
    """The entries but for leaders, which have met their whole list, dealt into blocks of a list in a random order; longer
    lists in two ways, so that their blocks hang together."""
    ways = F.when(F.col("n") > BLOCK, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = named.where("set <> lead").withColumn("asks", F.expr("comp <> led")).withColumn("way", F.explode(ways))
    parts, turn = F.ceil(F.col("n") / BLOCK), F.xxhash64("token", "set", "way")
    block = (F.pmod(F.xxhash64("turn"), parts) + parts * F.col("way")).cast("int")
    blocks = sent.withColumn("turn", turn).withColumn("block", block).drop("lead", "led", "n", "way")
    return blocks.repartition("token", "block").sortWithinPartitions("token", "block", "turn")


def _judged(batches: Iterator[pa.RecordBatch], percent: int, sets: Callable[[pa.RecordBatch, str], Iterator[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(sets(batch, "ta"), sets(batch, "tb")):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def verified(pairs: DataFrame, texts: DataFrame, percent: int, sets: Callable[[pa.RecordBatch, str], Iterator[np.ndarray]]) -> DataFrame:
    """The pairs whose exact Jaccard similarity reaches the threshold.

    ``texts`` has one row ``set, text`` per set; ``sets(batch, column)`` gives the distinct hashes
    of each text. Texts travel instead of hashes, as they pack better.
    """
    of_a = texts.select(F.col("set").alias("a"), F.col("text").alias("ta"))
    of_b = texts.select(F.col("set").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(partial(_judged, percent=percent, sets=sets), "a long, b long, linked boolean").where("linked").select("a", "b")
