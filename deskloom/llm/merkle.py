"""Operator 11, Merkle dataset manifest: proofs of all rows by octopus multiproofs.

Rows are leaves of one ternary tree per source; the subroots, in order of their sources, are leaves
of one more tree whose top is the root. Leaves lie in ranges of the order (source, id), so a hot
source is many ranges. A range grows what its own leaves determine and gives away only the tops it
cannot join (its frontier, a few nodes per level); frontiers of neighbouring ranges are folded in
rounds. For its proofs a range works out the least set of node coordinates it lacks (at each level
the siblings left of its first and right of its last path node), fetches them once, derives the
interior nodes its leaves share and expands each leaf's proof from them.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskloom.llm.common import col, documents, partitions, pin

ARITY = 3
#: Ranges folded in one group: each has two sources it shares with others, a few nodes per level.
FOLDED = 1024
#: Subroots of one group of the tree over sources.
SUBROOTS = ARITY**8
_TOP = -1
_NODE = "tree long, level int, idx long, digest string, n long"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def widths(n: int) -> list[int]:
    """Nodes of each level over ``n`` leaves, down to a single one."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def run_of(at: int, width: int) -> range:
    """The places that become one node together with ``at``."""
    first = at - at % ARITY
    return range(first, min(first + ARITY, width))


def grow(levels: list[dict[int, str]], wide: list[int]) -> list[tuple[int, int]]:
    """Add every node whose run is whole, level by level; the coordinates of those added."""
    added = []
    for level in range(len(wide) - 1):
        own, above = levels[level], levels[level + 1]
        for up in {at // ARITY for at in own}:
            run = run_of(up * ARITY, wide[level])
            if up not in above and all(at in own for at in run):
                above[up] = digest("".join(own[at] for at in run))
                added.append((level + 1, up))
    return added


def lacking(first: int, end: int, wide: list[int]) -> list[tuple[int, int]]:
    """Coordinates that the proofs of leaves ``first`` to ``end - 1`` need and these leaves cannot give."""
    out = []
    last = end - 1
    for level in range(len(wide) - 1):
        out += [(level, at) for at in run_of(first, wide[level]) if at < first]
        out += [(level, at) for at in run_of(last, wide[level]) if at > last]
        first, last = first // ARITY, last // ARITY
    return out


def _leaf(columns: list[Column]) -> Column:
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _segments(placed: DataFrame) -> DataFrame:
    """``range, tree, first, own, n``: the leaves that a range holds of a source's tree.

    One row per range and source; a source's number is its place in the order of sources. The
    window without a partition sees one row per range.
    """
    counts = placed.groupBy("range", "source").agg(F.count("*").alias("own"))
    of_source = Window.partitionBy("source")
    before = of_source.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cut = pin(
        counts.select(
            "range", "source", "own",
            F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first"),
            F.sum("own").over(of_source).alias("n"),
        ),
        "merkle-segments",
    )
    begun = cut.groupBy("range").agg(F.count_if(F.col("first") == 0).alias("begun"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = begun.select("range", F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("base"))
    at = F.row_number().over(Window.partitionBy("range").orderBy("source"))
    # Only the first source of a range can have begun in an earlier one.
    carried = F.max((F.col("first") > 0).cast("int")).over(Window.partitionBy("range"))
    numbered = cut.select("range", "own", "first", "n", (at - 1 - carried).alias("at"))
    return numbered.join(F.broadcast(base), "range").select(  # one row per range
        "range", (F.col("base") + F.col("at")).cast("long").alias("tree"), F.col("first").cast("long"), F.col("own").cast("long"), F.col("n").cast("long")
    )


def _in_order(leaves: pa.Table) -> pa.Table:
    keys = [(k, "ascending") for k in ("source", "doc_id", "leaf", "row")]
    return leaves.take(pc.sort_indices(leaves, sort_keys=keys, null_placement="at_start"))


def _node_table(rows: list[tuple], *more: str) -> pa.Table:
    names = ["tree", "level", "idx", "digest", "n", *more]
    kinds = {"level": pa.int32(), "digest": pa.string(), "new": pa.bool_()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in zip(names, columns)})


def _frontier(leaves: pa.Table, segments: pa.Table) -> pa.Table:
    """The nodes of one range that have no whole run, and the subroots it holds all of."""
    own = _in_order(leaves).column("leaf").to_pylist()
    out, at = [], 0
    for s in segments.sort_by("tree").to_pylist():
        wide = widths(s["n"])
        levels: list[dict[int, str]] = [{} for _ in wide]
        levels[0] = dict(zip(range(s["first"], s["first"] + s["own"]), own[at : at + s["own"]]))
        at += s["own"]
        grow(levels, wide)
        for level, nodes in enumerate(levels):
            done = levels[level + 1] if level + 1 < len(levels) else {}
            out += [(s["tree"], level, i, d, s["n"], s["range"]) for i, d in nodes.items() if i // ARITY not in done]
    return _node_table(out, "range")


def _fold(key: tuple, nodes: pa.Table) -> pa.Table:
    """Join frontiers of one group of ranges: new nodes, and older ones that still wait for others."""
    trees = defaultdict(list)
    for node in nodes.to_pylist():
        trees[node["tree"]].append(node)
    group, out = key[0].as_py(), []
    for tree, own in trees.items():
        n = own[0]["n"]
        wide = widths(n)
        levels: list[dict[int, str]] = [{} for _ in wide]
        for node in own:
            levels[node["level"]][node["idx"]] = node["digest"]
        new = set(grow(levels, wide))
        for level, at_level in enumerate(levels):
            above = levels[level + 1] if level + 1 < len(levels) else {}
            for i, d in at_level.items():
                fresh, waits = (level, i) in new, level + 1 < len(levels) and i // ARITY not in above
                if fresh or waits:
                    out.append((tree, level, i, d, n, group if waits else None, fresh))
    return _node_table(out, "range", "new")


def _climb(waiting: DataFrame, groups: int, name: str) -> DataFrame:
    """All nodes above ``waiting`` (nodes with the group, ``range``, that is folded first)."""
    found = None
    while True:
        folded = pin(waiting.groupBy("range").applyInArrow(_fold, _NODE + ", range long, new boolean"), name)
        fresh = folded.where("new").select("tree", "level", "idx", "digest", "n")
        found = fresh if found is None else found.unionByName(fresh)
        if groups <= 1:
            return found
        groups = -(-groups // FOLDED)
        waiting = folded.where("range is not null").withColumn("range", F.expr(f"range div {FOLDED}")).drop("new")


def _is_top(nodes: DataFrame) -> Column:
    """Whether a node is its tree's highest: the level below has more than one node."""
    return F.expr(f"idx = 0 and n <= power({ARITY}, level) and (level = 0 or n > power({ARITY}, level - 1))")


def _wanted(batches):
    """Coordinates that ranges lack, from segments ``range, tree, first, own, n``."""
    for batch in batches:
        rows = [
            (s["range"], s["tree"], level, i)
            for s in batch.to_pylist()
            for level, i in lacking(s["first"], s["first"] + s["own"], widths(s["n"]))
        ]
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["range", "tree", "level", "idx"])


def _suffixes(levels: list[dict[int, str]], wide: list[int], first: int, end: int, tail: str) -> list[str]:
    """The siblings of each leaf's path, one text per leaf; nodes above are worked out once for all."""
    spans = [(first, end)]
    for _ in wide[1:]:
        first, end = first // ARITY, (end - 1) // ARITY + 1
        spans.append((first, end))
    above = [tail]
    for level in range(len(wide) - 2, -1, -1):
        low, high = spans[level]
        up = spans[level + 1][0]
        own = levels[level]
        above = [
            "".join(own[j] for j in run_of(at, wide[level]) if j != at) + above[at // ARITY - up] for at in range(low, high)
        ]
    return above


def _fold_up(leaf: str, at: int, levels: list[dict[int, str]], wide: list[int]) -> str:
    """The top that a leaf at a place gives with its siblings."""
    for level in range(len(wide) - 1):
        own = levels[level]
        leaf = digest("".join(leaf if j == at else own[j] for j in run_of(at, wide[level])))
        at //= ARITY
    return leaf


def _expand(leaves: pa.Table, known: pa.Table) -> pa.Table:
    """Proofs of one range's leaves, from its segments and the nodes it has fetched."""
    leaves = _in_order(leaves)
    segments, fetched = [], defaultdict(list)
    for row in known.to_pylist():
        if row["digest"] is None:
            segments.append(row)
        else:
            fetched[row["tree"]].append(row)
    segments.sort(key=lambda s: s["tree"])
    tops = [s for s in segments if s["tree"] == _TOP]
    segments = [s for s in segments if s["tree"] != _TOP]

    def tree(s: dict, own: list[str]) -> tuple[list[dict[int, str]], list[int]]:
        wide = widths(s["n"])
        levels: list[dict[int, str]] = [{} for _ in wide]
        levels[0] = dict(zip(range(s["first"], s["first"] + s["own"]), own))
        for node in fetched[s["tree"]]:
            levels[node["level"]][node["idx"]] = node["digest"]
        grow(levels, wide)
        return levels, wide

    leaf, other = leaves.column("leaf").to_pylist(), leaves.column("tampered").to_pylist()
    trees, at = [], 0
    for s in segments:
        trees.append((s, at, *tree(s, leaf[at : at + s["own"]])))
        at += s["own"]
    top = tops[0]
    upper, upper_wide = tree(top, [levels[-1][0] for _, _, levels, _ in trees])
    tails = _suffixes(upper, upper_wide, top["first"], top["first"] + top["own"], "")
    subroot, proof, folded = [], [], []
    for (s, at, levels, wide), tail in zip(trees, tails):
        proofs = _suffixes(levels, wide, s["first"], s["first"] + s["own"], tail)
        for i, text in enumerate(proofs):
            subroot.append(levels[-1][0])
            proof.append(digest(text))
            low = _fold_up(other[at + i] or leaf[at + i], s["first"] + i, levels, wide)
            folded.append(_fold_up(low, s["tree"], upper, upper_wide))
    texts = {"subroot": subroot, "proof_sha256": proof, "folded_root": folded}
    out = {"doc_id": leaves.column("doc_id"), "leaf": leaves.column("leaf")}
    return pa.table({**out, **{k: pa.array(v, pa.string()) for k, v in texts.items()}})


def manifest(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A leaf is the digest of the named fields, each ``-`` if null, else its UTF-8 length, ``:`` and
    its value. ``tampered`` maps a field to what a reader received in its place; the root is then
    folded from that row's leaf and the original siblings, and ``verified`` tells whether it is the
    manifest's. Without it, folded roots come from the original leaves.

    A null source is a source of its own, before all others. Null ids come first in their source;
    rows of one id are ordered by leaf, and rows equal in all fields are interchangeable: each has
    a place of its own. An empty text differs from a null. A table of one row is its own root with
    an empty proof; an empty table gives an empty result. Other columns are ignored. Long texts
    leave the scan as digests only.
    """
    spark = df.sparkSession
    received = {**{f: col(f) for f in fields}, **(tampered or {})}
    rows = df.select(
        col(id_col).cast("long").alias("doc_id"),
        col(source_col).cast("string").alias("source"),
        _leaf([col(f) for f in fields]).alias("leaf"),
        _leaf([received[f] for f in fields]).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )
    if tampered is None:
        rows = rows.withColumn("tampered", F.col("leaf"))
    ranges = max(4, partitions(spark))
    placed = pin(
        rows.repartitionByRange(ranges, "source", "doc_id", "leaf", "row").withColumn("range", F.spark_partition_id().cast("long")),
        "merkle-leaves",
    )
    segments = pin(_segments(placed), "merkle-segments")
    leaves = placed.groupBy("range")
    first = pin(leaves.cogroup(segments.groupBy("range")).applyInArrow(_frontier, _NODE + ", range long"), "merkle-frontier")
    waiting = first.where(~_is_top(first)).withColumn("range", F.expr(f"range div {FOLDED}"))
    nodes = first.drop("range").unionByName(_climb(waiting, -(-ranges // FOLDED), "merkle-nodes"))

    subroots = pin(nodes.where(_is_top(nodes)).select("tree", "digest"), "merkle-subroots")
    sources = subroots.count()
    leaf_of_top = [F.lit(_TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "digest"]
    low = subroots.select(*leaf_of_top, F.lit(sources).cast("long").alias("n"))
    groups = max(1, -(-sources // SUBROOTS))
    upper = _climb(low.withColumn("range", F.expr(f"idx div {SUBROOTS}")), groups, "merkle-top") if sources > 1 else low.limit(0)
    upper = pin(low.unionByName(upper), "merkle-upper")
    root = upper.where(_is_top(upper)).select("digest").scalar()

    in_top = segments.groupBy("range").agg(
        F.lit(_TOP).cast("long").alias("tree"), F.min("tree").alias("first"), (F.max("tree") - F.min("tree") + 1).alias("own")
    ).withColumn("n", F.lit(sources).cast("long"))
    all_segments = segments.unionByName(in_top)
    wanted = all_segments.where("own < n").mapInArrow(_wanted, "range long, tree long, level int, idx long")
    fetched = wanted.join(nodes.drop("n").unionByName(upper.drop("n")), ["tree", "level", "idx"])
    known = fetched.unionByName(all_segments, allowMissingColumns=True)
    schema = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"
    proofs = leaves.cogroup(known.groupBy("range")).applyInArrow(_expand, schema)
    proofs = proofs.withColumn("root", root).withColumn("verified", F.col("folded_root") == F.col("root"))
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op11_merkle_manifest(spark, sf_dir):
    """Where 2 divides the id's CRC-32, the text is received without its line feeds."""
    odd = F.crc32(F.encode(col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    text = F.when(odd, F.replace(col("text"), F.lit("\n"), F.lit(""))).otherwise(col("text"))
    return manifest(documents(spark, sf_dir), tampered={"text": text})


OP11_SQL = """
with recursive
fields as (
  select doc_id, source,
         case when doc_id is null then '-' else strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar end
         || case when source is null then '-' else strlen(source)::varchar || ':' || source end
         || case when lang is null then '-' else strlen(lang)::varchar || ':' || lang end
         || case when n_chars is null then '-' else strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar end as head,
         text,
         list_reduce(
           list_concat([4294967295::ubigint], [ord(c)::ubigint for c in string_split(doc_id::varchar, '')]),
           lambda crc, b: list_reduce(
             list_concat([xor(crc, b)], [0::ubigint, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)) as crc
  from documents),
received as (
  select *, case when xor(crc, 4294967295::ubigint) % 2 = 0 then replace(text, chr(10), '') else text end as got from fields),
leaves as (
  select doc_id, source,
         sha256(head || case when text is null then '-' else strlen(text)::varchar || ':' || text end) as leaf,
         sha256(head || case when got is null then '-' else strlen(got)::varchar || ':' || got end) as tampered
  from received),
placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i,
         count(*) over (partition by source) as n,
         dense_rank() over (order by source nulls first) - 1 as tree
  from leaves),
nodes as (
  select tree, 0 as level, i, leaf as d, n from placed
  union all
  select tree, level + 1, i // 3, sha256(string_agg(d, '' order by i)), any_value((n + 2) // 3)
  from nodes where n > 1 group by tree, level, i // 3),
subroots as (select tree, d from nodes where n = 1),
upper as (
  select 0 as level, tree as i, d, (select count(*) from subroots) as n from subroots
  union all
  select level + 1, i // 3, sha256(string_agg(d, '' order by i)), any_value((n + 2) // 3)
  from upper where n > 1 group by level, i // 3),
every as (
  select tree, level, i, d, n from nodes where n > 1
  union all select -1, level, i, d, n from upper where n > 1),
low as (
  select tree, i as leaf_i, 0 as level, i, tampered as d, '' as proof, n from placed
  union all
  select l.tree, l.leaf_i, l.level + 1, l.i // 3, sha256(string_agg(case when e.i = l.i then l.d else e.d end, '' order by e.i)),
         any_value(l.proof) || coalesce(string_agg(e.d, '' order by e.i) filter (e.i <> l.i), ''), any_value((l.n + 2) // 3)
  from low l join every e on e.tree = l.tree and e.level = l.level and e.i // 3 = l.i // 3
  where l.n > 1 group by l.tree, l.leaf_i, l.level, l.i),
high as (
  select tree, leaf_i, 0 as level, tree as i, d, proof, (select count(*) from subroots) as n from low where n = 1
  union all
  select l.tree, l.leaf_i, l.level + 1, l.i // 3, sha256(string_agg(case when e.i = l.i then l.d else e.d end, '' order by e.i)),
         any_value(l.proof) || coalesce(string_agg(e.d, '' order by e.i) filter (e.i <> l.i), ''), any_value((l.n + 2) // 3)
  from high l join every e on e.tree = -1 and e.level = l.level and e.i // 3 = l.i // 3
  where l.n > 1 group by l.tree, l.leaf_i, l.level, l.i)
select p.doc_id, p.leaf, s.d as subroot, r.d as root, sha256(h.proof) as proof_sha256, h.d as folded_root, h.d = r.d as verified
from placed p join subroots s using (tree) join high h on h.tree = p.tree and h.leaf_i = p.i and h.n = 1
join upper r on r.n = 1
"""
