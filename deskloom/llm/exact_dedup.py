"""Operator 1, exact dedup: heavy-hitter split.

A Misra-Gries sketch (Spark's ``approx_top_k`` functions: bounded counters, partial aggregation on
the map side, merged in two levels) names digests that may be frequent. Their exact counts and
winners are computed next, and only those that really are frequent are broadcast: rows of hot
digests get their verdict where they are read and never meet in one task. All other digests use an
ordinary aggregation and join by digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.llm.common import ascii_lower, col, documents, pin, text_of

#: Counters of the sketch; also the bound on broadcast rows.
COUNTERS = 1024
#: A digest is hot if it holds at least this share of the rows.
HOT_SHARE = 1 / 512
_GROUPS = 32


def frequent(df: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters / 2`` values of ``key``, among them every one that is really frequent.

    The sketches of all partitions are merged in groups first, so no task reads more than its
    share of them.
    """
    size = int(counters)
    some = df.groupBy((F.spark_partition_id() % _GROUPS).alias("g")).agg(
        F.expr(f"approx_top_k_accumulate({key}, {size})").alias("s")
    )
    top = some.groupBy(F.col("g") < 0).agg(  # grouped, as a sketch of no rows does not exist
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {size}), {size // 2})").alias("t")
    )
    return top.select(F.explode("t").alias("t")).select(F.col("t.item").alias(key))


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    counters: int = COUNTERS,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal
    texts the row with the largest id stays. A null id is smaller than any id. If the largest id
    occurs on several rows of a group, exactly one of these rows stays. An empty table gives an
    empty result. Other columns are ignored; to filter a table, join it with the kept ids.
    """
    rows = pin(
        df.select(
            F.monotonically_increasing_id().alias("row"),
            col(id_col).alias("doc_id"),
            F.sha2(ascii_lower(text_of(text_col)), 256).alias("digest"),
        ),
        "digests",
    )
    verdict = [F.max(F.struct("doc_id", "row")).alias("win"), F.count("*").alias("group_size")]
    total = rows.agg(F.count("*").alias("n")).scalar()
    candidates = frequent(rows, "digest", counters)
    hot = (
        rows.join(F.broadcast(candidates), "digest")  # at most counters / 2 rows
        .groupBy("digest")
        .agg(*verdict)
        .where(F.col("group_size") >= total * hot_share)
    )
    hot = pin(hot, "hot-digests")
    bound = F.broadcast(hot)  # at most 1 / hot_share rows
    marked = rows.join(bound.withColumnRenamed("digest", "hot"), F.col("digest") == F.col("hot"), "left")
    cold = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    groups = cold.groupBy("digest").agg(*verdict)
    columns = ["row", "doc_id", "digest", "win", "group_size"]
    judged = marked.where("hot is not null").select(*columns).unionByName(cold.join(groups, "digest").select(*columns))
    return judged.select(
        "doc_id",
        F.col("win.doc_id").alias("keep_id"),
        F.col("group_size").cast("long"),
        (F.col("row") == F.col("win.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


OP1_SQL = """
with d as (
  select doc_id,
         sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id,
       max(doc_id) over w as keep_id,
       count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept,
       text_sha256
from d window w as (partition by text_sha256)
"""
