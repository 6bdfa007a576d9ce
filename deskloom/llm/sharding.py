"""Operator 9, sharding: global byte-size prefix sums, cut at equal targets.

Rows are range partitioned in a total order; every partition's total is known after one small
aggregation, so a row's global offset is the sum of the partitions before plus its local prefix.
Shard ``k`` holds the rows whose middle byte lies in the ``k``-th equal part of the total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskloom.llm.common import col, documents, partitions, pin, text_of


def prefix_sums(rows: DataFrame, order: list, measures: dict[str, str]) -> DataFrame:
    """Add global exclusive prefix sums: ``measures`` maps new columns to summed columns.

    Written tables fix the range bounds. A window sees one range at a time; what is broadcast is
    one row per range.
    """
    count = max(4, partitions(rows.sparkSession))
    placed = pin(
        rows.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    totals = placed.groupBy("_range").agg(*[F.sum(v).alias(k) for k, v in measures.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_before_{k}") for k in measures])
    local = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumns({f"_local_{k}": F.coalesce(F.sum(v).over(local), F.lit(0)) for k, v in measures.items()})
        .join(F.broadcast(offsets), "_range")  # one row per range
        .withColumns({k: (F.col(f"_local_{k}") + F.col(f"_before_{k}")).cast("long") for k in measures})
        .drop("_range", *[f"_local_{k}" for k in measures], *[f"_before_{k}" for k in measures])
    )


def shard_by_bytes(
    df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    A row's size is its text's UTF-8 bytes plus 1; a null text counts as empty. The order is the
    text's CRC-32, then SHA-256, then the id (nulls first), so that equal texts lie side by side
    and a group is split at shard borders only. Rows equal in all of these are interchangeable:
    each gets a slot of its own. Shards are contiguous in this order and near equal in bytes: off
    by at most the two rows at their borders. A table of fewer rows than shards leaves shards
    empty. Other columns are ignored.
    """
    text = text_of(text_col)
    rows = df.select(
        col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.substring(F.sha2(text, 256), 1, 16)).alias("digest"),
    ).withColumn("one", F.lit(1).cast("long"))
    order = [F.col("text_crc32"), F.col("digest"), F.col("doc_id")]
    numbered = prefix_sums(rows, order, {"start": "size", "place": "one"})
    total = df.agg(F.sum(F.octet_length(text) + 1).cast("long").alias("n")).scalar()
    middle = (2 * F.col("start") + F.col("size")) * shards
    sharded = pin(
        numbered.withColumn("shard", F.call_function("div", middle, 2 * total).cast("int")), "shards"
    )
    first = sharded.groupBy("shard").agg(F.min("place").alias("first"))
    return sharded.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_sharding(spark, sf_dir):
    return shard_by_bytes(documents(spark, sf_dir))
