"""Dense numbers at scale: job orders, ticket numbers, company ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskloom.functions.tickets import jo_format, jo_number
from deskloom.operators.schema_ops import key_column, quoted, read_field
from deskloom.session import pin

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def slotted(ranged: DataFrame, order: list[Column]) -> DataFrame:
    """Range partitioned rows, written with their place (``_slot``) inside their partition."""
    return pin(ranged.sortWithinPartitions(*order).withColumn("_slot", F.monotonically_increasing_id()))


def with_sequence(
    df: DataFrame, order: list[Column], name: str = "seq", after: Column | int = 0
) -> DataFrame:
    """Number all rows ``after + 1, after + 2, …`` in ``order`` without a one-task window.

    Rows are range partitioned and numbered inside their partition. The rows are then pinned on
    reliable storage, because a second evaluation might draw other range bounds. What is broadcast
    is one row per partition. ``order`` should end in a unique column, which also splits ranges
    with many equal leading values. A table that ``slotted`` has written is numbered as it is.
    """
    if "_slot" not in df.columns:
        df = slotted(df.repartitionByRange(*order), order)
    part = F.shiftright("_slot", _ROW_BITS)
    sizes = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    start = F.lit(after) if isinstance(after, int) else after
    local = F.col("_slot").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        df.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + local + 1 + start).cast("bigint"))
        .drop("_slot", "_part", "_before")
    )


def max_job_order(tickets: DataFrame) -> DataFrame:
    """Highest job-order number, 0 without any: one row."""
    number = jo_number(read_field(tickets, "job_order"))
    return tickets.agg(F.coalesce(F.max(number), F.lit(0)).alias("max_job_order"))


def next_job_order(tickets: DataFrame) -> DataFrame:
    return max_job_order(tickets).select(jo_format(F.col("max_job_order") + 1).alias("next_job_order"))


def max_ticket_no(tickets: DataFrame) -> DataFrame:
    key = quoted(key_column(tickets))
    return tickets.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("max_ticket_no"))


def allocate_job_orders(accepted: DataFrame, tickets: DataFrame, order: list[Column]) -> DataFrame:
    """Consecutive job orders for accepted rows, in input order, after the highest one in use."""
    numbered = with_sequence(accepted, order, "_jo", max_job_order(tickets).scalar())
    return numbered.withColumn("job_order", jo_format(F.col("_jo"))).drop("_jo")


def assign_ticket_no(df: DataFrame, tickets: DataFrame, order: list[Column]) -> DataFrame:
    """Consecutive ticket numbers after the highest one in use."""
    return with_sequence(df, order, "ticket_no", max_ticket_no(tickets).scalar())


def first_per_key(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row per key. Spark keeps one row per key and task before it shuffles."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")
