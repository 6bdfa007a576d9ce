"""Bulk ticket ingest: validation, accepted and rejected rows, new tickets, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskloom import schema as S
from deskloom.functions import tickets as K
from deskloom.functions.legacy import pack_legacy
from deskloom.functions.status import status_store, status_store_workbook
from deskloom.functions.text import clean, truthy
from deskloom.operators.ledger import Claim, reserve
from deskloom.operators.numbering import max_job_order, max_ticket_no, slotted, with_sequence
from deskloom.operators.schema_ops import key_column, write_column
from deskloom.session import pin

# Upload column to the ticket column whose declared width limits it.
_LIMITED = {
    "store_name": "store_name",
    "contact_number": "contact_number",
    "email": "email",
    "subject": "subject",
    "reported_concern": "concern",
    "assigned_to": "assigned_it",
}


def too_wide(widths: dict[str, str]) -> Column:
    """Name of the first column over its declared width, else NULL."""
    return F.coalesce(*[F.when(F.length(c) > S.WIDTHS[w], F.lit(c)) for c, w in widths.items()])


def validate(rows: DataFrame) -> DataFrame:
    """Uploaded text rows, cleaned, with the first failed rule as ``error`` (NULL if none)."""
    cleaned = {**{c: clean(F.col(c)) for c in _LIMITED}, "status": status_store(F.col("status"))}
    required = F.lit(False)
    for c in S.UPLOAD_REQUIRED:
        required = required | F.col(c).isNull()
    no_contact = F.col("contact_number").isNull() & F.col("email").isNull()
    wide = too_wide(_LIMITED)
    rules = []
    if "short" in rows.columns:
        rules.append((F.col("short"), F.lit("Row is shorter than the header")))
    rules += [
        (required, F.lit("Missing required fields")),
        (no_contact, F.lit("At least one of contact_number or email is required")),
        (wide.isNotNull(), F.concat(F.lit("Data too long for column "), wide)),
    ]
    failed = F.coalesce(*[F.when(broken, message) for broken, message in rules])
    error = F.concat(F.lit("Row "), F.col("row_num").cast("string"), F.lit(": "), failed)
    return rows.withColumns(cleaned).withColumn("error", error).drop("short")


def stage(checked: DataFrame) -> DataFrame:
    """Checked rows as a table in the shared folder.

    Accepted rows, rejected rows and the summary all start from it, so that uploads are parsed and
    cleaned once.
    """
    return pin(checked, "staged")


def stage_in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Uploaded rows, validated and staged in the order in which accepted ones are numbered.

    Raw rows are range partitioned, so that sampling cleans nothing. Accepted rows come first in
    their partition; their places are all the numbering needs, and no row is written again.
    """
    return slotted(validate(rows.repartitionByRange(*order)), [F.col("error").isNotNull(), *order])


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with row number and reason."""
    accepted = checked.where(F.col("error").isNull()).drop("error")
    keys = [c for c in ("file", "row_num", "error") if c in checked.columns]
    return accepted, checked.where(F.col("error").isNotNull()).select(*keys)


def ingest_summary(checked: DataFrame, messages: int = 5) -> DataFrame:
    """Per file: rows created and failed, the first messages and the number of others.

    Messages are cut to the first few per file and task before the shuffle, so one file with very
    many errors is no large group.
    """
    counts = checked.groupBy("file").agg(
        F.count_if(F.col("error").isNull()).alias("created"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
    order = Window.partitionBy("file").orderBy("row_num")
    first = (
        checked.where(F.col("error").isNotNull())
        .select("file", "row_num", "error", F.row_number().over(order).alias("_rank"))
        .where(F.col("_rank") <= messages)
        .groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("row_num", "error"))).alias("_first"))
        .select("file", F.array_join(F.transform("_first", lambda m: m["error"]), "; ").alias("errors"))
    )
    return counts.join(first, "file", "left").select(
        "file",
        "created",
        "failed",
        F.coalesce("errors", F.lit("")).alias("errors"),
        F.greatest(F.col("failed") - messages, F.lit(0)).cast("bigint").alias("more_errors"),
    )


def new_tickets(
    accepted: DataFrame, tickets: DataFrame, as_of: str, order: list[Column], claim: Claim | None = None
) -> DataFrame:
    """Accepted rows as rows of the ticket table, numbered in input order after the last ones.

    Numbers follow those of ``claim``, if the upload has reserved some, else the table's. Ticket
    number and job order share one numbering pass. A table without a concern column gets the legacy
    block instead.
    """
    last_ticket = max_ticket_no(tickets).scalar() if claim is None else F.lit(claim.ticket_no)
    last_job = max_job_order(tickets).scalar() if claim is None else F.lit(claim.job_order)
    numbered = with_sequence(accepted, order, "_n")
    concern_column = write_column(tickets, "concern")
    jo_column = write_column(tickets, "job_order")
    date_column = write_column(tickets, "date")
    assigned = F.col("assigned_to")
    if concern_column is None:
        assigned = pack_legacy(
            F.col("contact_number"), F.col("reported_concern"), F.col("assigned_to"), F.col("email")
        )
    values = {
        key_column(tickets): F.col("_n") + last_ticket,
        "store_name": F.col("store_name"),
        "contact_number": F.col("contact_number"),
        "email": F.col("email"),
        "subject": F.col("subject"),
        "assigned_it": assigned,
        "status": F.col("status"),
    }
    for extra in ("service_done", "labor_fee"):
        if extra in accepted.columns:
            values[extra] = F.col(extra)
    if jo_column is not None:
        values[jo_column] = K.jo_format(F.col("_n") + last_job)
    if concern_column is not None:
        values[concern_column] = F.col("reported_concern")
    if date_column is not None:
        values[date_column] = F.lit(as_of).cast("timestamp_ntz")
    nothing = F.lit(None)
    return numbered.select(
        *[
            values.get(f.name, nothing).cast(f.dataType).alias(f.name)
            for f in tickets.schema.fields
        ]
    )


def validate_workbook(rows: DataFrame) -> DataFrame:
    """Workbook rows that make tickets; values are not trimmed, incomplete rows are left out.

    ``error`` is set on all rows of a file that could not be read or holds a value over its width or
    a fee out of range: such a file is refused as a whole. A fee that is no number is left out.
    """
    required = F.lit(True)
    for c in S.UPLOAD_REQUIRED:
        required = required & truthy(F.col(c)).isNotNull()
    contact = F.coalesce(truthy(F.col("contact_number")), truthy(F.col("email")))
    complete = rows.where(F.col("error").isNotNull() | (required & contact.isNotNull()))
    wide, status = too_wide(_LIMITED), status_store_workbook(F.col("status"))
    checked = complete.withColumns(
        {
            **{c: truthy(F.col(c)) for c in _LIMITED},
            "status": status,
            "labor_fee": K.labor_fee(F.col("labor_fee")),
            "error": F.coalesce(
                "error",
                F.concat(F.lit("Data too long for column "), wide),
                F.when(F.length(status) > S.WIDTHS["status"], "Data too long for column status"),
                F.when(K.fee_out_of_range(F.col("labor_fee")), "Out of range value for column labor_fee"),
            ),
        }
    )
    # A workbook sheet holds at most 1,048,576 rows, which bounds the group.
    return checked.withColumn("error", F.max("error").over(Window.partitionBy("file")))


def append_tickets(df: DataFrame, path: str, upload_id: str) -> None:
    """Append an upload's rows to the ticket table, as its partition ``upload_id``.

    An append that is run again, after a failure or by mistake, replaces that upload's rows only.
    """
    named = df.withColumn("upload_id", F.lit(upload_id))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id").parquet(path)


def ingest_upload(
    rows: DataFrame, tickets: DataFrame, path: str, ledger: str, upload_id: str, as_of: str, order: list[Column]
) -> DataFrame:
    """Validate an upload, reserve its numbers in the ledger and append its tickets; the staged rows.

    Uploads may run at the same time. One that is run again gets the same numbers and replaces its
    own rows, so it is there once.
    """
    staged = stage_in_order(rows, order)
    accepted, _ = split_valid(staged)
    claim = reserve(ledger, upload_id, accepted.count(), tickets)
    append_tickets(new_tickets(accepted, tickets, as_of, order, claim), path, upload_id)
    return staged.drop("_slot")
