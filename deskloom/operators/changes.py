"""Ticket edits, deletes and change records, set at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom import schema as S
from deskloom.functions.legacy import pack_legacy
from deskloom.functions.status import status_choice, status_store, status_transition
from deskloom.functions.text import clean
from deskloom.operators.claims import refused_rows
from deskloom.operators.ingest import too_wide
from deskloom.operators.numbering import first_per_key
from deskloom.operators.schema_ops import data_type, key_column, quoted, read_field, write_column
from deskloom.session import pin, scratch

_TAKEN = "Duplicate entry for column job_order"

#: The most bitmaps of 4 kB that tasks are sent; beyond that they are joined by a shuffle.
MOST_BITMAPS = 16_384

# Edit column to the ticket column whose declared width limits it.
_LIMITED = {
    "store_name": "store_name",
    "contact_number": "contact_number",
    "email": "email",
    "subject": "subject",
    "reported_concern": "concern",
    "assigned_to": "assigned_it",
}


def check_edits(edits: DataFrame) -> DataFrame:
    """Edits as stored (stripped, blank as NULL), with the reason the table would refuse them.

    No field is required. Widths and the fee's type are the table's own limits; job orders have
    none, as numbers grow with the tickets.
    """
    cleaned = edits.withColumns(
        {
            **{c: clean(F.col(c)) for c in (*_LIMITED, "job_order", "service_done")},
            "status": status_store(F.col("status")),
            "_fee": clean(F.col("labor_fee")),
        }
    ).withColumn("labor_fee", F.col("_fee").try_cast("decimal(10,2)"))
    wide = too_wide(_LIMITED)
    error = F.when(wide.isNotNull(), F.concat(F.lit("Data too long for column "), wide)).when(
        F.col("_fee").isNotNull() & F.col("labor_fee").isNull(), "Incorrect decimal value for labor_fee"
    )
    return cleaned.withColumn("error", error).drop("_fee")


def _flag(df: DataFrame, rows: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` and a condition that tells whether its ``_row`` is among ``rows``.

    The rows travel as one bitmap per 32,768 row numbers, which is broadcast, so ``df`` is not shuffled.
    """
    numbered = rows.select("_row", F.bitmap_bucket_number("_row").alias("_bucket")).repartition("_bucket")
    bits = pin(numbered.groupBy("_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("_bits")), "row-bits")
    few = F.broadcast(bits) if bits.limit(MOST_BITMAPS + 1).count() <= MOST_BITMAPS else bits
    joined = df.withColumn("_bucket", F.bitmap_bucket_number("_row")).join(few, "_bucket", "left")
    position = F.bitmap_bit_position("_row")
    byte = F.conv(F.hex(F.substr("_bits", F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pow(F.lit(2), position % 8).cast("int")
    return joined, F.coalesce(byte.bitwiseAND(bit) > 0, F.lit(False))


def _judged(tickets: DataFrame, edits: DataFrame, order: list[str]) -> DataFrame:
    """``judge_edits``, with the number of each row as ``_row`` if they are written."""
    checked = check_edits(edits)
    if write_column(tickets, "concern") is None:
        block = pack_legacy(F.col("contact_number"), F.col("reported_concern"), F.col("assigned_to"))
        wide = F.when(F.length(block) > S.WIDTHS["assigned_it"], "Data too long for column assigned_it")
        checked = checked.withColumn("error", F.coalesce("error", wide))
    job_order, key = write_column(tickets, "job_order"), key_column(tickets)
    if job_order is None:
        return checked
    checked = pin(checked.withColumn("_row", F.monotonically_increasing_id()), "checked-edits", split_bytes=4 << 20, compression="zstd")
    own = tickets.select(quoted(key).alias(key), clean(quoted(job_order)).alias("job_order"))
    with scratch(checked.sparkSession, keep=1):  # but for the bitmaps
        taken = refused_rows(checked.where(F.col("error").isNull()), own, key, order, "job_order")
        judged, told = _flag(checked, taken)
    error = F.when(F.col("error").isNull() & told, _TAKEN).otherwise(F.col("error"))
    return judged.select(*[F.col(c) for c in checked.columns if c != "error"], error.alias("error"))


def judge_edits(tickets: DataFrame, edits: DataFrame, order: list[str]) -> DataFrame:
    """Checked edits, refused too where the ticket table itself would refuse them.

    A job order has one ticket. An edit is refused if another ticket has its job order when its turn
    comes; one that is given up can be taken by a later edit of the batch. Edits that leave a
    ticket's job order as it is are never refused for it. Without a concern column, the block that
    holds the concern has a width as well. Edits are cleaned once and written; claims are decided on
    their keys and job orders only, and come back as bitmaps of row numbers.
    """
    return _judged(tickets, edits, order).drop("_row")


def last_edits(edits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last accepted edit per key: later edits replace all editable columns.

    Accepted edits rank before refused ones, instead of a filter on ``error`` that would be pushed
    down and evaluate all the cleaning twice.
    """
    ranking = [F.col("error").isNull().desc(), *[F.desc(c) for c in order]]
    return first_per_key(edits, [F.col(key)], ranking).where(F.col("error").isNull()).drop("error")


def _editable(tickets: DataFrame) -> dict[str, Column]:
    """Ticket columns an edit replaces, and their new values."""
    concern = write_column(tickets, "concern")
    values = {
        "store_name": F.col("edit.store_name"),
        "Name": F.col("edit.store_name"),
        "contact_number": F.col("edit.contact_number"),
        "email": F.col("edit.email"),
        "Email": F.col("edit.email"),
        "subject": F.col("edit.subject"),
        "status": F.col("edit.status"),
        "service_done": F.col("edit.service_done"),
        "labor_fee": F.col("edit.labor_fee"),
    }
    job_order = write_column(tickets, "job_order")
    if job_order is not None:
        values[job_order] = F.col("edit.job_order")
    if concern is not None:
        values[concern] = F.col("edit.reported_concern")
        values["assigned_it"] = F.col("edit.assigned_to")
    else:
        values["Concern"] = F.col("edit.reported_concern")
        values["assigned_it"] = pack_legacy(
            F.col("edit.contact_number"), F.col("edit.reported_concern"), F.col("edit.assigned_to")
        )
    return {c: v for c, v in values.items() if c in tickets.columns}


def accepted_edits(tickets: DataFrame, edits: DataFrame, order: list[str]) -> DataFrame:
    """The last accepted edit per key, as key and struct ``edit``."""
    key = key_column(tickets)
    judged = _judged(tickets, edits, order)
    if "_row" in judged.columns:
        # The last ones are found by their row numbers, so that only they travel with all their columns.
        rows = last_edits(judged.select(key, *order, "_row", "error"), key, order).select("_row")
        chosen, is_last = _flag(judged, rows)
        last = chosen.where(is_last).drop("_bucket", "_bits", "_row", "error")
    else:
        last = last_edits(judged, key, order)
    return last.select(F.col(key), F.struct(*[c for c in last.columns if c != key]).alias("edit"))


def edited(tickets: DataFrame, last: DataFrame, beside: list[str] | None = None) -> DataFrame:
    """Tickets with their ``accepted_edits``. Both sides have one row per key, so no key is hot.

    ``beside`` names columns of both sides that follow from the key.
    """
    values = _editable(tickets)
    matched = F.col("edit").isNotNull()
    return tickets.join(last, [*(beside or []), key_column(tickets)], "left").select(
        *[
            F.when(matched, values[f.name]).otherwise(quoted(f.name)).cast(f.dataType).alias(f.name)
            if f.name in values
            else quoted(f.name)
            for f in tickets.schema.fields
        ]
    )


def apply_updates(tickets: DataFrame, edits: DataFrame, order: list[str]) -> DataFrame:
    """All tickets, with the last accepted edit applied. Write it as a new snapshot."""
    return edited(tickets, accepted_edits(tickets, edits, order))


def rejected_edits(tickets: DataFrame, edits: DataFrame, order: list[str]) -> DataFrame:
    judged = judge_edits(tickets, edits, order)
    return judged.where(F.col("error").isNotNull()).select(key_column(tickets), *order, "error")


def job_order_conflicts(tickets: DataFrame, edits: DataFrame, order: list[str]) -> DataFrame:
    """The edits refused because another ticket has their job order."""
    judged = judge_edits(tickets, edits, order)
    return judged.where(F.col("error") == _TAKEN).select(key_column(tickets), *order, "job_order")


def apply_deletes(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys``."""
    return rows.join(keys.select(key), key, "left_anti")


# Fields of a change record.
_COMPARED = ("store_name", "subject", "job_order", "status", "contact_number", "email")


def _record(df: DataFrame) -> Column:
    """One side of a change record."""
    fields = {c: read_field(df, c) for c in _COMPARED}
    fields["status"] = status_choice(fields["status"])
    fields["assigned"] = read_field(df, "assigned_it")
    return F.struct(*[v.alias(c) for c, v in fields.items()])


def _records(sides: DataFrame, key: str) -> DataFrame:
    pairs = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in _COMPARED for side in ("old", "new")]
    return sides.where(~F.col("old").eqNullSafe(F.col("new"))).select(
        key,
        *pairs,
        F.col("old.assigned").alias("old_assigned_it"),
        F.col("new.assigned").alias("new_assigned_to"),
    )


def diff_tickets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change records between two snapshots: tickets that differ in at least one field."""
    key = key_column(old)
    before = old.select(quoted(key), _record(old).alias("old"))
    after = new.select(quoted(key), _record(new).alias("new"))
    return _records(before.join(after, key), key)


def update_records(tickets: DataFrame, edits: DataFrame, order: list[str]) -> DataFrame:
    """The change records an update leaves, from one join instead of two snapshots."""
    key = key_column(tickets)
    matched = tickets.join(accepted_edits(tickets, edits, order), key)
    values = _editable(tickets)
    old = matched.withColumn("old", _record(tickets))
    new = old.withColumns({c: v.cast(data_type(tickets, c)) for c, v in values.items()})
    return _records(new.withColumn("new", _record(new)), key)


def status_transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tickets whose status choice changed, with the confirmation's ``from X to Y``."""
    key = key_column(old)
    before = old.select(quoted(key), read_field(old, "status").alias("old_status"))
    after = new.select(quoted(key), read_field(new, "status").alias("new_status"))
    label = status_transition(F.col("old_status"), F.col("new_status"))
    return before.join(after, key).select(key, label.alias("transition")).where(F.col("transition").isNotNull())
