"""Filters over tickets, users and audit events."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions import people as P
from deskloom.functions import tickets as K
from deskloom.functions.status import status_label
from deskloom.functions.text import matches_like, same_folded
from deskloom.operators.schema_ops import data_type, key_column, quoted, read_field, write_column


def _midnight(day: datetime) -> Column:
    return F.lit(day.strftime("%Y-%m-%d 00:00:00")).cast("timestamp_ntz")


def parse_day(day: str) -> datetime:
    try:
        return datetime.strptime(day, "%Y-%m-%d")
    except ValueError:
        raise ValueError("Invalid date format. Please use the date picker.") from None


def by_day(df: DataFrame, day: str) -> DataFrame:
    """Tickets of one day. A half-open range, so that the scan can use it."""
    start = parse_day(day)
    column = write_column(df, "date")
    if column is None:
        return df
    c = quoted(column)
    if data_type(df, column) == "string":
        c = c.try_cast("timestamp_ntz")
    return df.where((c >= _midnight(start)) & (c < _midnight(start + timedelta(days=1))))


def by_status(df: DataFrame, status: str) -> DataFrame:
    """Tickets whose stored status equals ``status`` but for case and accents."""
    return df.where(same_folded(F.col("status"), status))


def by_store(df: DataFrame, store: str) -> DataFrame:
    """Tickets whose store name contains ``store``, which may hold LIKE wildcards."""
    return df.where(matches_like(F.col("store_name"), store))


def filter_tickets(df: DataFrame, day: str = "", status: str = "", store: str = "") -> DataFrame:
    """All given filters together; blank ones do not count."""
    status, store = status.strip(), store.strip()
    if day:
        df = by_day(df, day)
    if status:
        df = by_status(df, status)
    if store:
        df = by_store(df, store)
    return df


def haystack(df: DataFrame) -> Column:
    """The text a free-text search looks at: the list's display fields."""
    assigned = read_field(df, "assigned_it")
    date = read_field(df, "date")
    date_column = write_column(df, "date")
    if date_column is not None and data_type(df, date_column) != "string":
        date = K.timestamp_text(date)
    return K.haystack(
        quoted(key_column(df)),
        read_field(df, "store_name"),
        read_field(df, "job_order"),
        read_field(df, "subject"),
        K.display_assignee(assigned, read_field(df, "email")),
        date,
        read_field(df, "email"),
        K.display_contact(read_field(df, "contact_number"), assigned),
        K.ticket_concern(read_field(df, "concern"), assigned),
    )


def search(df: DataFrame, query: str) -> DataFrame:
    """Tickets whose display fields contain ``query``; an empty query keeps all."""
    if not query:
        return df
    return df.where(F.contains(haystack(df), F.lower(F.lit(query))))


def by_label(df: DataFrame, label: str) -> DataFrame:
    """Tickets with a derived status label; an empty one keeps all."""
    if not label:
        return df
    return df.where(status_label(read_field(df, "status")) == label)


def ticket(df: DataFrame, key: int) -> DataFrame:
    return df.where(quoted(key_column(df)) == key)


def user_by_email(df: DataFrame, email: str) -> DataFrame:
    return df.where(same_folded(F.col("email"), P.norm_email(F.lit(email)))).limit(1)


def user_by_id(df: DataFrame, user_id: int) -> DataFrame:
    return df.where(F.col("id") == user_id).limit(1)


def valid_jo(df: DataFrame, column: str = "job_order") -> DataFrame:
    return df.where(quoted(column).rlike(K.JO_PATTERN))


def visible_users(df: DataFrame, viewer_role: str) -> DataFrame:
    """Super admins see all users, admins the end users, others none."""
    if viewer_role == "super_admin":
        return df
    return df.where((F.col("role") == "end_user") if viewer_role == "admin" else F.lit(False))


def active_users(df: DataFrame) -> DataFrame:
    return df.where(P.is_active(F.col("is_active"), data_type(df, "is_active")))


def by_action(df: DataFrame, actions: Iterable[str]) -> DataFrame:
    """Audit events with one of ``actions``, but for case and accents."""
    wanted = [same_folded(F.col("action"), a) for a in actions]
    condition = F.lit(False)
    for w in wanted:
        condition = condition | w
    return df.where(condition)
