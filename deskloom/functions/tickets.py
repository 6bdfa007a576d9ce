"""Ticket columns derived for listings, sheets and numbering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskloom.functions.legacy import assigned_to, legacy_concern, legacy_contact
from deskloom.functions.text import either, truthy

DASH = "—"
JO_PATTERN = "(?i)^jo-[0-9]+$"


def _or_dash(c: Column) -> Column:
    return F.coalesce(c, F.lit(DASH))


def reported_concern(concern: Column, assigned_it: Column) -> Column:
    """The concern, else the one inside the legacy block, else empty."""
    return F.coalesce(truthy(concern), legacy_concern(assigned_it), F.lit(""))


def display_assignee(assigned_it: Column, *emails: Column) -> Column:
    """List assignee: the raw assigned text, else an email, else a dash."""
    return _or_dash(either(assigned_it, *emails))


def sheet_assignee(assigned_it: Column, email: Column) -> Column:
    """Sheet assignee: the parsed one, else the email, else a dash."""
    return _or_dash(F.coalesce(assigned_to(assigned_it), truthy(email)))


def display_contact(contact: Column, assigned_it: Column) -> Column:
    """Contact number, else the legacy block's contact line, else a dash."""
    return _or_dash(F.coalesce(truthy(contact), legacy_contact(assigned_it)))


def contact_line(email: Column, contact: Column, assigned_it: Column) -> Column:
    """Email if there is one, else the contact."""
    return F.coalesce(truthy(email), display_contact(contact, assigned_it))


def ticket_concern(concern: Column, assigned_it: Column) -> Column:
    """List concern: the concern, else the raw assigned text, else empty."""
    return F.coalesce(either(concern, assigned_it), F.lit(""))


def haystack(*fields: Column) -> Column:
    """Lower-cased fields joined by one space; missing ones leave their blank."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))


def timestamp_text(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` without a time zone in between."""
    return F.substring(c.cast("timestamp_ntz").cast("string"), 1, 19)


def day_key(c: Column, data_type: str) -> Column:
    """``yyyy-MM-dd``; text is cut to ten characters, empty text is no day."""
    if data_type == "string":
        return truthy(F.substring(c, 1, 10))
    return c.cast("date").cast("string")


def sort_date(date: Column, as_of: str) -> Column:
    """The date, with undated tickets at ``as_of``."""
    return F.coalesce(date, F.lit(as_of).cast("timestamp_ntz"))


def jo_number(c: Column) -> Column:
    """The number of a well-formed job order, else NULL."""
    return F.when(c.rlike(JO_PATTERN), F.substr(c, F.lit(4)).try_cast("bigint"))


def jo_format(n: Column) -> Column:
    """``jo-`` and at least four digits."""
    return F.format_string("jo-%04d", n.cast("bigint"))


def labor_fee(c: Column) -> Column:
    """A fee from text; what is not a number, or out of range, is NULL."""
    return truthy(c).try_cast("decimal(10,2)")


def fee_out_of_range(c: Column) -> Column:
    """Whether a text is a number that no fee can be."""
    return F.coalesce(F.abs(truthy(c).try_cast("double")) < float("inf"), F.lit(False)) & labor_fee(c).isNull()
