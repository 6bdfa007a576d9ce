"""Status labels, stored status values and their transitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskloom.functions.text import strip, truthy

# Known stored statuses.
COMPLETE = ("complete", "completed")
ONGOING = ("ongoing", "in progress", "in_progress")
STORABLE = ("pending", *ONGOING, *COMPLETE)
LABELS = ("Pending", "Ongoing", "Complete")


def _lowered(c: Column) -> Column:
    return F.lower(F.coalesce(truthy(c), F.lit("pending")))


def _bucket(c: Column, pending: str, ongoing: str, complete: str) -> Column:
    s = _lowered(c)
    return F.when(s.isin(*COMPLETE), complete).when(s.isin(*ONGOING), ongoing).otherwise(pending)


def status_label(c: Column) -> Column:
    """Pending, Ongoing or Complete; unknown values are Pending. Not trimmed."""
    return _bucket(c, "Pending", "Ongoing", "Complete")


def status_choice(c: Column) -> Column:
    """The option an edit form shows for a stored status."""
    return _bucket(c, "pending", "ongoing", "completed")


def status_store(c: Column) -> Column:
    """Form and CSV input as stored: trimmed, lower case, unknown values pending."""
    s = F.lower(strip(F.coalesce(truthy(c), F.lit("pending"))))
    return F.when(s.isin(*COMPLETE), "completed").when(s.isin(*STORABLE), s).otherwise("pending")


def status_store_workbook(c: Column) -> Column:
    """Workbook input as stored: lower case only; a missing value takes the column default."""
    s = _lowered(c)
    return F.when(s.isin(*COMPLETE), "completed").otherwise(s)


def date_completed(status: Column, date: Column) -> Column:
    """The ticket date when the stored status is exactly one of the complete ones."""
    return F.when(status.isin(*COMPLETE), date)


def status_transition(old: Column, new: Column) -> Column:
    """``from X to Y`` when the form's choice changed, else NULL."""
    before, after = F.initcap(status_choice(old)), F.initcap(status_choice(new))
    return F.when(before != after, F.concat(F.lit("from "), before, F.lit(" to "), after))
