"""The legacy multi-line block kept in ``assigned_it``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskloom.functions.text import SPACES, truthy


def _value(c: Column, label: str, ignore_case: bool = True) -> Column:
    """Text after ``label`` on the first line that starts with it, stripped; NULL without one.

    Most texts hold no such label, which a plain search settles.
    """
    spaces = "".join(f"\\x{{{ord(ch):x}}}" for ch in SPACES if ch != "\n")
    flags = "(?imd)" if ignore_case else "(?md)"  # d: only \n ends a line
    line = F.regexp_extract(c, f"{flags}^[{spaces}]*{label}[^\n]*", 0)
    searched = F.lower(c) if ignore_case else c
    after = F.btrim(F.substr(line, F.locate(":", line) + 1), F.lit(SPACES))
    labelled = F.contains(c, F.lit(":")) & F.contains(searched, F.lit(label))
    return F.when(labelled & (line != ""), after)


def legacy_concern(c: Column) -> Column:
    return _value(c, "reported concern:")


def legacy_contact(c: Column) -> Column:
    return _value(c, "Contact:", ignore_case=False)


def assigned_to(c: Column) -> Column:
    """The ``Assigned to:`` line, else the whole text."""
    return F.coalesce(truthy(_value(c, "assigned to:")), truthy(c))


def pack_legacy(
    contact: Column, concern: Column, assignee: Column, email: Column | None = None
) -> Column:
    """The block for tables without a concern column; empty parts are left out."""

    def labelled(label: str, c: Column) -> Column:
        return F.concat(F.lit(label), truthy(c))

    parts = [labelled("Email: ", email)] if email is not None else []
    parts += [
        labelled("Contact: ", contact),
        F.concat(F.lit("Reported concern: "), F.coalesce(concern, F.lit(""))),
        labelled("Assigned to: ", assignee),
    ]
    return F.concat_ws("\n", *parts)
