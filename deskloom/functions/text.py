"""Text building blocks shared by all operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDED = "UNICODE_CI_AI"  # ignores case and accents, keeps trailing spaces significant

# Everything ``str.strip`` removes.
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def _accented() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters that decompose to a letter with marks, and that letter.

    A final sigma counts as a sigma.
    """
    marked, plain = ["ς"], ["σ"]
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isalpha():
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accented()


def strip(c: Column) -> Column:
    """``str.strip``. Trimming by a set reads every character, so only texts that need it are trimmed."""
    edge = F.substring(c, 1, 1).isin(*SPACES) | F.substring(c, -1, 1).isin(*SPACES)
    return F.when(edge, F.btrim(c, F.lit(SPACES))).otherwise(c)


def truthy(c: Column) -> Column:
    """The text, with the empty text as NULL."""
    return F.nullif(c, F.lit(""))


def either(*cols: Column) -> Column:
    """First non-empty text, else NULL."""
    return F.coalesce(*[truthy(c) for c in cols])


def clean(c: Column) -> Column:
    """Stripped text, blank as NULL."""
    return truthy(strip(c))


def folded(c: Column) -> Column:
    """The text under a case- and accent-insensitive collation, for =, GROUP BY and ORDER BY."""
    return F.collate(c, FOLDED)


def same_folded(c: Column, value: Column | str) -> Column:
    return folded(c) == folded(F.lit(value) if isinstance(value, str) else value)


def fold(c: Column) -> Column:
    """Plain lower-case text without accents, for searches inside texts. Pure ASCII is only lowered."""
    folded_text = F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}+", ""), _MARKED, _PLAIN)
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(folded_text)


def _like_pattern(text: str) -> tuple[str, bool]:
    """``text`` as a LIKE pattern with valid escapes only, and whether it has wildcards."""
    out, wild, chars = [], False, iter(text)
    for ch in chars:
        if ch == "\\":
            escaped = next(chars, "\\")
            out.append("\\" + escaped if escaped in "%_\\" else escaped)
            wild = wild or escaped in "%_\\"
        else:
            wild = wild or ch in "%_"
            out.append(ch)
    return "".join(out), wild


def literal_runs(text: str) -> list[str]:
    """The parts of a LIKE text between its wildcards, escapes resolved."""
    runs, chars = [""], iter(text)
    for ch in chars:
        if ch == "\\":
            runs[-1] += next(chars, "\\")
        elif ch in "%_":
            runs.append("")
        else:
            runs[-1] += ch
    return [r for r in runs if r]


def matches_like(c: Column, text: str) -> Column:
    """``c LIKE %text%`` without regard to case and accents; ``text`` may hold wildcards.

    Letters are compared one by one, so ß is not ss, with wildcards and without.
    """
    pattern, wild = _like_pattern(text)
    if not wild:
        return F.contains(fold(c), fold(F.lit(pattern)))
    return F.like(fold(c), fold(F.lit(f"%{pattern}%")))
