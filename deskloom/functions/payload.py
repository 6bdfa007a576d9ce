"""JSON payloads of audit events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A quoted text with backslash escapes, or a run without quotes.
_TOKEN = r"""('(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|[^'"]++)"""
# An escape, whose backslash is thereby not one of another escape, or a run without backslashes.
_ESCAPE = r"(?s)(\\x[0-9a-fA-F]{2}|\\U[0-9a-fA-F]{8}|\\.|[^\\]++|\\)"


def pretty_json(c: Column) -> Column:
    """One-line JSON with sorted keys; NULL is an empty object, broken JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c, F.lit("{}"))


def _hex4(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.hex(code), 4, F.lit("0")))


def _json_escapes(text: Column) -> Column:
    """A printed text whose two- and eight-digit escapes are written as JSON has them."""

    def escape(e: Column) -> Column:
        above = F.conv(F.substring(e, 3, 8), 16, 10).cast("bigint") - 0x10000
        pair = F.concat(_hex4(F.shiftright(above, 10) + 0xD800), _hex4(above.bitwiseAND(0x3FF) + 0xDC00))
        return (
            F.when(e.startswith("\\x") & (F.length(e) == 4), F.concat(F.lit("\\u00"), F.substring(e, 3, 2)))
            .when(e.startswith("\\U") & (F.length(e) == 10), pair)
            .otherwise(e)
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_ESCAPE), F.lit(1)), escape), "")


def dict_to_json(c: Column) -> Column:
    """A printed Python dict as text that a lenient JSON reader takes.

    Constants are only replaced outside quoted texts.
    """

    def token(t: Column) -> Column:
        bare = F.replace(t, F.lit("None"), F.lit("null"))
        bare = F.replace(bare, F.lit("True"), F.lit("true"))
        bare = F.replace(bare, F.lit("False"), F.lit("false"))
        escaped = F.contains(t, F.lit("\\x")) | F.contains(t, F.lit("\\U"))
        quoted = F.when(escaped, _json_escapes(t)).otherwise(t)
        return F.when(t.startswith("'") | t.startswith('"'), quoted).otherwise(bare)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(1)), token), "")


# Options for from_json on such text.
DICT_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
