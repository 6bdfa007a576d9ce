"""Schema drift: aliases, missing columns, uniqueness and required tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom import schema as S
from deskloom.functions.text import either, folded


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def data_type(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def key_column(df: DataFrame) -> str:
    """The ticket key: ``ticket_no``, else ``id``."""
    for name in S.KEY_ALIASES:
        if name in df.columns:
            return name
    raise ValueError(f"no key column among {df.columns}")


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def _first(df: DataFrame, names: list[str], as_type: str) -> Column:
    """First usable value among the columns ``names``; text skips the empty text."""
    if not names:
        return F.lit(None).cast(as_type)
    types = {data_type(df, n) for n in names}
    if as_type == "string":
        return either(*[quoted(n).cast("string") for n in names])
    if as_type == "timestamp_ntz":
        if types == {"string"}:
            return either(*[quoted(n) for n in names])
        if len(types) == 1:
            return F.coalesce(*[quoted(n) for n in names])
        return F.coalesce(*[quoted(n).try_cast(as_type) for n in names])
    return F.coalesce(*[quoted(n).try_cast(as_type) for n in names])


_TYPES = {"date": "timestamp_ntz", "labor_fee": "decimal(10,2)"}


def read_field(df: DataFrame, field: str) -> Column:
    """The value of a canonical field from whichever alias columns ``df`` has."""
    return _first(df, present(df, S.ALIASES[field]), _TYPES.get(field, "string"))


def concern_expr(df: DataFrame) -> Column:
    """Reported concern on read: the first alias column with a value."""
    return read_field(df, "concern")


def write_column(df: DataFrame, field: str) -> str | None:
    """The column a field is written to: the first alias present."""
    names = present(df, S.ALIASES[field])
    return names[0] if names else None


def _unambiguous(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under positional names, for columns that differ in case only."""
    slots = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*slots), dict(zip(df.columns, slots))


def canonicalize(df: DataFrame) -> DataFrame:
    """The canonical ticket columns out of any known layout."""
    key = key_column(df)
    flat, slots = _unambiguous(df)

    def names(field: str) -> list[str]:
        return [slots[n] for n in present(df, S.ALIASES[field])]

    return flat.select(
        F.col(slots[key]).alias("ticket_no"),
        *[_first(flat, names(f), _TYPES.get(f, "string")).alias(f) for f in S.ALIASES],
    )


def evolve(df: DataFrame) -> DataFrame:
    """``df`` with the later columns added where they are missing."""
    missing = {n: t for n, t in S.ADDED_COLUMNS.items() if n not in df.columns}
    return df.withColumns({n: F.lit(None).cast(t) for n, t in missing.items()})


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` on more than one row, by folded comparison; NULLs are exempt.

    Exact spellings are counted first, so a value on very many rows shrinks before any shuffle
    and the collated grouping only sees distinct spellings.
    """
    c = quoted(column)
    spelled = df.where(c.isNotNull()).groupBy(c.alias(column)).agg(F.count("*").alias("n"))
    return (
        spelled.groupBy(folded(F.col(column)).alias("_key"))
        .agg(F.min(column).alias(column), F.sum("n").alias("n"))
        .where("n > 1")
        .select(column, "n")
    )


def normalize_headers(df: DataFrame) -> DataFrame:
    """Workbook headers as field names."""
    return df.toDF(*[header_field(n) for n in df.columns])


def header_field(header: str) -> str:
    name = header.strip().lower()
    return S.HEADER_EXCEPTIONS.get(name, name.replace(" ", "_"))


def check_schema(spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Required tables and critical ticket columns as rows of (name, present).

    Looks at the session's catalog, or at ``tables`` when given.
    """

    def find(name: str) -> DataFrame | None:
        if tables is not None:
            return tables.get(name)
        return spark.table(name) if spark.catalog.tableExists(name) else None

    found = {name: find(name) for name in S.REQUIRED_TABLES}
    entries = found["entries"]
    columns = entries.columns if entries is not None else []
    rows = [(n, df is not None) for n, df in found.items()]
    rows += [(f"entries.{c}", c in columns) for c in S.CRITICAL_COLUMNS]
    return spark.createDataFrame(rows, "name string, present boolean")
