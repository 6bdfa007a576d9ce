"""CSV export of tickets: column order, titles, formatted values and file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deskloom import schema as S
from deskloom.functions.tickets import timestamp_text
from deskloom.operators.filters import filter_tickets
from deskloom.operators.reports import latest_first
from deskloom.operators.schema_ops import quoted


def export_order(columns: list[str]) -> list[str]:
    """Preferred columns first, the others behind in their own order."""
    first = [c for c in S.EXPORT_ORDER if c in columns]
    return first + [c for c in columns if c not in S.EXPORT_ORDER]


def export_title(column: str) -> str:
    return S.EXPORT_TITLES.get(column, column.replace("_", " ").title())


def export_values(df: DataFrame) -> DataFrame:
    """All values as text: no value as empty, dates to the second, fees with two decimals."""

    def text(name: str, kind: str):
        c = quoted(name)
        if name in S.EXPORT_DATES and kind in ("timestamp", "timestamp_ntz"):
            c = timestamp_text(c)
        elif name == "labor_fee" and kind != "string":
            c = c.cast("decimal(38,2)")
        elif name == "labor_fee":
            c = F.coalesce(c.try_cast("decimal(38,2)").cast("string"), c)
        return F.coalesce(c.cast("string"), F.lit("")).alias(name)

    return df.select(*[text(name, kind) for name, kind in df.dtypes])


def export_columns(df: DataFrame) -> DataFrame:
    """Columns in export order under their titles."""
    return df.select(*[quoted(c).alias(export_title(c)) for c in export_order(df.columns)])


def export_rows(df: DataFrame, day: str = "", status: str = "", store: str = "") -> DataFrame:
    """What an export holds: the matching tickets, newest first, formatted."""
    return export_columns(export_values(latest_first(filter_tickets(df, day, status, store))))


def export_name(day: str = "", status: str = "", store: str = "") -> str:
    """Name of an export, with its filters."""
    status, store = status.strip(), store.strip()
    parts = ["tickets"]
    if day:
        parts.append(day)
    if status:
        parts.append(f"status-{status}")
    if store:
        parts.append(f"store-{store.lower().replace(' ', '-')}")
    if len(parts) == 1:
        parts.append("all")
    return "-".join(parts)


def _chosen(df: DataFrame, folder: str, day: str, status: str, store: str, everything: bool) -> tuple[DataFrame, str]:
    """The rows of an export and its path."""
    if everything:
        day = status = store = ""
    elif not (day or status.strip() or store.strip()):
        raise ValueError("nothing to export: give a filter or ask for everything")
    path = f"{folder.rstrip('/')}/{export_name(day, status, store)}"
    return export_rows(df, day, status, store), path


_DIALECT = {
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def export_parts(
    df: DataFrame, folder: str, day: str = "", status: str = "", store: str = "", everything: bool = False
) -> DataFrame:
    """Write the export as parts that make one file, and return its manifest.

    The header is the first part alone; the parts one after the other, in the order of their names,
    are the file. The manifest has a row per part: ``part, rows, bytes, start`` (the byte of the
    file where it begins), so that a reader may fetch any stretch of a large export. An empty result
    is a header only.
    """
    rows, path = _chosen(df, folder, day, status, store, everything)
    spark = df.sparkSession
    titles = spark.range(1).select(F.array(*[F.lit(c) for c in rows.columns]).alias("t"))
    header = titles.select(F.to_csv(F.struct(*[F.get("t", F.lit(i)).alias(f"c{i}") for i in range(len(rows.columns))]), _DIALECT).alias("line"))
    # A newest-first sort is kept by the union, whose first partition is the header's.
    lines = rows.select(F.to_csv(F.struct(*[quoted(c) for c in rows.columns]), _DIALECT).alias("line"))
    header.coalesce(1).unionByName(lines).write.mode("error").option("lineSep", "\n").text(path)
    return export_manifest(spark, path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The records of an export in parts, the header among them, with the part's name and bytes."""
    return spark.read.options(**_DIALECT, multiLine="true", lineSep="\n").csv(path).select(
        "*", F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_size").alias("bytes")
    )


def export_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``part, rows, bytes, start`` of an export in parts; parts without a byte are left out."""
    parts = read_parts(spark, path).groupBy("part", "bytes").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    first = F.row_number().over(Window.orderBy("part")) == 1
    return parts.select(
        "part",
        (F.col("rows") - F.when(first, 1).otherwise(0)).alias("rows"),
        "bytes",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"),
    ).orderBy("part")


def export_csv(
    df: DataFrame, folder: str, day: str = "", status: str = "", store: str = "", everything: bool = False
) -> str:
    """Write the export below ``folder`` and return its path.

    ``everything`` ignores the filters. Part files follow the order of the rows and each starts
    with the header; an empty result is a header only.
    """
    rows, path = _chosen(df, folder, day, status, store, everything)
    rows.write.option("header", True).options(**_DIALECT).option("lineSep", "\n").mode("error").csv(path)
    return path
