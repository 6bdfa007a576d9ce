"""The ticket table in ranges of its key, so that edits and deletes rewrite what they touch only.

Ticket numbers are dense, so ranges of equal width hold about equally many rows. A batch is judged
on keys and job orders of the whole table, but texts are read and written in the touched ranges
alone; all other files stay as they are. Ranges are replaced one by one as their new rows are
complete, and edits replace values, so a batch that stopped can be run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.operators.changes import accepted_edits, edited
from deskloom.operators.schema_ops import key_column, quoted
from deskloom.session import drop, freeing, pin, scratch

#: Ticket numbers of a range.
WIDTH = 1_000_000
RANGE = "key_range"
#: The most ticket numbers that one task rewrites for a range, into one file.
SLICE = 250_000
_PLACE = [RANGE, "_slice"]


def _range_of(key: str, width: int) -> Column:
    return F.floor(quoted(key) / width).cast("bigint")


def _placed(rows: DataFrame, key: str, width: int) -> DataFrame:
    """Rows with their range, dealt out by range and slice: tables that are dealt out alike can be joined in place."""
    slices = F.floor(quoted(key) / min(width, SLICE)).cast("bigint")
    return rows.withColumns({RANGE: _range_of(key, width), "_slice": slices}).repartition(*_PLACE)


def _store(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    with freeing(rows.sparkSession, spark__sql__requireAllClusterKeysForCoPartition="false"):  # so that ``_placed`` rows stay where they are
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(path)


def write_ranged(tickets: DataFrame, path: str, width: int = WIDTH) -> None:
    """Write a new table; rows of one range meet in as many tasks as shuffle partitions allow."""
    ranged = tickets.withColumn(RANGE, _range_of(key_column(tickets), width))
    _store(ranged.repartitionByRange(RANGE, quoted(key_column(tickets))), path, "errorifexists")


def read_ranged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(RANGE)


def _touched(keys: DataFrame, key: str, width: int) -> list[int]:
    """The ranges of some keys: at most one number per range of the table."""
    return sorted(r[0] for r in keys.select(_range_of(key, width)).distinct().collect() if r[0] is not None)


def _replace(stored: DataFrame, path: str, touched: list[int], new: DataFrame) -> None:
    """Replace the touched ranges by ``new``, written once; ranges without any row left are removed.

    ``new`` comes ``_placed``, so a range is one file per slice, however many tasks there are.
    Spark puts new rows beside the table until all are complete, so ``new`` may read the table itself.
    """
    spark, before = stored.sparkSession, set(stored.inputFiles())
    _store(new, path)
    written = {f.rsplit(f"/{RANGE}=", 1)[1].split("/")[0] for f in spark.read.parquet(path).inputFiles() if f not in before}
    for number in touched:
        if str(number) not in written:
            drop(spark, f"{path}/{RANGE}={number}")


def update_ranged(spark: SparkSession, path: str, edits: DataFrame, order: list[str], width: int = WIDTH) -> list[int]:
    """Apply the last accepted edit of each ticket; the ranges that were rewritten."""
    stored = spark.read.parquet(path)
    tickets, key = stored.drop(RANGE), key_column(stored)
    with scratch(spark):
        with scratch(spark, keep=1):  # the edits and claims go before the ranges are written
            last = pin(accepted_edits(tickets, edits, order), "last-edits")
        known = last.join(tickets.select(quoted(key)), key, "left_semi")
        touched = _touched(known, key, width)
        if touched:
            part = _placed(stored.where(F.col(RANGE).isin(touched)).drop(RANGE), key, width)
            new = edited(part, _placed(last, key, width), _PLACE).drop("_slice")
            _replace(stored, path, touched, new)
    return touched


def delete_ranged(spark: SparkSession, path: str, keys: DataFrame, width: int = WIDTH) -> list[int]:
    """Remove the tickets whose key is among ``keys``; the ranges that were rewritten."""
    stored = spark.read.parquet(path)
    key = key_column(stored)
    touched = _touched(keys.join(stored.select(quoted(key)), key, "left_semi"), key, width)
    if touched:
        part = _placed(stored.where(F.col(RANGE).isin(touched)).drop(RANGE), key, width)
        gone = _placed(keys.select(quoted(key)).distinct(), key, width)
        _replace(stored, path, touched, part.join(gone, [*_PLACE, key], "left_anti").drop("_slice"))
    return touched
