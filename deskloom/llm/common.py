"""Shared pieces of the training-data operators.

Conventions of all operators here: the id and text columns are named by parameters, a null text
counts as empty, and other columns are ignored unless an operator says that it returns them, so
their names cannot clash with anything.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import deskloom
from deskloom.session import pin  # noqa: F401

#: Most rows of a broadcast table whose size depends on the data.
MOST_BROADCAST = 500_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    return F.coalesce(col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, as SQL's ``translate`` does; other letters stay."""
    return F.translate(text, _UPPER, _UPPER.lower())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if it has at most so many rows.

    Beyond that it is left as it is, and Spark joins it by a shuffle.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it.

    That suffices for local sessions and shared installs; elsewhere pass it with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(deskloom.__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
