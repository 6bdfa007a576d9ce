"""Audit events: latest, counts, payloads and seeding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.functions.payload import pretty_json
from deskloom.functions.text import folded


def latest_audit(audit: DataFrame, n: int = 5) -> DataFrame:
    return audit.orderBy(F.desc_nulls_last("timestamp"), F.desc("id")).limit(n)


def audit_count(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("n"))


def audit_payload(audit: DataFrame) -> DataFrame:
    return audit.select("id", "action", pretty_json(F.col("payload")).alias("payload"))


def seed_rows(spark: SparkSession, seeds: Sequence[tuple[str, str]]) -> DataFrame:
    """Seed events from pairs of action and payload."""
    rows = [F.struct(F.lit(action).alias("action"), F.lit(payload).alias("payload")) for action, payload in seeds]
    return spark.range(1).select(F.inline(F.array(*rows)))


def seed_if_absent(seeds: DataFrame, audit: DataFrame) -> DataFrame:
    """The seeds, if the audit has no event with any of their actions, else nothing."""
    actions = seeds.select(folded(F.col("action")).alias("_seed"))
    present = audit.select("action").join(actions, folded(F.col("action")) == F.col("_seed"), "left_semi")
    return seeds.where(~present.exists())
