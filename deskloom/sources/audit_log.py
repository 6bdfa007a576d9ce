"""Audit log text: ``time,ms [LEVEL] action | {dict}`` and free-text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.functions.payload import DICT_OPTIONS, dict_to_json

# What stands before the message, and the action before a printed dict.
_HEAD = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3} \[\w+\] "
_ACTION = r"^\w+(?= \| \{)"

# Keys of the logged dicts. In ``ticket_created`` the email is the ticket's.
_BASE = "user_id bigint, email string, role string, ip string, ua string"
_TICKET = "store_name string, subject string, job_order string, contact_number string, status string"
_CHANGES = ", ".join(
    f"{side}_{name} string"
    for name in ("store_name", "subject", "job_order", "status", "contact_number", "email")
    for side in ("old", "new")
)
DETAIL_SCHEMA = (
    f"{_BASE}, {_TICKET}, assigned_to string, ticket_pk bigint, ticket_id bigint, {_CHANGES}, "
    "old_assigned_it string, new_assigned_to string, "
    "target_user_id bigint, new_role string, is_active boolean, updated_fields array<string>"
)


def parse_audit_lines(lines: DataFrame) -> DataFrame:
    """One row per line of column ``value``; what is not there or not readable is NULL."""

    headed = lines.select("value", F.regexp_extract("value", _HEAD, 0).alias("head"))
    size = F.length("head")
    split = headed.select(
        F.replace(F.substring("head", 1, 23), F.lit(","), F.lit(".")).try_cast("timestamp_ntz").alias("timestamp"),
        # The level stands between "… [" and "] ".
        F.when(size > 0, F.substr("head", F.lit(26), size - 27)).alias("level"),
        F.substr("value", size + 1).alias("message"),
    )
    named = split.withColumn("action", F.regexp_extract("message", _ACTION, 0))
    is_event = (F.col("action") != "") & F.rtrim("message").endswith("}")
    printed = F.substr("message", F.length("action") + 4)
    events = named.withColumns(
        {
            "action": F.when(is_event, F.col("action")),
            "payload": F.when(is_event, dict_to_json(printed)),
        }
    )
    detail = F.from_json("payload", DETAIL_SCHEMA, DICT_OPTIONS)
    return events.withColumn("detail", detail).select(
        "timestamp",
        "level",
        "action",
        F.when(F.col("action").isNull(), F.col("message")).alias("message"),
        "detail.*",
    )


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_audit_lines(spark.read.text(path))
