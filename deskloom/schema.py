"""Canonical tables, column aliases and fixed names."""

from __future__ import annotations

from pyspark.sql import types as T

TICKET_SCHEMA = T.StructType(
    [
        T.StructField("ticket_no", T.LongType(), False),
        T.StructField("store_name", T.StringType()),
        T.StructField("contact_number", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("assigned_it", T.StringType()),
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("email", T.StringType()),
        T.StructField("concern", T.StringType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("remedy", T.StringType()),
        T.StructField("job_order", T.StringType()),
        T.StructField("service_done", T.StringType()),
        T.StructField("labor_fee", T.DecimalType(10, 2)),
    ]
)

USER_SCHEMA = T.StructType(
    [
        T.StructField("idusers", T.IntegerType(), False),
        T.StructField("email", T.StringType(), False),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("is_active", T.StringType()),
    ]
)

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("action", T.StringType(), False),
        T.StructField("user_id", T.IntegerType()),
        T.StructField("user_email", T.StringType()),
        T.StructField("user_role", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)

# Column aliases in priority order.
KEY_ALIASES = ("ticket_no", "id")
CONCERN_ALIASES = ("reported_concern", "reportedConcern", "concern", "details", "description")
ALIASES = {
    "store_name": ("store_name", "Name"),
    "contact_number": ("contact_number",),
    "email": ("email", "Email"),
    "subject": ("subject", "Concern", "concern"),
    "job_order": ("job_order", "remedy"),
    "concern": CONCERN_ALIASES,
    "assigned_it": ("assigned_it",),
    "status": ("status", "Status"),
    "date": ("date", "created_at"),
    "service_done": ("service_done",),
    "labor_fee": ("labor_fee",),
}

# Columns added to older ticket tables.
ADDED_COLUMNS = {
    "job_order": "string",
    "service_done": "string",
    "labor_fee": "decimal(10,2)",
}

# Declared widths of the ticket table's text columns.
WIDTHS = {
    "store_name": 45,
    "contact_number": 45,
    "subject": 45,
    "assigned_it": 255,
    "email": 255,
    "concern": 255,
    "status": 50,
}

# Tables and columns that have to exist.
REQUIRED_TABLES = ("entries", "users")
CRITICAL_COLUMNS = ("job_order", "service_done", "labor_fee")

# Upload columns.
UPLOAD_REQUIRED = ("store_name", "subject", "reported_concern")
UPLOAD_COLUMNS = (
    "store_name",
    "contact_number",
    "email",
    "subject",
    "reported_concern",
    "assigned_to",
    "status",
)

# Workbook headers (stripped, lower case) that do not follow the
# "spaces become underscores" rule.
HEADER_EXCEPTIONS = {"concern": "reported_concern"}

# Columns that come first in an export, and the one title that is not plain title case.
EXPORT_ORDER = (
    "ticket_no",
    "job_order",
    "store_name",
    "contact_number",
    "email",
    "subject",
    "concern",
    "reported_concern",
    "service_done",
    "labor_fee",
    "assigned_it",
    "assigned_to",
    "status",
    "date",
    "date_completed",
    "created_at",
    "remedy",
)
EXPORT_TITLES = {"assigned_it": "Assigned IT"}
EXPORT_DATES = ("date", "date_completed", "created_at")
