"""Ticket, user and audit tables."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_USER_COLUMNS = ("email", "first_name", "last_name", "role", "is_active")


def tickets(spark: SparkSession, path: str) -> DataFrame:
    """All ticket columns; readers prune what they do not use. Uploads are parts of the table."""
    return spark.read.parquet(path).drop("upload_id")


def users(spark: SparkSession, path: str) -> DataFrame:
    """Users under their public columns; password hashes are never read."""
    return select_users(spark.read.parquet(path))


def select_users(df: DataFrame) -> DataFrame:
    return df.select(df["idusers"].alias("id"), *_USER_COLUMNS)


def audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events; the payload stays text until it is parsed."""
    return spark.read.parquet(path)


def jdbc_options(
    url: str | None = None,
    host: str = "localhost",
    port: int = 3306,
    database: str | None = None,
    user: str | None = None,
    password: str | None = None,
) -> dict[str, str]:
    """Reader options from a ``mysql://user:password@host:port/database`` URL or single settings."""
    if url:
        parsed = urlparse(url)
        host, port = parsed.hostname or host, parsed.port or port
        database = parsed.path[1:] or database
        user = unquote(parsed.username) if parsed.username else user
        password = unquote(parsed.password) if parsed.password else password
    if not database:
        raise ValueError("name the database, in the URL or by itself")
    options = {"url": f"jdbc:mysql://{host}:{port}/{database}"}
    if user:
        options["user"] = user
    if password:
        options["password"] = password
    return options


def jdbc_tickets(
    spark: SparkSession,
    options: dict[str, str],
    lowest: int,
    highest: int,
    partitions: int,
    table: str = "entries",
    key: str = "ticket_no",
) -> DataFrame:
    """Tickets from the operational database, in parallel ranges of the key."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    return (
        reader.option("partitionColumn", key)
        .option("lowerBound", str(lowest))
        .option("upperBound", str(highest))
        .option("numPartitions", str(partitions))
        .load()
    )
