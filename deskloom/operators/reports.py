"""Counts, listings and sheets over tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.functions import tickets as K
from deskloom.functions.status import LABELS, date_completed, status_label
from deskloom.functions.text import folded, truthy
from deskloom.operators.filters import filter_tickets
from deskloom.operators.numbering import with_sequence
from deskloom.operators.schema_ops import data_type, key_column, quoted, read_field, write_column

UNKNOWN_STORE = "Unknown store"


def ticket_counts(df: DataFrame) -> DataFrame:
    """Complete, pending, ongoing and all tickets: one row from one pass.

    Without a status column every ticket is pending.
    """
    label = status_label(read_field(df, "status"))
    counts = [F.count_if(label == name).alias(f"ticket_{name.lower()}") for name in LABELS]
    return df.agg(*counts, F.count("*").alias("ticket_total")).select(
        "ticket_complete", "ticket_pending", "ticket_ongoing", "ticket_total"
    )


def tickets_by_status(df: DataFrame) -> DataFrame:
    """Always exactly three rows, from the one-row counts."""
    rows = [
        F.struct(F.lit(name).alias("status"), F.col(f"ticket_{name.lower()}").alias("n"))
        for name in LABELS
    ]
    return ticket_counts(df).select(F.inline(F.array(*rows)))


def _day(df: DataFrame) -> Column:
    """The day of a ticket; typed dates stay dates, to be printed once per group."""
    column = write_column(df, "date")
    date = read_field(df, "date")
    if column is not None and data_type(df, column) == "string":
        return K.day_key(date, "string")
    return date.cast("date")


def tickets_by_day(df: DataFrame) -> DataFrame:
    days = df.select(_day(df).alias("day")).where(F.col("day").isNotNull()).groupBy("day").agg(F.count("*").alias("n"))
    return days.select(F.col("day").cast("string").alias("day"), "n").orderBy("day")


def _store(df: DataFrame) -> Column:
    return F.coalesce(read_field(df, "store_name"), F.lit(UNKNOWN_STORE))


def tickets_by_store(df: DataFrame) -> DataFrame:
    """Tickets per exact store name; missing names count as one unknown store."""
    return df.groupBy(_store(df).alias("store_name")).agg(F.count("*").alias("n"))


def top_stores(df: DataFrame, k: int = 10) -> DataFrame:
    """The stores with most tickets; ties by name."""
    return tickets_by_store(df).orderBy(F.desc("n"), "store_name").limit(k)


def dashboard_series(df: DataFrame) -> DataFrame:
    """The three dashboard series as (series, key, n), from one pass over the tickets.

    A row of weight 0 per status keeps all of them in the result.
    """
    points = df.select(
        status_label(read_field(df, "status")).alias("label"), _day(df).alias("day"), _store(df).alias("store"), F.lit(1).alias("n")
    )
    labels = df.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(name) for name in LABELS])).alias("label"), F.lit(0).alias("n"))
    sets = [[F.col("label")], [F.col("day")], [F.col("store")]]
    counted = points.unionByName(labels, allowMissingColumns=True).groupingSets(sets, "label", "day", "store").agg(
        F.grouping("label").alias("_label"), F.grouping("day").alias("_day"), F.sum("n").alias("n")
    )
    series = F.when(F.col("_label") == 0, "status_counts").when(F.col("_day") == 0, "tickets_by_date").otherwise("tickets_by_store")
    key = F.coalesce("label", F.col("day").cast("string"), "store")
    return counted.select(series.alias("series"), key.alias("key"), "n").where(F.col("key").isNotNull())


def dashboard_json(df: DataFrame) -> DataFrame:
    """JSON lines for the charts, one point each, sorted by series and key.

    The store series grows with the data, so it is never packed into one document.
    """
    points = dashboard_series(df)
    line = F.to_json(F.struct("series", "key", "n")).alias("json")
    return points.orderBy("series", "key").select(line)


def company_history(df: DataFrame) -> DataFrame:
    """Stores by folded name: count and latest date, numbered by count and date.

    Exact spellings are counted first (hash aggregation, shrinks hot stores before the shuffle);
    only distinct spellings reach the collated grouping.
    """
    store = read_field(df, "store_name")
    spelled = (
        df.select(store.alias("name"), read_field(df, "date").alias("date"))
        .where(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.count("*").alias("n"), F.max("date").alias("latest"))
    )
    history = spelled.groupBy(folded(F.col("name")).alias("_key")).agg(
        F.min("name").alias("company_name"),
        F.sum("n").alias("usage_count"),
        F.max("latest").alias("last_used"),
    )
    order = [F.desc("usage_count"), F.desc_nulls_last("last_used"), F.asc("company_name")]
    numbered = with_sequence(history.drop("_key"), order, "id")
    return numbered.select("id", "company_name", "usage_count", "last_used").orderBy("id")


def ticket_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("ticket_total"))


def match_count(df: DataFrame, day: str = "", status: str = "", store: str = "") -> DataFrame:
    return filter_tickets(df, day, status, store).agg(F.count("*").alias("n"))


def home_list(df: DataFrame, as_of: str) -> DataFrame:
    """All tickets, newest first, undated ones at ``as_of``; equal dates by ticket number.

    The ticket number also splits a range of very many equal dates.
    """
    dated = df.withColumn("sort_date", K.sort_date(F.col("date"), as_of))
    return dated.orderBy(F.desc("sort_date"), F.desc(key_column(df)))


def latest_first(df: DataFrame) -> DataFrame:
    """By date, newest first; by ticket number where there is no date column."""
    key = quoted(key_column(df))
    if "date" not in df.columns:
        return df.orderBy(key.desc())
    return df.orderBy(F.desc_nulls_last("date"), key.desc())


def recent_job_orders(df: DataFrame, k: int = 10) -> DataFrame:
    """The highest job orders as text."""
    jo = df.where(F.col("job_order").isNotNull()).select("job_order")
    return jo.orderBy(folded(F.col("job_order")).desc(), F.desc("job_order")).limit(k)


def ticket_list(df: DataFrame) -> DataFrame:
    """One display row per ticket, as in the ticket list."""
    assigned = read_field(df, "assigned_it")
    email, contact = read_field(df, "email"), read_field(df, "contact_number")
    status, date = read_field(df, "status"), read_field(df, "date")
    stored = quoted("status") if "status" in df.columns else F.lit(None).cast("string")
    return df.select(
        quoted(key_column(df)).alias("ticket_no"),
        _dashed(read_field(df, "store_name")).alias("store_name"),
        K.contact_line(email, contact, assigned).alias("contact_line"),
        K.display_contact(contact, assigned).alias("contact"),
        _dashed(read_field(df, "job_order")).alias("job_order"),
        _dashed(read_field(df, "subject")).alias("subject"),
        K.display_assignee(assigned, email).alias("assignee"),
        status_label(status).alias("status_label"),
        date.alias("date"),
        date_completed(stored, date).alias("date_completed"),
        K.ticket_concern(read_field(df, "concern"), assigned).alias("concern"),
    )


def _dashed(c: Column) -> Column:
    return F.coalesce(truthy(c), F.lit(K.DASH))


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def job_order_sheet(df: DataFrame) -> DataFrame:
    """The fields of the printed job order, one row per ticket; a zero fee is blank."""
    assigned, email = read_field(df, "assigned_it"), read_field(df, "email")
    concern = K.reported_concern(read_field(df, "concern"), assigned)
    subject = read_field(df, "subject")
    fee = F.nullif(read_field(df, "labor_fee"), F.lit(0).cast("decimal(10,2)"))
    return df.select(
        quoted(key_column(df)).alias("ticket_no"),
        _blank(read_field(df, "store_name")).alias("store_name"),
        _blank(read_field(df, "contact_number")).alias("contact_number"),
        _blank(email).alias("email"),
        _blank(subject).alias("subject"),
        _blank(read_field(df, "job_order")).alias("job_order"),
        read_field(df, "date").alias("date"),
        status_label(read_field(df, "status")).alias("status_label"),
        concern.alias("reported_concern"),
        K.sheet_assignee(assigned, email).alias("assigned_to"),
        _blank(read_field(df, "service_done")).alias("service_done"),
        _blank(fee.cast("string")).alias("labor_fee"),
        F.coalesce(subject, concern).alias("service_reported"),
    )
