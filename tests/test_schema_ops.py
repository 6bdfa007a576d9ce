"""Schema drift, filters and reports on small frames."""

import pytest
from pyspark.sql import functions as F

from deskloom.operators import filters as FI
from deskloom.operators import reports as R
from deskloom.operators import schema_ops as SO


@pytest.fixture(scope="module")
def tickets(spark):
    rows = [
        (1, "Mesa", "2026-01-02 10:00:00", "completed", "jo-0012"),
        (2, "MESA", "2026-01-02 00:00:00", "Complete", "draft"),
        (3, "Mésa", "2026-01-03 00:00:00", "COMPLETED", "Draft"),
        (4, "Mesa ", None, "ongoing", None),
        (5, None, "2026-01-01 23:59:59", "on hold", None),
        (6, "", "2026-01-05 00:00:00", "", "jo-0009"),
    ]
    df = spark.createDataFrame(rows, "ticket_no int, store_name string, date string, status string, job_order string")
    return df.withColumn("date", F.col("date").cast("timestamp_ntz"))


def keys(df, column="ticket_no"):
    return sorted(r[column] for r in df.collect())


def test_canonicalize_old_layout(spark):
    rows = [(1, "", "Uno", None, "m@x.y", "", "help", None, "jo-1", "2026-01-02")]
    names = ["id", "store_name", "Name", "email", "Email", "subject", "concern", "reported_concern", "remedy", "created_at"]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} {'int' if i == 0 else 'string'}" for i in range(10))).toDF(*names)
    row = SO.canonicalize(df).first()
    assert row["ticket_no"] == 1 and row["store_name"] == "Uno" and row["email"] == "m@x.y"
    assert row["subject"] == "help" and row["concern"] == "help" and row["job_order"] == "jo-1"
    assert row["date"] == "2026-01-02" and row["status"] is None and row["labor_fee"] is None
    assert SO.write_column(df, "concern") == "reported_concern"
    with pytest.raises(ValueError):
        SO.key_column(df.drop("id"))


def test_evolve(spark, tickets):
    grown = SO.evolve(tickets)
    assert dict(grown.dtypes)["labor_fee"] == "decimal(10,2)" and "service_done" in grown.columns
    assert SO.evolve(grown).columns == grown.columns


def test_duplicates_fold(tickets):
    assert [tuple(r) for r in SO.duplicates(tickets, "job_order").collect()] == [("Draft", 2)]


def test_check_schema(spark, tickets):
    rows = {r["name"]: r["present"] for r in SO.check_schema(spark, {"entries": tickets}).collect()}
    assert rows == {"entries": True, "users": False, "entries.job_order": True, "entries.service_done": False, "entries.labor_fee": False}
    assert not any(r["present"] for r in SO.check_schema(spark).collect())


def test_filters(tickets):
    assert keys(FI.by_day(tickets, "2026-01-02")) == [1, 2]
    for bad in ("2026-02-30", "yesterday"):
        with pytest.raises(ValueError):
            FI.filter_tickets(tickets, bad)
    assert keys(FI.by_status(tickets, "Completed")) == [1, 3]
    assert keys(FI.by_store(tickets, "%")) == [1, 2, 3, 4, 6]
    assert keys(FI.by_store(tickets, "mesa")) == [1, 2, 3, 4]
    assert keys(FI.by_store(tickets, "m_sa")) == [1, 2, 3, 4]
    assert keys(FI.filter_tickets(tickets, " ".strip(), " completed ", "  ")) == [1, 3]
    assert keys(FI.filter_tickets(tickets)) == [1, 2, 3, 4, 5, 6]
    assert keys(FI.by_label(tickets, "Complete")) == [1, 2, 3]
    assert keys(FI.by_label(tickets, "")) == [1, 2, 3, 4, 5, 6]


def test_search_keeps_blanks_of_missing_fields(tickets):
    text = {r["ticket_no"]: r["h"] for r in tickets.select("ticket_no", FI.haystack(tickets).alias("h")).collect()}
    assert text[1] == "1 mesa jo-0012  — 2026-01-02 10:00:00  — "
    assert text[4] == "4 mesa    —   — "
    assert keys(FI.search(tickets, "MESA JO-0012  —")) == [1]
    assert keys(FI.search(tickets, "")) == [1, 2, 3, 4, 5, 6]
    assert keys(FI.search(tickets, " ")) == [1, 2, 3, 4, 5, 6]


def test_exact_and_folded_stores(tickets):
    exact = {r["store_name"]: r["n"] for r in R.tickets_by_store(tickets).collect()}
    assert exact == {"Mesa": 1, "MESA": 1, "Mésa": 1, "Mesa ": 1, "Unknown store": 2}
    history = [(r["id"], r["company_name"], r["usage_count"]) for r in R.company_history(tickets).collect()]
    assert history == [(1, "MESA", 3), (2, "Mesa ", 1)]


def test_days(spark, tickets):
    days = [(r["day"], r["n"]) for r in R.tickets_by_day(tickets).collect()]
    assert days == [("2026-01-01", 1), ("2026-01-02", 2), ("2026-01-03", 1), ("2026-01-05", 1)]
    text = spark.createDataFrame([("2026-01-02T1",), ("soon",), (None,), ("",)], "date string")
    assert [tuple(r) for r in R.tickets_by_day(text).collect()] == [("2026-01-02", 1), ("soon", 1)]


def test_counts_without_status_or_rows(tickets):
    assert tuple(R.ticket_counts(tickets.drop("status")).first()) == (0, 6, 0, 6)
    empty = tickets.limit(0)
    assert sorted(tuple(r) for r in R.tickets_by_status(empty).collect()) == [("Complete", 0), ("Ongoing", 0), ("Pending", 0)]


def test_lists(tickets):
    assert [r["ticket_no"] for r in R.home_list(tickets, "2026-02-01 00:00:00").collect()] == [4, 6, 3, 1, 2, 5]
    assert [r["ticket_no"] for r in R.latest_first(tickets).collect()] == [6, 3, 1, 2, 5, 4]
    assert [r["ticket_no"] for r in R.latest_first(tickets.drop("date")).collect()] == [6, 5, 4, 3, 2, 1]
    assert [r[0] for r in R.recent_job_orders(tickets, 2).collect()] == ["jo-0012", "jo-0009"]


def test_zero_fee_is_blank_on_the_sheet(tickets):
    df = tickets.withColumn("labor_fee", F.when(F.col("ticket_no") < 3, F.col("ticket_no") - 1).cast("decimal(10,2)"))
    fees = {r["ticket_no"]: r["labor_fee"] for r in R.job_order_sheet(df).collect()}
    assert fees == {1: "", 2: "1.00", 3: "", 4: "", 5: "", 6: ""}
