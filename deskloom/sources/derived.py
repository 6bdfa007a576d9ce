"""Ticket data derived from the order tables.

Every expression runs in Spark SQL and in ANSI SQL, so a check can build the same rows. Each view
has one output row per input row of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.schema import UPLOAD_COLUMNS

_K = "o_orderkey"


def _e(text: str) -> str:
    return text.replace("$k", _K)


TICKETS = {
    "ticket_no": _e("cast($k + 1 as bigint)"),
    "store_name": _e(
        "case when $k % 41 = 0 then null when $k % 43 = 0 then '' "
        "when $k % 5 = 0 then upper(c_name) else c_name end"
    ),
    "contact_number": _e(
        "case when $k % 3 = 0 then null else concat('09', lpad(cast(o_custkey as string), 9, '0')) end"
    ),
    "subject": _e("case when $k % 17 = 0 then null else o_orderpriority end"),
    "assigned_it": _e(
        "case when $k % 6 = 0 then concat('Email: c', cast(o_custkey as string), '@example.com', chr(10), "
        "'Contact: 09', lpad(cast(o_custkey as string), 9, '0'), chr(10), "
        "'Reported concern: Issue ', cast($k as string), chr(10), "
        "'Assigned to: Technician ', cast($k % 5 as string)) "
        "when $k % 7 = 0 then null else concat('Technician ', cast($k % 5 as string)) end"
    ),
    "date": _e("case when $k % 37 = 0 then null else o_orderdate end"),
    "email": _e(
        "case when $k % 4 = 0 then null else concat('c', cast(o_custkey as string), '@example.com') end"
    ),
    "concern": _e("case when $k % 6 = 0 then null else concat('Issue ', cast($k as string)) end"),
    "status": _e(
        "case when o_orderstatus = 'F' and $k % 2 = 0 then 'completed' "
        "when o_orderstatus = 'F' then 'Complete' "
        "when o_orderstatus = 'P' and $k % 3 = 0 then 'ongoing' "
        "when o_orderstatus = 'P' and $k % 3 = 1 then 'in progress' "
        "when o_orderstatus = 'P' then 'IN_PROGRESS' "
        "when $k % 19 = 0 then '' when $k % 23 = 0 then 'on hold' else 'pending' end"
    ),
    "remedy": "cast(null as string)",
    "job_order": _e(
        "case when $k % 11 = 0 then null when $k % 13 = 0 then 'draft' "
        "else concat('jo-', lpad(cast($k + 1 as string), "
        "cast(greatest(4, length(cast($k + 1 as string))) as int), '0')) end"
    ),
    "service_done": "case when o_orderstatus = 'F' then 'Serviced' else null end",
    "labor_fee": "case when o_orderstatus = 'F' then cast(o_totalprice as decimal(10, 2)) else null end",
}

USERS = {
    "id": "cast(s_suppkey + 1 as int)",
    "email": "lower(concat(replace(s_name, '#', ''), '@example.com'))",
    "first_name": "concat('F', cast(s_nationkey as string))",
    "last_name": "s_name",
    "role": (
        "case when s_suppkey % 10 = 0 then 'super_admin' "
        "when s_suppkey % 3 = 0 then 'admin' else 'end_user' end"
    ),
    "is_active": (
        "case when s_suppkey % 5 = 0 then '0' when s_suppkey % 5 = 1 then '1' "
        "when s_suppkey % 5 = 2 then 'TRUE' when s_suppkey % 5 = 3 then ' yes ' else 'no' end"
    ),
}

AUDIT = {
    "id": "event_id",
    "timestamp": "ts",
    "action": "event_type",
    "user_id": "user_id",
    "payload": "props",
}

# One printed log line per event, with the quoting the log writer uses. The texts hold constants
# and apostrophes that must survive parsing.
AUDIT_LINES = {
    "value": (
        "concat(substr(cast(ts as string), 1, 19), ',', lpad(cast(event_id % 1000 as string), 3, '0'), "
        "' [INFO] ', event_type, ' | ', replace(concat("
        "'{~user_id~: ', cast(user_id as string), "
        "', ~email~: ', case when user_id % 7 = 0 then 'None' "
        "else concat('~u', cast(user_id as string), '@example.com~') end, "
        "', ~role~: \"O~Brien, None\", ~ip~: ~10.0.0.', cast(user_id % 250 as string), "
        "'~, ~ua~: ~agent [None, True]~, ~is_active~: ', "
        "case when user_id % 2 = 0 then 'True' else 'False' end, "
        "', ~updated_fields~: [~names~, ~', event_type, '~]}'), '~', chr(39)))"
    ),
}

# One uploaded row per order, as text.
UPLOADS = {
    "file": "concat('batch-', cast(c_nationkey as string), '.csv')",
    "row_num": _e("cast($k + 2 as bigint)"),
    "store_name": _e(
        "case when $k % 29 = 0 then '   ' when $k % 31 = 0 then rpad(c_name, 60, 'x') "
        "else concat(' ', c_name, ' ') end"
    ),
    "contact_number": _e(
        "case when $k % 3 = 0 then ' ' else concat('09', lpad(cast(o_custkey as string), 9, '0')) end"
    ),
    "email": _e(
        "case when $k % 4 = 0 then null else concat('c', cast(o_custkey as string), '@example.com') end"
    ),
    "subject": _e("case when $k % 17 = 0 then '' else o_orderpriority end"),
    "reported_concern": _e(
        "case when $k % 53 = 0 then null when $k % 59 = 0 then rpad('Issue', 10000, '!') "
        "else concat('Issue ', cast($k as string)) end"
    ),
    "assigned_to": _e("case when $k % 7 = 0 then '' else concat('Technician ', cast($k % 5 as string)) end"),
    "status": _e(
        "case when o_orderstatus = 'F' then ' Complete ' when o_orderstatus = 'P' then 'In Progress' "
        "when $k % 19 = 0 then null when $k % 23 = 0 then 'weird' else 'pending' end"
    ),
}

# Workbook rows, in small files, with statuses and fees that no ticket can have.
WORKBOOK = {
    **UPLOADS,
    "file": "concat('book-', cast(o_custkey as string), '.xlsx')",
    "status": _e("case when $k % 101 = 0 then rpad('s', 60, 's') when $k % 19 = 0 then '' else ' On Hold' end"),
    "labor_fee": _e(
        "case when $k % 103 = 0 then '999999999999' when $k % 5 = 0 then 'free' when $k % 7 = 0 then '' "
        "else concat(cast($k % 300 as string), '.5') end"
    ),
    "error": "cast(null as string)",
}

# Text of uploaded files, one file per nation and one record per order. Some records span two
# lines, some are short, some have an extra cell, one of them of twenty thousand characters over a
# hundred lines, some a quote inside plain text, some a blank line behind them.
UPLOAD_TEXT = {
    "file": "concat('batch-', cast(c_nationkey as string), '.csv')",
    "k": _K,
    "text": _e(
        "case when $k % 29 = 0 then concat(c_name, ',09', cast(o_custkey as string)) "
        "when $k % 31 = 0 then concat('\"', c_name, ', \"\"north\"\"\",,c', cast(o_custkey as string), "
        "'@example.com,', o_orderpriority, ',\"Issue, ', chr(10), 'line two ', cast($k as string), '\",Ann,weird') "
        "when $k % 13 = 0 then concat(c_name, ' 5\" screen,0917,,', o_orderpriority, ',Issue ', "
        "cast($k as string), ',,Complete,extra') "
        "when $k % 11 = 0 then concat(c_name, ',,,', o_orderpriority, ',Issue ', cast($k as string), ',Ann,', chr(10)) "
        "when $k % 101 = 0 then concat(c_name, ',0917,,', o_orderpriority, ',Issue ', cast($k as string), "
        "',Ann,ongoing,\"', repeat(concat(rpad('note, ', 200, '.'), chr(10)), 100), '\"') "
        "else concat(c_name, ',0917,,', o_orderpriority, ',Issue ', cast($k as string), ',Ann,ongoing') end"
    ),
}

# One edit per order line, of the order's ticket.
EDITS = {
    "ticket_no": "cast(l_orderkey + 1 as bigint)",
    "seq": "l_linenumber * 100000000 + l_partkey",
    "seq2": "l_extendedprice",
    "store_name": "case when l_quantity > 45 then ' ' else concat('Store ', cast(l_suppkey as string)) end",
    "contact_number": "case when l_returnflag = 'A' then '' else concat('09', cast(l_partkey as string)) end",
    "email": "case when l_returnflag = 'R' then null else concat('s', cast(l_suppkey as string), '@example.com') end",
    "subject": "case when l_linenumber = 7 then rpad('Printer', 50, '!') else 'Printer' end",
    "job_order": (
        "case when l_partkey % 10 = 0 then concat(' jo-', cast(l_orderkey as string), ' ') "
        "when l_partkey % 10 = 1 then concat('SHARED-', cast(l_suppkey as string)) "
        "when l_partkey % 10 = 2 then concat('shared-', cast(l_suppkey as string)) "
        "else concat(' jo-9', lpad(cast(l_orderkey as string), 9, '0'), ' ') end"
    ),
    "reported_concern": "concat('Part ', cast(l_partkey as string))",
    "assigned_to": "concat('Technician ', cast(l_linenumber as string))",
    "status": (
        "case when l_linestatus = 'F' then ' Complete ' when l_returnflag = 'A' then 'In Progress' "
        "when l_returnflag = 'N' then 'lost' else '' end"
    ),
    "service_done": "case when l_linestatus = 'F' then 'Replaced' else '' end",
    "labor_fee": (
        "case when l_discount > 0.05 then '' when l_tax > 0.07 then 'free' "
        "else concat(cast(l_linenumber as string), '.50') end"
    ),
}

# Keys of tickets to delete: orders with a returned line.
DELETES = {"ticket_no": "cast(l_orderkey + 1 as bigint)"}
DELETES_WHERE = "l_returnflag = 'R'"

# One requested account per customer; some emails exist already, some repeat.
CANDIDATES = {
    "row_num": "c_custkey",
    "actor_role": "case when c_custkey % 3 = 0 then 'admin' else 'super_admin' end",
    "first_name": "case when c_custkey % 13 = 0 then ' ' else concat(' C', cast(c_nationkey as string)) end",
    "last_name": "c_name",
    "email": (
        "case when c_custkey % 4 = 0 then concat(' SUPPLIER', lpad(cast(c_custkey as string), 9, '0'), '@Example.com') "
        "else concat('User', cast(cast(floor(c_custkey / 3) as bigint) as string), '@example.com ') end"
    ),
    "role": (
        "case when c_custkey % 5 = 0 then ' ADMIN' when c_custkey % 7 = 0 then 'manager' "
        "when c_custkey % 11 = 0 then 'super_admin' else 'end_user' end"
    ),
}

# One account edit per order line, of the line's supplier.
USER_EDITS = {
    "id": "cast(l_suppkey + 1 as int)",
    "seq": "l_orderkey * 10 + l_linenumber",
    "seq2": "l_extendedprice",
    "actor_role": "case when l_returnflag = 'A' then 'admin' else 'super_admin' end",
    "first_name": "case when l_quantity > 48 then '' else concat('E', cast(l_linenumber as string)) end",
    "last_name": "concat('L', cast(l_partkey as string))",
    "role": "case when l_returnflag = 'R' then 'boss' when l_linestatus = 'O' then 'Admin' else 'end_user' end",
    "is_active": "case when l_linestatus = 'O' then '1' else '0' end",
}

# One delete request per supplier.
USER_DELETES = {
    "seq": "s_suppkey",
    "actor_id": "cast(s_suppkey + 1 as int)",
    "target_id": "cast(s_nationkey + 1 as int)",
}

VIEWS = {
    "tickets": (TICKETS, "orders join customer on o_custkey = c_custkey"),
    "users": (USERS, "supplier"),
    "audit": (AUDIT, "events"),
    "audit_lines": (AUDIT_LINES, "events"),
    "uploads": (UPLOADS, "orders join customer on o_custkey = c_custkey"),
    "upload_text": (UPLOAD_TEXT, "orders join customer on o_custkey = c_custkey"),
    "workbook": (WORKBOOK, "orders join customer on o_custkey = c_custkey"),
    "edits": (EDITS, "lineitem"),
    "deletes": (DELETES, f"lineitem where {DELETES_WHERE}"),
    "candidates": (CANDIDATES, "customer"),
    "user_edits": (USER_EDITS, "lineitem"),
    "user_deletes": (USER_DELETES, "supplier"),
}


def view_sql(name: str) -> str:
    """The view as one SELECT over the order tables."""
    columns, source = VIEWS[name]
    return f"select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {source}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; only the columns a query uses are read."""
    columns, source = VIEWS[name]
    source, _, where = source.partition(" where ")
    if " join " in source:
        orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
        df = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    else:
        df = _table(spark, sf_dir, source)
    if where:
        df = df.where(where)
    return df.selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def upload_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of ``upload_text`` as numbered lines, with a header line per file.

    Block borders fall inside records too. Each file ends in a record whose quote is not closed.
    The last nation's header lacks columns.
    """
    text = view(spark, sf_dir, "upload_text")
    lines = text.select("file", "k", F.posexplode(F.split("text", "\n")).alias("i", "value"))
    block = F.floor((F.col("k") * 4 + F.least("i", F.lit(3))) / 63)
    body = lines.select("file", block.alias("block"), (F.col("k") * 1000 + F.col("i")).alias("pos"), "value")
    file = F.concat(F.lit("batch-"), F.col("n_nationkey").cast("string"), F.lit(".csv")).alias("file")
    nations = _table(spark, sf_dir, "nation")
    header = nations.select(
        file,
        F.lit(-1).cast("bigint").alias("block"),
        F.lit(-1).cast("bigint").alias("pos"),
        F.when(F.col("n_nationkey") == 24, "store_name,email").otherwise(",".join(UPLOAD_COLUMNS)).alias("value"),
    )
    endless = F.array(F.lit('Last,0917,,Printer,"open'), F.lit("and on"))
    tail = nations.select(file, F.posexplode(endless).alias("i", "value"))
    last = F.lit(1 << 60).cast("bigint")
    return header.unionByName(body).unionByName(tail.select("file", last.alias("block"), (last + F.col("i")).alias("pos"), "value"))
