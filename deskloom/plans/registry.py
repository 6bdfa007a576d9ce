"""Every registered query: a function of (session, table folder) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.functions import legacy as L
from deskloom.functions import status as ST
from deskloom.functions import tickets as K
from deskloom.operators import audit as AU
from deskloom.operators import changes as C
from deskloom.operators import export as X
from deskloom.operators import filters as FI
from deskloom.operators import ingest as I
from deskloom.operators import numbering as N
from deskloom.operators import people as U
from deskloom.operators import ranged as RG
from deskloom.operators import reports as R
from deskloom.operators import schema_ops as SO
from deskloom.operators import skipping as SK
from deskloom.operators.ledger import reserve
from deskloom.session import new_shared_path
from deskloom.sources.audit_log import parse_audit_lines
from deskloom.sources import tables as T
from deskloom.sources.csv_upload import parse_uploads, refused_uploads
from deskloom.sources.derived import upload_text_lines, view
from deskloom.streaming.audit_stream import stream_audit_log, write_available

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2026-01-01 00:00:00"
DAY = "1998-04-01"
EDIT_ORDER = ["seq", "seq2"]
SEEDS = (
    ("system_startup", '{"message": "Started", "environment": "test"}'),
    ("database_connected", '{"database": "desk", "status": "connected"}'),
    ("app_deployed", f'{{"version": "1.0.0", "timestamp": "{AS_OF}"}}'),
)


def _on(name: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(view(spark, sf_dir, name))


def _on_two(first: str, second: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(view(spark, sf_dir, first), view(spark, sf_dir, second))


def _updated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tickets = view(spark, sf_dir, "tickets")
    return tickets, C.apply_updates(tickets, view(spark, sf_dir, "edits"), EDIT_ORDER)


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.split_valid(I.stage_in_order(view(spark, sf_dir, "uploads"), [F.asc("row_num")]))[0]


def _allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = N.allocate_job_orders(
        _accepted(spark, sf_dir), view(spark, sf_dir, "tickets"), [F.asc("row_num")]
    )
    return numbered.select("row_num", "job_order")


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickets = view(spark, sf_dir, "tickets")
    return I.new_tickets(_accepted(spark, sf_dir), tickets, AS_OF, [F.asc("row_num")])


def _concurrent_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two uploads that reserve their numbers before either is appended; the first one runs twice."""
    base, order = new_shared_path(spark, "uploads"), [F.asc("row_num")]
    tickets, rows = view(spark, sf_dir, "tickets"), view(spark, sf_dir, "uploads")
    even = F.col("row_num") % 2 == 0
    I.append_tickets(tickets, f"{base}/entries", "before")
    stored = T.tickets(spark, f"{base}/entries")
    first, second = (I.split_valid(I.stage_in_order(rows.where(part), order))[0] for part in (even, ~even))
    claim = reserve(f"{base}/ledger", "first", first.count(), stored)
    other = reserve(f"{base}/ledger", "second", second.count(), stored)
    I.append_tickets(I.new_tickets(second, stored, AS_OF, order, other), f"{base}/entries", "second")
    I.append_tickets(I.new_tickets(first, stored, AS_OF, order, claim), f"{base}/entries", "first")
    I.ingest_upload(rows.where(even), T.tickets(spark, f"{base}/entries"), f"{base}/entries", f"{base}/ledger", "first", AS_OF, order)
    new = T.tickets(spark, f"{base}/entries").where(F.col("date") == F.lit(AS_OF).cast("timestamp_ntz"))
    return new.select("ticket_no", "job_order", "store_name", "concern", "status")


def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tickets in key ranges, edited and then thinned out in place."""
    path = new_shared_path(spark, "ranged-tickets")
    RG.write_ranged(view(spark, sf_dir, "tickets"), path, width=10_000)
    RG.update_ranged(spark, path, view(spark, sf_dir, "edits"), EDIT_ORDER, width=10_000)
    RG.delete_ranged(spark, path, view(spark, sf_dir, "deletes"), width=10_000)
    return RG.read_ranged(spark, path)


def _searched(search: Callable[[SparkSession, str, str], DataFrame], text: str) -> Query:
    """The tickets as five indexed uploads, searched where their bitmaps allow a match."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, tickets = new_shared_path(spark, "indexed-tickets"), view(spark, sf_dir, "tickets")
        for part in range(5):
            SK.append_indexed(tickets.where(F.col("ticket_no") % 5 == part), path, f"upload-{part}")
        return search(spark, path, text)

    return run


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export in parts, read back without its header."""
    path, tickets = new_shared_path(spark, "export"), view(spark, sf_dir, "tickets")
    X.export_parts(tickets, path, everything=True)
    titles = X.export_rows(tickets.limit(0)).columns
    rows = X.read_parts(spark, f"{path}/{X.export_name()}").drop("part", "bytes").toDF(*titles)
    return rows.where(F.col(titles[0]) != titles[0]).na.fill("")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = N.assign_ticket_no(
        _accepted(spark, sf_dir), view(spark, sf_dir, "tickets"), [F.asc("row_num")]
    )
    return numbered.select("row_num", "ticket_no")


def _legacy_fields(df: DataFrame) -> DataFrame:
    assigned = F.col("assigned_it")
    return df.select(
        "ticket_no",
        K.reported_concern(F.col("concern"), assigned).alias("reported_concern"),
        L.assigned_to(assigned).alias("assigned_to"),
        L.legacy_contact(assigned).alias("legacy_contact"),
        K.sheet_assignee(assigned, F.col("email")).alias("sheet_assignee"),
        L.pack_legacy(
            F.col("contact_number"), F.col("concern"), L.assigned_to(assigned), F.col("email")
        ).alias("packed"),
    )


def _status_values(df: DataFrame) -> DataFrame:
    status = F.col("status")
    return df.select(
        "ticket_no",
        "status",
        ST.status_label(status).alias("status_label"),
        ST.status_store(status).alias("status_store"),
        ST.status_store_workbook(status).alias("status_workbook"),
        ST.status_choice(status).alias("status_choice"),
    )


def _search_text(df: DataFrame) -> DataFrame:
    return df.select("ticket_no", FI.haystack(df).alias("haystack"))


def _drifted(df: DataFrame) -> DataFrame:
    """The tickets under an older layout, canonicalised again."""
    old = df.select(
        F.col("ticket_no").alias("id"),
        F.col("store_name").alias("Name"),
        "contact_number",
        F.col("subject").alias("Concern"),
        "assigned_it",
        F.col("date").alias("created_at"),
        F.col("email").alias("Email"),
        F.lit("").alias("email"),
        F.col("concern").alias("details"),
        F.col("status").alias("Status"),
        F.col("job_order").alias("remedy"),
    )
    return SO.evolve(SO.canonicalize(old)).select(
        "ticket_no",
        "store_name",
        "email",
        "subject",
        "job_order",
        "concern",
        "status",
        "date",
        "service_done",
        "labor_fee",
    )


def _workbook_headers(df: DataFrame) -> DataFrame:
    """The uploads under headers as a workbook has them, as fields again."""
    titled = df.select(
        "row_num", F.col("store_name").alias(" Store Name"), F.col("contact_number").alias("Contact Number "),
        F.col("reported_concern").alias("CONCERN"), F.col("assigned_to").alias("Assigned To"),
    )
    return SO.normalize_headers(titled)


def _stored(name: str, read: Callable[[SparkSession, str], DataFrame], **renamed: str) -> Query:
    """A view written under its stored column names and read as a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_shared_path(spark, f"stored-{name}")
        view(spark, sf_dir, name).withColumnsRenamed(renamed).write.parquet(path)
        return read(spark, path)

    return run


def _csv_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.validate(parse_uploads(upload_text_lines(spark, sf_dir)))


def _audit_events(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "timestamp",
        "level",
        "action",
        "user_id",
        "email",
        "role",
        "ip",
        "ua",
        "is_active",
        F.array_join("updated_fields", ",").alias("updated_fields"),
    )


def _audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log segments written from the events, taken up by the stream and read back."""
    base = new_shared_path(spark, "audit-stream")
    view(spark, sf_dir, "audit_lines").write.text(f"{base}/segments")
    events = _audit_events(stream_audit_log(spark, f"{base}/segments"))
    write_available(events, f"{base}/rows", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/rows")


def _rejected(checked: DataFrame) -> DataFrame:
    return I.split_valid(checked)[1]


def _new_user_rows(requests: DataFrame, users: DataFrame, register: bool = False) -> DataFrame:
    return U.check_new_users(requests, users, register).select(
        "row_num", "email", "first_name", "last_name", "role", "error"
    )


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = view(spark, sf_dir, "audit")
    return AU.seed_if_absent(AU.seed_rows(spark, SEEDS), audit)


def _change_rows(build: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(*_updated(spark, sf_dir))


def _user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = view(spark, sf_dir, "users")
    return U.user_transitions(
        users, U.apply_user_updates(users, view(spark, sf_dir, "user_edits"), EDIT_ORDER)
    )


QUERIES: dict[str, Query] = {
    # Counts
    "tickets_by_status": _on("tickets", R.tickets_by_status),
    "tickets_by_day": _on("tickets", R.tickets_by_day),
    "tickets_by_store": _on("tickets", R.tickets_by_store),
    "top_stores": _on("tickets", R.top_stores),
    "ticket_counts": _on("tickets", R.ticket_counts),
    "company_history": _on("tickets", R.company_history),
    "ticket_total": _on("tickets", R.ticket_total),
    "match_count": _on("tickets", lambda df: R.match_count(df, status="Completed", store="customer#0")),
    "dashboard_json": _on("tickets", R.dashboard_json),
    # Filters and search
    "filter_tickets": _on("tickets", lambda df: FI.filter_tickets(df, DAY, " PENDING ", "tomer")),
    "by_day": _on("tickets", lambda df: FI.by_day(df, DAY)),
    "by_status": _on("tickets", lambda df: FI.by_status(df, "COMPLETED")),
    "by_store": _on("tickets", lambda df: FI.by_store(df, "CUSTÓMER%_7")),
    "search_tickets": _on("tickets", lambda df: FI.search(df, "Technician 3 199")),
    "search_skipping": _searched(SK.search, "Technician 3 199"),
    "by_store_skipping": _searched(SK.by_store, "CUSTÓMER%_7"),
    "search_text": _on("tickets", _search_text),
    "by_label": _on("tickets", lambda df: FI.by_label(df, "Ongoing")),
    "ticket_by_key": _on("tickets", lambda df: FI.ticket(df, 42)),
    "valid_job_orders": _on("tickets", lambda df: FI.valid_jo(df).select("ticket_no", "job_order")),
    # Listings
    "home_list": _on("tickets", lambda df: R.home_list(df, AS_OF)),
    "latest_first": _on("tickets", R.latest_first),
    "recent_job_orders": _on("tickets", R.recent_job_orders),
    "ticket_list": _on("tickets", R.ticket_list),
    "job_order_sheet": _on("tickets", R.job_order_sheet),
    "legacy_fields": _on("tickets", _legacy_fields),
    "status_values": _on("tickets", _status_values),
    "canonical_tickets": _on("tickets", _drifted),
    "export_rows": _on("tickets", X.export_rows),
    "export_parts": _exported,
    "export_filtered": _on("tickets", lambda df: X.export_rows(df, store="customer#000000")),
    # Numbers
    "next_job_order": _on("tickets", N.next_job_order),
    "max_ticket_no": _on("tickets", N.max_ticket_no),
    "duplicates_job_order": _on("tickets", lambda df: SO.duplicates(df, "job_order")),
    "duplicates_email": _on("users", lambda df: SO.duplicates(df, "email")),
    "allocate_job_orders": _allocated,
    "assign_ticket_no": _numbered,
    # Ingest
    "validate_tickets": _on("uploads", I.validate),
    "rejected_rows": _on("uploads", lambda df: _rejected(I.validate(df))),
    "ingest_summary": _on("uploads", lambda df: I.ingest_summary(I.stage(I.validate(df)))),
    "ingested_tickets": _ingested,
    "concurrent_uploads": _concurrent_uploads,
    "csv_upload": _csv_upload,
    "refused_uploads": lambda spark, sf_dir: refused_uploads(upload_text_lines(spark, sf_dir)),
    "workbook_rows": _on("workbook", I.validate_workbook),
    "workbook_headers": _on("uploads", _workbook_headers),
    # Stored tables
    "stored_tickets": _stored("tickets", T.tickets),
    "stored_users": _stored("users", T.users, id="idusers"),
    "stored_audit": _stored("audit", T.audit),
    # Changes
    "apply_updates": lambda spark, sf_dir: _updated(spark, sf_dir)[1],
    "ranged_changes": _ranged,
    "rejected_edits": _on_two("tickets", "edits", lambda t, e: C.rejected_edits(t, e, EDIT_ORDER)),
    "job_order_conflicts": _on_two("tickets", "edits", lambda t, e: C.job_order_conflicts(t, e, EDIT_ORDER)),
    "apply_deletes": _on_two("tickets", "deletes", lambda t, d: C.apply_deletes(t, d, "ticket_no")),
    "diff_tickets": _change_rows(C.diff_tickets),
    "update_records": _on_two("tickets", "edits", lambda t, e: C.update_records(t, e, EDIT_ORDER)),
    "status_transitions": _change_rows(C.status_transitions),
    # People
    "user_list": _on("users", U.user_list),
    "visible_users": _on("users", lambda df: FI.visible_users(df, "admin")),
    "user_cards": _on("users", lambda df: U.user_cards(df, "super_admin")),
    "manageable_users": _on("users", U.manageable),
    "active_users": _on("users", FI.active_users),
    "user_by_email": _on("users", lambda df: FI.user_by_email(df, " SUPPLIER000000007@example.com")),
    "user_by_id": _on("users", lambda df: FI.user_by_id(df, 7)),
    "super_admin_count": _on("users", U.super_admin_count),
    "new_users": _on_two("candidates", "users", U.new_users),
    "dedupe_users": _on("candidates", U.dedupe_users),
    "check_new_users": _on_two("candidates", "users", _new_user_rows),
    "register_users": _on_two("candidates", "users", lambda c, u: _new_user_rows(c, u, register=True)),
    "apply_user_updates": _on_two(
        "users", "user_edits", lambda u, e: U.apply_user_updates(u, e, EDIT_ORDER)
    ),
    "profile_updates": _on_two(
        "users", "user_edits", lambda u, e: U.apply_profile_updates(u, e, EDIT_ORDER)
    ),
    "user_transitions": _user_changes,
    "check_user_deletes": _on_two("user_deletes", "users", U.check_user_deletes),
    "apply_user_deletes": _on_two("users", "user_deletes", U.apply_user_deletes),
    # Audit
    "latest_audit": _on("audit", AU.latest_audit),
    "audit_by_action": _on("audit", lambda df: FI.by_action(df, ["SIGNUP", "error"])),
    "audit_count": _on("audit", AU.audit_count),
    "audit_payload": _on("audit", AU.audit_payload),
    "seed_if_absent": _seeds,
    "audit_events": _on("audit_lines", lambda df: _audit_events(parse_audit_lines(df))),
    "audit_stream": _audit_stream,
}
