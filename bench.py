"""Time the registered queries on one folder of tables; print one JSON line.

Every query writes all its rows to the noop sink. One untimed warm-up run of each comes first, so
that session start and code generation do not count.
"""

from __future__ import annotations

import json
import os
import sys
import time

from deskloom.plans.registry import QUERIES
from deskloom.session import local_session

HEADLINE = (
    "tickets_by_status",
    "tickets_by_day",
    "tickets_by_store",
    "top_stores",
    "ticket_counts",
    "company_history",
    "dashboard_json",
    "match_count",
    "filter_tickets",
    "search_tickets",
    "home_list",
    "job_order_sheet",
    "ticket_list",
    "export_rows",
    "next_job_order",
    "duplicates_job_order",
    "allocate_job_orders",
    "validate_tickets",
    "ingest_summary",
    "csv_upload",
    "apply_updates",
    "apply_deletes",
    "update_records",
    "check_new_users",
    "apply_user_updates",
    "audit_events",
    "latest_audit",
    "diff_tickets",
    "status_transitions",
    "ingested_tickets",
    "audit_stream",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1:] or HEADLINE
    for name in names:
        run(spark, name, sf_dir)
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
