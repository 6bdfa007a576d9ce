"""The SQL twin of every registered query, over the same tables."""

from __future__ import annotations

from deskloom.plans.registry import AS_OF, DAY, SEEDS
from deskloom.sources.derived import view_sql

_LOWERED = "lower(coalesce(nullif(status, ''), 'pending'))"


def _bucket(pending: str, ongoing: str, complete: str, s: str = _LOWERED) -> str:
    return (
        f"case when {s} in ('complete', 'completed') then '{complete}' "
        f"when {s} in ('ongoing', 'in progress', 'in_progress') then '{ongoing}' else '{pending}' end"
    )


def _stored(column: str) -> str:
    s = f"lower(trim(coalesce(nullif({column}, ''), 'pending')))"
    return (
        f"case when {s} in ('complete', 'completed') then 'completed' "
        f"when {s} in ('pending', 'ongoing', 'in progress', 'in_progress') then {s} else 'pending' end"
    )


def _clean(column: str) -> str:
    return f"nullif(trim({column}), '')"


def _line(label: str, flags: str = "im") -> str:
    return f"nullif(trim(regexp_extract(assigned_it, '(?{flags})^[ \\t]*{label}:(.*)$', 1)), '')"


_LABEL = _bucket("Pending", "Ongoing", "Complete")
_CHOICE = _bucket("pending", "ongoing", "completed")
_CONTACT = f"coalesce(nullif(contact_number, ''), {_line('Contact', 'm')}, '—')"
_ASSIGNEE = "coalesce(nullif(assigned_it, ''), nullif(email, ''), '—')"
_CONCERN = "coalesce(nullif(concern, ''), nullif(assigned_it, ''), '')"
_SUBJECT = "coalesce(nullif(subject, ''), nullif(concern, ''), '')"
_REPORTED = f"coalesce(nullif(concern, ''), {_line('reported concern')}, '')"
_PARSED = f"coalesce({_line('assigned to')}, nullif(assigned_it, ''))"
_JO = "case when regexp_matches(job_order, '(?i)^jo-[0-9]+$') then cast(substr(job_order, 4) as bigint) end"
_TIME = "substr(cast(date as string), 1, 19)"
_MAX_JO = f"(select coalesce(max({_JO}), 0) from tickets)"


def _jo(n: str) -> str:
    text = f"cast({n} as string)"
    return f"concat('jo-', lpad({text}, cast(greatest(4, length({text})) as int), '0'))"


_HAYSTACK = (
    "lower(concat_ws(' ', cast(ticket_no as string), coalesce(store_name, ''), coalesce(job_order, ''), "
    f"{_SUBJECT}, {_ASSIGNEE}, coalesce({_TIME}, ''), coalesce(email, ''), {_CONTACT}, {_CONCERN}))"
)
_ACTIVE = "coalesce(lower(trim(is_active)) in ('1', 'true', 'yes'), false)"

_EXPORT = (
    "select cast(ticket_no as string) as \"Ticket No\", coalesce(job_order, '') as \"Job Order\", "
    "coalesce(store_name, '') as \"Store Name\", coalesce(contact_number, '') as \"Contact Number\", "
    "coalesce(email, '') as \"Email\", coalesce(subject, '') as \"Subject\", "
    "coalesce(concern, '') as \"Concern\", coalesce(service_done, '') as \"Service Done\", "
    "coalesce(cast(labor_fee as string), '') as \"Labor Fee\", coalesce(assigned_it, '') as \"Assigned IT\", "
    f"status as \"Status\", coalesce({_TIME}, '') as \"Date\", coalesce(remedy, '') as \"Remedy\" from tickets"
)

_FIRST_WIDE = (
    "case when length(store_name) > 45 then 'store_name' when length(contact_number) > 45 then 'contact_number' "
    "when length(email) > 255 then 'email' when length(subject) > 45 then 'subject' {extra}"
    "when length(reported_concern) > 255 then 'reported_concern' "
    "when length(assigned_to) > 255 then 'assigned_to' end"
)


def _checked(source: str, short: str = "false") -> str:
    """CTEs ``cleaned`` and ``checked`` over upload rows."""
    fields = ("store_name", "contact_number", "email", "subject", "reported_concern", "assigned_to")
    cleaned = ", ".join(f"{_clean(f)} as {f}" for f in fields)
    wide = _FIRST_WIDE.format(extra="")
    row = "concat('Row ', cast(row_num as string), ': "
    return (
        f"cleaned as (select file, row_num, {cleaned}, {_stored('status')} as status, {short} as short from {source}), "
        "checked as (select file, row_num, store_name, contact_number, email, subject, reported_concern, "
        f"assigned_to, status, case when short then {row}Row is shorter than the header') "
        f"when store_name is null or subject is null or reported_concern is null then {row}Missing required fields') "
        "when contact_number is null and email is null "
        f"then {row}At least one of contact_number or email is required') "
        f"when {wide} is not null then {row}Data too long for column ', {wide}) end as error from cleaned)"
    )


_UPLOAD_CHECK = _checked("uploads")

_CSV_ROWS = (
    "csv_rows as (select concat('batch-', cast(c_nationkey as string), '.csv') as file, "
    "row_number() over (partition by c_nationkey order by o_orderkey) + 1 as row_num, "
    "case when o_orderkey % 29 = 0 then c_name when o_orderkey % 31 = 0 then concat(c_name, ', \"north\"') "
    "when o_orderkey % 13 = 0 then concat(c_name, ' 5\" screen') else c_name end as store_name, "
    "case when o_orderkey % 29 = 0 then concat('09', cast(o_custkey as string)) when o_orderkey % 31 = 0 then '' "
    "when o_orderkey % 13 = 0 then '0917' when o_orderkey % 11 = 0 then '' else '0917' end as contact_number, "
    "case when o_orderkey % 29 = 0 then null when o_orderkey % 31 = 0 "
    "then concat('c', cast(o_custkey as string), '@example.com') else '' end as email, "
    "case when o_orderkey % 29 = 0 then null else o_orderpriority end as subject, "
    "case when o_orderkey % 29 = 0 then null when o_orderkey % 31 = 0 "
    "then concat('Issue, ', chr(10), 'line two ', cast(o_orderkey as string)) "
    "else concat('Issue ', cast(o_orderkey as string)) end as reported_concern, "
    "case when o_orderkey % 29 = 0 then null when o_orderkey % 31 = 0 then 'Ann' "
    "when o_orderkey % 13 = 0 then '' else 'Ann' end as assigned_to, "
    "case when o_orderkey % 29 = 0 then null when o_orderkey % 31 = 0 then 'weird' "
    "when o_orderkey % 13 = 0 then 'Complete' when o_orderkey % 11 = 0 then '' else 'ongoing' end as status, "
    "o_orderkey % 29 = 0 as cut from orders join customer on o_custkey = c_custkey where c_nationkey <> 24 "
    "union all select concat('batch-', cast(n_nationkey as string), '.csv'), "
    "2 + (select count(*) from orders join customer on o_custkey = c_custkey where c_nationkey = n_nationkey), "
    "'Last', '0917', '', 'Printer', concat('open', chr(10), 'and on'), null, null, true from nation where n_nationkey <> 24)"
)

_EDIT_FIELDS = (
    "store_name",
    "contact_number",
    "email",
    "subject",
    "job_order",
    "reported_concern",
    "assigned_to",
    "service_done",
)
# A fold over all edits of contested job orders in turn. The state counts the tickets that have each
# (``h``), has the one that each ticket has (``o``, 0 if none of them) and the refused edits (``d``).
_REPLAY = (
    "claims as (select ticket_no, lower(job_order) as jo from own_errors where error is null and job_order is not null "
    "union select ticket_no, lower(trim(job_order)) from tickets where trim(job_order) <> ''), "
    "contested as (select jo, row_number() over (order by jo)::int as v "
    "from (select jo from claims group by jo having count(distinct ticket_no) > 1)), "
    "players as (select ticket_no, row_number() over (order by ticket_no)::int as t from tickets "
    "where ticket_no in (select ticket_no from claims semi join contested using (jo))), "
    "held as (select p.t, coalesce(c.v, 0) as v from players p join tickets k using (ticket_no) "
    "left join contested c on c.jo = lower(trim(k.job_order))), "
    "asked as (select e.ticket_no, e.seq, e.seq2, e.job_order, p.t, coalesce(c.v, 0) as v, "
    "row_number() over (order by e.seq, e.seq2, e.ticket_no) as i "
    "from own_errors e join players p using (ticket_no) left join contested c on c.jo = lower(e.job_order) where error is null), "
    "replayed as (select list_reduce([{'t': 0, 'v': 0, 'h': (select list(coalesce(n, 0)::int order by v) from contested "
    "left join (select v, count(*) as n from held group by v) using (v)), "
    "'o': (select list(v order by t) from held), 'd': []::bigint[]}] "
    "|| (select list({'t': t, 'v': v, 'h': null::int[], 'o': null::int[], 'd': [i]} order by i) from asked), "
    "lambda s, e: case when s.o[e.t] = e.v then s "
    "when e.v > 0 and s.h[e.v] > 0 then {'t': 0, 'v': 0, 'h': s.h, 'o': s.o, 'd': s.d || e.d} "
    "else {'t': 0, 'v': 0, 'h': list_transform(s.h, lambda n, j: n + (j = e.v)::int - (j = s.o[e.t])::int), "
    "'o': (s.o[:e.t - 1] || [e.v] || s.o[e.t + 1:]), 'd': s.d} end).d as d), "
    "conflicts as (select ticket_no, seq, seq2, job_order from asked where i in (select unnest(d) from replayed)), "
)
_EDIT_CTE = (
    "clean_edits as (select ticket_no, seq, seq2, "
    + ", ".join(f"{_clean(f)} as {f}" for f in _EDIT_FIELDS)
    + f", {_stored('status')} as status, {_clean('labor_fee')} as fee_text, "
    + f"try_cast({_clean('labor_fee')} as decimal(10, 2)) as labor_fee from edits), "
    + "wide_edits as (select *, "
    + _FIRST_WIDE.format(extra="")
    + " as wide from clean_edits), "
    + "own_errors as (select *, case when wide is not null then concat('Data too long for column ', wide) "
    + "when fee_text is not null and labor_fee is null then 'Incorrect decimal value for labor_fee' end as error "
    + "from wide_edits), "
    + _REPLAY
    + "checked_edits as (select e.* replace (case when c.ticket_no is not null then 'Duplicate entry for column job_order' "
    + "else error end as error) from own_errors e left join (select distinct * from conflicts) c "
    + "on e.ticket_no = c.ticket_no and e.seq = c.seq and e.seq2 = c.seq2 and e.error is null), "
    + "last_edits as (select * from (select *, row_number() over (partition by ticket_no "
    + "order by seq desc, seq2 desc) as rank from checked_edits where error is null) where rank = 1), "
    + "updated as (select t.ticket_no, "
    + ", ".join(
        f"case when e.ticket_no is not null then e.{new} else t.{old} end as {old}"
        for old, new in (
            ("store_name", "store_name"),
            ("contact_number", "contact_number"),
            ("subject", "subject"),
            ("assigned_it", "assigned_to"),
            ("email", "email"),
            ("concern", "reported_concern"),
            ("status", "status"),
            ("job_order", "job_order"),
            ("service_done", "service_done"),
            ("labor_fee", "labor_fee"),
        )
    )
    + ", t.date, t.remedy from tickets t left join last_edits e on t.ticket_no = e.ticket_no)"
)


def _record(table: str) -> str:
    return (
        f"select ticket_no, nullif(store_name, '') as store_name, nullif({_SUBJECT}, '') as subject, "
        f"nullif(job_order, '') as job_order, {_CHOICE} as status, nullif(contact_number, '') as contact_number, "
        f"nullif(email, '') as email, nullif(assigned_it, '') as assigned from {table}"
    )


_DIFF = (
    f"old as ({_record('tickets')}), new as ({_record('updated')}) select old.ticket_no, "
    + ", ".join(
        f"old.{c} as old_{c}, new.{c} as new_{c}"
        for c in ("store_name", "subject", "job_order", "status", "contact_number", "email")
    )
    + ", old.assigned as old_assigned_it, new.assigned as new_assigned_to "
    "from old join new on old.ticket_no = new.ticket_no where "
    + " or ".join(
        f"old.{c} is distinct from new.{c}"
        for c in ("store_name", "subject", "job_order", "status", "contact_number", "email", "assigned")
    )
)

_ROLE_LABEL = (
    "case when {c} = 'super_admin' then 'Super Admin' when {c} = 'admin' then 'Admin' else 'End User' end"
)
# Every user's edits in turn: a fold of the state over the ordered list of them.
_USER_STATE = ("actor_role", "first_name", "last_name", "role", "is_active")


def _user_state(**values: str) -> str:
    return "{" + ", ".join(f"'{c}': {values.get(c, c)}" for c in _USER_STATE) + "}"


_NEW_ROLE = "case when e.role in ('super_admin', 'admin', 'end_user') then e.role else coalesce(s.role, 'end_user') end"
_USER_EDIT_CTE = (
    "user_steps as (select id, list("
    + _user_state(first_name="trim(first_name)", last_name="trim(last_name)", role="lower(trim(role))")
    + " order by seq, seq2) as steps from user_edits group by id), "
    "folded as (select u.id, u.email, list_reduce(list_prepend("
    + _user_state(actor_role="''")
    + ", coalesce(steps, [])), lambda s, e: case when e.first_name <> '' and e.last_name <> '' "
    f"and (e.actor_role = 'super_admin' or (e.actor_role = 'admin' and s.role = 'end_user' and {_NEW_ROLE} = 'end_user')) then "
    + _user_state(actor_role="e.actor_role", first_name="e.first_name", last_name="e.last_name", role=_NEW_ROLE, is_active="e.is_active")
    + " else s end) as state from users u left join user_steps on u.id = user_steps.id), "
    "updated_users as (select id, email, "
    + ", ".join(f"state.{c} as {c}" for c in _USER_STATE[1:])
    + " from folded)"
)
_USER_DELETE_CTE = (
    "asked as (select d.seq, d.actor_id, d.target_id, t.role as target_role, "
    "case when d.actor_id = d.target_id then 'You cannot delete your own account.' "
    "when t.role is null or not (coalesce(a.role, '') = 'super_admin' "
    "or (coalesce(a.role, '') = 'admin' and t.role = 'end_user')) "
    "then 'User not found or you cannot delete this user.' end as error "
    "from user_deletes d left join users a on d.actor_id = a.id left join users t on d.target_id = t.id), "
    "taken as (select target_id, min(seq) as seq from asked "
    "where error is null and target_role = 'super_admin' group by target_id), "
    "kept as (select case when count(*) >= (select count(*) from users where role = 'super_admin') "
    "then arg_max(target_id, seq) end as target_id from taken), "
    "judged as (select seq, actor_id, target_id, coalesce(error, case when target_id = (select target_id from kept) "
    "then 'Cannot delete the last super admin.' end) as error from asked)"
)
_REQUEST_CTE = (
    "cleaned as (select row_num, actor_role, trim(first_name) as first_name, trim(last_name) as last_name, "
    "lower(trim(email)) as email, case when lower(trim(role)) in ('super_admin', 'admin', 'end_user') "
    "then lower(trim(role)) else 'end_user' end as role from candidates), "
    "judged as (select row_num, email, first_name, last_name, role, "
    "case when not (actor_role = 'super_admin' or (actor_role = 'admin' and role = 'end_user')) "
    "then 'You cannot assign that role.' when first_name = '' or last_name = '' or email = '' "
    "then 'Please fill in all required fields.' when email in (select email from users) "
    "then 'An account with that email already exists.' end as error from cleaned)"
)

_AUDIT_EVENTS = (
    "select cast(concat(substr(cast(ts as string), 1, 19), '.', lpad(cast(event_id % 1000 as string), 3, '0')) "
    "as timestamp) as timestamp, 'INFO' as level, event_type as action, user_id, "
    "case when user_id % 7 = 0 then null else concat('u', cast(user_id as string), '@example.com') end as email, "
    "'O''Brien, None' as role, concat('10.0.0.', cast(user_id % 250 as string)) as ip, "
    "'agent [None, True]' as ua, user_id % 2 = 0 as is_active, concat('names,', event_type) as updated_fields from events"
)

def _sql(views: str, query: str) -> str:
    """``query`` behind the named views; ``query`` may start with further CTEs and a comma."""
    ctes = ", ".join(f"{name} as ({view_sql(name)})" for name in views.split())
    return f"with {ctes}{query}" if query.startswith(",") else f"with {ctes} {query}"


def _t(query: str) -> str:
    return _sql("tickets", query)


_UPDATES = f", {_EDIT_CTE}"

ORACLE_SQL: dict[str, str] = {
    "tickets_by_status": _t(
        f"select s.status, count(t.label) as n from (values ('Pending'), ('Ongoing'), ('Complete')) s(status) "
        f"left join (select {_LABEL} as label from tickets) t on s.status = t.label group by s.status"
    ),
    "tickets_by_day": _t(
        "select substr(cast(date as string), 1, 10) as day, count(*) as n from tickets "
        "where date is not null group by 1 order by 1"
    ),
    "tickets_by_store": _t(
        "select coalesce(nullif(store_name, ''), 'Unknown store') as store_name, count(*) as n from tickets group by 1"
    ),
    "top_stores": _t(
        "select coalesce(nullif(store_name, ''), 'Unknown store') as store_name, count(*) as n "
        "from tickets group by 1 order by n desc, store_name limit 10"
    ),
    "ticket_counts": _t(
        "select "
        + ", ".join(f"count(*) filter ({_LABEL} = '{x}') as ticket_{x.lower()}" for x in ("Complete", "Pending", "Ongoing"))
        + ", count(*) as ticket_total from tickets"
    ),
    "company_history": _t(
        "select row_number() over (order by usage_count desc, last_used desc nulls last, company_name) as id, * from "
        "(select min(store_name) as company_name, count(*) as usage_count, max(date) as last_used from tickets "
        "where store_name <> '' group by lower(store_name))"
    ),
    "ticket_total": _t("select count(*) as ticket_total from tickets"),
    "match_count": _t(
        "select count(*) as n from tickets where lower(status) = 'completed' and lower(store_name) like '%customer#0%'"
    ),
    "dashboard_json": _t(
        f"select concat('{{\"series\":\"', series, '\",\"key\":\"', key, '\",\"n\":', cast(n as string), '}}') as json from ("
        f"select 'status_counts' as series, {_LABEL} as key, count(*) as n from tickets group by 2 union all "
        "select 'tickets_by_date', substr(cast(date as string), 1, 10), count(*) from tickets where date is not null group by 2 "
        "union all select 'tickets_by_store', coalesce(nullif(store_name, ''), 'Unknown store'), count(*) from tickets group by 2)"
    ),
    "filter_tickets": _t(
        f"select * from tickets where cast(date as date) = date '{DAY}' and lower(status) = 'pending' "
        "and lower(store_name) like '%tomer%'"
    ),
    "by_day": _t(f"select * from tickets where cast(date as date) = date '{DAY}'"),
    "by_status": _t("select * from tickets where lower(status) = 'completed'"),
    "by_store": _t("select * from tickets where lower(store_name) like '%customer%_7%'"),
    "search_tickets": _t(f"select * from tickets where contains({_HAYSTACK}, 'technician 3 199')"),
    "by_store_skipping": _t("select * from tickets where lower(store_name) like '%customer%_7%'"),
    "search_skipping": _t(f"select * from tickets where contains({_HAYSTACK}, 'technician 3 199')"),
    "search_text": _t(f"select ticket_no, {_HAYSTACK} as haystack from tickets"),
    "by_label": _t(f"select * from tickets where {_LABEL} = 'Ongoing'"),
    "ticket_by_key": _t("select * from tickets where ticket_no = 42"),
    "valid_job_orders": _t(
        "select ticket_no, job_order from tickets where regexp_matches(job_order, '(?i)^jo-[0-9]+$')"
    ),
    "home_list": _t(
        f"select *, coalesce(date, timestamp '{AS_OF}') as sort_date from tickets order by sort_date desc, ticket_no desc"
    ),
    "latest_first": _t("select * from tickets order by date desc nulls last, ticket_no desc"),
    "recent_job_orders": _t(
        "select job_order from tickets where job_order is not null order by job_order desc limit 10"
    ),
    "ticket_list": _t(
        "select ticket_no, coalesce(nullif(store_name, ''), '—') as store_name, "
        f"coalesce(nullif(email, ''), {_CONTACT}) as contact_line, {_CONTACT} as contact, "
        "coalesce(job_order, '—') as job_order, coalesce(nullif(subject, ''), nullif(concern, ''), '—') as subject, "
        f"{_ASSIGNEE} as assignee, {_LABEL} as status_label, date, "
        "case when status in ('completed', 'complete') then date end as date_completed, "
        f"{_CONCERN} as concern from tickets"
    ),
    "job_order_sheet": _t(
        "select ticket_no, coalesce(store_name, '') as store_name, coalesce(contact_number, '') as contact_number, "
        f"coalesce(email, '') as email, {_SUBJECT} as subject, "
        f"coalesce(job_order, '') as job_order, date, {_LABEL} as status_label, {_REPORTED} as reported_concern, "
        f"coalesce({_PARSED}, nullif(email, ''), '—') as assigned_to, coalesce(service_done, '') as service_done, "
        "coalesce(cast(nullif(labor_fee, 0) as string), '') as labor_fee, "
        f"coalesce(nullif(subject, ''), nullif(concern, ''), {_REPORTED}) as service_reported from tickets"
    ),
    "legacy_fields": _t(
        f"select ticket_no, {_REPORTED} as reported_concern, {_PARSED} as assigned_to, "
        f"{_line('Contact', 'm')} as legacy_contact, coalesce({_PARSED}, nullif(email, ''), '—') as sheet_assignee, "
        "concat_ws(chr(10), 'Email: ' || nullif(email, ''), 'Contact: ' || nullif(contact_number, ''), "
        f"'Reported concern: ' || coalesce(concern, ''), 'Assigned to: ' || {_PARSED}) as packed from tickets"
    ),
    "status_values": _t(
        f"select ticket_no, status, {_LABEL} as status_label, {_stored('status')} as status_store, "
        f"case when {_LOWERED} in ('complete', 'completed') then 'completed' else {_LOWERED} end as status_workbook, "
        f"{_CHOICE} as status_choice from tickets"
    ),
    "canonical_tickets": _t(
        "select ticket_no, nullif(store_name, '') as store_name, email, subject, job_order, concern, "
        "nullif(status, '') as status, date, cast(null as string) as service_done, "
        "cast(null as decimal(10, 2)) as labor_fee from tickets"
    ),
    "export_rows": _t(f"{_EXPORT} order by date desc nulls last, ticket_no desc"),
    "export_parts": _t(f"{_EXPORT} order by date desc nulls last, ticket_no desc"),
    "export_filtered": _t(
        f"{_EXPORT} where lower(store_name) like '%customer#000000%' order by date desc nulls last, ticket_no desc"
    ),
    "next_job_order": _t(f"select {_jo(f'({_MAX_JO} + 1)')} as next_job_order"),
    "max_ticket_no": _t("select cast(coalesce(max(ticket_no), 0) as bigint) as max_ticket_no from tickets"),
    "duplicates_job_order": _t(
        "select min(job_order) as job_order, count(*) as n from tickets where job_order is not null "
        "group by lower(job_order) having count(*) > 1"
    ),
    "duplicates_email": _sql(
        "users", "select min(email) as email, count(*) as n from users group by lower(email) having count(*) > 1"
    ),
    "allocate_job_orders": _sql(
        "tickets uploads",
        f", {_UPLOAD_CHECK}, numbered as (select row_num, row_number() over (order by row_num) + {_MAX_JO} as jo "
        f"from checked where error is null) select row_num, {_jo('jo')} as job_order from numbered",
    ),
    "assign_ticket_no": _sql(
        "tickets uploads",
        f", {_UPLOAD_CHECK} select row_num, row_number() over (order by row_num) "
        "+ (select max(ticket_no) from tickets) as ticket_no from checked where error is null",
    ),
    "validate_tickets": _sql("uploads", f", {_UPLOAD_CHECK} select * from checked"),
    "rejected_rows": _sql(
        "uploads", f", {_UPLOAD_CHECK} select file, row_num, error from checked where error is not null"
    ),
    "ingest_summary": _sql(
        "uploads",
        f", {_UPLOAD_CHECK}, ranked as (select file, error, row_num, row_number() over "
        "(partition by file, error is null order by row_num) as rank from checked) "
        "select file, count(*) filter (error is null) as created, count(*) filter (error is not null) as failed, "
        "coalesce(string_agg(error, '; ' order by row_num) filter (error is not null and rank <= 5), '') as errors, "
        "greatest(count(*) filter (error is not null) - 5, 0) as more_errors from ranked group by file",
    ),
    "ingested_tickets": _sql(
        "tickets uploads",
        f", {_UPLOAD_CHECK}, numbered as (select *, row_number() over (order by row_num) as seq "
        "from checked where error is null) select cast(seq + (select max(ticket_no) from tickets) as bigint) as ticket_no, "
        "store_name, contact_number, subject, assigned_to as assigned_it, "
        f"timestamp '{AS_OF}' as date, email, reported_concern as concern, status, cast(null as string) as remedy, "
        f"{_jo(f'(seq + {_MAX_JO})')} as job_order, cast(null as string) as service_done, "
        "cast(null as decimal(10, 2)) as labor_fee from numbered",
    ),
    "concurrent_uploads": _sql(
        "tickets uploads",
        f", {_UPLOAD_CHECK}, numbered as (select *, row_number() over (order by row_num % 2, row_num) as seq "
        "from checked where error is null) select cast(seq + (select max(ticket_no) from tickets) as bigint) as ticket_no, "
        f"{_jo(f'(seq + {_MAX_JO})')} as job_order, store_name, reported_concern as concern, status from numbered",
    ),
    "csv_upload": f"with {_CSV_ROWS}, {_checked('csv_rows', 'cut')} select * from checked",
    "refused_uploads": (
        "select concat('batch-', cast(n_nationkey as string), '.csv') as file, "
        "'Missing required columns: subject, reported_concern' as message from nation where n_nationkey = 24"
    ),
    "workbook_rows": _sql(
        "workbook",
        ", filled as (select file, row_num, "
        + ", ".join(f"nullif({f}, '') as {f}" for f in _EDIT_FIELDS if f not in ("job_order", "service_done"))
        + f", case when {_LOWERED} in ('complete', 'completed') then 'completed' else {_LOWERED} end as status, "
        "nullif(labor_fee, '') as fee from workbook), "
        "judged as (select * exclude (fee), try_cast(fee as decimal(10, 2)) as labor_fee, case "
        f"when {_FIRST_WIDE.format(extra='')} is not null then concat('Data too long for column ', {_FIRST_WIDE.format(extra='')}) "
        "when length(status) > 50 then 'Data too long for column status' "
        "when fee like '999999%' then 'Out of range value for column labor_fee' end as own "
        "from filled where store_name is not null and subject is not null and reported_concern is not null "
        "and coalesce(contact_number, email) is not null) "
        "select * exclude (own), max(own) over (partition by file) as error from judged",
    ),
    "workbook_headers": _sql("uploads", "select row_num, store_name, contact_number, reported_concern, assigned_to from uploads"),
    "stored_tickets": _t("select * from tickets"),
    "stored_users": _sql("users", "select * from users"),
    "stored_audit": _sql("audit", "select * from audit"),
    "apply_updates": _sql("tickets edits", f"{_UPDATES} select * from updated"),
    "ranged_changes": _sql(
        "tickets edits deletes", f"{_UPDATES} select * from updated where ticket_no not in (select ticket_no from deletes)"
    ),
    "rejected_edits": _sql(
        "tickets edits",
        f"{_UPDATES} select ticket_no, seq, seq2, error from checked_edits where error is not null",
    ),
    "job_order_conflicts": _sql("tickets edits", f"{_UPDATES} select * from conflicts"),
    "apply_deletes": _sql(
        "tickets deletes", "select * from tickets where ticket_no not in (select ticket_no from deletes)"
    ),
    "diff_tickets": _sql("tickets edits", f"{_UPDATES}, {_DIFF}"),
    "update_records": _sql("tickets edits", f"{_UPDATES}, {_DIFF}"),
    "status_transitions": _sql(
        "tickets edits",
        f"{_UPDATES}, before as (select ticket_no, {_bucket('Pending', 'Ongoing', 'Completed')} as label from tickets), "
        f"after as (select ticket_no, {_bucket('Pending', 'Ongoing', 'Completed')} as label from updated) "
        "select before.ticket_no, concat('from ', before.label, ' to ', after.label) as transition "
        "from before join after on before.ticket_no = after.ticket_no where before.label <> after.label",
    ),
    "user_list": _sql(
        "users",
        f"select id, email, first_name, last_name, role, {_ACTIVE} as is_active from users "
        "order by role <> 'super_admin', role <> 'admin', last_name, first_name",
    ),
    "visible_users": _sql("users", "select * from users where role = 'end_user'"),
    "user_cards": _sql(
        "users",
        "select id, email, concat(first_name, ' ', last_name) as display_name, "
        f"{_ROLE_LABEL.format(c='role')} as role_label, {_ROLE_LABEL.format(c='role')} as role_title, "
        f"{_ACTIVE} as is_active from users",
    ),
    "manageable_users": _sql(
        "users",
        "select id, role, true as by_super_admin, role = 'end_user' as by_admin, false as by_end_user from users",
    ),
    "active_users": _sql("users", f"select * from users where {_ACTIVE}"),
    "user_by_email": _sql("users", "select * from users where email = 'supplier000000007@example.com'"),
    "user_by_id": _sql("users", "select * from users where id = 7"),
    "super_admin_count": _sql("users", "select count(*) filter (role = 'super_admin') as super_admins from users"),
    "new_users": _sql(
        "candidates users",
        "select row_num, actor_role, first_name, last_name, lower(trim(email)) as email, role from candidates "
        "where lower(trim(email)) not in (select email from users)",
    ),
    "dedupe_users": _sql(
        "candidates",
        "select row_num, actor_role, first_name, last_name, lower(trim(email)) as email, role from candidates "
        "qualify row_number() over (partition by lower(trim(email)) order by row_num) = 1",
    ),
    "check_new_users": _sql(
        "candidates users",
        f", {_REQUEST_CTE} select row_num, email, first_name, last_name, role, coalesce(error, "
        "case when row_number() over (partition by email, error is null order by row_num) > 1 "
        "then 'An account with that email already exists.' end) as error from judged",
    ),
    "register_users": _sql(
        "candidates users",
        ", asked as (select row_num, lower(trim(email)) as email, trim(first_name) as first_name, trim(last_name) as last_name "
        "from candidates), judged as (select *, case when first_name = '' or last_name = '' or email = '' "
        "then 'Please fill in all fields.' when email in (select email from users) "
        "then 'An account with that email already exists.' end as refused from asked) "
        "select row_num, email, first_name, last_name, 'end_user' as role, coalesce(refused, "
        "case when row_number() over (partition by email, refused is null order by row_num) > 1 "
        "then 'An account with that email already exists.' end) as error from judged",
    ),
    "apply_user_updates": _sql("users user_edits", f", {_USER_EDIT_CTE} select * from updated_users"),
    "profile_updates": _sql(
        "users user_edits",
        ", named as (select id, trim(first_name) as first_name, trim(last_name) as last_name, seq, seq2 from user_edits "
        "where trim(first_name) <> '' and trim(last_name) <> ''), "
        "last_named as (select * from named qualify row_number() over (partition by id order by seq desc, seq2 desc) = 1) "
        "select u.id, u.email, coalesce(n.first_name, u.first_name) as first_name, "
        "coalesce(n.last_name, u.last_name) as last_name, u.role, u.is_active from users u left join last_named n on u.id = n.id",
    ),
    "user_transitions": _sql(
        "users user_edits",
        f", {_USER_EDIT_CTE}, sides as (select o.id, {_ROLE_LABEL.format(c='o.role')} as a, "
        f"{_ROLE_LABEL.format(c='n.role')} as b, {_ACTIVE.replace('is_active', 'o.is_active')} as was, "
        f"{_ACTIVE.replace('is_active', 'n.is_active')} as now from users o join updated_users n on o.id = n.id) "
        "select id, case when a <> b then concat('from ', a, ' to ', b) end as role_change, "
        "case when was and not now then 'deactivate' when now and not was then 'activate' end as activity_change "
        "from sides where a <> b or was <> now",
    ),
    "check_user_deletes": _sql("users user_deletes", f", {_USER_DELETE_CTE} select * from judged"),
    "apply_user_deletes": _sql(
        "users user_deletes",
        f", {_USER_DELETE_CTE} select * from users where id not in (select target_id from judged where error is null)",
    ),
    "latest_audit": _sql("audit", "select * from audit order by timestamp desc, id desc limit 5"),
    "audit_by_action": _sql("audit", "select * from audit where action in ('signup', 'error')"),
    "audit_count": _sql("audit", "select count(*) as n from audit"),
    "audit_payload": _sql(
        "audit", "select id, action, coalesce(replace(payload, ': ', ':'), '{}') as payload from audit"
    ),
    "seed_if_absent": _sql(
        "audit",
        "select * from (values "
        + ", ".join(f"('{action}', '{payload}')" for action, payload in SEEDS)
        + ") s(action, payload) "
        "where not exists (select 1 from audit where action in ('system_startup', 'database_connected', 'app_deployed'))",
    ),
    "audit_events": _AUDIT_EVENTS,
    "audit_stream": _AUDIT_EVENTS,
}
