"""Role-scoped reads and writes, and integrity reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspark.operators import access, parts, quality, views
from floorspark.queries.registry import query
from floorspark.queries.scans import incoming_saves
from floorspark.session import new_folder
from floorspark.sources.tables import Tables


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@query(
    "ac_01",
    "jobs published_day",
    """select 'anon' as role, id, job_date from jobs where job_date = (select job_date from published_day)
union all select 'view_only', id, job_date from jobs union all select 'full_access', id, job_date from jobs""",
)
def visible_jobs(t: Tables) -> DataFrame:
    return _union(
        [
            access.visible("jobs", role, t.jobs, t.published_day).select(F.lit(role).alias("role"), "id", "job_date")
            for role in access.ROLES
        ]
    )


@query(
    "ac_02",
    "jobs counts saves published_day",
    """with writes as (select 'save' as source, job_id, seq from saves union all select 'count', job_id, null from counts),
today as (select j.id from jobs j, published_day p where j.job_date = p.job_date)
select 'anon update' as write, source, job_id, seq, case when job_id not in (select id from today) then 'outside the role''s rows' end as reason
from writes union all select 'view_only insert', source, job_id, seq, null from writes
union all select 'full_access update', source, job_id, seq, 'not granted' from writes""",
)
def admitted_counts(t: Tables) -> DataFrame:
    saves = incoming_saves(t).select(F.lit("save").alias("source"), "job_id", "seq")
    writes = saves.unionByName(t.counts.select(F.lit("count").alias("source"), "job_id"), allowMissingColumns=True)
    checked = []
    for role, operation in (("anon", "update"), ("view_only", "insert"), ("full_access", "update")):
        admitted = access.admit("counts", operation, role, writes, t.published_day, t.jobs, changed=["group_a_cores"])
        checked.append(admitted.select(F.lit(f"{role} {operation}").alias("write"), "source", "job_id", "seq", "reason"))
    return _union(checked)


@query(
    "ac_06",
    "chat_messages published_chat_day",
    """with today as (select m.*, m.job_date = p.job_date as today from chat_messages m, published_chat_day p)
select 'read' as write, id, cast(null as varchar) as reason from today where today
union all select 'insert', id, case when not (today and sender_role = 'trolley') then 'outside the role''s rows' end from today
union all select 'mark read', id, case when not (today and sender_role = 'admin') then 'outside the role''s rows' end from today
union all select 'rewrite', id, 'column not granted' from today""",
)
def governed_chat(t: Tables) -> DataFrame:
    chat, day = t.chat_messages, t.published_chat_day
    seen = access.visible("chat_messages", "anon", chat, day).withColumn("reason", F.lit(None).cast("string"))
    results = {
        "read": seen,
        "insert": access.admit("chat_messages", "insert", "anon", chat, day),
        "mark read": access.admit("chat_messages", "update", "anon", chat, day, changed=["read_at", "read_by"]),
        "rewrite": access.admit("chat_messages", "update", "anon", chat, day, changed=["body"]),
    }
    return _union([df.select(F.lit(write).alias("write"), "id", "reason") for write, df in results.items()])


@query(
    "ac_07",
    "notes",
    """select 'anon' as role, id, item_number from notes where visible_to_trolley = true
union all select 'view_only', id, item_number from notes""",
)
def visible_notes(t: Tables) -> DataFrame:
    return _union(
        [
            access.visible("item_reference_notes", role, t.notes).select(F.lit(role).alias("role"), "id", "item_number")
            for role in ("anon", "view_only")
        ]
    )


@query(
    "ac_12",
    "toggles app_users",
    """select seq, g.caller_id as user_id, ifnull(u.permission = 'full_access', false) as is_full_access
from toggles g left join app_users u on u.user_id = g.caller_id""",
)
def full_access_callers(t: Tables) -> DataFrame:
    return access.has_full_access(t.toggles.select("seq", F.col("caller_id").alias("user_id")), t.app_users)


@query(
    "ac_13",
    "jobs job_notes",
    """select n.id, n.job_id from job_notes n where n.visible_to_trolley
 and exists (select 1 from jobs j where j.id = n.job_id and j.job_date = (select max_by(d.job_date, d.n) from
  (select j2.job_date, count(*) * 100000 + datediff('day', date '1970-01-01', j2.job_date) as n
   from job_notes n2 join jobs j2 on j2.id = n2.job_id group by j2.job_date) d))""",
)
def visible_job_notes(t: Tables) -> DataFrame:
    # Published here is the day whose jobs have the most notes, the later one of equals.
    per_job = t.job_notes.groupBy("job_id").agg(F.count("*").alias("_notes"))
    per_day = (
        per_job.join(t.jobs.select(F.col("id").alias("job_id"), "job_date"), "job_id")
        .groupBy("job_date")
        .agg(F.sum("_notes").alias("_notes"))
    )
    busiest = per_day.agg(F.max_by("job_date", F.struct("_notes", "job_date")).alias("job_date")).withColumn("id", F.lit(1))
    return access.visible("job_notes", "anon", t.job_notes, busiest, t.jobs).select("id", "job_id")


_RULE_ROWS = {
    "jobs": ("published day,,,", "all rows,,,", "all rows,all rows,all rows,all rows"),
    "counts": ("all rows,published day,published day,", "all rows,all rows,,", "all rows,all rows,,"),
    "dip_items": (",,,", "all rows,,,", "all rows,all rows,all rows,all rows"),
    "item_reference": (",,,", "all rows,,,", "all rows,all rows,all rows,all rows"),
    "published_day": ("all rows,,,", "all rows,,,", "all rows,,all rows,"),
    "item_reference_notes": ("visible to the floor,,,", "all rows,,,", "all rows,all rows,all rows,all rows"),
    "additions": (",,,", "all rows,all rows,all rows,all rows", "all rows,all rows,all rows,all rows"),
    "job_pace": ("all rows,,,", "all rows,all rows,all rows,all rows", "all rows,all rows,all rows,all rows"),
    "app_users": (",,,", "all rows,,,", "all rows,,,"),
    "trolley_jobs": ("all rows,,,", ",,,", ",,,"),
    "job_summary": (",,,", "all rows,,,", "all rows,,,"),
}
_RULES_SQL = ",\n ".join(
    f"('{relation}', '{role}', '{operation}', '{scope}')"
    for relation, roles in _RULE_ROWS.items()
    for role, scopes in zip(("anon", "view_only", "full_access"), roles)
    for operation, scope in zip(("select", "insert", "update", "delete"), scopes.split(","))
)
_SIZES = {
    "jobs": "select count(*), count(*) filter (where job_date = (select job_date from published_day)) from jobs",
    "counts": "select count(*), count(*) from counts",
    "dip_items": "select count(*), 0 from dip_items",
    "item_reference": "select count(*), 0 from item_reference",
    "published_day": "select count(*), count(*) from published_day",
    "item_reference_notes": "select count(*), count(*) filter (where visible_to_trolley) from notes",
    "additions": "select count(*), 0 from additions",
    "job_pace": "select count(*), count(*) from job_pace",
    "app_users": "select count(*), 0 from app_users",
    "trolley_jobs": "select count(*), count(*) from jobs where not coalesce(is_done, false)",
    "job_summary": "select count(*), 0 from jobs",
}
_SIZES_SQL = "\n union all ".join(
    f"select '{relation}' as relation, * from ({sql}) s(whole, floor)" for relation, sql in _SIZES.items()
)


def _governed(t: Tables, relation: str, rows: DataFrame, key: str) -> DataFrame:
    """Per role, the rows it reads and what becomes of each row it writes."""
    cells = access.every_cell(relation, rows, t.published_day)
    return cells.select("role", "operation", F.col(key).cast("string").alias("row_key"), "reason")


def _governed_sql(relation: str, table: str, key: str) -> str:
    cells = [
        (role, operation, scope)
        for role, scopes in zip(("anon", "view_only", "full_access"), _RULE_ROWS[relation])
        for operation, scope in zip(("select", "insert", "update", "delete"), scopes.split(","))
    ]
    values = ", ".join(f"('{role}', '{operation}', '{scope}')" for role, operation, scope in cells)
    return f"""select role, operation, cast({key} as varchar) as row_key, case when scope = '' then 'not granted' end as reason
from {table}, (values {values}) r(role, operation, scope) where operation <> 'select' or scope <> ''"""


# Inventory id, relation, table that holds it here, and its key.
_GOVERNED = [
    ("ac_03", "dip_items", "dip_items", "item_number"),
    ("ac_04", "item_reference", "item_reference", "id"),
    ("ac_05", "published_day", "published_day", "job_date"),
    ("ac_08", "additions", "additions", "seq"),
    ("ac_09", "job_pace", "job_pace", "job_date"),
    ("ac_10", "app_users", "app_users", "user_id"),
]


def _register_governed(name: str, relation: str, table: str, key: str) -> None:
    query(name, table, _governed_sql(relation, table, key))(lambda t: _governed(t, relation, t.table(table), key))


for _row in _GOVERNED:
    _register_governed(*_row)


# The same for the relations whose rules look at the row.
_OUTSIDE = "'outside the role''s rows'"


def _cells_sql(source: str, key: str, cells: dict[tuple[str, str], str]) -> str:
    """``cells`` has the condition, or 'all' or a quoted refusal, of each role and
    operation; those not named are not granted."""
    parts = []
    for role in ("anon", "view_only", "full_access"):
        for operation in ("select", "insert", "update", "delete"):
            rule = cells.get((role, operation), "'not granted'")
            reason = "null" if rule == "all" else rule if rule.startswith("'") else f"case when not ifnull({rule}, false) then {_OUTSIDE} end"
            parts.append(f"select '{role}' as role, '{operation}' as operation, {key} as row_key, {reason} as reason from s")
    return f"with s as ({source}), e as ({' union all '.join(parts)}) select * from e where operation <> 'select' or reason is null"


_ALL_WRITES = {("view_only", "select"): "all"} | {("full_access", op): "all" for op in ("select", "insert", "update", "delete")}


@query(
    "ac_02_cells",
    "jobs counts published_day",
    _cells_sql(
        "select c.*, j.job_date = (select job_date from published_day) as today from counts c left join jobs j on j.id = c.job_id",
        "job_id",
        {("anon", "select"): "all", ("anon", "insert"): "today", ("anon", "update"): "today"}
        | {(r, op): "all" for r in ("view_only", "full_access") for op in ("select", "insert")},
    ),
)
def all_counts_cells(t: Tables) -> DataFrame:
    cells = access.every_cell("counts", t.counts, t.published_day, t.jobs)
    return cells.select("role", "operation", F.col("job_id").alias("row_key"), "reason")


@query(
    "ac_06_cells",
    "chat_messages published_chat_day",
    _cells_sql(
        "select m.*, m.job_date = (select job_date from published_chat_day) as today from chat_messages m",
        "id",
        {
            ("anon", "select"): "today",
            ("anon", "insert"): "today and sender_role = 'trolley'",
            ("anon", "update"): "today and sender_role = 'admin'",
            ("view_only", "select"): "all",
            ("full_access", "select"): "all",
            ("full_access", "insert"): "all",
        },
    ),
)
def all_chat_cells(t: Tables) -> DataFrame:
    cells = access.every_cell("chat_messages", t.chat_messages, t.published_chat_day, changed=["read_at", "read_by"])
    return cells.select("role", "operation", F.col("id").alias("row_key"), "reason")


@query(
    "ac_07_cells",
    "notes",
    _cells_sql("select * from notes", "id", {("anon", "select"): "visible_to_trolley"} | _ALL_WRITES),
)
def all_part_note_cells(t: Tables) -> DataFrame:
    cells = access.every_cell("item_reference_notes", t.notes)
    return cells.select("role", "operation", F.col("id").alias("row_key"), "reason")


@query(
    "ac_13_cells",
    "job_notes jobs published_day",
    _cells_sql(
        """select n.*, j.job_date = (select job_date from published_day) as today
  from job_notes n left join jobs j on j.id = n.job_id""",
        "id",
        {("anon", "select"): "visible_to_trolley and today"} | _ALL_WRITES,
    ),
)
def all_job_note_cells(t: Tables) -> DataFrame:
    cells = access.every_cell("job_notes", t.job_notes, t.published_day, t.jobs)
    return cells.select("role", "operation", F.col("id").alias("row_key"), "reason")


@query(
    "ac_11",
    "jobs counts published_day",
    """select 'anon' as role, 'trolley_jobs' as view, id as job_id, am_number from jobs where not ifnull(is_done, false)
union all select 'anon', 'jobs', id, null from jobs where job_date = (select job_date from published_day)
union all select role, 'job_summary', id, am_number from jobs, (values ('view_only'), ('full_access')) r(role)""",
)
def visible_views(t: Tables) -> DataFrame:
    # The floor's view shows columns the floor cannot read on the jobs themselves.
    summary = views.job_summary(t.jobs, t.counts).withColumnRenamed("id", "job_id")
    floor = views.trolley_jobs(t.jobs, t.counts)
    rows = [
        (role, relation, access.visible(relation, role, view))
        for role in access.ROLES
        for relation, view in (("trolley_jobs", floor), ("job_summary", summary))
    ]
    shown = [
        df.select(F.lit(role).alias("role"), F.lit(relation).alias("view"), "job_id", "am_number")
        for role, relation, df in rows
    ]
    masked = access.visible("jobs", "anon", t.jobs, t.published_day).select(
        F.lit("anon").alias("role"),
        F.lit("jobs").alias("view"),
        F.col("id").alias("job_id"),
        F.lit(None).cast("string").alias("am_number"),
    )
    return _union([*shown, masked])


@query(
    "ac_matrix",
    "jobs counts dip_items item_reference published_day notes additions job_pace app_users",
    f"""with rules(relation, role, operation, scope) as (values {_RULES_SQL}),
sizes as ({_SIZES_SQL})
select r.relation, r.role, r.operation, r.scope <> '' as allowed, r.scope,
 case when s0.scope = '' then 0 when r.role = 'anon' then floor else whole end as visible_rows
from rules r join sizes using (relation)
join rules s0 on s0.relation = r.relation and s0.role = r.role and s0.operation = 'select'""",
)
def access_matrix(t: Tables) -> DataFrame:
    relations = {
        "jobs": t.jobs,
        "counts": t.counts,
        "dip_items": t.dip_items,
        "item_reference": t.item_reference,
        "published_day": t.published_day,
        "item_reference_notes": t.notes,
        "additions": t.additions,
        "job_pace": t.job_pace,
        "app_users": t.app_users,
        "trolley_jobs": views.trolley_jobs(t.jobs, t.counts),
        "job_summary": views.job_summary(t.jobs, t.counts),
    }
    return access.matrix(relations, t.published_day)


@query(
    "dq_01",
    "counts app_users additions job_pace chat_messages",
    """select 'counts' as relation, cast(job_id as varchar) as key_value, count(*) as row_count from counts group by job_id having count(*) > 1
union all select 'app_users', email, count(*) from app_users group by email having count(*) > 1
union all select 'additions', element, count(*) from additions group by element having count(*) > 1
union all select 'job_pace', cast(job_date as varchar), count(*) from job_pace group by job_date having count(*) > 1
union all select 'chat_messages', cast(id as varchar), count(*) from chat_messages group by id having count(*) > 1
union all select 'lineitem', l_orderkey || '/' || l_linenumber, count(*) from lineitem group by l_orderkey, l_linenumber having count(*) > 1""",
)
def duplicate_keys(t: Tables) -> DataFrame:
    keyed = [
        ("counts", t.counts, ["job_id"]),
        ("app_users", t.app_users, ["email"]),
        ("additions", t.additions, ["element"]),
        ("job_pace", t.job_pace, ["job_date"]),
        ("chat_messages", t.chat_messages, ["id"]),
        ("lineitem", t.lineitem, ["l_orderkey", "l_linenumber"]),
    ]
    return _union(
        [
            quality.duplicate_keys(rows, keys).select(
                F.lit(relation).alias("relation"), F.concat_ws("/", *keys).alias("key_value"), "row_count"
            )
            for relation, rows, keys in keyed
        ]
    )


@query(
    "dq_02",
    "jobs notes chat_messages",
    """select 'jobs' as relation, unnest(['am_number', 'item_number', 'job_date', 'grade']) as column_name,
 unnest([count(*) - count(am_number), count(*) - count(item_number), count(*) - count(job_date), count(*) - count(grade)]) as nulls from jobs
union all select 'item_reference_notes', unnest(['item_number', 'body', 'visible_to_trolley']),
 unnest([count(*) - count(item_number), count(*) - count(body), count(*) - count(visible_to_trolley)]) from notes
union all select 'chat_messages', unnest(['sender_role', 'body', 'sender_name']),
 unnest([count(*) - count(sender_role), count(*) - count(body), count(*) - count(sender_name)]) from chat_messages""",
)
def null_columns(t: Tables) -> DataFrame:
    checked = [
        ("jobs", t.jobs, ["am_number", "item_number", "job_date", "grade"]),
        ("item_reference_notes", t.notes, ["item_number", "body", "visible_to_trolley"]),
        ("chat_messages", t.chat_messages, ["sender_role", "body", "sender_name"]),
    ]
    return _union(
        [
            quality.null_counts(rows, columns).select(F.lit(relation).alias("relation"), "column_name", "nulls")
            for relation, rows, columns in checked
        ]
    )


@query(
    "dq_02_observed",
    "jobs chat_messages app_users",
    """select 'jobs' as relation, unnest(['rows', 'no am_number', 'no grade', 'no job_date']) as check_name,
 unnest([count(*), count(*) - count(am_number), count(*) - count(grade), count(*) - count(job_date)]) as found from jobs
union all select 'chat_messages', unnest(['rows', 'no sender_name', 'sender_role']),
 unnest([count(*), count(*) filter (sender_name is null), count(*) filter (sender_role not in ('admin', 'trolley'))]) from chat_messages
union all select 'app_users', unnest(['rows', 'permission', 'wrong key']),
 unnest([count(*), count(*) filter (permission not in ('view_only', 'full_access')), count(*) filter (user_id <> 1)]) from app_users""",
)
def observed_while_stored(t: Tables) -> DataFrame:
    checked = [
        ("jobs", t.jobs, {f"no {c}": quality.missing(c) for c in ("am_number", "grade", "job_date")}),
        (
            "chat_messages",
            t.chat_messages,
            {"no sender_name": quality.missing("sender_name"), "sender_role": quality.not_allowed("sender_role", quality.SENDER_ROLES)},
        ),
        (
            "app_users",
            t.app_users,
            {"permission": quality.not_allowed("permission", quality.PERMISSIONS), "wrong key": F.col("user_id") != 1},
        ),
    ]
    found = []
    for relation, rows, checks in checked:
        folder = new_folder(t.spark, relation)
        counts = quality.write_checked(rows, checks, lambda seen, folder=folder: seen.write.parquet(folder))
        found += [(relation, name, count) for name, count in counts.items()]
    return t.spark.createDataFrame(found, "relation string, check_name string, found long")


@query(
    "dq_03",
    "chat_messages additions user_commands",
    """select 'chat_messages' as relation, id as row_key, sender_role as "value" from chat_messages where sender_role = 'system'
union all select 'additions', seq, element from additions where element = 'Xx'
union all select 'user_commands', command_id, permission from user_commands where permission = 'boss'""",
)
def domain_violations(t: Tables) -> DataFrame:
    checked = [
        ("chat_messages", t.chat_messages, "id", "sender_role", quality.SENDER_ROLES),
        ("additions", t.additions, "seq", "element", quality.ELEMENTS),
        ("user_commands", t.user_commands, "command_id", "permission", quality.PERMISSIONS),
    ]
    return _union(
        [
            quality.outside_domain(rows, column, allowed).select(
                F.lit(relation).alias("relation"), F.col(key).alias("row_key"), F.col(column).alias("value")
            )
            for relation, rows, key, column, allowed in checked
        ]
    )


@query(
    "dq_04",
    "published_day jobs",
    """select 'published_day' as relation, count(*) as row_count, count(*) filter (where id <> 1) as wrong_keys,
 count(*) = 1 and bool_and(id = 1) as is_valid from published_day
union all select 'jobs', count(*), count(*) filter (where id <> 1), false from jobs""",
)
def singleton_states(t: Tables) -> DataFrame:
    return _union(
        [
            quality.singleton_state(rows).select(F.lit(relation).alias("relation"), "row_count", "wrong_keys", "is_valid")
            for relation, rows in (("published_day", t.published_day), ("jobs", t.jobs))
        ]
    )


@query(
    "dq_05",
    "jobs counts notes item_reference job_pace toggles app_users",
    """select 'counts' as relation, job_id as row_key from counts where job_id not in (select id from jobs where status <> 'pulled')
union all select 'notes', id from notes where item_number not in (select item_number from item_reference)
union all select 'job_pace', current_job_id from job_pace where current_job_id not in (select id from jobs where status <> 'pulled')
union all select 'toggles', seq from toggles where caller_id not in (select user_id from app_users)""",
)
def orphans(t: Tables) -> DataFrame:
    kept = t.jobs.where("status <> 'pulled'")
    found = {
        "counts": quality.orphans(t.counts, "job_id", kept, "id").select(F.col("job_id").alias("row_key")),
        "notes": quality.orphans(t.notes, "item_number", parts.latest_reference(t.item_reference), "item_number").select(
            F.col("id").alias("row_key")
        ),
        "job_pace": quality.orphans(t.job_pace, "current_job_id", kept, "id").select(F.col("current_job_id").alias("row_key")),
        "toggles": quality.orphans(t.toggles, "caller_id", t.app_users, "user_id").select(F.col("seq").alias("row_key")),
    }
    return _union([df.select(F.lit(relation).alias("relation"), "row_key") for relation, df in found.items()])


@query(
    "dq_06",
    "user_commands app_users",
    """select command_id, action, case when caller_id is null then 'not authenticated'
 when caller_id not in (select user_id from app_users where is_owner) then 'only the owner can manage users'
 when action = 'list' then 'ok'
 when action = 'create' and (ifnull(email, '') = '' or ifnull(password, '') = '' or ifnull(name, '') = '')
  then 'email, password, and name are required'
 when action = 'create' and length(password) < 8 then 'password must be at least 8 characters'
 when action = 'create' and (permission is null or permission = 'boss') then 'invalid permission'
 when action = 'create' then 'ok'
 when action = 'rename' then 'unknown action'
 when user_id is null then 'user_id required'
 when action = 'delete' then if(user_id = caller_id, 'you can''t delete your own account', 'ok')
 when permission = 'boss' then 'invalid permission'
 when user_id = caller_id and permission = 'view_only' then 'you can''t downgrade your own account'
 else 'ok' end as result from user_commands""",
)
def command_results(t: Tables) -> DataFrame:
    return quality.command_result(t.user_commands, t.app_users).select("command_id", "action", "result")


