"""SQL that derives the floor tables from the order, event and text tables.

Each text is portable: Spark runs it with DataFrames bound to the ``{name}``
placeholders, and the SQL checks use it as a common table expression. Every
binding keeps all rows of its source; a ``where`` states a business condition
only. Key columns take as many values as the data has parts, jobs or messages.
"""

from __future__ import annotations

import re

BINDINGS: dict[str, str] = {
    # One planned job per order. Nulls, blank items, zero quantities and missing
    # flags occur; a work-order number covers some thirty jobs on many days.
    "jobs": """
select o_orderkey as id,
 'AM' || cast(cast(floor(o_orderkey / 30) as bigint) as varchar(20)) as am_number,
 case when o_orderkey % 50 = 0 then null when o_orderkey % 50 = 1 then ''
  else 'P' || cast(o_custkey as varchar(20)) end as item_number,
 case when o_orderkey % 41 = 0 then null else o_orderstatus end as grade,
 'Customer ' || cast(o_custkey as varchar(20)) as customer_name,
 case when o_custkey % 10 = 0 then null
  else cast(o_custkey % 50 + case when o_orderpriority = '1-URGENT' then 0.625 else 0.125 end as decimal(18,3)) end as weight_kg,
 case when o_orderkey % 23 = 0 then null when o_orderkey % 29 = 0 then 0
  else cast(o_orderkey % 120 + 1 as int) end as planned_qty,
 'M' || cast(o_custkey % 9 as varchar(20)) as mingzhi_hansberg_no,
 case o_orderstatus when 'P' then 'pulled' when 'O' then 'open' else 'cast' end as status,
 o_orderpriority = '1-URGENT' as is_trial,
 case when o_orderkey % 19 = 0 then null else o_orderkey % 3 = 0 end as is_doubles,
 o_orderkey % 4 = 0 as needs_dipping,
 case when o_orderkey % 37 = 0 then null else o_orderstatus = 'F' end as is_done,
 cast(o_orderdate as date) as job_date,
 case when o_orderkey % 11 = 0 then null else o_orderkey % 7 end as sort_order,
 o_orderdate + (o_orderkey * 7919 % 86400) * interval '1' second as created_at
from {orders}""",
    # At most one row per job; a job without line items has none.
    "counts": """
select l_orderkey as job_id,
 cast(max(case when l_linenumber <= 3 then l_quantity end) as int) as group_a_cores,
 cast(sum(case when l_linenumber <= 3 then 1 else 0 end) as int) as group_a_trolleys,
 cast(max(case when l_linenumber > 3 then l_quantity end) as int) as group_b_cores,
 cast(sum(case when l_linenumber > 3 then 1 else 0 end) as int) as group_b_trolleys,
 case when l_orderkey % 7 = 0 then cast(sum(l_quantity) as int) end as manual_total_override,
 case when l_orderkey % 5 = 0 then null else 'c' || cast(l_orderkey as varchar(20)) end as comment,
 case when l_orderkey % 13 = 0 then null else l_orderkey % 2 = 0 end as still_making
from {lineitem} group by l_orderkey""",
    # First retired layout of counts.
    "counts_v0": """
select l_orderkey as job_id, cast(max(l_quantity) as int) as cores_per_trolley,
 cast(count(*) as int) as trolley_count,
 cast(case when l_orderkey % 7 = 0 then sum(l_quantity) end as int) as manual_total_override
from {lineitem} group by l_orderkey""",
    # One pace row per day: null, stale and live current jobs; rate null, 0 or 12.
    "job_pace": """
select cast(o_orderdate as date) as job_date,
 case when max(o_orderkey) % 3 = 0 then null when max(o_orderkey) % 3 = 1 then max(o_orderkey)
  else min(o_orderkey) end as current_job_id,
 case when max(o_orderkey) % 17 = 0 then null
  else cast(cast(o_orderdate as date) as timestamp) + interval '6' hour end as started_at,
 case when max(o_orderkey) % 10 = 0 then null when max(o_orderkey) % 10 = 1 then 0 else 12 end as tons_per_hour,
 case when max(o_orderkey) % 4 = 0 then 3 when max(o_orderkey) % 4 = 1 then 0 end as remaining_qty
from {orders} group by cast(o_orderdate as date)""",
    # Latest day with at least five jobs.
    "published_day": """
select 1 as id, max(job_date) as job_date from
 (select cast(o_orderdate as date) as job_date, count(*) as n from {orders} group by cast(o_orderdate as date)) d
where n >= 5""",
    # Confirmed part variants: the finished jobs that name a part.
    "item_reference": """
select id, am_number, item_number, grade, weight_kg, coalesce(is_doubles, false) as is_doubles, needs_dipping,
 case when id % 6 = 0 then null else created_at end as updated_at
from {jobs} where item_number is not null and item_number <> '' and is_done""",
    # Remembered dipping parts.
    "dip_items": """
select item_number, true as needs_dipping, max(created_at) as updated_at
from {jobs} where needs_dipping and item_number <> '' and is_done group by item_number""",
    # Notes per part, whole document texts as bodies.
    "notes": """
select d.doc_id as id, 'P' || cast(cast(floor(d.doc_id / 3) as bigint) as varchar(20)) as item_number, d.text as body,
 coalesce(l.quality = 1, false) as visible_to_trolley,
 timestamp '2024-01-01 00:00:00' + d.doc_id * interval '1' minute as created_at
from {documents} d left join (select doc_id, max(quality) as quality from {labels} group by doc_id) l
 on l.doc_id = d.doc_id""",
    # Retired notes per job.
    "job_notes": """
select doc_id as id, cast(floor(doc_id / 3) as bigint) as job_id, text as body, doc_id % 2 = 0 as visible_to_trolley,
 timestamp '2024-01-01 00:00:00' + doc_id * interval '1' minute as created_at
from {documents}""",
    # Chat messages; 'system' rows break the sender_role domain.
    "chat_messages": """
select conv_id * 1000 + turn as id, cast(date '2024-01-01' + cast(conv_id % 30 as int) as date) as job_date,
 case role when 'assistant' then 'admin' when 'user' then 'trolley' else role end as sender_role,
 case conv_id % 3 when 0 then null when 1 then '' else 'Floor ' || cast(conv_id as varchar(20)) end as sender_name,
 text as body,
 timestamp '2024-01-01 06:00:00' + (conv_id * 1000 + turn) * interval '1' second as created_at,
 case when turn % 3 = 0 then timestamp '2024-03-01 00:00:00' end as read_at,
 case when turn % 3 = 0 then 'Floor' end as read_by
from {conversations}""",
    "published_chat_day": """
select 1 as id, max(job_date) as job_date from {chat_messages}""",
    # Last message each day's floor side has read; null where it read none.
    "chat_seen": """
select job_date, max(case when sender_role = 'trolley' and read_at is not null then created_at end) as last_seen
from {chat_messages} group by job_date""",
    # Count edits in arrival order.
    "edits": """
select user_id as job_id, event_id as seq, ts,
 case when event_id % 2 = 0 then 'a' else 'b' end as box,
 case event_type when 'click' then 'plus' when 'view' then 'minus' when 'purchase' then 'cores'
  when 'signup' then 'total' else case when event_id % 4 < 2 then 'comment' else 'making' end end as kind,
 case when event_id % 9 = 0 then 'n/a' when event_id % 9 = 1 then cast(event_id % 60 as varchar(20)) || 'x'
  else cast(event_id % 60 as varchar(20)) end as raw,
 event_id % 3 = 0 as checked
from {events}""",
    # Done and dipping toggles; the latest by seq wins.
    "toggles": """
select event_id as seq, user_id as job_id, cast(floor(value) as bigint) as caller_id,
 event_type in ('click', 'view') as flag, ts
from {events} where event_type <> 'error'""",
    # Saved payloads as they arrive; a replay carries an older updated_at.
    "saves": """
select user_id as job_id, event_id as seq, cast(event_id % 60 as int) as group_a_cores,
 cast(event_id % 8 as int) as group_a_trolleys,
 ts - (event_id % 3) * interval '9' hour as updated_at, event_type = 'error' as offline
from {events}""",
    "pixels": """
select l_orderkey as frame_id, l_orderkey % 8 + 1 as device, cast(l_quantity as int) as x, l_linenumber * 7 as y,
 l_quantity * 5 as r, l_tax * 1000 as g, l_discount * 1000 as b, l_orderkey % 10 = 0 as frozen
from {lineitem}""",
    # Calibration points per device, from clean to noisy.
    "cal": """
select cast(l_linenumber as bigint) as device, l_discount * 10 as idx,
 800 + 8000 * l_discount + (l_linenumber - 1) * l_tax * 3000 as temp
from {lineitem}""",
    "cal_seq": """
select user_id % 7 as device, event_id as seq, value / 100 as idx, 1000 + event_id % 500 as temp
from {events}""",
    "app_users": """
select c_custkey as user_id, lower(replace(c_name, '#', '')) || '@example.com' as email, c_name as name,
 case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'view_only' else 'full_access' end as permission,
 c_custkey = 0 as is_owner,
 timestamp '2024-01-01 00:00:00' + (c_custkey * 7919 % 86400) * interval '1' second as created_at
from {customer}""",
    # Presence flags separate an absent field from a null one.
    "patches": """
select c_custkey as user_id, c_custkey % 2 = 0 as has_name,
 case when c_custkey % 4 = 0 then 'N' || cast(c_custkey as varchar(20)) end as name,
 c_custkey % 3 = 0 as has_permission,
 case when c_custkey % 6 = 0 then 'view_only' else 'full_access' end as permission
from {customer}""",
    # User-admin commands with every kind of defect.
    "user_commands": """
select c_custkey as command_id, case when c_custkey % 12 = 5 then null when c_custkey % 4 = 3 then c_custkey else 0 end as caller_id,
 case c_custkey % 5 when 0 then 'create' when 1 then 'update' when 2 then 'delete' when 3 then 'list' else 'rename' end as action,
 case when c_custkey % 11 = 0 then null when c_custkey % 13 = 0 then ''
  else lower(replace(c_name, '#', '')) || '@example.com' end as email,
 case when c_custkey % 17 = 0 then null when c_custkey % 4 = 0 then 'short' else 'long enough' end as password,
 case when c_custkey % 19 = 0 then '' else c_name end as name,
 case when c_custkey % 6 = 0 then 'boss' when c_custkey % 10 = 1 then null when c_custkey % 3 = 1 then 'view_only'
  else 'full_access' end as permission,
 case when c_custkey % 23 = 0 then null when c_custkey % 7 < 3 then 0 else c_custkey end as user_id
from {customer}""",
    # Proposed dosing rates; 'Xx' is not a known element.
    "additions": """
select case s_suppkey % 8 when 0 then 'Cr' when 1 then 'Cu' when 2 then 'Mo' when 3 then 'Sn' when 4 then 'Ni'
  when 5 then 'Gr' when 6 then 'Ti' else 'Xx' end as element,
 cast(s_nationkey * 0.25 as decimal(18,3)) as per_tonne, s_suppkey as seq
from {supplier}""",
    # Extraction requests: wrong role, no image, oversize, upstream failure, no
    # body, cut-off JSON, empty list, and two rows with one float-typed quantity.
    "envelopes": """
select o_orderkey as req_id,
 case when o_orderkey % 13 = 0 then 'anon' when o_orderkey % 31 = 0 then null else 'authenticated' end as role,
 case when o_orderkey % 17 = 0 then null when o_orderkey % 19 = 0 then 11184811 else 1000 end as image_len,
 case when o_orderkey % 43 = 0 then 503 else 200 end as upstream_status,
 case when o_orderkey % 23 = 0 then null when o_orderkey % 29 = 0 then '[{{"grade":'
  when o_orderkey % 7 = 0 then '[]'
  else '[{{"am_number":"AM' || cast(o_orderkey as varchar(20)) || '","item_number":"P' || cast(o_custkey as varchar(20))
   || '","grade":"' || o_orderstatus || '","planned_qty":' || cast(o_orderkey % 120 as varchar(20))
   || ',"weight_kg":12.5,"ratio":"' || case when o_orderkey % 2 = 0 then '2/1' else '1/1' end
   || '","is_trial":true}},{{"am_number":null,"planned_qty":3.0,"is_doubles":true}}]' end as body
from {orders}""",
}

_PLACEHOLDER = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def inputs(name: str) -> list[str]:
    """Tables the binding reads, in order of first use."""
    return list(dict.fromkeys(_PLACEHOLDER.findall(BINDINGS[name])))


def with_clause(names: list[str] | tuple[str, ...], recursive: bool = False) -> str:
    """The bindings as common table expressions, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in BINDINGS and name not in ordered:
            for source in inputs(name):
                add(source)
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as ({BINDINGS[n].format(**{s: s for s in inputs(n)}).strip()})" for n in ordered]
    return ("with recursive " if recursive else "with ") + ",\n".join(parts)
