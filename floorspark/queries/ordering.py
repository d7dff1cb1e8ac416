"""Windows, sorts and top-1 selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspark.functions import formulas as fx
from floorspark.operators import calibration, changes, chat, edits, eta, parts, views
from floorspark.operators.notes import note_counts
from floorspark.plans.ordered import OrderedGroups
from floorspark.queries.columns import ETA_STEPS, OPEN, project_etas
from floorspark.queries.registry import plain, query
from floorspark.sources.tables import Tables


@query(
    "wn_01",
    "jobs",
    """select id, rank() over (partition by job_date order by created_at, id) as created_position,
 coalesce(sort_order, rank() over (partition by job_date order by created_at, id)) as sort_order from jobs""",
)
def created_positions(t: Tables) -> DataFrame:
    return changes.fill_sort_order(t.jobs).select("id", "created_position", "sort_order")


@query(
    "wn_02",
    "jobs job_pace",
    f"""with open_jobs as (select * from jobs where {OPEN})
select d.job_date, case when exists (select 1 from open_jobs o where o.job_date = d.job_date and o.id = p.current_job_id)
 then p.current_job_id else (select o.id from open_jobs o where o.job_date = d.job_date order by sort_order nulls last, id limit 1)
 end as current_job_id
from (select distinct job_date from open_jobs) d left join job_pace p on p.job_date = d.job_date""",
)
def current_jobs(t: Tables) -> DataFrame:
    return eta.current_jobs(t.jobs.where(fx.is_open()), t.job_pace).select("job_date", "current_job_id")


@query(
    "wn_03",
    "jobs job_pace",
    f"""with {ETA_STEPS}
select s.id, s.job_date, cast(floor(w.eta + 0.5) as bigint) as eta_offset_ms, s.rn = s.cur as is_current
from steps s left join walk w on w.id = s.id""",
    recursive=True,
)
def eta_projection(t: Tables) -> DataFrame:
    return project_etas(t).select("id", "job_date", "eta_offset_ms", "is_current")


CLAMPED = """steps as (select job_id, box, seq, if(kind = 'plus', 1, -1) as step,
  row_number() over (partition by job_id, box order by seq) as rn from edits where kind in ('plus', 'minus')),
walk as (
 select job_id, box, seq, rn, greatest(0, step) as v from steps where rn = 1
 union all
 select n.job_id, n.box, n.seq, n.rn, greatest(0, w.v + n.step) from walk w
  join steps n on n.job_id = w.job_id and n.box = w.box and n.rn = w.rn + 1)"""


@query(
    "wn_04",
    "edits",
    f"""with {CLAMPED}
select job_id, box, seq, cast(v as bigint) as "value" from walk""",
    recursive=True,
)
def clamped_counters(t: Tables) -> DataFrame:
    return edits.clamped_counter(t.edits)


@query(
    "wn_05",
    "edits",
    """select job_id, if(kind = 'total', try_cast(replace(raw, 'x', '') as int), null) as manual_total_override from edits
where kind in ('plus', 'minus', 'cores', 'total') qualify seq = max(seq) over (partition by job_id)""",
)
def typed_totals(t: Tables) -> DataFrame:
    return edits.typed_total(t.edits)


@query(
    "wn_06",
    "cal_seq",
    """select device, seq, n, case when ok then round(a, 4) end as a, case when ok then round(b, 4) end as b,
 case when ok then round(case when n * vy > 1e-9 then r2 else 1 end, 4) end as r2
from (select device, seq, regr_count(temp, idx) over w as n, regr_slope(temp, idx) over w as a, regr_intercept(temp, idx) over w as b,
  regr_r2(temp, idx) over w as r2, var_pop(temp) over w as vy,
  count(*) over w >= 2 and var_pop(idx) over w * power(count(*) over w, 2) >= 1e-9 as ok
 from cal_seq window w as (partition by device order by seq rows unbounded preceding)) f""",
)
def fit_history(t: Tables) -> DataFrame:
    history = calibration.fit_history(t.cal_seq)
    return history.select("device", "seq", "n", *[F.round(c, 4).alias(c) for c in ("a", "b", "r2")])


@query(
    "so_01",
    "jobs",
    """select id, job_date, row_number() over (partition by job_date order by coalesce(sort_order, 9e18), id) as day_position
from jobs order by job_date desc, day_position""",
)
def listed_jobs(t: Tables) -> DataFrame:
    return views.listed(t.jobs).select("id", "job_date", "day_position")


@query(
    "so_02",
    "chat_messages",
    """select m.job_date, count(*) as place, m.id, any_value(case when m.sender_role <> 'trolley' then 'Office'
  when length(m.sender_name) > 0 then m.sender_name else 'You' end) as author, any_value(strftime(m.created_at, '%H:%M')) as sent
from chat_messages m join chat_messages e on e.job_date = m.job_date and (e.created_at, e.id) <= (m.created_at, m.id)
group by m.job_date, m.id""",
)
def chat_thread(t: Tables) -> DataFrame:
    return chat.thread(t.chat_messages).drop("body")


@query(
    "so_03",
    "jobs notes",
    """select j.id, j.item_number, n.notes, n.newest_at from jobs j join (select item_number, count(*) as notes,
  cast(max(epoch(created_at)) as bigint) as newest_at from notes where visible_to_trolley group by item_number) n using (item_number)""",
)
def newest_notes(t: Tables) -> DataFrame:
    return plain(note_counts(t.jobs.select("id", "item_number"), t.notes))


@query(
    "so_04",
    "app_users",
    """select user_id, email, created_day, row_number() over (partition by created_day order by created_at, user_id) as place
from (select *, cast(created_at as date) as created_day from app_users) u order by created_at""",
)
def listed_users(t: Tables) -> DataFrame:
    users = t.app_users.withColumn("created_day", F.col("created_at").cast("date"))
    order = [F.col("created_at").asc_nulls_last(), F.col("user_id").asc()]
    placed = OrderedGroups(users, ["created_day"], order).numbered("place")
    return placed.rows.orderBy("created_at", "user_id").select("user_id", "email", "created_day", "place")


@query(
    "so_05",
    "item_reference",
    """select item_number, id, grade, cast(weight_kg as double) as weight_kg from item_reference
qualify row_number() over (partition by item_number order by updated_at desc nulls last, id desc) = 1""",
)
def top_reference(t: Tables) -> DataFrame:
    return plain(parts.latest_reference(t.item_reference).select("item_number", "id", "grade", "weight_kg"))


@query(
    "so_06",
    "jobs",
    f"""select job_date, id from jobs where {OPEN}
qualify row_number() over (partition by job_date order by sort_order nulls last, id) = 1""",
)
def first_open_jobs(t: Tables) -> DataFrame:
    return t.jobs.where(fx.is_open()).groupBy("job_date").agg(F.min_by("id", views.list_key()).alias("id"))


@query(
    "so_07",
    "jobs",
    """with ends as (select job_date, min(id) as first_id, max(id) as second_id from jobs group by job_date)
select j.id, case j.id when e.first_id then s.sort_order when e.second_id then f.sort_order else j.sort_order end as sort_order
from jobs j join ends e on e.job_date = j.job_date join jobs f on f.id = e.first_id join jobs s on s.id = e.second_id""",
)
def swapped_order(t: Tables) -> DataFrame:
    ends = t.jobs.groupBy("job_date").agg(F.min("id").alias("first_id"), F.max("id").alias("second_id"))
    swaps = ends.where("first_id <> second_id").select("first_id", "second_id")
    return changes.swap_sort_order(t.jobs, swaps).select("id", "sort_order")


@query(
    "so_08",
    "jobs",
    "select id, ifnull(sort_order, cast(floor(epoch(created_at)) as bigint)) as sort_order from jobs",
)
def default_order(t: Tables) -> DataFrame:
    return changes.default_sort_order(t.jobs).select("id", "sort_order")
