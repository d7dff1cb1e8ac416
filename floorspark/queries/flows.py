"""The floor list and the plan intake from start to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspark.operators import flows, notes
from floorspark.queries.columns import ETA_STEPS, EXTRACTED, PRODUCT, TOTAL
from floorspark.queries.registry import query
from floorspark.queries.streams import BURSTS, FOLD_RESULT, FOLD_STEPS, GAP_SECONDS
from floorspark.sources.tables import Tables

AS_OF = "timestamp'2024-01-02 06:00:00'"


@query(
    "floor_list",
    "jobs counts job_pace notes published_day",
    f"""with {ETA_STEPS}
select s.rn as day_position, s.id as job_id, j.am_number, j.planned_qty, j.mingzhi_hansberg_no, {TOTAL} as total_cores,
 case when {TOTAL} <> {PRODUCT} then {TOTAL} end as rebuilt_override,
 case when w.eta is null then '' else strftime(p.started_at + cast(floor(w.eta + 0.5) as bigint) * interval '1' millisecond, '%H:%M') end as eta,
 s.rn = s.cur as is_current, j.needs_dipping as dip, ifnull(c.still_making, false) as making,
 ifnull(j.item_number in (select item_number from notes where visible_to_trolley), false) as has_notes
from steps s join published_day d on d.job_date = s.job_date join jobs j on j.id = s.id left join counts c on c.job_id = s.id
left join walk w on w.id = s.id left join job_pace p on p.job_date = s.job_date""",
    recursive=True,
)
def floor_list(t: Tables) -> DataFrame:
    return flows.floor_list(t.jobs, t.counts, t.job_pace, t.notes, t.published_day, F.expr(AS_OF))


@query(
    "plan_rows",
    "envelopes jobs item_reference dip_items",
    f"""with {EXTRACTED}, record as (select item_number, grade, cast(weight_kg as double) as weight_kg, is_doubles, needs_dipping
 from item_reference qualify row_number() over (partition by item_number order by updated_at desc nulls last, id desc) = 1),
rows as (select e.*, ifnull(e.item_number in (select item_number from dip_items), false) as dipping from extracted e join admitted using (req_id)),
checked as (select w.*, r.item_number is not null as known, concat_ws(',', if(w.grade is distinct from r.grade, 'grade', null),
   if(w.weight_kg is distinct from r.weight_kg, 'weight_kg', null), if(w.is_doubles <> r.is_doubles, 'is_doubles', null),
   if(w.dipping <> r.needs_dipping, 'needs_dipping', null)) as differing
 from rows w left join record r on r.item_number = w.item_number)
select req_id, row_no, dipping as needs_dipping,
 case when item_number is null then null when not known then 'new_part' when differing = '' then 'exact' else 'variant' end as part_check,
 case when item_number is null then null when known then differing else '' end as differing_fields,
 if(exists (select 1 from jobs j where j.am_number = checked.am_number and j.item_number = checked.item_number
  and j.job_date = date '2024-01-02'), 'edit', 'insert') as action from checked""",
)
def plan_rows(t: Tables) -> DataFrame:
    rows = flows.plan_rows(t.requests, t.jobs, t.item_reference, t.dip_items, F.expr(AS_OF))
    return rows.select("req_id", "row_no", "needs_dipping", "part_check", "differing_fields", "action")


# Pulled jobs stand for deleted ones; the busiest edited day for the published one.
_SAVE_JOBS = "jobs where status <> 'pulled'"
_SAVE_DAY = f"""(select job_date from (select job_date, count(*) as n from {_SAVE_JOBS}
  and id in (select job_id from edits) group by job_date) b order by n desc, job_date desc limit 1)"""


def _save_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    jobs = t.jobs.where("status <> 'pulled'")
    edited = t.edits.select(F.col("job_id").alias("id")).distinct()
    busiest = jobs.join(edited, "id", "left_semi").groupBy("job_date").agg(F.count("*").alias("_n"))
    day = busiest.agg(F.max_by("job_date", F.struct("_n", "job_date")).alias("job_date")).withColumn("id", F.lit(1))
    return jobs, day


@query(
    "save_flow",
    "counts edits jobs",
    f"""with {BURSTS}, {FOLD_STEPS}, folded as ({FOLD_RESULT}),
sent as (select job_id, count(*) as saves from bursts group by job_id)
select folded.*, saves, case when j.id is null then 'deleted' when j.job_date = {_SAVE_DAY} then 'applied' else 'not published' end as outcome
from folded join sent using (job_id) left join (select id, job_date from {_SAVE_JOBS}) j on j.id = folded.job_id""",
    recursive=True,
)
def save_flow(t: Tables) -> DataFrame:
    jobs, day = _save_tables(t)
    return flows.save_outcomes(t.edits, t.counts, jobs, day, GAP_SECONDS).drop("updated_at")


@query(
    "save_flow_counts",
    "counts edits jobs",
    f"""with {FOLD_STEPS}, folded as ({FOLD_RESULT}),
applied as (select * from folded where job_id in (select id from {_SAVE_JOBS} and job_date = {_SAVE_DAY}))
select job_id, group_a_cores, group_a_trolleys, group_b_cores, group_b_trolleys, manual_total_override from applied
union all
select job_id, group_a_cores, group_a_trolleys, group_b_cores, group_b_trolleys, manual_total_override from counts
where job_id not in (select job_id from applied)""",
    recursive=True,
)
def save_flow_counts(t: Tables) -> DataFrame:
    jobs, day = _save_tables(t)
    outcomes = flows.save_outcomes(t.edits, t.counts, jobs, day, GAP_SECONDS)
    kept = ["job_id", "group_a_cores", "group_a_trolleys", "group_b_cores", "group_b_trolleys", "manual_total_override"]
    return flows.saved_counts(outcomes, t.counts.select(*kept))


@query(
    "floor_notes",
    "jobs notes published_day",
    """select j.id as job_id, j.item_number, n.id as note_id,
 row_number() over (partition by j.id order by n.created_at desc, n.id desc) as place,
 replace(replace(replace(replace(n.body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as body
from jobs j join published_day p on p.job_date = j.job_date and p.id = 1 join notes n on n.item_number = j.item_number
where n.visible_to_trolley and j.item_number <> ''""",
)
def floor_notes(t: Tables) -> DataFrame:
    return notes.under_jobs(t.jobs, t.notes, t.published_day)
