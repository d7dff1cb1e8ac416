"""Joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspark.functions import formulas as fx
from floorspark.operators import calibration, changes, chat, notes, parts, views
from floorspark.queries.columns import ENTRY_ROWS, HEIGHT, MEANS, OPEN, RAW_FIT, TOTAL, WIDTH
from floorspark.queries.registry import plain, query
from floorspark.sources.tables import Tables


@query(
    "jn_01",
    "jobs counts",
    f"""select j.id as job_id, j.am_number, j.item_number, j.planned_qty, cast(j.weight_kg as double) as weight_kg, j.is_doubles,
 j.mingzhi_hansberg_no, j.job_date, j.needs_dipping, j.sort_order, ifnull(group_a_cores, 0) as group_a_cores,
 ifnull(group_a_trolleys, 0) as group_a_trolleys, ifnull(group_b_cores, 0) as group_b_cores,
 ifnull(group_b_trolleys, 0) as group_b_trolleys, ifnull(comment, '') as comment, ifnull(still_making, false) as still_making,
 {TOTAL} as total_cores
from jobs j left join counts c on c.job_id = j.id where {OPEN}""",
)
def trolley_jobs(t: Tables) -> DataFrame:
    return plain(views.trolley_jobs(t.jobs, t.counts))


@query(
    "jn_02",
    "jobs counts",
    f"""select j.id, j.am_number, j.item_number, j.grade, j.customer_name, cast(j.weight_kg as double) as weight_kg,
 j.planned_qty, j.mingzhi_hansberg_no, j.status, j.is_trial, j.is_doubles, j.needs_dipping, j.is_done, j.job_date,
 j.sort_order, cast(epoch(j.created_at) as bigint) as created_at, ifnull(c.comment, '') as comment,
 ifnull(c.still_making, false) as still_making, {TOTAL} as counted_total,
 {TOTAL} / if(ifnull(is_doubles, false), 2.0, 1.0) as effective_qty,
 cast(floor({TOTAL} * if(ifnull(is_doubles, false), 1, 2) * cast(ifnull(weight_kg, 0) * 1000 as bigint) / 2000.0 + 0.5) / 1000 as double) as tonnage
from jobs j left join counts c on c.job_id = j.id""",
)
def job_summary(t: Tables) -> DataFrame:
    return plain(views.job_summary(t.jobs, t.counts))


@query(
    "jn_03",
    "jobs job_notes",
    """select n.id as note_id, n.job_id, j.item_number, n.visible_to_trolley, cast(epoch(n.created_at) as bigint) as noted_at
from job_notes n, jobs j where j.id = n.job_id""",
)
def noted_jobs(t: Tables) -> DataFrame:
    joined = parts.noted_jobs(t.job_notes, t.jobs)
    return plain(joined.select("note_id", "job_id", "item_number", "visible_to_trolley", "noted_at"))


@query(
    "jn_04",
    "jobs published_day",
    "select j.id, j.job_date from jobs j, published_day p where p.id = 1 and j.job_date = p.job_date",
)
def published_day_jobs(t: Tables) -> DataFrame:
    return views.published_jobs(t.jobs, t.published_day).select("id", "job_date")


@query(
    "jn_05",
    "jobs counts published_day",
    "select job_id from counts where job_id in (select id from jobs where job_date in (select job_date from published_day))",
)
def admissible_counts(t: Tables) -> DataFrame:
    today = views.published_jobs(t.jobs, t.published_day).select(F.col("id").alias("job_id"))
    return t.counts.join(today, "job_id", "left_semi").select("job_id")


@query(
    "jn_06",
    "jobs item_reference",
    """select am_number, item_number, grade, cast(weight_kg as double) as weight_kg, is_doubles is true as is_doubles,
 needs_dipping is true as needs_dipping from jobs where length(item_number) > 0
except
select am_number, item_number, grade, cast(weight_kg as double), is_doubles, needs_dipping from item_reference""",
)
def new_variants(t: Tables) -> DataFrame:
    return plain(parts.new_variants(t.jobs, t.item_reference))


@query(
    "jn_07",
    "jobs job_notes item_reference",
    """select distinct j.am_number, j.item_number, j.grade, cast(j.weight_kg as double) as weight_kg,
 ifnull(j.is_doubles, false) as is_doubles, ifnull(j.needs_dipping, false) as needs_dipping
from job_notes n join jobs j on j.id = n.job_id where j.item_number <> ''
 and j.item_number not in (select item_number from item_reference)""",
)
def minimal_references(t: Tables) -> DataFrame:
    created = parts.minimal_references(t.job_notes, t.jobs, t.item_reference)
    return plain(created.select(*parts.VARIANT))


@query(
    "jn_08",
    "jobs job_notes",
    """select n.id as note_id, j.item_number from job_notes n join jobs j on j.id = n.job_id
where j.item_number <> '' and not n.visible_to_trolley""",
)
def replay_guard(t: Tables) -> DataFrame:
    named = t.jobs.where(fx.not_blank("item_number"))
    all_notes = parts.noted_jobs(t.job_notes, named).select(
        "note_id", "item_number", "body", "visible_to_trolley", F.col("noted_at").alias("created_at")
    )
    # The visible notes were migrated by an earlier run.
    migrated = all_notes.where("visible_to_trolley")
    return parts.new_notes(all_notes, migrated).select("note_id", "item_number")


@query(
    "jn_09",
    "chat_messages published_chat_day",
    "select m.id, m.sender_role from published_chat_day p join chat_messages m using (job_date)",
)
def scalar_subquery(t: Tables) -> DataFrame:
    day = t.published_chat_day.where("id = 1").select("job_date")
    return t.chat_messages.where(F.col("job_date") == day.scalar()).select("id", "sender_role")


@query(
    "jn_10",
    "item_reference",
    """select item_number, arg_max(id, (case when updated_at is null then 0 else 1 end, ifnull(updated_at, timestamp '1970-01-01'), id)) as id
from item_reference group by item_number""",
)
def latest_reference(t: Tables) -> DataFrame:
    return parts.latest_reference(t.item_reference).select("item_number", "id")


@query(
    "jn_11",
    sql=f"""with {ENTRY_ROWS}
select o_orderkey as job_id, cast(ifnull(total, 0) as bigint) as total from orders
left join lateral (select sum(entry) as total from entries e where e.job_id = o_orderkey) x on true""",
)
def lateral_entries(t: Tables) -> DataFrame:
    entries = t.counts_v1.select("job_id", F.explode_outer("trolley_entries").alias("entry"))
    return entries.groupBy("job_id").agg(F.coalesce(F.sum("entry"), F.lit(0)).cast("long").alias("total"))


@query(
    "jn_12",
    "jobs",
    """select j.id, ifnull(any_value(j.sort_order), count(*)) as sort_order
from jobs j join jobs e on e.job_date = j.job_date and (e.created_at, e.id) <= (j.created_at, j.id) group by j.id""",
)
def filled_sort_order(t: Tables) -> DataFrame:
    return changes.fill_sort_order(t.jobs).select("id", "sort_order")


@query(
    "jn_13",
    "jobs notes published_day",
    f"""select j.id as job_id, n.id as note_id, n.body, cast(epoch(n.created_at) as bigint) as created_at
from jobs j join published_day p on p.job_date = j.job_date join notes n on n.item_number = j.item_number
where {OPEN} and n.visible_to_trolley and j.item_number <> ''""",
)
def fanned_out_notes(t: Tables) -> DataFrame:
    listed = views.trolley_jobs(t.jobs, t.counts)
    fanned = notes.fan_out(listed, t.notes, t.published_day)
    return plain(fanned.select("job_id", "note_id", "body", "created_at"))


@query(
    "jn_14",
    "jobs counts",
    f"""with counted as (select j.id, j.am_number, j.job_date, c.* exclude (job_id) from jobs j join counts c on c.job_id = j.id)
select j.id as job_id, s.id as source_job_id, {TOTAL.replace("manual", "s.manual").replace("group_", "s.group_")} as counted_total
from jobs j join counted s on s.am_number = j.am_number and s.job_date < j.job_date
where j.id not in (select job_id from counts)
qualify row_number() over (partition by j.id order by s.job_date desc, s.id desc) = 1""",
)
def carried_counts(t: Tables) -> DataFrame:
    carried = parts.carry_forward(t.jobs, t.counts)
    return carried.select("job_id", "source_job_id", fx.counted_total().alias("counted_total"))


@query(
    "jn_15",
    "jobs",
    """select j.id, case when exists (select 1 from jobs e where not e.is_trial and e.job_date = j.job_date
  and e.am_number = j.am_number and e.item_number = j.item_number) then 'edit' else 'insert' end as action
from jobs j""",
)
def classified_incoming(t: Tables) -> DataFrame:
    # The whole plan is read again; trial jobs have not been saved before.
    return parts.classify_incoming(t.jobs, t.jobs.where("not is_trial")).select("id", "action")


@query(
    "jn_16",
    "jobs item_reference",
    """with record as (select * from item_reference
  qualify row_number() over (partition by item_number order by updated_at desc nulls last, id desc) = 1),
compared as (select j.id, j.item_number, r.id is not null as known,
  concat_ws(',', if(j.grade is distinct from r.grade, 'grade', null), if(j.weight_kg is distinct from r.weight_kg, 'weight_kg', null),
   if(ifnull(j.is_doubles, false) <> r.is_doubles, 'is_doubles', null),
   if(ifnull(j.needs_dipping, false) <> r.needs_dipping, 'needs_dipping', null)) as differing
 from jobs j left join record r on r.item_number = j.item_number where j.item_number <> '')
select id, item_number, case when not known then 'new_part' when differing = '' then 'exact' else 'variant' end as status,
 case when known then differing else '' end as differing_fields from compared""",
)
def cross_check(t: Tables) -> DataFrame:
    return parts.cross_check(t.jobs, t.item_reference)


@query(
    "jn_17",
    "jobs dip_items",
    """select id, needs_dipping or ifnull(item_number in (select item_number from dip_items), false) as needs_dipping from jobs""",
)
def remembered_dipping(t: Tables) -> DataFrame:
    return parts.remember_dipping(t.jobs, t.dip_items).select("id", "needs_dipping")


# The minimal references of noted parts without any, with ids from their fields.
CREATED_REFERENCES = """created as (
  select *, -1 - cast('0x' || left(sha256(concat_ws('|', coalesce(am_number, '?'), item_number, coalesce(grade, '?'),
    coalesce(cast(weight_kg as varchar), '?'), cast(is_doubles as varchar), cast(needs_dipping as varchar))), 15) as bigint) as id
  from (select distinct am_number, item_number, grade, weight_kg, ifnull(is_doubles, false) as is_doubles,
    ifnull(needs_dipping, false) as needs_dipping
    from jobs where id in (select job_id from job_notes) and item_number <> ''
      and item_number not in (select item_number from item_reference where item_number is not null)) m)"""


@query("jn_18_references", "jobs job_notes item_reference", f"with {CREATED_REFERENCES} select id, am_number, item_number from created")
def created_references(t: Tables) -> DataFrame:
    return parts.new_references(t.job_notes, t.jobs, t.item_reference).select("id", "am_number", "item_number")


@query(
    "jn_18",
    "jobs job_notes item_reference notes",
    """with named as (select n.id as note_id, j.item_number, n.body, n.created_at, n.visible_to_trolley
  from job_notes n join jobs j on j.id = n.job_id where length(j.item_number) > 0),
record as (select item_number, id from item_reference
  qualify rank() over (partition by item_number order by updated_at desc nulls last, id desc) = 1
  union all select item_number, max(id) from created group by item_number)
select note_id, item_number, r.id as item_reference_id, visible_to_trolley
from named left join record r using (item_number)
where (item_number, body, created_at) not in (select (item_number, body, created_at) from notes)""".replace(
        "),\nrecord as", f"),\n{CREATED_REFERENCES},\nrecord as"
    ),
)
def migrated_notes(t: Tables) -> DataFrame:
    migrated = parts.migrate_job_notes(t.job_notes, t.jobs, t.item_reference, t.notes)
    return migrated.select("note_id", "item_number", "item_reference_id", "visible_to_trolley")


@query(
    "ag_01",
    "jobs",
    """select am_number, item_number, grade, cast(weight_kg as double) as weight_kg, ifnull(is_doubles, false) as is_doubles,
 ifnull(needs_dipping, false) as needs_dipping from jobs where item_number <> '' group by all""",
)
def distinct_variants(t: Tables) -> DataFrame:
    return plain(parts.part_variants(t.jobs))


@query(
    "ag_02",
    "jobs job_notes",
    """select count(*) filter (where ifnull(length(item_number), 0) = 0) as orphan_notes
from job_notes n, jobs j where n.job_id = j.id""",
)
def orphan_notes(t: Tables) -> DataFrame:
    return parts.orphan_notes(t.job_notes, t.jobs)


@query(
    "ag_03",
    sql=f"""with {ENTRY_ROWS}
select o_orderkey as job_id, cast(ifnull(sum(entry), 0) as bigint) as total, count(e.job_id) as entries
from orders left join entries e on e.job_id = o_orderkey group by o_orderkey""",
)
def entry_sums(t: Tables) -> DataFrame:
    return t.counts_v1.select(
        "job_id",
        fx.entries_total("trolley_entries").cast("long").alias("total"),
        fx.entries_count("trolley_entries").cast("long").alias("entries"),
    )


@query(
    "ag_04",
    "chat_messages",
    """select job_date, max(if(sender_role = 'admin', 1, 0)) = 1 as has_office, max(if(read_at is null, 1, 0)) = 1 as has_unread
from chat_messages group by job_date""",
)
def existence_tests(t: Tables) -> DataFrame:
    return t.chat_messages.groupBy("job_date").agg(
        F.bool_or(F.col("sender_role") == "admin").alias("has_office"),
        F.bool_or(F.col("read_at").isNull()).alias("has_unread"),
    )


@query(
    "ag_05",
    "pixels",
    f"""select frame_id, round(r, 6) as r, round(g, 6) as g, round(b, 6) as b, round((r - b) / (r + b + 1e-6), 6) as idx
from ({MEANS}) m""",
)
def frame_means(t: Tables) -> DataFrame:
    frames = calibration.frame_index(calibration.centre_box(t.pixels, WIDTH, HEIGHT))
    return frames.select("frame_id", *[F.round(c, 6).alias(c) for c in ("r", "g", "b", "idx")])


@query(
    "ag_06",
    "cal",
    f"""with {RAW_FIT}
select device, n, round(a, 4) as a, round(b, 4) as b from fits""",
)
def least_squares(t: Tables) -> DataFrame:
    return calibration.fit(t.cal).select("device", "n", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query(
    "ag_07",
    "cal",
    f"""with {RAW_FIT}
select device, round(r2, 6) as r2 from fits""",
)
def fit_quality(t: Tables) -> DataFrame:
    return calibration.fit(t.cal).select("device", F.round("r2", 6).alias("r2"))


@query(
    "ag_08",
    "notes",
    """select item_number, id as note_id, rank() over (partition by item_number order by created_at desc, id desc) as place,
 replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as body
from notes where visible_to_trolley""",
)
def ordered_notes(t: Tables) -> DataFrame:
    return notes.newest_first(t.notes).select("item_number", "note_id", "place", "body")


@query("ag_09", "jobs", "select job_date, item_number from jobs where item_number <> '' group by job_date, item_number")
def day_parts(t: Tables) -> DataFrame:
    return notes.day_parts(t.jobs)


@query(
    "ag_10",
    "chat_messages chat_seen",
    """select s.job_date, cast(epoch(coalesce(m.created_at, s.last_seen)) as bigint) as last_seen from chat_seen s left join
 (select * from chat_messages qualify row_number() over (partition by job_date order by created_at desc) = 1) m on m.job_date = s.job_date""",
)
def seen_markers(t: Tables) -> DataFrame:
    return plain(chat.mark_seen(t.chat_messages, t.chat_seen))


@query(
    "ag_11",
    "jobs",
    f"""select job_date, count(*) filter (where {OPEN}) as listed, count(*) filter (where {OPEN}) = 0 as is_empty
from jobs group by job_date""",
)
def list_states(t: Tables) -> DataFrame:
    return views.list_states(t.jobs.select("job_date").distinct(), t.jobs.where(fx.is_open()))
