"""Scans, lookups, extraction ingest and table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspark.functions import formulas as fx
from floorspark.operators import calibration, changes, ingest, notes, parts, views
from floorspark.queries.columns import EXTRACTED, HEIGHT, OPEN, PRODUCT, WIDTH
from floorspark.queries.registry import plain, query
from floorspark.session import new_folder
from floorspark.sources import storage
from floorspark.sources.tables import Tables


@query(
    "sc_01",
    "jobs",
    """select id, am_number, item_number, grade, customer_name, cast(weight_kg as double) as weight_kg, planned_qty,
 mingzhi_hansberg_no, status, is_trial, is_doubles, needs_dipping, is_done, job_date, sort_order,
 cast(epoch(created_at) as bigint) as created_at from jobs""",
)
def full_scan(t: Tables) -> DataFrame:
    return plain(t.jobs)


@query(
    "sc_02",
    "jobs published_day",
    """select id, job_date, row_number() over (order by sort_order nulls last, id) as day_position
from jobs where job_date = (select job_date from published_day)""",
)
def day_scan(t: Tables) -> DataFrame:
    return views.positions(views.published_jobs(t.jobs, t.published_day)).select("id", "job_date", "day_position")


@query(
    "sc_03",
    "jobs job_pace",
    """with rated as (select * from job_pace union all select * from job_pace where remaining_qty = 0)
select d.job_date, case count(r.job_date) when 0 then 'missing' when 1 then 'ok' else 'multiple' end as status,
 case when count(r.job_date) = 1 then min(r.current_job_id) end as current_job_id,
 case when count(r.job_date) = 1 then min(r.remaining_qty) end as remaining_qty
from (select distinct job_date from jobs union all select distinct job_date + 20000 from jobs) d left join rated r on r.job_date = d.job_date group by d.job_date""",
)
def single_lookup(t: Tables) -> DataFrame:
    pace = t.job_pace
    rated = pace.unionByName(pace.where("remaining_qty = 0"))
    days = t.jobs.select("job_date").distinct()
    # Days long after the last one have no pace.
    days = days.unionByName(days.select(F.date_add("job_date", 20_000).alias("job_date")))
    return views.lookup(days, rated, "job_date", ["current_job_id", "remaining_qty"])


@query(
    "sc_04",
    "jobs notes",
    f"""select id, item_number from notes
where visible_to_trolley and item_number in (select item_number from jobs where {OPEN} and item_number <> '')""",
)
def in_list_scan(t: Tables) -> DataFrame:
    named = notes.day_parts(t.jobs.where(fx.is_open()))
    return notes.notes_for(named, t.notes).select("id", "item_number")


@query(
    "sc_05",
    "envelopes",
    f"""with {EXTRACTED}
select req_id, row_no, am_number, cast(planned_qty as double) as planned_qty, weight_kg, 'row' as kind from extracted
union all
select req_id, null, null, null, null, 'parse_failed' from envelopes where length(body) between 3 and 20""",
)
def extraction_rows(t: Tables) -> DataFrame:
    kind = F.when(F.col("reason").isNull(), "row").otherwise("parse_failed")
    return plain(
        ingest.sorted_out(t.requests).select("req_id", "row_no", "am_number", "planned_qty", "weight_kg", kind.alias("kind"))
    )


@query(
    "sc_06",
    "envelopes",
    """select status, count(*) as requests from (select case when role is null or role <> 'authenticated'
  then 'authenticated caller required' when image_len is null then 'missing imageBase64'
  when image_len >= 11184811 then 'image too large' when upstream_status <> 200 then 'upstream error' else 'ok' end as status
 from envelopes) e group by status""",
)
def admission_statuses(t: Tables) -> DataFrame:
    return t.requests.groupBy(ingest.admission().alias("status")).agg(F.count("*").alias("requests"))


@query(
    "sc_07",
    "envelopes",
    f"""with {EXTRACTED}
select req_id, row_no, am_number, item_number, grade, planned_qty, weight_kg, is_trial, is_doubles
from extracted join admitted using (req_id)""",
)
def normalised_rows(t: Tables) -> DataFrame:
    rows = ingest.normalised(ingest.extracted_rows(ingest.admitted(t.requests)))
    return plain(
        rows.select(
            "req_id", "row_no", "am_number", "item_number", "grade", "planned_qty", "weight_kg", "is_trial", "is_doubles"
        )
    )


@query(
    "sc_08",
    "chat_messages published_chat_day",
    """select id, job_date, sender_role, sender_name, body from chat_messages
union all
select null, p.job_date, 'trolley', case when length(sender_name) > 0 then sender_name else 'Trolley' end, sender_role
from chat_messages, published_chat_day p where read_at is null""",
)
def appended_messages(t: Tables) -> DataFrame:
    # Every message is answered: a blank line where it was read, else its role with blanks around.
    body = F.when(F.col("read_at").isNotNull(), F.lit(" \n ")).otherwise(
        F.concat(F.lit("\n "), F.col("sender_role"), F.lit("\t"))
    )
    day = t.published_chat_day.select("job_date").scalar()
    outgoing = t.chat_messages.select(body.alias("body"), "sender_name", day.alias("job_date"))
    return changes.send_messages(t.chat_messages, outgoing).select("id", "job_date", "sender_role", "sender_name", "body")


def incoming_saves(t: Tables) -> DataFrame:
    """Saved payloads in the layout of counts."""
    return t.saves.select(
        "job_id",
        "seq",
        "updated_at",
        "group_a_cores",
        "group_a_trolleys",
        F.lit(0).alias("group_b_cores"),
        F.lit(0).alias("group_b_trolleys"),
        F.lit(None).cast("int").alias("manual_total_override"),
        F.lit("").alias("comment"),
        F.lit(False).alias("still_making"),
    )


@query(
    "sc_09",
    "counts saves",
    """with ranked as (select *, row_number() over (partition by job_id order by seq desc) as rn from saves)
select job_id, group_a_cores, group_a_trolleys, group_b_cores, manual_total_override, comment from counts
where job_id not in (select job_id from saves)
union all
select job_id, group_a_cores, group_a_trolleys, 0, null, '' from ranked where rn = 1""",
)
def upserted_counts(t: Tables) -> DataFrame:
    return changes.upsert(t.counts, incoming_saves(t), "job_id").select(
        "job_id", "group_a_cores", "group_a_trolleys", "group_b_cores", "manual_total_override", "comment"
    )


@query(
    "sc_10",
    "jobs dip_items",
    """select item_number, true as needs_dipping, cast(floor(epoch(arg_min(d.moment, d.arrival))) as bigint) as updated_at
from (select item_number, updated_at as moment, -1 as arrival from dip_items
  union all select item_number, created_at, id from jobs where item_number <> '' and needs_dipping) d group by item_number""",
)
def inserted_missing(t: Tables) -> DataFrame:
    ticked = t.jobs.where(F.col("needs_dipping") & fx.not_blank("item_number")).select(
        "item_number", "needs_dipping", F.col("created_at").alias("updated_at"), F.col("id").alias("seq")
    )
    return plain(changes.insert_missing(t.dip_items, ticked, "item_number").select("item_number", "needs_dipping", "updated_at"))


DIPPING_TICKS = """ticks as (select j.item_number, max(g.ts) as learned_at from toggles g join jobs j on j.id = g.job_id
 join app_users u on u.user_id = g.caller_id and u.permission = 'full_access'
 where g.flag and j.item_number is not null group by j.item_number)"""


@query(
    "sc_11",
    "jobs toggles dip_items app_users",
    f"""with {DIPPING_TICKS}
select item_number, true as needs_dipping, cast(floor(epoch(coalesce(learned_at, updated_at))) as bigint) as updated_at
from dip_items full join ticks using (item_number)""",
)
def learned_dipping(t: Tables) -> DataFrame:
    return plain(changes.learn_dipping(t.dip_items, changes.dipping_ticks(t.jobs, t.toggles, t.app_users)))


MARKED_READ = """select m.id, cast(epoch(case when m.sender_role = 'admin' and m.read_at is null and m.job_date = p.job_date
  then timestamp '2024-03-02 00:00:00' else m.read_at end) as bigint) as read_at,
 case when m.sender_role = 'admin' and m.read_at is null and m.job_date = p.job_date then 'Sam' else m.read_by end as read_by
from chat_messages m, published_chat_day p"""
READ_STAMP = "timestamp'2024-03-02 00:00:00'"


@query("sc_12", "chat_messages published_chat_day", MARKED_READ)
def marked_read(t: Tables) -> DataFrame:
    marked = changes.mark_read(t.chat_messages, t.published_chat_day, F.expr(READ_STAMP), "Sam")
    return plain(marked.select("id", "read_at", "read_by"))


@query(
    "sc_13",
    "app_users patches",
    """select u.user_id, if(p.has_name, p.name, u.name) as name, if(p.has_permission, p.permission, u.permission) as permission
from app_users u join patches p on p.user_id = u.user_id""",
)
def patched_users(t: Tables) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    given = F.map_concat(
        *[F.when(F.col(f"has_{c}"), F.create_map(F.lit(c), F.col(c))).otherwise(empty) for c in ("name", "permission")]
    )
    patches = t.patches.select("user_id", given.alias("changes"))
    return changes.patch(t.app_users, patches, "user_id", ["name", "permission"]).select("user_id", "name", "permission")


@query(
    "sc_14",
    "jobs toggles app_users",
    """with last as (select * from (select g.job_id, g.flag, row_number() over (partition by g.job_id order by g.seq desc) as rn
  from toggles g join app_users u on u.user_id = g.caller_id where u.permission = 'full_access') r where rn = 1)
select j.id, case when l.job_id is null then j.is_done else l.flag end as is_done
from jobs j left join last l on l.job_id = j.id""",
)
def toggled_jobs(t: Tables) -> DataFrame:
    return changes.apply_toggles(t.jobs, t.toggles, t.app_users, "is_done").select("id", "is_done")


@query(
    "sc_14_days",
    "jobs toggles",
    """with last as (select job_id, arg_max(flag, seq) as flag from toggles group by job_id)
select id, if(id % 5 = 0 and l.job_id is not null, date '1992-01-01', job_date) as job_date, coalesce(l.flag, is_done) as is_done
from jobs left join last l on l.job_id = id where l.job_id is null or id % 7 <> 0""",
)
def toggled_days(t: Tables) -> DataFrame:
    """Toggles, moves to another day and deletes, written into the stored day folders they touch."""
    folder = new_folder(t.spark, "jobs")
    t.jobs.repartition(8, "job_date").write.partitionBy("job_date").parquet(folder)
    last = changes.latest(t.toggles.select("job_id", "seq", "flag"), "job_id", "seq").withColumnRenamed("job_id", "id")
    touched = t.jobs.join(last.drop("seq"), "id")
    moved = F.when(F.col("id") % 5 == 0, F.lit("1992-01-01").cast("date")).otherwise(F.col("job_date"))
    changed = touched.withColumns({"is_done": F.coalesce("flag", "is_done"), "job_date": moved}).drop("flag")
    storage.upsert_days(t.spark, folder, "jobs", changed.where("id % 7 <> 0"), gone=touched.where("id % 7 = 0"))
    return storage.read_floor(t.spark, folder, "jobs").select("id", "job_date", "is_done")


@query(
    "sc_15",
    "jobs counts job_pace",
    """select 'counts' as relation, c.job_id as row_key, cast(null as date) as job_date from counts c, jobs j
where j.id = c.job_id and j.status <> 'pulled'
union all
select 'job_pace', case when j.status <> 'pulled' then p.current_job_id end, p.job_date
from job_pace p left join jobs j on j.id = p.current_job_id""",
)
def referential_deletes(t: Tables) -> DataFrame:
    deleted = t.jobs.where(F.col("status") == "pulled")
    left = changes.delete_rows(t.counts, deleted, "job_id", "id").select(
        F.lit("counts").alias("relation"), F.col("job_id").alias("row_key"), F.lit(None).cast("date").alias("job_date")
    )
    pace = changes.unset_references(t.job_pace, deleted, "current_job_id", "id")
    return left.unionByName(
        pace.select(F.lit("job_pace").alias("relation"), F.col("current_job_id").alias("row_key"), "job_date")
    )


@query(
    "sc_16",
    "counts counts_v0",
    f"""select job_id, cast(0 as bigint) as product, manual_total_override, false as still_making from counts_v0
union all select job_id, cast({PRODUCT} as bigint), manual_total_override, still_making from counts""",
)
def evolved_layouts(t: Tables) -> DataFrame:
    boxes = ["group_a_cores", "group_a_trolleys", "group_b_cores", "group_b_trolleys"]
    added = {c: F.lit(0) for c in boxes} | {"still_making": F.lit(False)}
    retired = changes.evolve(t.counts_v0, ["cores_per_trolley", "trolley_count"], added)
    both = retired.unionByName(t.counts, allowMissingColumns=True)
    return both.select("job_id", fx.group_product().cast("long").alias("product"), "manual_total_override", "still_making")


@query(
    "sc_17",
    "jobs item_reference",
    """select am_number, item_number, grade, cast(weight_kg as double) as weight_kg, is_doubles, needs_dipping from item_reference
union all (
 select am_number, item_number, grade, cast(weight_kg as double), ifnull(is_doubles, false), ifnull(needs_dipping, false)
 from jobs where item_number <> ''
 except select am_number, item_number, grade, cast(weight_kg as double), is_doubles, needs_dipping from item_reference)""",
)
def backfilled(t: Tables) -> DataFrame:
    return plain(parts.backfill(t.jobs, t.item_reference))


@query(
    "sc_18",
    "pixels",
    "select frame_id, x, y, r, g, b from pixels where abs(x - 24.5) <= 12 and abs(y - 24.5) <= 12",
)
def sample_box(t: Tables) -> DataFrame:
    return calibration.centre_box(t.pixels, WIDTH, HEIGHT).select("frame_id", "x", "y", "r", "g", "b")


@query(
    "sc_19",
    "app_users",
    """select c.c_custkey as user_id, u.name, case when c.c_acctbal > 0 then 'full_access' else u.permission end as permission,
 case when c.c_acctbal > 0 then true else u.is_owner end as is_owner
from customer c join app_users u on u.user_id = c.c_custkey""",
)
def partial_upsert(t: Tables) -> DataFrame:
    owners = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    incoming = t.app_users.join(owners, "user_id", "left_semi").withColumns(
        {"permission": F.lit("full_access"), "is_owner": F.lit(True)}
    )
    merged = changes.upsert_fields(t.app_users, incoming, "user_id", ["is_owner", "permission"])
    return merged.select("user_id", "name", "permission", "is_owner")


@query(
    "sc_20",
    "jobs published_day",
    "select id, job_date from jobs where job_date in (select min(job_date) from jobs)",
)
def republished(t: Tables) -> DataFrame:
    first = t.jobs.agg(F.min("job_date").alias("job_date"))
    return views.published_jobs(t.jobs, changes.publish(t.published_day, first)).select("id", "job_date")
