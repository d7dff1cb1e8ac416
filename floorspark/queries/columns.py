"""Projections, filters, derived columns and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspark.functions import formulas as fx
from floorspark.functions import text as tx
from floorspark.operators import calibration, changes, eta, flows, ingest, views
from floorspark.queries.registry import plain, query
from floorspark.session import new_folder
from floorspark.sources import storage
from floorspark.sources.tables import Tables

OPEN = "not coalesce(is_done, false)"
# A product with a missing factor is null, hence zero.
PRODUCT = "(ifnull(group_a_cores * group_a_trolleys, 0) + ifnull(group_b_cores * group_b_trolleys, 0))"
TOTAL = f"ifnull(manual_total_override, {PRODUCT})"
MEANS = """select frame_id, device, avg(r) as r, avg(g) as g, avg(b) as b from pixels
  where x >= 13 and x < 37 and y >= 13 and y < 37 group by frame_id, device"""
# Frame size of the pixel table.
WIDTH = HEIGHT = 50


@query("pr_01", "jobs", "select id as job_id, am_number, item_number, planned_qty, job_date from jobs")
def project_rename(t: Tables) -> DataFrame:
    return t.jobs.select(F.col("id").alias("job_id"), "am_number", "item_number", "planned_qty", "job_date")


@query(
    "pr_02",
    "jobs counts",
    f"""select j.id, j.am_number, j.item_number, j.grade, j.customer_name, cast(j.weight_kg as double) as weight_kg,
 j.planned_qty, j.mingzhi_hansberg_no, j.status, j.is_trial, j.is_doubles, j.needs_dipping, j.is_done, j.job_date,
 j.sort_order, cast(epoch(j.created_at) as bigint) as created_at, coalesce(c.comment, '') as comment,
 coalesce(c.still_making, false) as still_making, cast({TOTAL} as bigint) as counted_total
from jobs j left join counts c on c.job_id = j.id""",
)
def star_and_derived(t: Tables) -> DataFrame:
    summary = views.job_summary(t.jobs, t.counts).drop("effective_qty", "tonnage")
    return plain(summary.withColumn("counted_total", F.col("counted_total").cast("long")))


@query(
    "pr_03",
    "jobs counts",
    """select id as job_id, case when group_b_cores is null then 0 else group_b_cores end as group_b_cores,
 case when comment is null then '' else comment end as comment,
 case when still_making is null then false else still_making end as still_making
from jobs left join counts on job_id = id""",
)
def null_defaults(t: Tables) -> DataFrame:
    return t.jobs.join(t.counts, F.col("id") == F.col("job_id"), "left").select(
        F.col("id").alias("job_id"),
        F.coalesce("group_b_cores", F.lit(0)).alias("group_b_cores"),
        F.coalesce("comment", F.lit("")).alias("comment"),
        F.coalesce("still_making", F.lit(False)).alias("still_making"),
    )


@query(
    "pr_04",
    "jobs counts",
    """select id as job_id, cast(case when manual_total_override is not null then manual_total_override
 else ifnull(group_a_cores * group_a_trolleys, 0) + ifnull(group_b_cores * group_b_trolleys, 0) end as bigint) as counted_total
from jobs left join counts on job_id = id""",
)
def counted_total(t: Tables) -> DataFrame:
    return t.jobs.join(t.counts, F.col("id") == F.col("job_id"), "left").select(
        F.col("id").alias("job_id"), fx.counted_total().cast("long").alias("counted_total")
    )


@query(
    "pr_05",
    "counts_v0",
    """select job_id, cast(case when manual_total_override is null then ifnull(cores_per_trolley * trolley_count, 0)
 else manual_total_override end as bigint) as counted_total from counts_v0""",
)
def counted_total_v0(t: Tables) -> DataFrame:
    return t.counts_v0.select("job_id", fx.counted_total_v0().cast("long").alias("counted_total"))


ENTRY_ROWS = """entries as (
 select o_orderkey as job_id, i, case when (o_orderkey + i) % 7 <> 0 then (o_orderkey * i) % 40 end as entry
 from orders, range(1, 6) r(i) where i <= o_orderkey % 6 and o_orderkey % 13 <> 0)"""


@query(
    "pr_06",
    sql=f"""with {ENTRY_ROWS}
select o_orderkey as job_id, count(e.job_id) as trolley_count,
 cast(case when o_orderkey % 7 = 0 then o_orderkey % 90 else ifnull(sum(entry), 0) end as bigint) as counted_total
from orders left join entries e on e.job_id = o_orderkey group by o_orderkey""",
)
def counted_total_v1(t: Tables) -> DataFrame:
    return t.counts_v1.select(
        "job_id",
        fx.entries_count("trolley_entries").cast("long").alias("trolley_count"),
        fx.counted_total_v1().cast("long").alias("counted_total"),
    )


@query(
    "pr_05_layouts",
    "counts_v0 counts",
    f"""with {ENTRY_ROWS}
select 'v0' as layout, job_id, cast(coalesce(manual_total_override, cores_per_trolley * trolley_count, 0) as bigint) as counted_total, null as still_making from counts_v0
union all select 'v1', o_orderkey, cast(case when o_orderkey % 7 = 0 then o_orderkey % 90 else ifnull(sum(entry), 0) end as bigint), null
from orders left join entries e on e.job_id = o_orderkey group by o_orderkey
union all select 'v2', job_id, cast(coalesce(manual_total_override, {PRODUCT}) as bigint), still_making from counts""",
)
def totals_of_all_layouts(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "counts")
    for name, rows in (("2023", t.counts_v0), ("2024", t.counts_v1), ("2025", t.counts)):
        rows.write.parquet(f"{folder}/{name}")
    return storage.read_counts(t.spark, folder).select("layout", "job_id", "counted_total", "still_making")


@query(
    "pr_07",
    "jobs counts",
    f"""select id, {TOTAL} / case when is_doubles then 2.0 else 1.0 end as effective_qty
from jobs left join counts on job_id = id""",
)
def effective_qty(t: Tables) -> DataFrame:
    return plain(views.job_summary(t.jobs, t.counts).select("id", "effective_qty"))


@query(
    "pr_08",
    "jobs counts",
    f"""select id, cast(floor({TOTAL} * case when is_doubles then 1 else 2 end * cast(ifnull(weight_kg, 0) * 1000 as bigint)
 / 2000.0 + 0.5) / 1000 as double) as tonnage
from jobs left join counts on job_id = id""",
)
def tonnage(t: Tables) -> DataFrame:
    return plain(views.job_summary(t.jobs, t.counts).select("id", "tonnage"))


@query(
    "pr_09",
    "jobs",
    """select id, round(case when is_doubles then 0.5 else 1.0 end * ifnull(planned_qty, 0)
 * cast(ifnull(weight_kg, 0) as double) / 1000, 9) as planned_tonnage from jobs""",
)
def planned_tonnage(t: Tables) -> DataFrame:
    return t.jobs.select("id", F.round(fx.planned_tonnage(), 9).alias("planned_tonnage"))


@query(
    "pr_10",
    "jobs counts",
    f"""select id as job_id, case when {TOTAL} <> {PRODUCT} then {TOTAL} end as rebuilt_override
from jobs left join counts on job_id = id where {OPEN}""",
)
def rebuilt_override(t: Tables) -> DataFrame:
    return views.trolley_jobs(t.jobs, t.counts).select("job_id", fx.rebuilt_override().alias("rebuilt_override"))


@query("pr_11", "jobs", "select id, job_date from jobs where is_done is null or is_done = false")
def open_jobs(t: Tables) -> DataFrame:
    return t.jobs.where(fx.is_open()).select("id", "job_date")


@query("pr_12", "jobs", "select id, item_number from jobs where length(item_number) > 0")
def named_parts(t: Tables) -> DataFrame:
    return t.jobs.where(fx.not_blank("item_number")).select("id", "item_number")


ETA_STEPS = f"""open_jobs as (
 select *, row_number() over (partition by job_date order by sort_order asc nulls last, id) as rn from jobs where {OPEN}),
starts as (
 select o.job_date, coalesce(min(case when o.id = p.current_job_id then o.rn end), 1) as cur
 from open_jobs o left join job_pace p on p.job_date = o.job_date group by o.job_date),
steps as (
 select o.id, o.job_date, o.rn, s.cur, case when p.started_at is not null and p.tons_per_hour > 0 then
  case when is_doubles then 0.5 else 1.0 end * ifnull(planned_qty, 0) * cast(ifnull(weight_kg, 0) as double) / 1000
  * case when o.rn = s.cur and remaining_qty is not null and planned_qty <> 0
     then cast(remaining_qty as double) / planned_qty else 1 end
  / p.tons_per_hour * 3600000 + 420000 end as takes
 from open_jobs o join starts s on s.job_date = o.job_date left join job_pace p on p.job_date = o.job_date),
walk as (
 select id, job_date, rn, cast(null as double) as eta, takes as t from steps where rn = cur
 union all
 select n.id, n.job_date, n.rn, w.t, w.t + n.takes from walk w join steps n on n.job_date = w.job_date and n.rn = w.rn + 1)"""


def project_etas(t: Tables) -> DataFrame:
    return eta.project(t.jobs.where(fx.is_open()), t.job_pace)


@query(
    "pr_13",
    "jobs counts job_pace notes",
    f"""with {ETA_STEPS}
select s.id as job_id, s.job_date, s.rn = s.cur as is_current, w.eta is not null as has_eta, j.needs_dipping as dip,
 ifnull(c.still_making, false) as making,
 exists (select 1 from notes n where n.item_number = j.item_number and n.visible_to_trolley) as has_notes
from steps s join jobs j on j.id = s.id left join counts c on c.job_id = s.id left join walk w on w.id = s.id""",
    recursive=True,
)
def badges(t: Tables) -> DataFrame:
    listed = flows.floor_lines(t.jobs, t.counts, t.job_pace, t.notes)
    return listed.select("job_id", "job_date", "is_current", "has_eta", "dip", "making", "has_notes")


@query(
    "pr_14",
    "cal",
    """select device, idx, cast(temp as bigint) as floor_temp, case when temp >= 1550 then '#fff2d0' when temp >= 1400 then '#ffb84d'
 when temp >= 1200 then '#ff8a1e' when temp >= 900 then '#d9432e' else '#8a2a1e' end as band
from (select device, idx, floor(temp) as temp from cal) c""",
)
def temperature_bands(t: Tables) -> DataFrame:
    temps = t.cal.select("device", "idx", F.floor("temp").alias("floor_temp"))
    return temps.withColumn("band", fx.temperature_band("floor_temp"))


# The fit written out from raw sums.
RAW_FIT = """sums as (select device, count(*) as n, sum(idx) as sx, sum(temp) as sy, sum(idx * temp) as sxy,
  sum(idx * idx) as sxx, avg(temp) as my from cal group by device),
lines as (select *, case when n >= 2 and abs(n * sxx - sx * sx) >= 1e-9
  then (n * sxy - sx * sy) / (n * sxx - sx * sx) end as a from sums),
fits as (select l.device, l.n, l.a, (sy - a * sx) / n as b, e.r2 from lines l join (
  select c.device, case when sum((temp - my) * (temp - my)) > 1e-9 then 1 - sum((temp - a * idx - (sy - a * sx) / n)
   * (temp - a * idx - (sy - a * sx) / n)) / sum((temp - my) * (temp - my)) else 1 end as r2
  from cal c join lines k on k.device = c.device group by c.device) e on e.device = l.device)"""


@query(
    "pr_15",
    "cal",
    f"""with {RAW_FIT}
select device, n, case when a is null then 'uncalibrated' when r2 > 0.9 then 'good' when r2 > 0.6 then 'fair'
 else 'poor' end as tier from fits""",
)
def fit_tiers(t: Tables) -> DataFrame:
    return calibration.fit(t.cal).select("device", "n", fx.fit_tier("r2").alias("tier"))


@query(
    "pr_16",
    "pixels cal",
    f"""with {RAW_FIT}, frames as (select *, (r - b) / (r + b + 1e-6) as idx from ({MEANS}) m)
select frame_id, cast(floor(f.a * idx + f.b + 0.5) as bigint) as temperature from frames left join fits f on f.device = frames.device""",
)
def temperature_estimates(t: Tables) -> DataFrame:
    frames = calibration.frame_index(calibration.centre_box(t.pixels, WIDTH, HEIGHT))
    return calibration.estimates(frames, calibration.fit(t.cal)).select("frame_id", "temperature")


@query("pr_17", "pixels", "select frame_id, x, y, round((r - b) / (r + b + 0.000001), 9) as idx from pixels")
def redness(t: Tables) -> DataFrame:
    return t.pixels.select("frame_id", "x", "y", F.round(fx.redness(), 9).alias("idx"))


@query(
    "pr_18",
    "chat_messages",
    """select id, case when sender_role <> 'trolley' then 'Office' when length(sender_name) > 0 then sender_name
 else 'You' end as author from chat_messages""",
)
def chat_authors(t: Tables) -> DataFrame:
    return t.chat_messages.select("id", tx.display_author().alias("author"))


@query(
    "fn_01",
    "counts",
    """select job_id, case when comment is null then '' else comment end as comment,
 case when still_making then true else false end as still_making,
 case when group_b_cores is null then 0.0 else cast(group_b_cores as double) end as group_b_cores from counts""",
)
def defaults(t: Tables) -> DataFrame:
    return t.counts.select(
        "job_id",
        F.coalesce("comment", F.lit("")).alias("comment"),
        F.coalesce("still_making", F.lit(False)).alias("still_making"),
        fx.or_zero("group_b_cores").alias("group_b_cores"),
    )


@query(
    "fn_02",
    "jobs",
    "select id, if(is_doubles is not null and is_doubles, 2, 1) as cores_per_mould from jobs",
)
def conditional(t: Tables) -> DataFrame:
    return t.jobs.select("id", F.when(F.col("is_doubles"), 2).otherwise(1).alias("cores_per_mould"))


@query(
    "fn_03",
    "jobs",
    """select id, cast(floor(cast(weight_kg * 1000 as bigint) * planned_qty / 1000.0 + 0.5) / 1000.0 as double) as tonnes from jobs""",
)
def rounding(t: Tables) -> DataFrame:
    return plain(t.jobs.select("id", F.round(F.col("weight_kg") * F.col("planned_qty") * fx.THOUSANDTH, 3).alias("tonnes")))


@query(
    "fn_04",
    "counts",
    """select job_id, cast(ifnull(group_a_cores * group_a_trolleys, 0) + ifnull(group_b_cores * group_b_trolleys, 0) as bigint)
 as product, (ifnull(group_a_cores * group_a_trolleys, 0) + ifnull(group_b_cores * group_b_trolleys, 0)) / 2.0 as halved from counts""",
)
def arithmetic(t: Tables) -> DataFrame:
    product = fx.group_product()
    return plain(
        t.counts.select("job_id", product.cast("long").alias("product"), (product * fx.HALF).alias("halved"))
    )


@query("fn_05", "jobs", "select id, cast(floor(epoch(created_at)) as bigint) as created_epoch from jobs")
def epoch_seconds(t: Tables) -> DataFrame:
    return t.jobs.select("id", F.unix_timestamp(F.col("created_at").cast("timestamp")).alias("created_epoch"))


# Requests that pass every check, and the two rows such a request extracts.
ADMITTED = """admitted as (select * from envelopes where role = 'authenticated' and image_len <= 11184810
  and upstream_status = 200)"""
EXTRACTED = f"""{ADMITTED}, bodies as (
 select a.*, o.o_custkey, o.o_orderstatus from envelopes a join orders o on o.o_orderkey = a.req_id
 where body is not null and length(body) > 20),
extracted as (
 select req_id, 0 as row_no, 'AM' || req_id as am_number, 'P' || o_custkey as item_number, o_orderstatus as grade,
  cast(req_id % 120 as int) as planned_qty, 12.5 as weight_kg, true as is_trial, req_id % 2 = 0 as is_doubles from bodies
 union all
 select req_id, 1, null, null, null, 3, null, false, true from bodies)"""


@query(
    "fn_06",
    "envelopes published_day",
    f"""with {EXTRACTED}
select req_id, row_no, p.job_date, cast(epoch(cast(p.job_date as timestamp)) as bigint) + 21600 as sort_order, is_trial, false as is_done
from extracted join admitted using (req_id), published_day p""",
)
def column_defaults(t: Tables) -> DataFrame:
    rows = ingest.normalised(ingest.extracted_rows(ingest.admitted(t.requests)))
    day = t.published_day.select((F.col("job_date").cast("timestamp") + F.expr("interval 6 hours")).alias("as_of"))
    dated = rows.withColumn("_as_of", day.scalar())
    return changes.with_defaults(dated, F.col("_as_of")).select(
        "req_id", "row_no", "job_date", "sort_order", "is_trial", "is_done"
    )


@query(
    "fn_07",
    sql=f"""with {ENTRY_ROWS}
select o_orderkey as job_id, count(e.job_id) as entries from orders left join entries e on e.job_id = o_orderkey group by o_orderkey""",
)
def list_lengths(t: Tables) -> DataFrame:
    filled = F.coalesce("trolley_entries", F.array().cast("array<int>"))
    return t.counts_v1.select("job_id", F.size(filled).cast("long").alias("entries"))


@query(
    "fn_08",
    "edits",
    """select seq, case when raw = 'n/a' then 0 else cast(replace(raw, 'x', '') as int) end as cores,
 try_cast(replace(raw, 'x', '') as int) as total from edits""",
)
def parsed_integers(t: Tables) -> DataFrame:
    value = tx.leading_int("raw")
    return t.edits.select("seq", F.coalesce(value, F.lit(0)).alias("cores"), value.alias("total"))


@query(
    "fn_09",
    "cal_seq",
    """select seq, if(idx < 2, 0.0, round(idx - 2, 6)) as above, if(idx < 2, round(2 - idx, 6), round(idx - 2, 6)) as distance,
 cast(floor(temp / 2) as bigint) as half_floor, cast(ceil((temp - 2100) / 2 - 0.5) + if((temp - 2100) % 2 = 0, 0, 1) as bigint) as nearest_half
from (select seq, idx, temp from cal_seq) c""",
)
def numeric_functions(t: Tables) -> DataFrame:
    idx, half = F.col("idx"), (F.col("temp") - 2100) / 2
    return t.cal_seq.select(
        "seq",
        F.round(F.greatest(F.lit(0.0), idx - 2), 6).alias("above"),
        F.round(F.abs(idx - 2), 6).alias("distance"),
        F.floor(F.col("temp") / 2).alias("half_floor"),
        fx.nearest(half).alias("nearest_half"),
    )


_BLANKS = r"'[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}\x{000b}]+'"


@query(
    "fn_10",
    "chat_messages",
    f"""select id, regexp_replace(regexp_replace(body, '^' || {_BLANKS}, ''), {_BLANKS} || '$', '') as body,
 case when length(sender_name) > 0 then sender_name else 'Trolley' end as sender_name from chat_messages""",
)
def trimmed_text(t: Tables) -> DataFrame:
    return t.chat_messages.select(
        "id", tx.trimmed_or("body", "").alias("body"), tx.trimmed_or("sender_name", "Trolley").alias("sender_name")
    )


@query("fn_11", "jobs", "select id, strftime(created_at, '%Y-%m-%d') as created_day from jobs")
def iso_days(t: Tables) -> DataFrame:
    return t.jobs.select("id", tx.iso_day("created_at").alias("created_day"))


@query(
    "fn_12",
    "jobs job_pace",
    f"""with {ETA_STEPS}
select s.id, case when w.eta is null then '' else strftime(p.started_at + cast(floor(w.eta + 0.5) as bigint) * interval '1' millisecond,
 '%H:%M') end as eta from steps s left join walk w on w.id = s.id left join job_pace p on p.job_date = s.job_date""",
    recursive=True,
)
def eta_clock(t: Tables) -> DataFrame:
    return project_etas(t).select("id", tx.clock_time("eta_at").alias("eta"))


@query(
    "fn_13",
    "pixels cal",
    f"""with {RAW_FIT}, frames as (select *, (r - b) / (r + b + 1e-6) as idx from ({MEANS}) m)
select frame_id, printf('idx %.3f  (R%d G%d B%d)', idx, cast(floor(red + 0.5) as bigint), cast(floor(green + 0.5) as bigint),
 cast(floor(blue + 0.5) as bigint)) as chip, format('{{:,}}', cast(floor(a * idx + b + 0.5) as bigint)) as shown
from (select frame_id, device, idx, r as red, g as green, b as blue from frames) x left join fits using (device)""",
)
def number_formats(t: Tables) -> DataFrame:
    frames = calibration.frame_index(calibration.centre_box(t.pixels, WIDTH, HEIGHT))
    chip = F.concat(
        F.lit("idx "), tx.fixed("idx", 3), F.lit("  (R"), tx.fixed("r", 0), F.lit(" G"), tx.fixed("g", 0),
        F.lit(" B"), tx.fixed(F.col("blue"), 0), F.lit(")"),
    )
    scored = calibration.estimates(frames.withColumnRenamed("b", "blue"), calibration.fit(t.cal))
    return scored.select("frame_id", chip.alias("chip"), tx.grouped_thousands("temperature").alias("shown"))


@query(
    "fn_14",
    sql="""select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '"', '&quot;'), '>', '&gt;'), '<', '&lt;') as escaped
from pages""",
)
def escaped_markup(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.escape_markup("html").alias("escaped"))


@query("fn_15", "envelopes", "select req_id, role from envelopes")
def token_roles(t: Tables) -> DataFrame:
    return t.requests.select("req_id", tx.role_claim("authorization").alias("role"))


@query(
    "fn_16",
    "jobs",
    "select id, is_doubles is not distinct from is_done as same_flags from jobs",
)
def null_safe_equality(t: Tables) -> DataFrame:
    return t.jobs.select("id", F.col("is_doubles").eqNullSafe(F.col("is_done")).alias("same_flags"))


@query(
    "fn_17",
    sql="""select page_id, cast(4 * ceil(octet_length(encode(html)) / 3) as bigint) as encoded_length,
 4 * ceil(octet_length(encode(html)) / 3) > 11184810 as too_large from pages""",
)
def length_caps(t: Tables) -> DataFrame:
    encoded = F.replace(F.base64(F.encode("html", "UTF-8")), F.lit("\r\n"))
    length = F.length(encoded).cast("long")
    return t.pages.select(
        "page_id", length.alias("encoded_length"), (length > ingest.MAX_IMAGE_LENGTH).alias("too_large")
    )


@query(
    "fn_18",
    "envelopes",
    "select req_id, ifnull(body, '[]') as extracted_text from envelopes",
)
def nested_paths(t: Tables) -> DataFrame:
    part = F.struct(F.col("body").alias("text"))
    candidate = F.struct(F.struct(F.array(part).alias("parts")).alias("content"))
    response = F.to_json(F.struct(F.array(candidate).alias("candidates")))
    return t.envelopes.select("req_id", response.alias("response")).select(
        "req_id", ingest.response_text("response").alias("extracted_text")
    )
