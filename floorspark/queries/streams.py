"""Event-driven operators, in batch and as streams over the same files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspark.operators import calibration, chat, edits
from floorspark.queries.columns import HEIGHT, MEANS, RAW_FIT, WIDTH
from floorspark.queries.registry import plain, query
from floorspark.queries.scans import MARKED_READ, READ_STAMP, incoming_saves
from floorspark.session import new_folder, stored
from floorspark.sources.tables import Tables
from floorspark.streaming import feeds
from floorspark.streaming.run import ChangeLog, collect_rows

GAP_SECONDS = 3600
DELAY_SECONDS = 600

BURSTS = f"""marked as (select job_id, seq, kind, raw, epoch_us(ts) as at_us,
  row_number() over (partition by job_id order by ts, seq) as rn from edits),
bursts as (select a.* from marked a left join marked b on b.job_id = a.job_id and b.rn = a.rn + 1
 where b.at_us is null or b.at_us - a.at_us > {GAP_SECONDS * 1_000_000})"""


@query("st_01", "edits", f"with {BURSTS} select job_id, seq, kind, raw from bursts")
def burst_ends(t: Tables) -> DataFrame:
    return edits.bursts(t.edits, GAP_SECONDS).select("job_id", "seq", "kind", "raw")


@query("st_01_stream", "edits", f"with {BURSTS} select job_id, seq, kind, raw from bursts")
def debounced_stream(t: Tables) -> DataFrame:
    arriving = t.derive("edits", events=t.stream("events"))
    every = feeds.all_bursts(arriving, f"{GAP_SECONDS} seconds", f"{DELAY_SECONDS} seconds")
    return every.select("job_id", "seq", "kind", "raw")


@query(
    "st_02",
    "counts saves",
    """select job_id, arg_max(s.group_a_cores, s.seq) as group_a_cores, arg_max(s.group_a_trolleys, s.seq) as group_a_trolleys,
 0 as group_b_cores from saves s group by job_id
union all select job_id, group_a_cores, group_a_trolleys, group_b_cores from counts c
where not exists (select 1 from saves s where s.job_id = c.job_id)""",
)
def upsert_stream(t: Tables) -> DataFrame:
    arriving = Tables(t.spark, t.folder)
    arriving._known["saves"] = t.derive("saves", events=t.stream("events"))
    log = feeds.follow_saves(incoming_saves(arriving), "saves")
    return log.current(stamped(t.counts), "job_id").select(
        "job_id", "group_a_cores", "group_a_trolleys", "group_b_cores"
    )


@query(
    "st_02_deletes",
    "counts saves jobs",
    """with gone as (select id from jobs where status = 'pulled')
select job_id, arg_max(s.group_a_cores, s.seq) as group_a_cores, arg_max(s.group_a_trolleys, s.seq) as group_a_trolleys
from saves s where job_id not in (select id from gone) group by job_id
union all select job_id, group_a_cores, group_a_trolleys from counts c
where job_id not in (select id from gone) and job_id not in (select job_id from saves)""",
)
def upserts_and_deletes(t: Tables) -> DataFrame:
    arriving = Tables(t.spark, t.folder)
    arriving._known["saves"] = t.derive("saves", events=t.stream("events"))
    pulled = t.derive("jobs", orders=t.stream("orders")).where("status = 'pulled'").select(F.col("id").alias("job_id"))
    log = feeds.follow_saves(incoming_saves(arriving), "saves", deletes=pulled)
    counts = feeds.surviving(t.counts, "job_id", log)
    return log.current(stamped(counts), "job_id").select("job_id", "group_a_cores", "group_a_trolleys")


@query(
    "st_02_resent",
    "saves",
    "select job_id, count(*) as payloads, max(seq) as last_seq from saves group by job_id",
)
def resent_saves(t: Tables) -> DataFrame:
    """Every payload arrives twice, five seconds apart; the second one counts for nothing."""
    arriving = t.stream("events")
    saves = t.derive("saves", events=arriving).withColumn("arrived_at", arrived("updated_at", "seq"))
    again = saves.withColumns({"arrived_at": F.col("arrived_at") + F.expr("interval 5 seconds"), "sent_again": F.lit(True)})
    both = saves.withColumn("sent_again", F.lit(False)).unionByName(again)
    counted = collect_rows(feeds.once(both, "arrived_at", f"{DELAY_SECONDS} seconds"), "once")
    return counted.groupBy("job_id").agg(F.count("*").alias("payloads"), F.max("seq").alias("last_seq"))


def arrived(updated_at: str, seq: str) -> Column:
    """When a save came in: offline replays carry an older time stamp."""
    return F.col(updated_at).cast("timestamp") + F.make_dt_interval(hours=(F.col(seq) % 3 * 9).cast("int"))


def stamped(counts: DataFrame) -> DataFrame:
    """Stored counts with the columns that order saves; stored rows come first."""
    return counts.withColumns({"updated_at": F.lit(None).cast("timestamp"), "seq": F.lit(None).cast("long")})


OUTCOMES = """select job_id, max(seq) as seq, case when arg_max(offline, seq) then 'pending'
 when job_id in (select id from jobs where status = 'pulled') then 'dropped' else 'applied' end as outcome from saves group by job_id"""


@query("st_03", "saves jobs", OUTCOMES)
def replay_outcomes(t: Tables) -> DataFrame:
    kept = t.jobs.where("status <> 'pulled'")
    return edits.replay(t.saves, kept).select("job_id", "seq", "outcome")


@query("st_03_stream", "saves jobs", OUTCOMES)
def replay_stream(t: Tables) -> DataFrame:
    kept = t.jobs.where("status <> 'pulled'")
    log = feeds.follow_replays(t.derive("saves", events=t.stream("events")), kept, "replays")
    return log.newest("job_id").select("job_id", "seq", "outcome")


@query(
    "st_03_retry",
    "saves jobs",
    """select job_id, max(seq) as seq, if(arg_max(offline, seq), 2, 1) as attempts,
 if(job_id in (select id from jobs where status = 'pulled'), 'dropped', 'applied') as outcome from saves group by job_id""",
)
def retried_by_the_clock(t: Tables) -> DataFrame:
    clock = new_folder(t.spark, "ticks")
    for _ in range(3):  # one tick per micro-batch; only the first brings saves too
        t.spark.range(1).write.mode("append").parquet(clock)
    ticks = t.spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(clock)
    kept = t.jobs.where("status <> 'pulled'")
    log = feeds.follow_replays(t.derive("saves", events=t.stream("events")), kept, "replays", ticks=ticks)
    return log.newest("job_id").select("job_id", "seq", "attempts", "outcome")


# Every edit applied one after the other to the stored counts.
FOLD_STEPS = """numbered as (select *, row_number() over (partition by job_id order by seq) as rn,
  count(*) over (partition by job_id) as n, case when raw = 'n/a' then null else cast(replace(raw, 'x', '') as int) end as num from edits),
state as (
 select distinct e.job_id, cast(0 as bigint) as rn, ifnull(group_a_cores, 0) as ac, ifnull(group_a_trolleys, 0) as "at",
  ifnull(group_b_cores, 0) as bc, ifnull(group_b_trolleys, 0) as bt, manual_total_override as total,
  ifnull(comment, '') as comment, ifnull(still_making, false) as making
 from edits e left join counts c on c.job_id = e.job_id
 union all
 select s.job_id, n.rn, if(kind = 'cores' and box = 'a', ifnull(num, 0), ac),
  if(kind in ('plus', 'minus') and box = 'a', greatest(0, "at" + if(kind = 'plus', 1, -1)), "at"),
  if(kind = 'cores' and box = 'b', ifnull(num, 0), bc),
  if(kind in ('plus', 'minus') and box = 'b', greatest(0, bt + if(kind = 'plus', 1, -1)), bt),
  case when kind in ('plus', 'minus', 'cores') then null when kind = 'total' then num else total end,
  if(kind = 'comment', raw, comment), if(kind = 'making', checked, making)
 from state s join numbered n on n.job_id = s.job_id and n.rn = s.rn + 1)"""
FOLD_RESULT = """select s.job_id, cast(ac as int) as group_a_cores, cast("at" as int) as group_a_trolleys, cast(bc as int) as group_b_cores,
 cast(bt as int) as group_b_trolleys, cast(total as int) as manual_total_override, comment, making as still_making
from state s join (select distinct job_id, n from numbered) l on l.job_id = s.job_id and l.n = s.rn"""
FOLDED = f"{FOLD_STEPS}\n{FOLD_RESULT}"


@query("st_04", "counts edits", f"with {FOLDED}", recursive=True)
def folded_edits(t: Tables) -> DataFrame:
    return edits.fold(t.edits, t.counts).drop("updated_at")


@query("st_04_stream", "counts edits", f"with {FOLDED}", recursive=True)
def folded_stream(t: Tables) -> DataFrame:
    log = feeds.follow_edits(t.derive("edits", events=t.stream("events")), t.counts, "edits")
    return log.newest("job_id")


def arriving_chat(t: Tables) -> DataFrame:
    return t.derive("chat_messages", conversations=t.stream("conversations"))


@query(
    "st_05",
    "chat_messages published_chat_day",
    "select m.id, m.body from chat_messages m join published_chat_day p on p.job_date = m.job_date",
)
def day_feed(t: Tables) -> DataFrame:
    feed = feeds.day_feed(arriving_chat(t), t.published_chat_day).select("id", "body")
    return collect_rows(feed, "day-feed")


UNREAD = """select job_date, exists (select 1 from chat_messages m where m.job_date = d.job_date and m.sender_role = 'admin'
 and m.created_at > coalesce(s.last_seen, timestamp '0001-01-01 00:00:00')) as unread
from (select distinct job_date from chat_messages) d join chat_seen s using (job_date)"""


@query("st_06", "chat_messages chat_seen", UNREAD)
def unread_days(t: Tables) -> DataFrame:
    return chat.unread(chat.newest_office(t.chat_messages), t.chat_seen)


@query("st_06_stream", "chat_messages chat_seen", UNREAD)
def unread_stream(t: Tables) -> DataFrame:
    log = feeds.follow_office_messages(arriving_chat(t), "unread")
    return chat.unread(log.newest("job_date"), t.chat_seen)


@query(
    "st_06_viewers",
    "chat_messages",
    """with seen as (select job_date, sender_name as viewer, max(created_at) as last_seen from chat_messages
  where sender_role = 'trolley' and read_at is not null and sender_name <> '' group by all)
select s.job_date, viewer, exists (select 1 from chat_messages m where m.job_date = s.job_date and m.sender_role = 'admin'
 and m.created_at > s.last_seen) as unread from seen s""",
)
def unread_per_viewer(t: Tables) -> DataFrame:
    """Floor messages that were read stand for the moments their sender had the thread open."""
    opened = arriving_chat(t).where("sender_role = 'trolley' and read_at is not null and sender_name <> ''")
    seen = opened.select("job_date", F.col("sender_name").alias("viewer"), F.col("created_at").alias("seen_at"))
    return feeds.unread_by_viewer(feeds.follow_unread(arriving_chat(t), seen, "unread"))


@query("st_07", "chat_messages published_chat_day", MARKED_READ)
def receipt_stream(t: Tables) -> DataFrame:
    log = feeds.follow_receipts(arriving_chat(t), t.published_chat_day, F.expr(READ_STAMP), "Sam", "receipts")
    return plain(log.newest("id").select("id", "read_at", "read_by"))


@query(
    "st_08",
    "pixels cal",
    f"""with {RAW_FIT}, live as (select * from pixels where not frozen and x between 13 and 36 and y between 13 and 36),
frames as (select frame_id, device, (r - b) / (r + b + 1e-6) as idx from ({MEANS.replace("from pixels", "from live")}) m)
select frame_id, cast(floor(a * idx + b + 0.5) as bigint) as temperature,
 case when r2 > 0.9 then 'good' when r2 > 0.6 then 'fair' when r2 is null then 'uncalibrated' else 'poor' end as tier
from frames left join fits using (device)""",
)
def temperature_stream(t: Tables) -> DataFrame:
    start = F.lit("2000-01-01 00:00:00").cast("timestamp")
    fits = calibration.fit(t.cal).withColumns({"seq": F.lit(0).cast("long"), "added_at": start})
    return live_frames(t, fits).newest("frame_id").select("frame_id", "temperature", "tier")


def seconds_on(column: str) -> Column:
    """So many seconds into the day of the frames."""
    return F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col(column))


def live_frames(t: Tables, fits: DataFrame) -> ChangeLog:
    arriving = t.derive("pixels", lineitem=t.stream("lineitem")).withColumn("captured_at", seconds_on("frame_id"))
    return feeds.follow_temperatures(arriving, fits, WIDTH, HEIGHT, f"{DELAY_SECONDS} seconds", "temperatures")


@query(
    "st_08_refit",
    "pixels cal_seq",
    f"""with live as (select * from pixels where not frozen and x between 13 and 36 and y between 13 and 36),
frames as (select frame_id, device, (r - b) / (r + b + 1e-6) as idx from ({MEANS.replace("from pixels", "from live")}) m),
sums as (select device, seq, count(*) over w as n, regr_slope(temp, idx) over w as a, regr_intercept(temp, idx) over w as b,
  case when var_pop(temp) over w * count(*) over w > 1e-9 then regr_r2(temp, idx) over w else 1 end as r2,
  count(*) over w >= 2 and var_pop(idx) over w * power(count(*) over w, 2) >= 1e-9 as ok
 from cal_seq window w as (partition by device order by seq rows unbounded preceding)),
asof_fit as (select f.frame_id, f.idx, s.n, case when s.ok then s.a end as a, case when s.ok then s.b end as b, case when s.ok then s.r2 end as r2
 from frames f asof left join sums s on s.device = f.device and s.seq <= f.frame_id)
select frame_id, n as points, round(a * idx + b, 3) as estimate,
 case when r2 > 0.9 then 'good' when r2 > 0.6 then 'fair' when r2 is null then 'uncalibrated' else 'poor' end as tier from asof_fit""",
)
def temperatures_refitted(t: Tables) -> DataFrame:
    """Points and frames of one day: each frame is scored with the points added before it."""
    points = t.derive("cal_seq", events=t.stream("events")).withColumn("added_at", seconds_on("seq"))
    # Stored, because every batch of frames reads them twice, to sample and to order them.
    versions = stored(calibration.version_fits(feeds.follow_points(points, "points").newest(["device", "seq"])), "versions")
    scored = live_frames(t, versions).newest("frame_id")
    return scored.select("frame_id", "points", F.round("estimate", 3).alias("estimate"), "tier")


@query(
    "st_09_stream",
    "counts saves",
    """select job_id, group_a_cores, group_a_trolleys from (select * from saves
 qualify row_number() over (partition by job_id order by updated_at desc, seq desc) = 1) s
union all select job_id, group_a_cores, group_a_trolleys from counts where job_id not in (select job_id from saves)""",
)
def event_time_stream(t: Tables) -> DataFrame:
    arriving = Tables(t.spark, t.folder)
    arriving._known["saves"] = t.derive("saves", events=t.stream("events"))
    log = feeds.follow_saves(incoming_saves(arriving), "event-time", by_event_time=True)
    current = log.current(stamped(t.counts), "job_id", order_by=feeds.EVENT_TIME)
    return current.select("job_id", "group_a_cores", "group_a_trolleys")


@query(
    "st_09",
    "saves",
    """select a.job_id, a.seq as arrival_seq, e.seq as event_time_seq, a.seq <> e.seq as regressed
from (select * from saves qualify row_number() over (partition by job_id order by seq desc) = 1) a
join (select * from saves qualify row_number() over (partition by job_id order by updated_at desc, seq desc) = 1) e using (job_id)""",
)
def late_winners(t: Tables) -> DataFrame:
    return feeds.winners(t.saves)
