"""Streams cut into several micro-batches end in the same state as one batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from floorspark.operators import calibration, changes, chat, edits
from floorspark.queries.scans import incoming_saves
from floorspark.queries.streams import stamped
from floorspark.session import new_folder
from floorspark.sources.schemas import SOURCES
from floorspark.sources.tables import Tables
from floorspark.streaming import feeds
from floorspark.streaming.run import ChangeLog, collect_rows
from tests.checks import DATA, spark_rows


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, f"{DATA}/sf0.001")


def in_pieces(tables, name, order, pieces=4):
    """A table as a stream of files, each a later stretch, one file per micro-batch."""
    spark = tables.spark
    folder = new_folder(spark, f"pieces-{name}")
    rows = tables.table(name)
    low, high = rows.agg(F.min(order), F.max(order)).first()
    for i in range(pieces):
        start, end = low + (high + 1 - low) * i // pieces, low + (high + 1 - low) * (i + 1) // pieces
        part = rows.where((F.col(order) >= start) & (F.col(order) < end))
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SOURCES[name]).option("maxFilesPerTrigger", 1).parquet(folder)


def arriving(tables, name, binding, order):
    return tables.derive(binding, **{name: in_pieces(tables, name, order)})


def batches(log: ChangeLog) -> int:
    return log.rows().where("batch >= 0").select("batch").distinct().count()


def test_folded_edits(tables):
    log = feeds.follow_edits(arriving(tables, "events", "edits", "event_id"), tables.counts, "fold")
    assert batches(log) == 4
    expected = edits.fold(tables.edits, tables.counts).drop("updated_at")
    assert spark_rows(log.newest("job_id")) == spark_rows(expected)


def test_latest_saves(tables):
    changed = Tables(tables.spark, tables.folder)
    changed._known["saves"] = arriving(tables, "events", "saves", "event_id")
    log = feeds.follow_saves(incoming_saves(changed), "saves")
    assert batches(log) == 4
    kept = ["job_id", "group_a_cores", "group_a_trolleys", "comment"]
    expected = changes.upsert(tables.counts, incoming_saves(tables), "job_id")
    current = log.current(stamped(tables.counts), "job_id")
    assert spark_rows(current.select(*kept)) == spark_rows(expected.select(*kept))


def test_late_saves_lose_by_event_time(tables):
    changed = Tables(tables.spark, tables.folder)
    changed._known["saves"] = arriving(tables, "events", "saves", "event_id")
    log = feeds.follow_saves(incoming_saves(changed), "event-time", by_event_time=True)
    assert batches(log) == 4
    kept = ["job_id", "group_a_cores", "group_a_trolleys"]
    current = log.current(stamped(tables.counts), "job_id", order_by=feeds.EVENT_TIME).select(*kept)
    expected = changes.upsert(tables.counts, incoming_saves(tables), "job_id", "updated_at").select(*kept)
    by_arrival = changes.upsert(tables.counts, incoming_saves(tables), "job_id").select(*kept)
    assert spark_rows(current) == spark_rows(expected) != spark_rows(by_arrival)


def test_pending_saves_are_retried(tables):
    jobs = tables.jobs.where("status <> 'pulled'")
    log = feeds.follow_replays(arriving(tables, "events", "saves", "event_id"), jobs, "replays")
    rows = log.rows().where("batch >= 0").collect()
    pending = {(r["batch"] + 1, r["job_id"]): r["seq"] for r in rows if r["outcome"] == "pending" and r["batch"] < 3}
    later = {(r["batch"], r["job_id"]): (r["seq"], r["outcome"]) for r in rows}
    assert pending
    for key, seq in pending.items():
        assert key in later and later[key][0] >= seq
    alive = {r["id"] for r in jobs.select("id").collect()}
    assert all((r["outcome"] == "dropped") == (r["job_id"] not in alive) for r in rows if r["outcome"] != "pending")


def test_debounced_bursts(tables):
    closed = collect_rows(
        feeds.debounced(arriving(tables, "events", "edits", "event_id"), "1 hour", "10 minutes"), "bursts"
    )
    batch = edits.bursts(tables.edits, 3600)
    last = tables.edits.agg(F.max("ts")).first()[0]
    settled = batch.where(F.col("ts") < F.lit(last) - F.expr("interval 71 minutes"))
    streamed = {r["seq"] for r in closed.collect()}
    assert {r["seq"] for r in settled.collect()} <= streamed <= {r["seq"] for r in batch.collect()}


def test_unread_state(tables):
    log = feeds.follow_office_messages(arriving(tables, "conversations", "chat_messages", "conv_id"), "unread")
    expected = chat.unread(chat.newest_office(tables.chat_messages), tables.chat_seen)
    assert spark_rows(chat.unread(log.newest("job_date"), tables.chat_seen)) == spark_rows(expected)


def test_a_repeated_batch_counts_once(spark):
    log = ChangeLog.create(spark, "repeat", "job_id long, total int")
    rows = spark.createDataFrame([(1, 5)], "job_id long, total int")
    log.write(rows, 0)
    log.write(rows, 0)
    assert log.rows().count() == 1
    base = spark.createDataFrame([(1, 1), (2, 2)], "job_id long, total int")
    assert {r[0]: r[1] for r in log.current(base, "job_id").collect()} == {1: 5, 2: 2}
    assert log.newest("job_id", before=0).count() == 0


def test_continuous_feed_polls_and_stops(tables):
    from floorspark.streaming.run import run

    folder = new_folder(tables.spark, "poll")
    feed = feeds.day_feed(arriving(tables, "conversations", "chat_messages", "conv_id"), tables.published_chat_day)
    stream = run(
        feed.select("id").writeStream.format("parquet").option("path", f"{folder}/rows"), folder, continuous=True, every="1 second"
    )
    stream.processAllAvailable()
    stream.stop()
    expected = tables.chat_messages.join(tables.published_chat_day.select("job_date"), "job_date").count()
    assert tables.spark.read.schema("id long").parquet(f"{folder}/rows").count() == expected > 0


def test_plan_rows_on_a_stream(tables):
    from floorspark.operators import flows

    as_of = F.expr("timestamp'2024-01-02 06:00:00'")
    static = (tables.jobs, tables.item_reference, tables.dip_items, as_of)
    columns = ["req_id", "row_no", "needs_dipping", "part_check", "differing_fields", "action"]
    arriving_tables = Tables(tables.spark, tables.folder)
    arriving_tables._known["envelopes"] = arriving(tables, "orders", "envelopes", "o_orderkey")
    streamed = collect_rows(flows.plan_rows(arriving_tables.requests, *static).select(*columns), "plan-rows")
    assert spark_rows(streamed) == spark_rows(flows.plan_rows(tables.requests, *static).select(*columns))


RESUMED = {
    "saves": (
        "events",
        "event_id",
        lambda t, arriving, folder: feeds.follow_saves(incoming_saves(_with(t, "saves", arriving)), "saves", folder=folder),
        lambda t, log: log.current(stamped(t.counts), "job_id").select("job_id", "group_a_cores", "comment"),
        lambda t: changes.upsert(t.counts, incoming_saves(t), "job_id").select("job_id", "group_a_cores", "comment"),
    ),
    "edits": (
        "events",
        "event_id",
        lambda t, arriving, folder: feeds.follow_edits(arriving, t.counts, "edits", folder=folder),
        lambda t, log: log.newest("job_id"),
        lambda t: edits.fold(t.edits, t.counts).drop("updated_at"),
    ),
    "chat_messages": (
        "conversations",
        "conv_id",
        lambda t, arriving, folder: feeds.follow_office_messages(arriving, "unread", folder=folder),
        lambda t, log: log.newest("job_date"),
        lambda t: chat.newest_office(t.chat_messages),
    ),
}


def _with(tables, name, rows):
    changed = Tables(tables.spark, tables.folder)
    changed._known[name] = rows
    return changed


@pytest.mark.parametrize("binding", list(RESUMED))
def test_a_stream_goes_on_after_a_restart(tables, binding, monkeypatch):
    monkeypatch.setattr(ChangeLog, "SETTLE_EVERY", 2)
    source, order, start, read, expected = RESUMED[binding]
    spark, folder, log_folder = tables.spark, new_folder(tables.spark, "arriving"), new_folder(tables.spark, "log")
    rows = tables.table(source)
    low, high = rows.agg(F.min(order), F.max(order)).first()
    for i in range(3):
        cut = [low + (high + 1 - low) * k // 3 for k in (i, i + 1)]
        rows.where((F.col(order) >= cut[0]) & (F.col(order) < cut[1])).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SOURCES[source]).option("maxFilesPerTrigger", 1).parquet(folder)
        log = start(tables, tables.derive(binding, **{source: stream}), log_folder)
    assert log._batches().where("batch >= 0").select("batch").distinct().count() == 3
    assert spark.read.parquet(f"{log_folder}/settled").where("upto = 1").count() > 0
    assert spark_rows(read(tables, log)) == spark_rows(expected(tables))


def test_receipts_reach_messages_published_later(spark):
    import datetime as dt

    folder = new_folder(spark, "messages")
    columns = "id long, job_date date, sender_role string, body string, created_at timestamp, read_at timestamp, read_by string"
    day, now = dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 6)
    published = [dt.date(2024, 1, 1)]
    of_day = lambda: spark.createDataFrame([(1, published[0])], "id int, job_date date")
    log_folder = new_folder(spark, "log")
    for i, shown in enumerate([dt.date(2024, 1, 1), day]):
        published[0] = shown
        spark.createDataFrame([(i, day, "admin", "b", now, None, None)], columns).write.mode("append").parquet(folder)
        messages = spark.readStream.schema(columns).parquet(folder)
        log = feeds.follow_receipts(messages, of_day, F.lit(now), "Sam", "receipts", folder=log_folder)
    assert {r["id"]: r["read_by"] for r in log.newest("id").collect()} == {0: "Sam", 1: "Sam"}


def test_applied_replays_reach_the_counts(tables):
    jobs = tables.jobs.where("status <> 'pulled'")
    changed = _with(tables, "saves", arriving(tables, "events", "saves", "event_id"))
    whole = incoming_saves(changed).withColumn("offline", F.lit(False))
    log = feeds.follow_replays(whole, jobs, "replays")
    alive = incoming_saves(tables).join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    expected = changes.upsert(tables.counts, alive, "job_id")
    assert spark_rows(feeds.applied_replays(log, tables.counts)) == spark_rows(expected.select(*tables.counts.columns))


def test_open_bursts_come_from_the_state(tables):
    """Every burst is there, closed or open, also while the stream goes on."""
    folder = new_folder(tables.spark, "bursts")
    every = feeds.all_bursts(arriving(tables, "events", "edits", "event_id"), "1 hour", "10 minutes", folder)
    columns = ["job_id", "seq", "kind", "raw"]
    assert spark_rows(every.select(*columns)) == spark_rows(edits.bursts(tables.edits, 3600).select(*columns))
    assert feeds.open_bursts(tables.spark, folder, every.columns).count() > 0


POINTS = "device long, seq long, idx double, temp double, added_at timestamp"
PIXELS = "frame_id long, device long, x int, y int, r double, g double, b double, frozen boolean, captured_at timestamp"


def clock(minute):
    import datetime as dt

    return dt.datetime(2024, 1, 1, 6) + dt.timedelta(minutes=minute)


def test_a_point_added_midway_changes_later_frames_only(spark):
    """Points and frames come in turns; frames after the second run see its points."""
    points_at, pixels_at = new_folder(spark, "points"), new_folder(spark, "pixels")
    fits_at, frames_at = new_folder(spark, "fits"), new_folder(spark, "frames")
    points = [[(1, 0, 0.0, 1000.0, clock(0)), (1, 1, 0.5, 1100.0, clock(1))], [(1, 2, 0.25, 1500.0, clock(10)), (2, 3, 0.1, 900.0, clock(11))]]
    frames = [[(1, 1, clock(0)), (2, 1, clock(5)), (3, 2, clock(5))], [(4, 1, clock(9)), (5, 1, clock(12)), (6, 2, clock(12))]]
    for added, shown in zip(points, frames, strict=True):
        spark.createDataFrame(added, POINTS).coalesce(1).write.mode("append").parquet(points_at)
        pixels = [(f, d, 25, 25, 60.0, 0.0, 20.0, False, at) for f, d, at in shown] + [(f, d, 1, 1, 9.0, 9.0, 9.0, False, at) for f, d, at in shown]
        spark.createDataFrame(pixels, PIXELS).coalesce(1).write.mode("append").parquet(pixels_at)
        versions = feeds.follow_points(spark.readStream.schema(POINTS).parquet(points_at), "points", fits_at)
        current = lambda log=versions: calibration.version_fits(log.newest(["device", "seq"]))
        log = feeds.follow_temperatures(spark.readStream.schema(PIXELS).parquet(pixels_at), current, 50, 50, "10 minutes", "frames", frames_at)
    found = {r["frame_id"]: (r["points"], r["temperature"]) for r in log.newest("frame_id").collect()}
    # idx is 0.5: on the line through two points 1100, on the refit 1200 + ...
    whole = calibration.fit(spark.createDataFrame([p for run in points for p in run if p[0] == 1], POINTS)).first()
    after = int(whole["a"] * (40 / (80 + 1e-6)) + whole["b"] + 0.5)
    assert found == {1: (1, None), 2: (2, 1100), 3: (None, None), 4: (2, 1100), 5: (3, after), 6: (1, None)} and after != 1100
    versions = {(r["device"], r["seq"]): r["n"] for r in versions.rows().where("batch >= 0").collect()}
    assert versions == {(1, 0): 1, (1, 1): 2, (1, 2): 3, (2, 3): 1}


def test_versions_do_not_depend_on_the_batches(tables):
    points = arriving(tables, "events", "cal_seq", "event_id").withColumn("added_at", F.timestamp_seconds("seq"))
    log = feeds.follow_points(points, "points")
    assert batches(log) == 4
    rounded = lambda rows: spark_rows(rows.select("device", "seq", "n", *[F.round(c, 6).alias(c) for c in ("a", "b", "r2")]))
    assert rounded(calibration.version_fits(log.newest(["device", "seq"]))) == rounded(calibration.fit_history(tables.cal_seq))


def test_frames_take_the_version_of_their_time(spark):
    """A third of all frames on one device, equal times, devices without a version."""
    frames = spark.range(900).select(
        F.col("id").alias("frame_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).cast("long").alias("device"),
        F.timestamp_seconds(F.col("id") % 60).alias("captured_at"),
    )
    versions = spark.range(300).select(
        (F.col("id") % 40).alias("device"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 7 % 60).alias("added_at"), (F.col("id") * 3).alias("value")
    )
    got = {r["frame_id"]: r["value"] for r in calibration.as_of(frames, versions, "captured_at").collect()}
    known = versions.collect()
    for f in frames.collect():
        there = [(v["added_at"], v["seq"], v["value"]) for v in known if v["device"] == f["device"] and v["added_at"] <= f["captured_at"]]
        assert got[f["frame_id"]] == (max(there)[2] if there else None)


def test_the_clock_retries_without_new_saves(spark):
    """Two payloads wait, the network comes back with the third tick; a newer save replaces one."""
    saves_at, ticks_at, log_at = new_folder(spark, "saves"), new_folder(spark, "ticks"), new_folder(spark, "log")
    columns = "job_id long, seq long, updated_at timestamp, offline boolean"
    jobs = spark.createDataFrame([(1,), (2,), (4,)], "id long")

    def go(new=()):
        if new:
            spark.createDataFrame(list(new), columns).coalesce(1).write.mode("append").parquet(saves_at)
        spark.range(1).write.mode("append").parquet(ticks_at)
        ticks = spark.readStream.schema("id long").parquet(ticks_at)
        saves = spark.readStream.schema(columns).parquet(saves_at)
        log = feeds.follow_replays(saves, jobs, "replays", log_at, ticks=ticks, unreachable=lambda batch: F.lit(batch < 3))
        return {r["job_id"]: (r["seq"], r["attempts"], r["outcome"]) for r in log.newest("job_id").collect()}

    assert go([(1, 0, clock(0), True), (2, 1, clock(0), True), (3, 2, clock(0), True), (4, 3, clock(0), False)]) == {
        1: (0, 1, "pending"), 2: (1, 1, "pending"), 3: (2, 1, "pending"), 4: (3, 1, "applied")
    }
    assert go() == {1: (0, 2, "pending"), 2: (1, 2, "pending"), 3: (2, 2, "pending"), 4: (3, 1, "applied")}
    assert go([(2, 9, clock(5), False)]) == {1: (0, 3, "pending"), 2: (9, 1, "applied"), 3: (2, 3, "pending"), 4: (3, 1, "applied")}
    assert go() == {1: (0, 4, "applied"), 2: (9, 1, "applied"), 3: (2, 4, "dropped"), 4: (3, 1, "applied")}
    assert go() == {1: (0, 4, "applied"), 2: (9, 1, "applied"), 3: (2, 4, "dropped"), 4: (3, 1, "applied")}


def test_a_running_clock_ticks(spark):
    import time

    from floorspark.streaming.run import run

    folder = new_folder(spark, "clock")
    stream = run(feeds.retry_clock(spark, 1).writeStream.format("parquet").option("path", f"{folder}/rows"), folder, continuous=True, every="1 second")
    until = time.time() + 30
    while time.time() < until and spark.read.schema("value long").parquet(f"{folder}/rows" if stream.lastProgress else ChangeLog.create(spark, "no", "value long").folder + "/rows").count() < 2:
        time.sleep(0.5)
    stream.stop()
    assert spark.read.schema("value long").parquet(f"{folder}/rows").count() >= 2


def deleted_stream(spark, folder, ids):
    spark.createDataFrame([(i,) for i in ids], "job_id long").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("job_id long").parquet(folder)


def test_deleted_jobs_end_their_counts_and_notes(tables):
    """Deletes in the middle of a stream: counts, notes and later saves of the job go."""
    spark, gone_at, log_at, events_at = tables.spark, new_folder(tables.spark, "gone"), new_folder(tables.spark, "log"), new_folder(tables.spark, "events")
    saved = [r["job_id"] for r in tables.saves.select("job_id").distinct().orderBy("job_id").limit(4).collect()]
    middle = tables.events.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    for i, ids in enumerate([saved[:1], saved[1:3]]):
        part = tables.events.where(F.col("event_id") < middle if i == 0 else F.col("event_id") >= middle)
        part.coalesce(1).write.mode("append").parquet(events_at)
        stream = tables.derive("saves", events=spark.readStream.schema(SOURCES["events"]).parquet(events_at))
        log = feeds.follow_saves(incoming_saves(_with(tables, "saves", stream)), "saves", folder=log_at, deletes=deleted_stream(spark, gone_at, ids))
    assert {r["job_id"] for r in log.ended_keys().collect()} == set(saved[:3])
    left = log.current(stamped(feeds.surviving(tables.counts, "job_id", log)), "job_id")
    expected = changes.upsert(tables.counts, incoming_saves(tables), "job_id").where(~F.col("job_id").isin(saved[:3]))
    kept = ["job_id", "group_a_cores", "comment"]
    assert spark_rows(left.select(*kept)) == spark_rows(expected.select(*kept))
    notes = feeds.surviving(tables.job_notes, "job_id", log)
    assert spark_rows(notes.select("id")) == spark_rows(tables.job_notes.where(~F.col("job_id").isin(saved[:3])).select("id"))


def test_edits_of_deleted_jobs_are_left_out(tables):
    spark, gone_at = tables.spark, new_folder(tables.spark, "gone")
    ids = [r["job_id"] for r in tables.edits.select("job_id").distinct().orderBy("job_id").limit(2).collect()]
    log = feeds.follow_edits(
        arriving(tables, "events", "edits", "event_id"), tables.counts, "fold", deletes=deleted_stream(spark, gone_at, ids)
    )
    expected = edits.fold(tables.edits, tables.counts).drop("updated_at").where(~F.col("job_id").isin(ids))
    assert spark_rows(log.newest("job_id")) == spark_rows(expected)


def test_resent_payloads_count_once_across_batches(spark):
    folder, columns = new_folder(spark, "saves"), "job_id long, seq long, updated_at timestamp, arrived_at timestamp"
    rows = [[(1, 0, clock(0), clock(0)), (1, 1, clock(0), clock(1))], [(1, 2, clock(0), clock(2)), (2, 3, clock(-500), clock(3))], [(2, 4, clock(-500), clock(4)), (1, 5, clock(5), clock(5))]]
    for part in rows:
        spark.createDataFrame(part, columns).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(folder)
    found = collect_rows(feeds.once(stream, "arrived_at", "10 minutes"), "once").collect()
    assert sorted((r["job_id"], r["updated_at"]) for r in found) == [(1, clock(0)), (1, clock(5)), (2, clock(-500))]


def test_markers_and_messages_meet_while_both_arrive(tables):
    """The dot goes when the panel is opened and comes back with a newer message."""
    import datetime as dt

    spark, day = tables.spark, dt.date(2024, 1, 1)
    said_at, seen_at, log_at = (new_folder(tables.spark, n) for n in ("said", "seen", "log"))
    said, seen = "job_date date, sender_role string, created_at timestamp", "job_date date, viewer string, seen_at timestamp"

    def go(message, marker):
        spark.createDataFrame([(day, *message)], said).coalesce(1).write.mode("append").parquet(said_at)
        spark.createDataFrame([(day, *marker)], seen).coalesce(1).write.mode("append").parquet(seen_at)
        log = feeds.follow_unread(spark.readStream.schema(said).parquet(said_at), spark.readStream.schema(seen).parquet(seen_at), "unread", log_at)
        return {r["viewer"]: r["unread"] for r in feeds.unread_by_viewer(log).collect()}

    assert go(("admin", clock(0)), ("Ann", clock(-1))) == {"Ann": True}
    assert go(("trolley", clock(9)), ("Ann", clock(1))) == {"Ann": False}
    assert go(("admin", clock(2)), ("Bob", clock(3))) == {"Ann": True, "Bob": False}


def test_a_log_settles_in_levels_and_drops_what_is_settled(spark, monkeypatch):
    monkeypatch.setattr(ChangeLog, "SETTLE_EVERY", 3)
    log = ChangeLog.create(spark, "levels", "job_id long, total int", key="job_id")
    state = {}
    for batch in range(20):
        rows = [(batch % 4, batch), (100 + batch, batch)]
        state |= dict(rows)
        log.write(spark.createDataFrame(rows, "job_id long, total int"), batch)
        if (batch + 1) % 3 == 0:
            log.settle(batch)
        if batch in (2, 7, 8, 13, 17, 19):
            assert {r["job_id"]: r["total"] for r in log.newest("job_id").collect()} == state
            earlier = {r["job_id"]: r["total"] for r in log.newest("job_id", before=batch).collect()}
            assert earlier == {k: v for k, v in _state_before(batch).items()}
    assert log._settled(None) == ([(2, 8), (2, 17)], 18)
    assert min(n for n in log._numbers("rows") if n >= 0) >= 15 and len(log._numbers("settled/level=1")) <= 6


def _state_before(batch):
    state = {}
    for b in range(batch):
        state |= {b % 4: b, 100 + b: b}
    return state


def test_checks_are_counted_while_a_stream_is_stored(spark):
    from floorspark.operators import quality

    columns = "id long, sender_role string"
    checks = {"no role": quality.missing("sender_role"), "role": quality.not_allowed("sender_role", quality.SENDER_ROLES)}
    folder = new_folder(spark, "roles")
    for part in ([(1, "admin"), (2, None)], [(3, "boss"), (4, "boss"), (5, "trolley")]):
        spark.createDataFrame(part, columns).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(folder)
    log = ChangeLog.create(spark, "checked", columns, key="id", checks=checks).follow(stream, lambda rows, batch: rows)
    found = {}
    for r in log.violations().collect():
        found.setdefault(r["batch"], {})[r["check_name"]] = r["rows"]
    assert found == {0: {"rows": 2, "no role": 1, "role": 0}, 1: {"rows": 3, "no role": 0, "role": 2}}
    assert log.newest("id").count() == 5


def test_a_batch_without_frames_orders_no_versions(tables):
    """The last batch only moves the watermark: fits are asked for once."""
    from floorspark.operators import calibration
    from floorspark.queries.streams import live_frames

    start = F.lit("2000-01-01 00:00:00").cast("timestamp")
    versions = calibration.fit(tables.cal).withColumns({"seq": F.lit(0).cast("long"), "added_at": start})
    asked = []
    log = live_frames(tables, lambda: asked.append(1) or versions)
    assert len(asked) == 1
    assert log.newest("frame_id").count() > 0
