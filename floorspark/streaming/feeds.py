"""Streams of edits, saves, messages and frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspark.operators import calibration, changes, edits, views
from floorspark.plans.skew import lookup_join
from floorspark.session import new_folder
from floorspark.streaming.run import ChangeLog, collect_rows

# Fixed value: how often the floor page tries waiting saves again.
RETRY_SECONDS = 15

COUNT_COLUMNS = (
    "job_id long, group_a_cores int, group_a_trolleys int, group_b_cores int, group_b_trolleys int, "
    "manual_total_override int, comment string, still_making boolean"
)


def debounced(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    """The last edit of each burst, emitted once the watermark has passed it.

    ``gap`` is the quiet time that ends a burst, ``delay`` how late an edit may
    arrive.
    """
    payload = [c for c in stream.columns if c not in ("job_id", "ts")]
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    last = F.max_by(F.struct("ts", *payload), F.struct("ts", "seq"))
    return (
        timed.groupBy("job_id", F.session_window("ts", gap))
        .agg(last.alias("_last"))
        .select("job_id", F.col("_last.ts").alias("ts"), *[F.col(f"_last.{c}").alias(c) for c in payload])
    )


def open_bursts(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """The last edit so far of each burst that a debounced stream has not closed.

    They are read from the state in the stream's checkpoint, as of its last batch.
    """
    state = spark.read.format("statestore").load(f"{folder}/checkpoint")
    payload = [c for c in columns if c != "job_id"]
    held = next(f.name for f in state.schema["value"].dataType.fields if getattr(f.dataType, "names", None) == payload)
    return state.select("value.job_id", F.col(f"value.{held}").alias("_last")).select("job_id", "_last.*")


def all_bursts(stream: DataFrame, gap: str, delay: str, folder: str | None = None) -> DataFrame:
    """The last edit of every burst of a stream that has ended or been stopped.

    Closed bursts were emitted, open ones still are in the state; when the stream
    goes on, a later call has them closed or grown.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, "bursts")
    closed = collect_rows(debounced(stream, gap, delay), "bursts", folder)
    return closed.unionByName(open_bursts(spark, folder, closed.columns).select(*closed.columns))


def once(saves: DataFrame, arrived: str, delay: str) -> DataFrame:
    """Saves without those sent again because their answer was lost.

    A payload is known by its job and its own time stamp. ``arrived`` is the time it
    came in, by which payloads are remembered for ``delay`` only; their own stamp
    would make offline replays late.
    """
    timed = saves.withColumn(arrived, F.col(arrived).cast("timestamp")).withWatermark(arrived, delay)
    return timed.dropDuplicatesWithinWatermark(["job_id", "updated_at"])


ARRIVAL = ("batch", "seq")
EVENT_TIME = ("updated_at", "seq")


def _with_deletes(rows: DataFrame, deletes: DataFrame | None) -> DataFrame:
    """Rows and deletes as one stream; ``deleted`` tells them apart."""
    rows = rows.withColumn("deleted", F.lit(False))
    if deletes is None:
        return rows
    return rows.unionByName(deletes.select("job_id", F.lit(True).alias("deleted")), allowMissingColumns=True)


def follow_saves(
    saves: DataFrame, name: str, by_event_time: bool = False, folder: str | None = None, deletes: DataFrame | None = None, **options
) -> ChangeLog:
    """Latest-wins upserts: each micro-batch logs the last payload of each job.

    By arrival a replayed payload wins over newer ones; by event time it loses.
    Read the log back with the same choice, ``order_by=ARRIVAL`` or
    ``EVENT_TIME``. ``deletes`` is a stream of the jobs (job_id) that are deleted:
    their counts end, and saves that arrive later are dropped.
    """
    rank = EVENT_TIME if by_event_time else ("seq",)
    columns = f"{COUNT_COLUMNS}, updated_at timestamp, seq long, deleted boolean"
    log = ChangeLog.create(
        saves.sparkSession, name, columns, folder, key="job_id", order_by=EVENT_TIME if by_event_time else ("batch",), ended="deleted"
    )
    return log.follow(_with_deletes(saves, deletes), lambda rows, batch: changes.latest(rows, "job_id", "deleted", *rank), **options)


def follow_edits(
    stream: DataFrame, stored: DataFrame, name: str, folder: str | None = None, deletes: DataFrame | None = None, **options
) -> ChangeLog:
    """Edits folded into counts, each batch starting from the state before it.

    ``deletes`` is a stream of deleted jobs (job_id), which end their counts.
    """
    log = ChangeLog.create(stream.sparkSession, name, f"{COUNT_COLUMNS}, deleted boolean", folder, key="job_id", ended="deleted")
    columns = [c.split()[0] for c in COUNT_COLUMNS.split(", ")]

    def change(rows: DataFrame, batch: int) -> DataFrame:
        gone = rows.where("deleted").select("job_id").distinct()
        if deletes is not None:
            gone = gone.unionByName(log.ended_keys(before=batch)).distinct()
        alive = lookup_join(rows.where("not deleted").drop("deleted"), gone, ["job_id"], "left_anti")
        touched = alive.select("job_id").distinct()
        folded = edits.fold(alive, log.current(stored.select(*columns), "job_id", before=batch, only=touched))
        ends = rows.where("deleted").select("job_id").distinct().withColumn("deleted", F.lit(True))
        return folded.withColumn("deleted", F.lit(False)).unionByName(ends, allowMissingColumns=True)

    return log.follow(_with_deletes(stream, deletes), change, **options)


def surviving(table: DataFrame, key: str, log: ChangeLog) -> DataFrame:
    """Rows of a table whose job, named by ``key``, was not deleted in a stream."""
    return changes.delete_rows(table, log.ended_keys(), key, log.key)


def retry_clock(spark: SparkSession, seconds: int = RETRY_SECONDS) -> DataFrame:
    """A tick every so many seconds, as a stream."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.col("value") % seconds == 0)


def follow_replays(
    saves: DataFrame,
    jobs: DataFrame | Callable[[], DataFrame],
    name: str,
    folder: str | None = None,
    ticks: DataFrame | None = None,
    unreachable: Callable[[int], Column] | None = None,
    **options,
) -> ChangeLog:
    """Offline saves with their whole payload, their outcome (applied, pending or
    dropped) and how often they were tried.

    Pending payloads are retried with every batch; a newer payload of the job
    replaces them. With a stream of ``ticks``, such as :func:`retry_clock`, batches
    come without new saves too. ``unreachable`` says, by batch, which of the waiting
    payloads cannot be sent yet either; by default all can. Give ``jobs`` as a
    function where they change while the stream runs. Fields that ``saves`` lacks
    are null.
    """
    columns = f"{COUNT_COLUMNS}, updated_at timestamp, seq long"
    # Of each job the newest row of every outcome stays: a payload that waits does not hide one applied before.
    log = ChangeLog.create(saves.sparkSession, name, f"{columns}, attempts int, outcome string", folder, key=["job_id", "outcome"])
    typed = dict(c.split() for c in columns.split(", "))
    kept = list(typed)
    lacking = {c: F.lit(None).cast(kind) for c, kind in typed.items() if c not in saves.columns}
    saves = saves.withColumns(lacking) if lacking else saves
    arriving = saves.select(*kept, "offline", F.lit(False).alias("tick"))
    if ticks is not None:
        arriving = arriving.unionByName(ticks.select(F.lit(True).alias("tick")), allowMissingColumns=True)

    def change(rows: DataFrame, batch: int) -> DataFrame:
        waiting = log.rows(batch=batch - 1).where(F.col("outcome") == "pending")
        offline = unreachable(batch) if unreachable else F.lit(False)
        retried = waiting.select(*kept, offline.alias("offline"), (F.col("attempts") + 1).alias("attempts"))
        new = rows.where("not tick").select(*kept, "offline", F.lit(1).alias("attempts"))
        return edits.replay(new.unionByName(retried), jobs() if callable(jobs) else jobs)

    return log.follow(arriving, change, **options)


def day_feed(messages: DataFrame, published_day: DataFrame) -> DataFrame:
    """Messages of the published day as they arrive."""
    return messages.where(views.on_day(published_day))


def applied_replays(log: ChangeLog, counts: DataFrame) -> DataFrame:
    """Counts with every payload that a replay applied, the last of each job."""
    applied = log.rows().where(F.col("outcome") == "applied").drop("outcome")
    newest = changes.latest(applied, "job_id", "batch").select(*counts.columns)
    return changes.upsert(counts, newest.withColumn("seq", F.lit(0)), "job_id")


def follow_office_messages(messages: DataFrame, name: str, folder: str | None = None, **options) -> ChangeLog:
    """Per day, the newest office message so far; the state is one row per day."""
    newest = messages.groupBy("job_date").agg(
        F.max(F.when(F.col("sender_role") == "admin", F.col("created_at"))).alias("newest_office")
    )
    log = ChangeLog.create(messages.sparkSession, name, "job_date date, newest_office timestamp", folder, key="job_date")
    return log.follow(newest, lambda rows, batch: rows, mode="update", **options)


def follow_unread(messages: DataFrame, seen: DataFrame, name: str, folder: str | None = None, **options) -> ChangeLog:
    """Office messages and seen markers (job_date, viewer, seen_at) as one stream,
    folded per day and viewer; messages count for the day alone."""
    none = lambda kind: F.lit(None).cast(kind)
    office = F.when(F.col("sender_role") == "admin", F.col("created_at").cast("timestamp"))
    sent = messages.select("job_date", none("string").alias("viewer"), office.alias("newest_office"), none("timestamp").alias("last_seen"))
    marked = seen.select("job_date", "viewer", none("timestamp").alias("newest_office"), F.col("seen_at").cast("timestamp").alias("last_seen"))
    folded = sent.unionByName(marked).groupBy("job_date", "viewer").agg(
        F.max("newest_office").alias("newest_office"), F.max("last_seen").alias("last_seen")
    )
    columns = "job_date date, viewer string, newest_office timestamp, last_seen timestamp"
    log = ChangeLog.create(messages.sparkSession, name, columns, folder, key=["job_date", "viewer"])
    return log.follow(folded, lambda rows, batch: rows, mode="update", **options)


def unread_by_viewer(log: ChangeLog) -> DataFrame:
    """Per day and viewer that has a marker, whether an office message is newer."""
    newest = log.newest(["job_date", "viewer"])
    office = newest.where("viewer is null").select("job_date", "newest_office")
    marked = newest.where("viewer is not null").select("job_date", "viewer", "last_seen")
    unread = F.coalesce(F.col("newest_office") > F.col("last_seen"), F.lit(False))
    return marked.join(office, "job_date", "left").select("job_date", "viewer", unread.alias("unread"))


def follow_receipts(
    messages: DataFrame,
    published_day: DataFrame | Callable[[], DataFrame],
    read_at: Column,
    read_by: str,
    name: str,
    folder: str | None = None,
    **options,
) -> ChangeLog:
    """Messages with the read stamp set as they are shown.

    Office messages that arrived before their day was published are looked at
    again with every batch. Give ``published_day`` as a function where it changes
    while the stream runs.
    """
    columns = "id long, job_date date, sender_role string, body string, created_at timestamp, read_at timestamp, read_by string"
    log = ChangeLog.create(messages.sparkSession, name, columns, folder, key="id")
    names = [c.split()[0] for c in columns.split(", ")]

    def change(rows: DataFrame, batch: int) -> DataFrame:
        day = published_day() if callable(published_day) else published_day
        unread = (F.col("sender_role") == "admin") & F.col("read_at").isNull()
        waiting = log.newest("id", before=batch).where(unread).select(*names)
        again = changes.mark_read(waiting, day, read_at, read_by).where(F.col("read_at").isNotNull())
        return changes.mark_read(rows.select(*names), day, read_at, read_by).unionByName(again)

    return log.follow(messages, change, **options)


def follow_points(points: DataFrame, name: str, folder: str | None = None, **options) -> ChangeLog:
    """Calibration points as they are added: the log keeps the sums of every version
    of a device's fit, see :func:`floorspark.operators.calibration.version_fits`.

    ``points`` has device, seq, idx, temp and added_at. Each batch goes on from the
    last version of its devices.
    """
    log = ChangeLog.create(points.sparkSession, name, calibration.VERSION_COLUMNS, folder, key=["device", "seq"])

    def change(rows: DataFrame, batch: int) -> DataFrame:
        touched = rows.select("device").distinct()
        last = log.newest("device", before=batch, only=touched, order_by=("seq",))
        return calibration.fit_versions(rows, last)

    return log.follow(points, change, **options)


def follow_temperatures(
    pixels: DataFrame,
    fits: DataFrame | Callable[[], DataFrame],
    width: int,
    height: int,
    delay: str,
    name: str,
    folder: str | None = None,
    **options,
) -> ChangeLog:
    """Every frame with its temperature, as soon as its first pixels arrive.

    ``pixels`` carries the capture time ``captured_at``; frozen frames are skipped.
    ``fits`` are versions (device, seq, added_at, n, a, b, r2): a frame is scored
    with the newest version of its device at its capture time, null without one.
    Give them as a function where points are added while the stream runs: then later
    frames follow, and frames already scored keep their temperature. Pixels of a
    frame that arrive within ``delay`` of each other count together.
    """
    columns = "frame_id long, device long, captured_at timestamp, idx double, points long, estimate double, temperature long, band string, tier string"
    timed = calibration.centre_box(pixels.where(~F.col("frozen")), width, height).withWatermark("captured_at", delay)
    frames = calibration.frame_index(timed, "captured_at")
    spark = pixels.sparkSession
    log = ChangeLog.create(spark, name, columns, folder, key="frame_id")

    def change(rows: DataFrame, batch: int) -> DataFrame:
        if rows.isEmpty():  # a batch that only moves the watermark need not order all versions
            return spark.createDataFrame([], columns)
        return calibration.estimates_as_of(rows, fits() if callable(fits) else fits, "captured_at")

    return log.follow(frames, change, mode="update", **options)


def winners(saves: DataFrame) -> DataFrame:
    """Which payload each job ends up with, by arrival and by its own time stamp.

    Replays arrive late with an old time stamp: by arrival they still win.
    """
    by_time = F.struct("updated_at", "seq")
    return saves.groupBy("job_id").agg(
        F.max("seq").alias("arrival_seq"),
        F.max_by("seq", by_time).alias("event_time_seq"),
        (F.max("seq") != F.max_by("seq", by_time)).alias("regressed"),
    )
