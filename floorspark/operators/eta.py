"""Start-time projection for the jobs below the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspark.functions import formulas as fx
from floorspark.operators.views import list_key, list_order
from floorspark.plans.ordered import OrderedGroups
from floorspark.plans.skew import lookup_join


def live_pace(open_jobs: DataFrame, pace: DataFrame) -> DataFrame:
    """The pace rows with the list key of the job they name, while that job is
    still open on the day; null otherwise."""
    named = pace.select("job_date", F.col("current_job_id").alias("id"))
    live = open_jobs.join(named, ["job_date", "id"], "left_semi").select("job_date", list_key().alias("live_key"))
    return pace.drop("current_job_id").join(live, "job_date", "left")


def current_jobs(open_jobs: DataFrame, pace: DataFrame) -> DataFrame:
    """The effective current job of every day with open jobs.

    That is the job the pace names while it is still open, else the first of
    the list.
    """
    first = open_jobs.groupBy("job_date").agg(F.min(list_key()).alias("_first"))
    live = live_pace(open_jobs, pace).select("job_date", "live_key")
    return first.join(live, "job_date", "left").select(
        "job_date", F.coalesce("live_key", "_first")["id"].alias("current_job_id")
    )


def project(open_jobs: DataFrame, pace: DataFrame, plain_jobs: DataFrame | None = None) -> DataFrame:
    """Expected start of every open job, in ms after the day's start.

    No estimate without a start or a positive rate, none above the current job
    and none for the current job itself. Each job takes its planned tonnage at
    the day's rate plus a changeover; the current job's tonnage is scaled by
    the quantity left, if known. Places and times before come from one pass
    over the ordered keys; times are added as decimals, and the rest of the jobs
    joins by id. ``plain_jobs`` may be the same jobs without what was joined to
    them: then that join is not evaluated for the keys.
    """
    rate = F.col("tons_per_hour").cast("double")
    usable = F.col("started_at").isNotNull() & (rate > 0) & (rate < float("inf"))
    plain_jobs = open_jobs if plain_jobs is None else plain_jobs
    first = plain_jobs.groupBy("job_date").agg(F.min(list_key()).alias("_first"))
    days = first.join(live_pace(plain_jobs, pace), "job_date", "left")
    days = days.withColumn("_current", F.coalesce("live_key", "_first")).drop("_first", "live_key")
    measures = plain_jobs.select("job_date", "sort_order", "id", "planned_qty", "weight_kg", "is_doubles")
    jobs = lookup_join(measures, days, ["job_date"]).withColumns(
        {"_key": list_key(), "_usable": F.coalesce(usable, F.lit(False))}
    )
    is_current, is_below = F.col("_key") == F.col("_current"), F.col("_key") > F.col("_current")
    scaled = is_current & F.col("remaining_qty").isNotNull() & (F.coalesce("planned_qty", F.lit(0)) != 0)
    tonnes = fx.planned_tonnage()
    tonnes = F.when(scaled, tonnes * (F.col("remaining_qty").cast("double") / F.col("planned_qty"))).otherwise(tonnes)
    takes = F.when(is_current | is_below, tonnes / rate * fx.MS_PER_HOUR + fx.CHANGEOVER_MS)
    exact = F.when(F.col("_usable"), takes).try_cast("decimal(36,16)")
    keys = jobs.select(
        "job_date", "sort_order", "id", "started_at", exact.alias("_takes"), is_current.alias("is_current"),
        (F.col("_usable") & is_below).alias("_timed"), *[c for c in pace.columns if c not in ("job_date", "current_job_id", "started_at")],
    )
    ordered = OrderedGroups(keys, ["job_date"], list_order())
    one = F.lit(1).cast("long")
    running = ordered.running(day_position=("sum", one), _upto=("sum", F.col("_takes"))).rows
    before = (F.col("_upto") - F.coalesce("_takes", F.lit(0))).cast("double")
    running = running.withColumn("_before", F.when(F.col("day_position") > 1, before))
    offset = F.when(F.col("_timed"), fx.nearest(F.col("_before")))
    timed = running.withColumns(
        {
            "eta_offset_ms": offset,
            "eta_at": F.timestamp_millis(F.unix_millis(F.col("started_at").cast("timestamp")) + offset),
        }
    )
    return lookup_join(open_jobs, timed.drop("job_date", "sort_order", "_takes", "_upto", "_before", "_timed"), ["id"])
