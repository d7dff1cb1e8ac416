"""The floor list and the plan intake, each as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspark.functions import formulas as fx
from floorspark.functions.text import clock_time
from floorspark.operators import changes, edits, eta, ingest, parts, views


def floor_lines(jobs: DataFrame, counts: DataFrame, pace: DataFrame, notes: DataFrame) -> DataFrame:
    """Open jobs of every day with their place, totals, estimates and flags.

    One plan: counts join by job, the pace by day, note counts by part, and the
    day's order is sorted once.
    """
    listed = views.trolley_jobs(jobs, counts).withColumnRenamed("job_id", "id")
    etas = eta.project(listed, pace, plain_jobs=jobs.where(fx.is_open()))
    return views.badges(etas, notes).withColumnRenamed("id", "job_id")


def floor_list(
    jobs: DataFrame, counts: DataFrame, pace: DataFrame, notes: DataFrame, published_day: DataFrame, as_of: Column
) -> DataFrame:
    """The floor's list for the shown day."""
    today = views.published_jobs(jobs, views.shown_day(published_day, as_of))
    return floor_lines(today, counts, pace, notes).select(
        "day_position",
        "job_id",
        "am_number",
        "planned_qty",
        "mingzhi_hansberg_no",
        "total_cores",
        fx.rebuilt_override().alias("rebuilt_override"),
        clock_time("eta_at").alias("eta"),
        "is_current",
        "dip",
        "making",
        "has_notes",
    )


def plan_rows(
    requests: DataFrame, saved: DataFrame, reference: DataFrame, dip_items: DataFrame, as_of: Column
) -> DataFrame:
    """Rows of admitted plan photos, ready to save.

    They get the column defaults, the remembered dipping tick, the result of
    the part cross-check and whether they edit a saved job of the day. Works on
    a stream of requests too: all other tables are static.
    """
    rows = changes.with_defaults(ingest.normalised(ingest.extracted_rows(ingest.admitted(requests))), as_of)
    ticked = parts.remember_dipping(rows, dip_items)
    return parts.classify_incoming(parts.with_cross_check(ticked, reference), saved)


def save_outcomes(
    edit_log: DataFrame, counts: DataFrame, jobs: DataFrame, published_day: DataFrame, gap_seconds: int
) -> DataFrame:
    """What becomes of the edits of each job, from the keys pressed to the table.

    Edits are folded into the job's counts and saved at the end of each burst.
    ``outcome`` is ``applied``, or why the save goes to the dead letter:
    ``deleted`` (the job is gone) or ``not published`` (its day is not the
    published one). ``saves`` is how often the job was saved.
    """
    folded = edits.fold(edit_log, counts)
    saves = edits.bursts(edit_log, gap_seconds).groupBy("job_id").agg(F.count("*").alias("saves"))
    known = jobs.select(F.col("id").alias("job_id"), "job_date", F.lit(True).alias("_known"))
    outcome = (
        F.when(F.col("_known").isNull(), "deleted")
        .when(F.coalesce(views.on_day(published_day), F.lit(False)), "applied")
        .otherwise("not published")
    )
    return folded.join(saves, "job_id").join(known, "job_id", "left").withColumn("outcome", outcome).drop("_known", "job_date")


def saved_counts(outcomes: DataFrame, counts: DataFrame) -> DataFrame:
    """The counts with every applied save in place of the row it replaces."""
    applied = outcomes.where(F.col("outcome") == "applied").withColumn("seq", F.lit(0))
    return changes.upsert(counts, applied, "job_id")
