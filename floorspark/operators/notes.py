"""Office notes shown on the floor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspark.functions import formulas as fx
from floorspark.functions.text import escape_markup
from floorspark.operators.views import published_jobs
from floorspark.plans.ordered import OrderedGroups
from floorspark.plans.skew import lookup_join


def day_parts(jobs: DataFrame) -> DataFrame:
    """Distinct parts named by each day's jobs."""
    return jobs.where(fx.not_blank("item_number")).select("job_date", "item_number").distinct()


def notes_for(parts: DataFrame, notes: DataFrame) -> DataFrame:
    """Visible notes of the given parts; the part list stays a table."""
    wanted = parts.select("item_number").distinct()
    return lookup_join(notes.where(F.col("visible_to_trolley")), wanted, ["item_number"], "left_semi")


def newest_first(notes: DataFrame) -> DataFrame:
    """Visible notes with their place in the part's list, newest first.

    The list is ordered once per part, one row per note, however many jobs
    show the part. Only keys and times are sorted; the texts join by id.
    """
    shown = notes.where(F.col("visible_to_trolley") & fx.not_blank("item_number"))
    return lookup_join(shown, _places(shown).select("id", "place"), ["id"], "inner").select(
        "item_number", "place", F.col("id").alias("note_id"), escape_markup("body").alias("body"), "created_at"
    )


def _places(shown: DataFrame) -> DataFrame:
    """The place of each note in its part's list, without texts."""
    order = [F.col("created_at").desc_nulls_last(), F.col("id").desc()]
    keys = shown.select("item_number", "created_at", "id")
    return OrderedGroups(keys, ["item_number"], order).numbered("place").rows


def under_jobs(jobs: DataFrame, notes: DataFrame, published_day: DataFrame) -> DataFrame:
    """Under each job of the published day, its part's visible notes, newest first.

    Ids and places meet first; bodies join by the note's id last. ``place`` is
    the note's place under the job, which is its place in the part's list.
    """
    today = published_jobs(jobs, published_day).where(fx.not_blank("item_number")).select(F.col("id").alias("job_id"), "item_number")
    shown = notes_for(today, notes)
    places = _places(shown).select("item_number", "place", F.col("id").alias("note_id"))
    ids = lookup_join(today, places, ["item_number"], "inner")
    bodies = shown.select(F.col("id").alias("note_id"), escape_markup("body").alias("body"))
    return lookup_join(ids, bodies, ["note_id"], "inner").select("job_id", "item_number", "place", "note_id", "body")


def fan_out(open_jobs: DataFrame, notes: DataFrame, published_day: DataFrame) -> DataFrame:
    """Visible notes on every open job of the published day that runs the part."""
    today = published_jobs(open_jobs, published_day).where(fx.not_blank("item_number")).select("job_id", "item_number")
    shown = notes_for(today, notes)
    ids = today.join(shown.select("item_number", F.col("id").alias("note_id")), "item_number")
    return ids.join(shown.select(F.col("id").alias("note_id"), "body", "created_at"), "note_id")


def note_counts(jobs: DataFrame, notes: DataFrame) -> DataFrame:
    """Per job, how many visible notes its part has and the newest one's time."""
    per_part = (
        notes.where(F.col("visible_to_trolley") & fx.not_blank("item_number"))
        .groupBy("item_number")
        .agg(F.count("*").alias("notes"), F.max("created_at").alias("newest_at"))
    )
    return lookup_join(jobs, per_part, ["item_number"], "inner")
