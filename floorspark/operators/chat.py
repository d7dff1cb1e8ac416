"""Chat threads, last-seen markers and unread state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspark.functions.text import clock_time, display_author, escape_markup
from floorspark.plans.ordered import OrderedGroups


def thread(chat: DataFrame) -> DataFrame:
    """Each day's messages in order, as they are displayed.

    Only keys and times are sorted; the texts join by id.
    """
    order = [F.col("created_at").asc_nulls_last(), F.col("id").asc()]
    keys = chat.select("job_date", "created_at", "id")
    placed = OrderedGroups(keys, ["job_date"], order).numbered("place").rows
    return chat.join(placed.select("id", "place"), "id").select(
        "job_date",
        "place",
        "id",
        display_author().alias("author"),
        clock_time("created_at").alias("sent"),
        escape_markup("body").alias("body"),
    )


def mark_seen(chat: DataFrame, seen: DataFrame) -> DataFrame:
    """Last-seen marker per day after opening the thread; an empty one keeps its marker."""
    newest = chat.groupBy("job_date").agg(F.max("created_at").alias("_newest"))
    return seen.join(newest, "job_date", "full").select(
        "job_date", F.coalesce("_newest", "last_seen").alias("last_seen")
    )


def newest_office(chat: DataFrame) -> DataFrame:
    """Per day, the time of the newest office message, null without one."""
    return chat.groupBy("job_date").agg(
        F.max(F.when(F.col("sender_role") == "admin", F.col("created_at"))).alias("newest_office")
    )


def unread(newest: DataFrame, seen: DataFrame, panel_open: bool = False) -> DataFrame:
    """Whether a day shows the unread dot: an office message later than the marker.

    Some message is later than the marker exactly when the newest one is, so the
    per-day maximum decides. A missing marker means nothing was seen.
    """
    marked = newest.join(seen, "job_date", "left")
    is_unread = F.col("newest_office").isNotNull() & (
        F.col("last_seen").isNull() | (F.col("newest_office") > F.col("last_seen"))
    )
    return marked.select("job_date", (is_unread & F.lit(not panel_open)).alias("unread"))
