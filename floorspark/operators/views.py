"""The two job views and what the floor list shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspark.functions import formulas as fx
from floorspark.plans.ordered import OrderedGroups
from floorspark.plans.skew import lookup_join


def list_order() -> list[Column]:
    """Manual order, unordered jobs last, ties by id."""
    return [F.col("sort_order").asc_nulls_last(), F.col("id").asc()]


def list_key(sort_order: str = "sort_order", id: str = "id") -> Column:
    """The list order as one comparable value."""
    order = F.col(sort_order)
    return F.struct(
        order.isNull().alias("unordered"), F.coalesce(order, F.lit(0)).cast("long").alias("position"), F.col(id).alias("id")
    )


def trolley_jobs(jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """Open jobs with their count inputs and the counted total."""
    zero = F.lit(0)
    boxes = ["group_a_cores", "group_a_trolleys", "group_b_cores", "group_b_trolleys"]
    return (
        jobs.where(fx.is_open())
        .join(counts, jobs["id"] == counts["job_id"], "left")
        .select(
            jobs["id"].alias("job_id"),
            "am_number",
            "item_number",
            "planned_qty",
            "weight_kg",
            "is_doubles",
            "mingzhi_hansberg_no",
            "job_date",
            "needs_dipping",
            "sort_order",
            *[F.coalesce(F.col(b), zero).alias(b) for b in boxes],
            F.coalesce("comment", F.lit("")).alias("comment"),
            F.coalesce("still_making", F.lit(False)).alias("still_making"),
            fx.counted_total().alias("total_cores"),
        )
    )


def job_summary(jobs: DataFrame, counts: DataFrame, counted: Column | None = None) -> DataFrame:
    """Every job with counted total, moulds used and cast tonnage.

    The total is derived once per count row and reused by the columns on it.
    ``counted`` replaces it for the retired layouts of counts, which also lack
    the comment and the making flag.
    """
    kept = lambda c, kind: F.col(c) if c in counts.columns else F.lit(None).cast(kind)
    totals = counts.select(
        "job_id",
        (fx.counted_total() if counted is None else counted).alias("_counted"),
        kept("still_making", "boolean").alias("_making"),
        kept("comment", "string").alias("_comment"),
    )
    total = F.coalesce("_counted", F.lit(0))
    return (
        jobs.join(totals, jobs["id"] == totals["job_id"], "left")
        .select(
            *[jobs[c] for c in jobs.columns],
            F.coalesce("_comment", F.lit("")).alias("comment"),
            F.coalesce("_making", F.lit(False)).alias("still_making"),
            total.alias("counted_total"),
            fx.effective_qty(total).alias("effective_qty"),
            fx.tonnage(total).alias("tonnage"),
        )
    )


def published_jobs(jobs: DataFrame, published_day: DataFrame) -> DataFrame:
    """Jobs of the published day; none when no day is published."""
    return jobs.where(on_day(published_day))


def on_day(published_day: DataFrame) -> Column:
    """Whether a row's job_date is the published one; null when none is.

    ``published_day`` holds one row at most, its key being fixed to 1. A second
    row is an error and raises one.
    """
    return F.col("job_date") == published_day.where(F.col("id") == 1).select("job_date").scalar()


def shown_day(published_day: DataFrame, as_of: Column) -> DataFrame:
    """The day the floor shows: the published one, else the UTC date of ``as_of``."""
    published = published_day.where(F.col("id") == 1).agg(F.max("job_date").alias("_day"))
    return published.select(F.lit(1).alias("id"), F.coalesce("_day", as_of.cast("date")).alias("job_date"))


def positions(rows: DataFrame) -> DataFrame:
    """Place of each job in its day's list; only keys are ordered, the rest joins by id."""
    keys = rows.select("job_date", "sort_order", "id")
    placed = OrderedGroups(keys, ["job_date"], list_order()).numbered("day_position").rows
    return lookup_join(rows, placed.select("id", "day_position"), ["id"])


def listed(rows: DataFrame) -> DataFrame:
    """Newest day first, manual order inside a day; for the final output only."""
    return positions(rows).orderBy(F.col("job_date").desc(), "day_position")


def badges(etas: DataFrame, notes: DataFrame) -> DataFrame:
    """Each line of the floor list with its flags.

    ``etas`` are floor jobs that went through
    :func:`floorspark.operators.eta.project`. Notes are counted per part before
    they meet the jobs.
    """
    per_part = (
        notes.where(F.col("visible_to_trolley") & fx.not_blank("item_number"))
        .groupBy("item_number")
        .agg(F.count("*").alias("_notes"))
    )
    return (
        lookup_join(etas, per_part, ["item_number"])
        .withColumns(
            {
                "has_eta": F.col("eta_offset_ms").isNotNull(),
                "dip": fx.dipping_or_false("needs_dipping"),
                "making": F.col("still_making"),
                "has_notes": F.coalesce("_notes", F.lit(0)) > 0,
            }
        )
        .drop("_notes")
    )


def list_states(days: DataFrame, rows: DataFrame) -> DataFrame:
    """Per day, how many jobs are listed and whether the list is empty."""
    per_day = rows.groupBy("job_date").agg(F.count("*").alias("_listed"))
    listed_jobs = F.coalesce("_listed", F.lit(0)).cast("long")
    return days.join(per_day, "job_date", "left").select(
        "job_date", listed_jobs.alias("listed"), (listed_jobs == 0).alias("is_empty")
    )


def lookup(keys: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Zero-or-one lookup for every requested key.

    Status is ``ok`` for one match, ``missing`` for none (columns null) and
    ``multiple`` for several (columns null, as the lookup then fails).
    """
    found = table.groupBy(key).agg(
        F.count("*").alias("_matches"), *[F.max(c).alias(c) for c in columns]
    )
    matches = F.coalesce("_matches", F.lit(0))
    return keys.join(found, key, "left").select(
        key,
        F.when(matches == 0, "missing").when(matches == 1, "ok").otherwise("multiple").alias("status"),
        *[F.when(matches == 1, F.col(c)).alias(c) for c in columns],
    )
