"""Count edits: clamped counters, typed totals, bursts and the full fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspark.functions.text import leading_int
from floorspark.operators.changes import latest
from floorspark.plans.ordered import OrderedGroups, number_slice

BOXES = ["a", "b"]
# Edits of one job per slice, by arrival number.
SEQ_SLICE = 1 << 16


def _step() -> Column:
    return F.when(F.col("kind") == "plus", 1).otherwise(-1)


def _steps(edits: DataFrame) -> DataFrame:
    return edits.where(F.col("kind").isin("plus", "minus"))


def _running_steps(edits: DataFrame) -> OrderedGroups:
    cut = number_slice(F.col("seq"), SEQ_SLICE)
    ordered = OrderedGroups(_steps(edits), ["job_id", "box"], [F.col("seq").asc()], cut)
    return ordered.running(_sum=("sum", _step()))


def clamped_counter(edits: DataFrame) -> DataFrame:
    """Load counter after each step; it never drops below zero.

    A counter that stops at zero equals the plain running sum less its lowest
    point below zero, so two running aggregates replace the step-by-step loop.
    """
    ordered = _running_steps(edits).running(_low=("min", F.col("_sum")))
    return ordered.rows.select(
        "job_id", "box", "seq", (F.col("_sum") - F.least(F.lit(0), F.col("_low"))).cast("long").alias("value")
    )


def typed_total(edits: DataFrame) -> DataFrame:
    """Typed total left per job: set by a total edit, cleared by a step or cores edit."""
    relevant = edits.where(F.col("kind").isin("plus", "minus", "cores", "total"))
    value = F.struct(F.when(F.col("kind") == "total", leading_int("raw")).alias("value"))
    return relevant.groupBy("job_id").agg(F.max_by(value, "seq").alias("_last")).select(
        "job_id", F.col("_last.value").alias("manual_total_override")
    )


def fold(edits: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored counts with a batch of edits applied: one row per edited job.

    ``stored`` needs one row per job at most and seeds the counters.
    """
    counters = _running_steps(edits).rows.groupBy("job_id").agg(
        *[F.sum(F.when(F.col("box") == b, _step())).alias(f"_sum_{b}") for b in BOXES],
        *[F.min(F.when(F.col("box") == b, F.col("_sum"))).alias(f"_low_{b}") for b in BOXES],
    )
    kind = F.col("kind")

    def last(value: Column, when: Column) -> Column:
        return F.max_by(F.struct(value.alias("value")), F.when(when, F.col("seq")))

    resets = kind.isin("plus", "minus", "cores", "total")
    fields = edits.groupBy("job_id").agg(
        *[
            last(F.coalesce(leading_int("raw"), F.lit(0)), (kind == "cores") & (F.col("box") == b)).alias(f"_cores_{b}")
            for b in BOXES
        ],
        last(F.when(kind == "total", leading_int("raw")), resets).alias("_override"),
        last(F.col("raw"), kind == "comment").alias("_comment"),
        last(F.col("checked"), kind == "making").alias("_making"),
        F.max("ts").alias("updated_at"),
    )
    seeds = stored.select(
        "job_id",
        *[F.col(f"group_{b}_{part}").alias(f"_old_{part}_{b}") for b in BOXES for part in ("cores", "trolleys")],
        F.col("manual_total_override").alias("_old_override"),
        F.col("comment").alias("_old_comment"),
        F.col("still_making").alias("_old_making"),
    )
    zero = F.lit(0)
    columns = []
    for b in BOXES:
        start = F.coalesce(f"_old_trolleys_{b}", zero)
        end = start + F.coalesce(f"_sum_{b}", zero)
        lowest = start + F.coalesce(f"_low_{b}", zero)
        columns += [
            F.coalesce(F.col(f"_cores_{b}.value"), F.col(f"_old_cores_{b}"), zero).cast("int").alias(f"group_{b}_cores"),
            (end - F.least(zero, lowest)).cast("int").alias(f"group_{b}_trolleys"),
        ]
    override = F.when(F.col("_override").isNotNull(), F.col("_override.value")).otherwise(F.col("_old_override"))
    return (
        fields.join(counters, "job_id", "left")
        .join(seeds, "job_id", "left")
        .select(
            "job_id",
            *columns,
            override.cast("int").alias("manual_total_override"),
            F.coalesce("_comment.value", "_old_comment", F.lit("")).alias("comment"),
            F.coalesce("_making.value", "_old_making", F.lit(False)).alias("still_making"),
            "updated_at",
        )
    )


def bursts(edits: DataFrame, gap_seconds: int) -> DataFrame:
    """The last edit of each burst: nothing follows it within the gap."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    order = [F.col("_at").asc_nulls_last(), F.col("seq").asc()]
    ordered = OrderedGroups(edits.withColumn("_at", micros), ["job_id"], order).following("_next", F.col("_at"))
    quiet = F.col("_next").isNull() | (F.col("_next") - F.col("_at") > gap_seconds * 1_000_000)
    return ordered.rows.where(quiet).drop("_at", "_next")


def replay(pending: DataFrame, jobs: DataFrame, order_by: str = "seq") -> DataFrame:
    """Outcome of retrying each job's last pending payload.

    ``offline`` payloads stay pending, those of deleted jobs are dropped for
    good, the rest are applied.
    """
    last = latest(pending, "job_id", order_by)
    alive = jobs.select(F.col("id").alias("job_id"), F.lit(True).alias("_alive"))
    outcome = (
        F.when(F.col("offline"), "pending").when(F.col("_alive").isNull(), "dropped").otherwise("applied")
    )
    return last.join(alive, "job_id", "left").withColumn("outcome", outcome).drop("_alive")


