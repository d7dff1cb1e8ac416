"""Part master records: backfill, latest record, cross-check, carry-forward.

Functions marked *inferred* follow the data model's own comments; the screen
that used them is not available.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorspark.functions import formulas as fx
from floorspark.plans.skew import lookup_join

VARIANT = ["am_number", "item_number", "grade", "weight_kg", "is_doubles", "needs_dipping"]


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    match = left[keys[0]].eqNullSafe(right[keys[0]])
    for key in keys[1:]:
        match = match & left[key].eqNullSafe(right[key])
    return match


def part_variants(jobs: DataFrame) -> DataFrame:
    """Distinct part variants the jobs name; nulls compare equal."""
    return (
        jobs.where(fx.not_blank("item_number"))
        .select(
            "am_number",
            "item_number",
            "grade",
            "weight_kg",
            fx.dipping_or_false("is_doubles").alias("is_doubles"),
            fx.dipping_or_false("needs_dipping").alias("needs_dipping"),
        )
        .distinct()
    )


def new_variants(jobs: DataFrame, reference: DataFrame) -> DataFrame:
    """Variants on the jobs that no reference row holds, all six fields compared."""
    wanted = part_variants(jobs)
    known = reference.select(*VARIANT).distinct()
    return wanted.join(known, _null_safe(wanted, known, VARIANT), "left_anti")


def backfill(jobs: DataFrame, reference: DataFrame) -> DataFrame:
    """Reference rows with the missing variants appended; a second run adds none."""
    return reference.select(*VARIANT).unionByName(new_variants(jobs, reference))


def noted_jobs(job_notes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each job note with the job it belongs to."""
    return job_notes.select(
        F.col("id").alias("note_id"), "job_id", "body", "visible_to_trolley", F.col("created_at").alias("noted_at")
    ).join(jobs, F.col("job_id") == jobs["id"])


def minimal_references(job_notes: DataFrame, jobs: DataFrame, reference: DataFrame) -> DataFrame:
    """Variants of noted parts that have no reference row at all.

    Notes only say which jobs matter, so they reduce to distinct job ids first.
    """
    noted = job_notes.select(F.col("job_id").alias("id")).distinct()
    wanted = part_variants(jobs.join(noted, "id", "left_semi"))
    return lookup_join(wanted, reference.select("item_number").distinct(), ["item_number"], "left_anti")


def new_references(job_notes: DataFrame, jobs: DataFrame, reference: DataFrame) -> DataFrame:
    """The minimal references that noted parts without any record get.

    A new record's id derives from its six fields, so a second run makes the
    same ones. Such ids are negative and cannot meet those given out in order.
    """
    wanted = minimal_references(job_notes, jobs, reference)
    named = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in VARIANT])
    digest = F.conv(F.substring(F.sha2(named, 256), 1, 15), 16, 10).cast("long")
    return wanted.withColumn("id", -1 - digest)


def orphan_notes(job_notes: DataFrame, jobs: DataFrame) -> DataFrame:
    """How many notes belong to a job that names no part."""
    per_job = job_notes.groupBy("job_id").agg(F.count("*").alias("_notes"))
    nameless = jobs.where(~F.coalesce(fx.not_blank("item_number"), F.lit(False))).select(F.col("id").alias("job_id"))
    return per_job.join(nameless, "job_id", "left_semi").agg(
        F.coalesce(F.sum("_notes"), F.lit(0)).cast("long").alias("orphan_notes")
    )


def latest_reference(reference: DataFrame) -> DataFrame:
    """Latest record per part; never-updated records rank last, ties by id."""
    fields = [c for c in reference.columns if c != "item_number"]
    rank = F.struct("updated_at", "id")
    return reference.groupBy("item_number").agg(F.max_by(F.struct(*fields), rank).alias("_latest")).select(
        "item_number", *[F.col(f"_latest.{c}").alias(c) for c in fields]
    )


def migrate_job_notes(
    job_notes: DataFrame, jobs: DataFrame, reference: DataFrame, part_notes: DataFrame
) -> DataFrame:
    """Job notes as part notes, attached to each part's latest record.

    Parts without a record get minimal ones first, see :func:`new_references`;
    notes already present (same part, body and time) are left out, so a re-run
    adds nothing. A part's minimal records have no update time, so the one with
    the highest id takes the notes, as :func:`latest_reference` would choose.
    """
    created = new_references(job_notes, jobs, reference).groupBy("item_number").agg(F.max("id").alias("item_reference_id"))
    latest = latest_reference(reference).select("item_number", F.col("id").alias("item_reference_id"))
    records = latest.unionByName(created)
    notes = noted_jobs(job_notes, jobs.where(fx.not_blank("item_number")).select("id", "item_number")).select(
        "note_id", "item_number", "body", "visible_to_trolley", F.col("noted_at").alias("created_at")
    )
    return lookup_join(new_notes(notes, part_notes), records, ["item_number"], "inner")


def new_notes(notes: DataFrame, existing: DataFrame) -> DataFrame:
    """Notes whose (part, body, time) is not stored yet.

    Bodies are compared by their SHA-256, so no text travels as a join key.
    """
    keys = ["item_number", "created_at", "_digest"]
    digest = F.sha2("body", 256)
    stored = existing.select("item_number", "created_at", digest.alias("_digest")).distinct()
    return lookup_join(notes.withColumn("_digest", digest), stored, keys, "left_anti").drop("_digest")


def carry_forward(jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts for jobs that have none, from the same work order's latest earlier day.

    *Inferred*: a work order that reappears on a later day takes over the counts
    of the most recent earlier day that has some; on that day the highest job id
    wins. Jobs first reduce to one row per work order and day, so the window
    that looks back holds calendar days, not jobs. The counts travel along in
    the compared value: day and id already decide, and no second join is needed.
    """
    boxes = [c for c in counts.columns if c != "job_id"]
    named = jobs.select("id", "am_number", "job_date")
    counted = named.join(counts, F.col("id") == F.col("job_id"), "left")
    per_day = counted.groupBy("am_number", "job_date").agg(
        F.max(F.when(F.col("job_id").isNotNull(), F.struct("job_date", "id", *boxes))).alias("_latest")
    )
    earlier = Window.partitionBy("am_number").orderBy("job_date").rowsBetween(Window.unboundedPreceding, -1)
    sources = per_day.withColumn("_source", F.max("_latest").over(earlier)).where(F.col("_source").isNotNull())
    uncounted = counted.where(F.col("job_id").isNull()).select("id", "am_number", "job_date")
    carried = lookup_join(uncounted, sources.select("am_number", "job_date", "_source"), ["am_number", "job_date"], "inner")
    return carried.select(
        F.col("id").alias("job_id"), F.col("_source.id").alias("source_job_id"), *[f"_source.{c}" for c in boxes]
    )


def classify_incoming(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Whether a saved row edits a job or adds one.

    *Inferred*: an edit when a job of the same day has the same work order and
    part; a row without a part is always added.
    """
    keys = ["job_date", "am_number", "item_number"]
    known = existing.where(F.col("item_number").isNotNull()).select(*keys).distinct().withColumn("_known", F.lit(True))
    return lookup_join(incoming, known, keys).withColumn(
        "action", F.when(F.col("_known"), "edit").otherwise("insert")
    ).drop("_known")


def with_cross_check(jobs: DataFrame, reference: DataFrame) -> DataFrame:
    """Jobs with ``part_check`` and ``differing_fields``, null without a part.

    *Inferred*: matched to the part's latest record by part only; ``new_part``
    without a record, ``exact`` when grade, weight, doubles and dipping agree
    (nulls equal), else ``variant`` with the differing fields listed.
    """
    fields = ["grade", "weight_kg", "is_doubles", "needs_dipping"]
    record = latest_reference(reference).select(
        "item_number", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in fields]
    )
    mine = {c: fx.dipping_or_false(c) if c.startswith(("is_", "needs_")) else F.col(c) for c in fields}
    differing = F.concat_ws(",", *[F.when(~mine[c].eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in fields])
    checked = lookup_join(jobs, record, ["item_number"]).withColumn(
        "differing_fields",
        F.when(fx.not_blank("item_number"), F.when(F.col("_known"), differing).otherwise("")),
    )
    status = (
        F.when(F.col("differing_fields").isNull(), F.lit(None).cast("string"))
        .when(F.col("_known").isNull(), "new_part")
        .when(F.col("differing_fields") == "", "exact")
        .otherwise("variant")
    )
    return checked.withColumn("part_check", status).drop("_known", *[f"_{c}" for c in fields])


def cross_check(jobs: DataFrame, reference: DataFrame) -> DataFrame:
    """How the part of each job that names one compares with its latest record."""
    named = jobs.where(fx.not_blank("item_number"))
    return with_cross_check(named, reference).select(
        "id", "item_number", F.col("part_check").alias("status"), "differing_fields"
    )


def remember_dipping(jobs: DataFrame, dip_items: DataFrame) -> DataFrame:
    """Jobs whose part was dipped before are ticked.

    *Inferred* from the memory table's comment.
    """
    memory = dip_items.where(F.col("needs_dipping")).select("item_number").distinct().withColumn("_dipped", F.lit(True))
    return lookup_join(jobs, memory, ["item_number"]).withColumn(
        "needs_dipping", fx.dipping_or_false("needs_dipping") | F.coalesce("_dipped", F.lit(False))
    ).drop("_dipped")
