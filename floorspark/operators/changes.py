"""Writes as DataFrame rewrites: append, upsert, patch, toggle, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspark.functions.text import trimmed_or
from floorspark.plans.ordered import OrderedGroups
from floorspark.plans.skew import lookup_join


def latest(rows: DataFrame, key: str | list[str], *rank: str) -> DataFrame:
    """The row of each key that ranks highest, by aggregation rather than a sort."""
    keys = [key] if isinstance(key, str) else list(key)
    fields = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*rank)).alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in fields]
    )


def send_messages(chat: DataFrame, outgoing: DataFrame) -> DataFrame:
    """Chat with trimmed, non-blank messages appended; unset columns take defaults."""
    ready = outgoing.withColumns(
        {
            "body": trimmed_or("body"),
            "sender_role": F.lit("trolley"),
            "sender_name": trimmed_or("sender_name", "Trolley"),
        }
    ).where(F.col("body").isNotNull())
    return chat.unionByName(ready, allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order_by: str = "seq") -> DataFrame:
    """Replace whole rows by key; of several incoming rows the last one counts.

    Arrival order decides by default, so a replayed older payload still wins.
    Order by its own time stamp to let the newest edit win instead.
    """
    newest = latest(incoming, key, order_by, *([] if order_by == "seq" else ["seq"])).select(*existing.columns)
    fields = [c for c in existing.columns if c != key]
    row = lambda table, name: table.select(key, F.struct(*fields).alias(name))
    both = row(existing, "_old").join(row(newest, "_new"), key, "full")
    return both.select(key, F.coalesce("_new", "_old").alias("_row")).select(
        *[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in existing.columns]
    )


def insert_missing(existing: DataFrame, incoming: DataFrame, key: str, arrival: str = "seq") -> DataFrame:
    """Insert rows whose key is free; of several for a key the first to arrive."""
    fields = [c for c in existing.columns if c != key]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*fields), arrival).alias("_row"))
    first = first.select(key, *[F.col(f"_row.{c}").alias(c) for c in fields])
    fresh = first.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def learn_dipping(memory: DataFrame, ticks: DataFrame) -> DataFrame:
    """Dip memory after some jobs were ticked or unticked.

    ``ticks`` has item_number, flag and updated_at. A tick is remembered and
    moves the time on; an untick changes nothing.
    """
    learned = (
        ticks.where(F.col("flag") & F.col("item_number").isNotNull())
        .groupBy("item_number")
        .agg(F.max("updated_at").alias("_learned_at"))
    )
    return memory.join(learned, "item_number", "full").select(
        "item_number",
        F.when(F.col("_learned_at").isNotNull(), True).otherwise(F.col("needs_dipping")).alias("needs_dipping"),
        F.coalesce("_learned_at", "updated_at").alias("updated_at"),
    )


def mark_read(chat: DataFrame, day: DataFrame, read_at: Column, read_by: str) -> DataFrame:
    """Set the read stamp on unread office messages of the published day.

    Stamped messages keep their stamp, so a second run changes nothing.
    """
    today = F.col("job_date") == day.where(F.col("id") == 1).select("job_date").scalar()
    unread = today & (F.col("sender_role") == "admin") & F.col("read_at").isNull()
    return (
        chat.withColumn("_mark", F.coalesce(unread, F.lit(False)))
        .withColumns(
            {
                "read_at": F.when(F.col("_mark"), read_at).otherwise(F.col("read_at")),
                "read_by": F.when(F.col("_mark"), F.lit(read_by)).otherwise(F.col("read_by")),
            }
        )
        .select(*chat.columns)
    )


def patch(table: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Change only the fields a patch carries.

    ``patches`` has the key and a map column ``changes``: an absent field stays,
    a present null is written.
    """
    changes = F.col("changes")
    updated = {
        c: F.when(F.coalesce(F.map_contains_key(changes, F.lit(c)), F.lit(False)), F.element_at(changes, F.lit(c)))
        .otherwise(F.col(c))
        for c in fields
    }
    return table.join(patches.select(key, "changes"), key, "left").withColumns(updated).select(*table.columns)


def permitted(toggles: DataFrame, users: DataFrame, require_full_access: bool = True) -> DataFrame:
    """Toggles whose caller may set them."""
    if not require_full_access:
        return toggles
    callers = users.where(F.col("permission") == "full_access").select(F.col("user_id").alias("caller_id"))
    return toggles.join(callers, "caller_id", "left_semi")


def apply_toggles(
    jobs: DataFrame, toggles: DataFrame, users: DataFrame, column: str, require_full_access: bool = True
) -> DataFrame:
    """Jobs with a flag set by the latest permitted toggle of each job."""
    last = latest(permitted(toggles, users, require_full_access).select("job_id", "seq", "flag"), "job_id", "seq")
    return (
        jobs.join(last.select(F.col("job_id").alias("id"), F.col("flag").alias("_flag")), "id", "left")
        .withColumn(column, F.coalesce("_flag", column))
        .select(*jobs.columns)
    )


def dipping_ticks(jobs: DataFrame, toggles: DataFrame, users: DataFrame, require_full_access: bool = True) -> DataFrame:
    """The memory updates that permitted dipping toggles cause, one per toggle
    that ticks a job naming a part."""
    allowed = permitted(toggles, users, require_full_access).where("flag")
    per_job = allowed.groupBy("job_id").agg(F.max("ts").alias("updated_at"))
    return per_job.join(jobs.select(F.col("id").alias("job_id"), "item_number"), "job_id").select(
        "item_number", F.lit(True).alias("flag"), "updated_at"
    )


def delete_rows(table: DataFrame, deleted: DataFrame, key: str, deleted_key: str) -> DataFrame:
    """Rows left after a delete that cascades on ``key``."""
    gone = deleted.select(F.col(deleted_key).alias(key)).distinct()
    return lookup_join(table, gone, [key], "left_anti")


def unset_references(table: DataFrame, deleted: DataFrame, key: str, deleted_key: str) -> DataFrame:
    """Rows with ``key`` nulled where the row it points at was deleted."""
    gone = deleted.select(F.col(deleted_key).alias(key)).distinct().withColumn("_gone", F.lit(True))
    return (
        lookup_join(table, gone, [key])
        .withColumn(key, F.when(F.col("_gone").isNull(), F.col(key)))
        .select(*table.columns)
    )


def evolve(table: DataFrame, drop: list[str], add: dict[str, Column]) -> DataFrame:
    """Drop retired columns and add new ones with their defaults, if missing."""
    kept = table.drop(*drop)
    return kept.withColumns({c: default for c, default in add.items() if c not in kept.columns})


def upsert_fields(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Insert new keys whole; on known keys change the named fields only."""
    new = incoming.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in existing.columns if c != key])
    old = existing.withColumn("_old", F.lit(True))
    columns = []
    for c in existing.columns:
        if c == key:
            columns.append(F.col(key))
        elif c in fields:
            columns.append(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c))
    return old.join(new, key, "full").select(*columns)


def publish(published_day: DataFrame, day: DataFrame) -> DataFrame:
    """The one published row, pointing at the day that ``day`` holds in its one row."""
    return published_day.withColumn("job_date", day.select("job_date").scalar())


def fill_sort_order(jobs: DataFrame) -> DataFrame:
    """Give unordered jobs their place by creation within the day.

    Every job of the day is numbered; only missing orders are filled. Only keys
    are ordered, the rest joins by id.
    """
    order = [F.col("created_at").asc_nulls_last(), F.col("id").asc()]
    keys = jobs.select("job_date", "created_at", "id")
    numbered = OrderedGroups(keys, ["job_date"], order).numbered("created_position").rows
    placed = lookup_join(jobs, numbered.select("id", "created_position"), ["id"])
    return placed.withColumn("sort_order", F.coalesce("sort_order", "created_position"))


def default_sort_order(jobs: DataFrame) -> DataFrame:
    """Unordered jobs go to the end: creation time in epoch seconds."""
    return jobs.withColumn(
        "sort_order", F.coalesce("sort_order", F.unix_timestamp(F.col("created_at").cast("timestamp")))
    )


def swap_sort_order(jobs: DataFrame, swaps: DataFrame) -> DataFrame:
    """Swap the order values of job pairs (``first_id``, ``second_id``).

    *Inferred*: reordering only exchanges two jobs' values. A job may be in one
    pair at most.
    """
    there = swaps.select(F.col("first_id").alias("id"), F.col("second_id").alias("_partner"))
    back = swaps.select(F.col("second_id").alias("id"), F.col("first_id").alias("_partner"))
    partner_order = jobs.select(F.col("id").alias("_partner"), F.col("sort_order").alias("_order"))
    pairs = there.unionByName(back).join(partner_order, "_partner")
    return (
        jobs.join(pairs, "id", "left")
        .withColumn("sort_order", F.when(F.col("_partner").isNotNull(), F.col("_order")).otherwise(F.col("sort_order")))
        .select(*jobs.columns)
    )


def with_defaults(rows: DataFrame, as_of: Column) -> DataFrame:
    """New jobs with unset columns filled: flags false, day and times from ``as_of``."""
    flags = ["is_trial", "is_doubles", "needs_dipping", "is_done"]
    defaults = {c: F.lit(False) for c in flags}
    defaults |= {"job_date": as_of.cast("date"), "created_at": as_of, "sort_order": F.unix_timestamp(as_of)}
    return rows.withColumns(
        {c: F.coalesce(F.col(c), default) if c in rows.columns else default for c, default in defaults.items()}
    )
