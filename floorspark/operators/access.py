"""Role-scoped reads and write admission as filters and reason columns.

Roles: ``anon`` is the floor page; ``view_only`` and ``full_access`` are
signed-in users.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspark.operators.views import on_day, published_jobs
from floorspark.plans.skew import lookup_join

ROLES = ["anon", "view_only", "full_access"]
OPERATIONS = ["select", "insert", "update", "delete"]
ALL, PUBLISHED, FLAGGED = "all rows", "published day", "visible to the floor"
TROLLEY_PUBLISHED, ADMIN_PUBLISHED = "own role on the published day", "office rows of the published day"

_READ = {"select": ALL}
_WRITE = {"select": ALL, "insert": ALL, "update": ALL, "delete": ALL}

# Which rows a role may touch; an operation not listed is denied.
RULES: dict[str, dict[str, dict[str, str]]] = {
    "jobs": {"anon": {"select": PUBLISHED}, "view_only": _READ, "full_access": _WRITE},
    "counts": {
        "anon": {"select": ALL, "insert": PUBLISHED, "update": PUBLISHED},
        "view_only": {"select": ALL, "insert": ALL},
        "full_access": {"select": ALL, "insert": ALL},
    },
    "dip_items": {"view_only": _READ, "full_access": _WRITE},
    "item_reference": {"view_only": _READ, "full_access": _WRITE},
    "published_day": {"anon": _READ, "view_only": _READ, "full_access": {"select": ALL, "update": ALL}},
    "chat_messages": {
        "anon": {"select": PUBLISHED, "insert": TROLLEY_PUBLISHED, "update": ADMIN_PUBLISHED},
        "view_only": _READ,
        "full_access": {"select": ALL, "insert": ALL},
    },
    "item_reference_notes": {"anon": {"select": FLAGGED}, "view_only": _READ, "full_access": _WRITE},
    "job_notes": {"anon": {"select": f"{FLAGGED}, {PUBLISHED}"}, "view_only": _READ, "full_access": _WRITE},
    "additions": {"view_only": _WRITE, "full_access": _WRITE},
    "job_pace": {"anon": _READ, "view_only": _WRITE, "full_access": _WRITE},
    "app_users": {"view_only": _READ, "full_access": _READ},
    "trolley_jobs": {"anon": _READ},
    "job_summary": {"view_only": _READ, "full_access": _READ},
}

# Columns a role may read or update where not all of them.
READ_COLUMNS = {("jobs", "anon"): ["id", "job_date"]}
UPDATE_COLUMNS = {("chat_messages", "anon"): ["read_at", "read_by"]}


def on_published_day(rows: DataFrame, published_day: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Rows with a flag ``_today``; rows without a day take their job's."""
    if jobs is not None:
        today = published_jobs(jobs, published_day).select(F.col("id").alias("job_id"), F.lit(True).alias("_today"))
        flagged = rows.join(today, "job_id", "left")
    else:
        flagged = rows.withColumn("_today", on_day(published_day))
    return flagged.withColumn("_today", F.coalesce("_today", F.lit(False)))


def visible(
    relation: str, role: str, rows: DataFrame, published_day: DataFrame | None = None, jobs: DataFrame | None = None
) -> DataFrame:
    """The rows and columns of a relation that a role reads."""
    rule = RULES[relation].get(role, {}).get("select")
    columns = READ_COLUMNS.get((relation, role), rows.columns)
    if rule is None:
        return rows.where(F.lit(False)).select(*columns)
    if FLAGGED in rule:
        rows = rows.where("visible_to_trolley")
    if PUBLISHED in rule:
        rows = on_published_day(rows, published_day, jobs).where("_today")
    return rows.select(*columns)


def admit(
    relation: str,
    operation: str,
    role: str,
    writes: DataFrame,
    published_day: DataFrame | None = None,
    jobs: DataFrame | None = None,
    changed: list[str] | None = None,
) -> DataFrame:
    """Writes with a ``reason`` column; null means accepted.

    ``changed`` names the columns an update sets.
    """
    reason = _reason(relation, operation, role, changed)
    if "_today" not in reason.used:
        return writes.withColumn("reason", reason.column)
    return on_published_day(writes, published_day, jobs).withColumn("reason", reason.column).drop("_today")


class _Reason(NamedTuple):
    """Why a row is refused, null if it is not, and the flags that decide."""

    column: Column
    used: tuple[str, ...] = ()


def _reason(relation: str, operation: str, role: str, changed: list[str] | None = None) -> _Reason:
    rule = RULES[relation].get(role, {}).get(operation)
    if rule is None:
        return _Reason(F.lit("not granted"))
    grantable = UPDATE_COLUMNS.get((relation, role))
    if operation == "update" and grantable and not set(changed or []) <= set(grantable):
        return _Reason(F.lit("column not granted"))
    allowed, used = F.lit(True), ()
    if PUBLISHED in rule:
        allowed, used = F.col("_today"), ("_today",)
    if FLAGGED in rule:
        allowed = allowed & F.col("visible_to_trolley")
    if rule == TROLLEY_PUBLISHED:
        allowed = allowed & (F.col("sender_role") == "trolley")
    if rule == ADMIN_PUBLISHED:
        allowed = allowed & (F.col("sender_role") == "admin")
    return _Reason(F.when(~F.coalesce(allowed, F.lit(False)), "outside the role's rows"), used)


def every_cell(
    relation: str,
    rows: DataFrame,
    published_day: DataFrame | None = None,
    jobs: DataFrame | None = None,
    changed: list[str] | None = None,
) -> DataFrame:
    """Each row for every role and operation, with the ``reason`` it is refused
    for; rows that a role does not read are left out. One scan of ``rows``."""
    cells, used = [], set()
    for role in ROLES:
        for operation in OPERATIONS:
            reason = _reason(relation, operation, role, changed)
            used |= set(reason.used)
            cells.append(F.struct(F.lit(role).alias("role"), F.lit(operation).alias("operation"), reason.column.alias("reason")))
    flagged = on_published_day(rows, published_day, jobs) if "_today" in used else rows
    each = flagged.select("*", F.inline(F.array(*cells))).drop("_today")
    return each.where((F.col("operation") != "select") | F.col("reason").isNull())


def split(admitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted writes and rejected writes with their reason."""
    return admitted.where(F.col("reason").isNull()).drop("reason"), admitted.where(F.col("reason").isNotNull())


def has_full_access(callers: DataFrame, users: DataFrame) -> DataFrame:
    """Callers with the flag ``is_full_access``."""
    full = users.where(F.col("permission") == "full_access").select("user_id").distinct()
    return lookup_join(callers, full.withColumn("_full", F.lit(True)), ["user_id"]).withColumn(
        "is_full_access", F.coalesce("_full", F.lit(False))
    ).drop("_full")


def matrix(relations: dict[str, DataFrame], published_day: DataFrame) -> DataFrame:
    """Relation, role and operation with the rule and the rows the role reads.

    Each relation is counted once, with the floor's rows as a conditional count.
    """
    parts = []
    for relation, rows in relations.items():
        rule = RULES[relation].get("anon", {}).get("select")
        seen = F.lit(rule is not None)
        if rule == PUBLISHED:
            rows, seen = on_published_day(rows, published_day), F.col("_today")
        elif rule == FLAGGED:
            seen = F.col("visible_to_trolley")
        totals = rows.agg(F.count("*").alias("_all"), F.coalesce(F.sum(seen.cast("long")), F.lit(0)).alias("_anon"))
        cells = []
        for role in ROLES:
            rules = RULES[relation].get(role, {})
            count = F.col("_anon") if role == "anon" else F.col("_all")
            count = count if "select" in rules else F.lit(0)
            for operation in OPERATIONS:
                cells.append(
                    F.struct(
                        F.lit(relation).alias("relation"),
                        F.lit(role).alias("role"),
                        F.lit(operation).alias("operation"),
                        F.lit(operation in rules).alias("allowed"),
                        F.lit(rules.get(operation, "")).alias("scope"),
                        count.cast("long").alias("visible_rows"),
                    )
                )
        parts.append(totals.select(F.inline(F.array(*cells))))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
