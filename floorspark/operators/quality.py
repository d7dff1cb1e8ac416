"""Constraints as data-quality reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from floorspark.plans.skew import lookup_join

# Fixed values.
ELEMENTS = ["Cr", "Cu", "Mo", "Sn", "Ni", "Gr", "Ti"]
SENDER_ROLES = ["admin", "trolley"]
PERMISSIONS = ["view_only", "full_access"]
MIN_PASSWORD = 8


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their row count; nulls never clash."""
    named = rows.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    return named.groupBy(*keys).agg(F.count("*").alias("row_count")).where(F.col("row_count") > 1)


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its number of nulls, from a single pass."""
    totals = rows.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return totals.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns]))
    )


def outside_domain(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is not allowed; null passes, as in a check constraint."""
    return rows.where(not_allowed(column, allowed))


def write_checked(rows: DataFrame, checks: dict[str, Column], write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Write rows and return how many of them meet each condition.

    The counts are taken while the rows are stored, not by scans of their own;
    ``write`` gets the observed rows and must write them in one go.
    """
    seen = Observation()
    counts = [F.count_if(F.coalesce(condition, F.lit(False))).alias(name) for name, condition in checks.items()]
    write(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts))
    return {name: seen.get[name] for name in ("rows", *checks)}


def missing(column: str) -> Column:
    """Null where a value is required."""
    return F.col(column).isNull()


def not_allowed(column: str, allowed: list[str]) -> Column:
    """Outside the domain; null passes, as in a check constraint."""
    return ~F.col(column).isin(allowed)


def singleton_state(rows: DataFrame) -> DataFrame:
    """Whether the table holds exactly the row with key 1."""
    return rows.agg(
        F.count("*").alias("row_count"), F.count(F.when(F.col("id") != 1, 1)).alias("wrong_keys")
    ).withColumn("is_valid", (F.col("row_count") == 1) & (F.col("wrong_keys") == 0))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows that point at no parent; a null reference is no orphan."""
    parents = parent.select(F.col(parent_key).alias(key))
    return lookup_join(child.where(F.col(key).isNotNull()), parents, [key], "left_anti")


def command_result(commands: DataFrame, users: DataFrame) -> DataFrame:
    """User-admin commands with ``ok`` or the first check they fail.

    Messages are fixed values.
    """
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    owners = users.where("is_owner").select(F.col("user_id").alias("caller_id"), F.lit(True).alias("_owner")).distinct()
    in_domain = F.coalesce(F.col("permission").isin(PERMISSIONS), F.lit(False))
    given = ~blank("permission")
    action = F.col("action")
    own = F.col("user_id").eqNullSafe(F.col("caller_id"))
    create = (
        F.when(blank("email") | blank("password") | blank("name"), "email, password, and name are required")
        .when(F.length("password") < MIN_PASSWORD, "password must be at least 8 characters")
        .when(~in_domain, "invalid permission")
        .otherwise("ok")
    )
    update = (
        F.when(F.col("user_id").isNull(), "user_id required")
        .when(given & ~in_domain, "invalid permission")
        .when(own & given & (F.col("permission") != "full_access"), "you can't downgrade your own account")
        .otherwise("ok")
    )
    delete = (
        F.when(F.col("user_id").isNull(), "user_id required")
        .when(own, "you can't delete your own account")
        .otherwise("ok")
    )
    result = (
        F.when(F.col("caller_id").isNull(), "not authenticated")
        .when(F.col("_owner").isNull(), "only the owner can manage users")
        .when(action == "list", "ok")
        .when(action == "create", create)
        .when(action == "update", update)
        .when(action == "delete", delete)
        .otherwise("unknown action")
    )
    return lookup_join(commands, owners, ["caller_id"]).withColumn("result", result).drop("_owner")
