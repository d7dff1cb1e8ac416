"""The derived tables reach every branch of the operators that have several."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from floorspark.operators import ingest
from tests.checks import connect

# Query, expression over its rows, and the values that must occur.
BRANCHES = [
    ("sc_03", "status", {"ok", "missing", "multiple"}),
    ("sc_05", "kind", {"row", "parse_failed"}),
    (
        "sc_06",
        "status",
        {"authenticated caller required", "missing imageBase64", "image too large", "upstream error", "ok"},
    ),
    ("sc_14", "is_done", {True, False, None}),
    ("jn_15", "action", {"edit", "insert"}),
    ("jn_16", "status", {"new_part", "exact", "variant"}),
    ("jn_18", "item_reference_id < 0", {True, False}),
    ("pr_10", "rebuilt_override is null", {True, False}),
    ("pr_13", "is_current", {True, False}),
    ("pr_13", "has_eta", {True, False}),
    ("pr_13", "has_notes", {True, False}),
    ("pr_14", "band", {"#8a2a1e", "#d9432e", "#ff8a1e", "#ffb84d", "#fff2d0"}),
    ("pr_15", "tier", {"good", "fair", "poor"}),
    ("pr_16", "temperature is null", {True, False}),
    ("st_08", "tier", {"good", "fair", "poor", "uncalibrated"}),
    ("st_03", "outcome", {"applied", "pending", "dropped"}),
    ("save_flow", "outcome", {"applied", "deleted", "not published"}),
    ("st_04", "manual_total_override is null", {True, False}),
    ("st_06", "unread", {True, False}),
    ("st_09", "regressed", {True, False}),
    ("wn_04", '"value" = 0', {True, False}),
    ("wn_05", "manual_total_override is null", {True, False}),
    ("ag_11", "is_empty", {True, False}),
    ("ac_02", "reason", {None, "not granted", "outside the role's rows"}),
    ("ac_06", "reason", {None, "column not granted", "outside the role's rows"}),
    ("ac_12", "is_full_access", {True, False}),
    ("dq_03", "relation", {"chat_messages", "additions", "user_commands"}),
    (
        "dq_06",
        "result",
        {
            "ok",
            "not authenticated",
            "only the owner can manage users",
            "email, password, and name are required",
            "password must be at least 8 characters",
            "invalid permission",
            "user_id required",
            "you can't downgrade your own account",
            "you can't delete your own account",
            "unknown action",
        },
    ),
]


@pytest.fixture(scope="module")
def duck():
    return connect("0.01")


@pytest.mark.parametrize("name, value, expected", BRANCHES)
def test_branch_occurs(duck, name, value, expected):
    rows = duck.execute(f"select distinct {value} from ({entry.oracle_sql()[name]}) q").fetchall()
    assert {r[0] for r in rows} == expected


def test_each_list_element_is_read_once(spark):
    """Neither the filter on reasons nor the single cells read an element again."""
    requests = spark.createDataFrame([(1, '[{"grade":"A","planned_qty":3.5},{"grade":"B","planned_qty":4}]')], "req_id long, body string").repartition(1)
    rows = ingest.extracted_rows(requests)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("StructField(grade") == 1
    assert [(r.row_no, r.grade) for r in rows.collect()] == [(0, "A"), (1, "B")]
