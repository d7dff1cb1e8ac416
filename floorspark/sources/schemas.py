"""Explicit schemas as DDL; nothing is inferred."""

from __future__ import annotations

# The stored source tables.
SOURCES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}

# The floor tables as an installation would store them.
FLOOR = {
    "jobs": (
        "id long not null, am_number string not null, item_number string, grade string, customer_name string, "
        "weight_kg decimal(18,3), planned_qty int, mingzhi_hansberg_no string, status string, is_trial boolean, "
        "is_doubles boolean, needs_dipping boolean, is_done boolean, job_date date not null, sort_order long, "
        "created_at timestamp"
    ),
    "counts": (
        "job_id long, group_a_cores int, group_a_trolleys int, group_b_cores int, group_b_trolleys int, "
        "manual_total_override int, comment string, still_making boolean, updated_at timestamp"
    ),
    "published_day": "id short not null, job_date date not null, updated_at timestamp",
    "dip_items": "item_number string not null, needs_dipping boolean not null, updated_at timestamp",
    "item_reference": (
        "id long not null, am_number string, item_number string not null, grade string, weight_kg decimal(18,3), "
        "is_doubles boolean not null, needs_dipping boolean not null, created_at timestamp, updated_at timestamp"
    ),
    "item_reference_notes": (
        "id long not null, item_reference_id long not null, item_number string not null, body string not null, "
        "visible_to_trolley boolean not null, created_at timestamp not null"
    ),
    "chat_messages": (
        "id long not null, job_date date not null, sender_role string not null, sender_name string, "
        "body string not null, created_at timestamp not null, read_at timestamp, read_by string"
    ),
    "additions": (
        "element string not null, per_tonne decimal(18,3), per_laddle decimal(18,3), updated_at timestamp not null"
    ),
    "job_pace": (
        "job_date date not null, current_job_id long, started_at timestamp, tons_per_hour decimal(18,3), "
        "remaining_qty decimal(18,3), updated_at timestamp"
    ),
    "app_users": (
        "user_id long not null, email string not null, name string not null, permission string not null, "
        "is_owner boolean not null, created_at timestamp not null"
    ),
    "job_notes": (
        "id long not null, job_id long not null, body string not null, visible_to_trolley boolean not null, "
        "created_at timestamp not null"
    ),
}

# Extraction requests as JSON lines: the caller's token, the image's encoded
# length, the upstream status and the extracted text.
REQUESTS = "req_id long, authorization string, image_len long, upstream_status int, body string"

# An extracted job as it is given: all cells as text, read afterwards.
EXTRACTION = (
    "struct<grade: string, am_number: string, item_number: string, customer_name: string, weight_kg: string, "
    "planned_qty: string, mingzhi_hansberg_no: string, status: string, is_trial: string, is_doubles: string, ratio: string>"
)
