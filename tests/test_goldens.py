"""Hand-computed results."""

from __future__ import annotations

import base64
import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from floorspark.functions import formulas as fx
from floorspark.functions import text as tx
from floorspark.operators import access, calibration, changes, chat, edits, eta, ingest, parts, quality, views
from floorspark.sources.schemas import FLOOR

DAY = dt.date(2024, 5, 6)
START = dt.datetime(2024, 5, 6, 6, 0)


def table(spark, name, rows):
    columns = [c.strip().split()[0] for c in FLOOR[name].replace("decimal(18,3)", "decimal").split(", ")]
    filled = []
    for row in rows:
        unknown = set(row) - set(columns)
        assert not unknown, unknown
        filled.append(tuple(row.get(c) for c in columns))
    return spark.createDataFrame(filled, FLOOR[name])


def job(id, **fields):
    return {"id": id, "am_number": f"AM{id}", "job_date": DAY, **fields}


def jobs_table(spark, rows):
    return table(spark, "jobs", rows)


@pytest.mark.parametrize(
    "count, doubles, weight, expected",
    [
        ((10, 3, 4, 2, None), True, "12.5", (38, 19.0, 0.238)),
        ((10, 3, 4, 2, 40), False, "12.5", (40, 40.0, 0.5)),
        ((10, 3, None, None, 0), False, "12.5", (0, 0.0, 0.0)),
        ((10, 3, None, None, None), None, None, (30, 30.0, 0.0)),
        (None, True, "12.5", (0, 0.0, 0.0)),
        ((1, 1, None, None, None), True, "0.999", (1, 0.5, 0.0)),
        ((2147483647, 1, None, None, None), False, "1.001", (2147483647, 2147483647.0, 2149631.131)),
    ],
)
def test_job_summary(spark, count, doubles, weight, expected):
    jobs = jobs_table(spark, [job(1, is_doubles=doubles, weight_kg=weight and Decimal(weight))])
    rows = []
    if count:
        names = ["group_a_cores", "group_a_trolleys", "group_b_cores", "group_b_trolleys", "manual_total_override"]
        rows = [{"job_id": 1, **dict(zip(names, count))}]
    row = views.job_summary(jobs, table(spark, "counts", rows)).first()
    assert (row["counted_total"], float(row["effective_qty"]), float(row["tonnage"])) == expected


def test_overflowing_total_is_an_error(spark):
    counts = table(spark, "counts", [{"job_id": 1, "group_a_cores": 2147483647, "group_a_trolleys": 2}])
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        counts.select(fx.counted_total()).collect()


def test_rebuilt_override(spark):
    rows = spark.createDataFrame(
        [(38, 10, 3, 4, 2), (40, 10, 3, 4, 2)],
        "total_cores int, group_a_cores int, group_a_trolleys int, group_b_cores int, group_b_trolleys int",
    )
    assert [r[0] for r in rows.select(fx.rebuilt_override()).collect()] == [None, 40]


A = job(1, am_number="A", planned_qty=100, weight_kg=Decimal(12), sort_order=1)
B = job(2, am_number="B", planned_qty=50, weight_kg=Decimal(24), is_doubles=True, sort_order=2)
C = job(3, am_number="C", sort_order=3)


@pytest.mark.parametrize(
    "current, left, tph, started, expected",
    [
        (1, None, 12, START, {2: "06:13", 3: "06:23"}),
        (1, 25, 12, START, {2: "06:08", 3: "06:18"}),
        (1, 0, 12, START, {2: "06:07", 3: "06:17"}),
        (2, None, 12, START, {3: "06:10"}),
        (99, None, 12, START, {2: "06:13", 3: "06:23"}),
        (None, None, 12, START, {2: "06:13", 3: "06:23"}),
        (1, None, 0, START, {}),
        (1, None, None, START, {}),
        (1, None, 12, None, {}),
    ],
)
def test_eta(spark, current, left, tph, started, expected):
    pace = {"job_date": DAY, "current_job_id": current, "started_at": started}
    pace |= {"tons_per_hour": tph and Decimal(tph), "remaining_qty": None if left is None else Decimal(left)}
    if tph == 0:
        pace["tons_per_hour"] = Decimal(0)
    jobs = jobs_table(spark, [C, A, B])
    rows = eta.project(jobs, table(spark, "job_pace", [pace]))
    shown = rows.select("id", tx.clock_time("eta_at").alias("eta"), "eta_offset_ms").collect()
    assert {r["id"]: r["eta"] for r in shown if r["eta"]} == expected
    if left == 25:
        assert {r["id"]: r["eta_offset_ms"] for r in shown} == {1: None, 2: 510_000, 3: 1_110_000}


def test_eta_without_pace_row(spark):
    rows = eta.project(jobs_table(spark, [A, B]), table(spark, "job_pace", [])).collect()
    assert {r["id"]: (r["is_current"], r["eta_at"]) for r in rows} == {1: (True, None), 2: (False, None)}


@pytest.mark.parametrize("width", [4, 10**6])
def test_clamped_counter_equals_loop(spark, monkeypatch, width):
    monkeypatch.setattr(edits, "SEQ_SLICE", width)
    rng, events, expected = random.Random(7), [], {}
    for job_id in range(30):
        value = 0
        for i in range(rng.randint(1, 40)):
            step = rng.choice([1, -1])
            value = max(0, value + step)
            seq = i * 30 + job_id
            events.append((job_id, seq, "a", "plus" if step > 0 else "minus"))
            expected[job_id, seq] = value
    rng.shuffle(events)
    frame = spark.createDataFrame(events, "job_id long, seq long, box string, kind string")
    rows = edits.clamped_counter(frame).collect()
    assert {(r["job_id"], r["seq"]): r["value"] for r in rows} == expected


def test_clamped_counter_golden(spark):
    kinds = ["plus", "minus", "minus", "plus", "minus", "minus"]
    frame = spark.createDataFrame(
        [(1, i, "a", k) for i, k in enumerate(kinds)], "job_id long, seq long, box string, kind string"
    )
    rows = edits.clamped_counter(frame).orderBy("seq").collect()
    assert [r["value"] for r in rows] == [1, 0, 0, 1, 0, 0]


def fit_of(spark, points):
    frame = spark.createDataFrame([("d", *p) for p in points], "device string, idx double, temp double")
    return calibration.fit(frame).first()


def test_calibration(spark):
    row = fit_of(spark, [(0.2, 1200.0), (0.4, 1400.0)])
    assert (round(row["a"], 6), round(row["b"], 6), round(row["r2"], 6)) == (1000.0, 1000.0, 1.0)
    frames = spark.createDataFrame([("d", 0.35), ("d", 0.4), ("e", 0.35)], "device string, idx double")
    fits = spark.createDataFrame([row])
    shown = [(r["temperature"], r["band"], r["tier"]) for r in calibration.estimates(frames, fits).orderBy("device", "idx").collect()]
    assert shown[0] == (1350, "#ff8a1e", "good")
    assert shown[1][0] == 1400
    assert shown[2] == (None, None, "uncalibrated")


def test_calibration_without_a_line(spark):
    assert fit_of(spark, [(0.2, 1200.0)])["a"] is None
    assert fit_of(spark, [(0.2, 1200.0), (0.2, 1300.0)])["a"] is None
    flat = fit_of(spark, [(0.2, 1200.0), (0.4, 1200.0)])
    assert (flat["a"], flat["r2"]) == (0.0, 1.0)


@pytest.mark.parametrize("value, band", [(899, "#8a2a1e"), (900, "#d9432e"), (1200, "#ff8a1e"), (1400, "#ffb84d"), (1550, "#fff2d0")])
def test_bands(spark, value, band):
    assert spark.range(1).select(fx.temperature_band(F.lit(value))).first()[0] == band


@pytest.mark.parametrize("r2, tier", [(0.91, "good"), (0.9, "fair"), (0.6, "poor"), (None, "uncalibrated")])
def test_tiers(spark, r2, tier):
    assert spark.range(1).select(fx.fit_tier(F.lit(r2).cast("double"))).first()[0] == tier


def test_rounding_half_up_towards_infinity(spark):
    values = spark.createDataFrame([(-2.5,), (2.5,), (2.4,)], "v double")
    assert [r[0] for r in values.select(fx.nearest("v")).collect()] == [-2, 3, 2]


def test_array_total(spark):
    rows = spark.createDataFrame([([3, None, 4],), ([],), (None,)], "e array<int>")
    shown = rows.select(fx.entries_total("e"), fx.entries_count("e")).collect()
    assert [tuple(r) for r in shown] == [(7, 3), (0, 0), (0, 0)]


def test_leading_int(spark):
    values = ["12abc", "abc", " -7", "+3.9", "", None, "99999999999"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in rows.select(tx.leading_int("v")).collect()] == [12, None, -7, 3, None, None, None]


def test_trim_and_escape(spark):
    rows = spark.createDataFrame([("\n\t Sam ",), (" \n",), (None,)], "v string")
    assert [r[0] for r in rows.select(tx.trimmed_or("v", "Trolley")).collect()] == ["Sam", "Trolley", "Trolley"]
    marked = spark.createDataFrame([('<a b="c">&lt;',), (None,)], "v string")
    assert [r[0] for r in marked.select(tx.escape_markup("v")).collect()] == ["&lt;a b=&quot;c&quot;&gt;&amp;lt;", ""]


@pytest.mark.parametrize(
    "header, role",
    [
        ("Bearer h.eyJyb2xlIjoiYW5vbiJ9.s", "anon"),
        ("bearer   h.eyJyb2xlIjoiYW5vbiJ9.s", "anon"),
        ("h.eyJyb2xlIjoiYW5vbiJ9", "anon"),
        ("Bearer h.eyJzdWIiOiJ4In0.s", None),
        ("Bearer h", None),
        ("Bearer h..s", None),
        ("Bearer h.%%%.s", None),
        (None, None),
        # '{"role":"a?>~"}' needs both url-safe characters.
        ("Bearer h.eyJyb2xlIjoiYT8-fiJ9.s", "a?>~"),
    ],
)
def test_role_claim(spark, header, role):
    assert spark.range(1).select(tx.role_claim(F.lit(header).cast("string"))).first()[0] == role


def test_unread_is_strict(spark):
    at = dt.datetime(2024, 5, 6, 10)
    messages = table(
        spark, "chat_messages", [{"id": 1, "job_date": DAY, "sender_role": "admin", "body": "x", "created_at": at}]
    )
    newest = chat.newest_office(messages)
    for seen, expected in ((None, True), (at, False), (at - dt.timedelta(seconds=1), True)):
        marker = spark.createDataFrame([(DAY, seen)], "job_date date, last_seen timestamp")
        assert chat.unread(newest, marker).first()["unread"] is expected
        assert chat.unread(newest, marker, panel_open=True).first()["unread"] is False


def test_burst_boundary(spark):
    at = dt.datetime(2024, 5, 6, 10)
    times = [0, 10, 20, 31]
    frame = spark.createDataFrame(
        [(1, i, at + dt.timedelta(seconds=s)) for i, s in enumerate(times)], "job_id long, seq long, ts timestamp"
    )
    assert [r["seq"] for r in edits.bursts(frame, 10).orderBy("seq").collect()] == [2, 3]


def variants(rows):
    return sorted(tuple(r) for r in rows.select(*parts.VARIANT).collect())


def test_backfill_is_idempotent_with_nulls(spark):
    rows = [job(1, item_number="P", grade=None), job(2, am_number="AM1", item_number="P", grade=None), job(3, item_number="")]
    jobs = jobs_table(spark, rows)
    empty = table(spark, "item_reference", [])
    once = parts.backfill(jobs, empty)
    assert once.count() == 1
    assert variants(parts.backfill(jobs, once)) == variants(once)


def test_carry_forward_takes_latest_earlier_day(spark):
    day = lambda n: DAY + dt.timedelta(days=n)
    rows = [job(i, am_number="W", job_date=day(n)) for i, n in ((1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (6, 0))]
    rows.append(job(7, am_number="X", job_date=day(3)))
    counts = table(spark, "counts", [{"job_id": i, "group_a_cores": i} for i in (1, 2, 3, 5)])
    carried = {r["job_id"]: r["source_job_id"] for r in parts.carry_forward(jobs_table(spark, rows), counts).collect()}
    assert carried == {4: 3}


def test_cross_check(spark):
    reference = table(
        spark,
        "item_reference",
        [
            {"id": 1, "item_number": "P", "grade": "G", "is_doubles": False, "needs_dipping": False, "updated_at": START},
            {"id": 2, "item_number": "P", "grade": "old", "is_doubles": False, "needs_dipping": False},
        ],
    )
    rows = [job(1, item_number="P", grade="G"), job(2, item_number="P", grade="H", is_doubles=True), job(3, item_number="Q")]
    shown = {r["id"]: (r["status"], r["differing_fields"]) for r in parts.cross_check(jobs_table(spark, rows), reference).collect()}
    assert shown == {1: ("exact", ""), 2: ("variant", "grade,is_doubles"), 3: ("new_part", "")}


def test_swap_twice_is_identity(spark):
    jobs = jobs_table(spark, [A, B, C])
    swaps = spark.createDataFrame([(1, 3)], "first_id long, second_id long")
    once = changes.swap_sort_order(jobs, swaps)
    assert {r["id"]: r["sort_order"] for r in once.collect()} == {1: 3, 2: 2, 3: 1}
    twice = changes.swap_sort_order(once, swaps)
    assert {r["id"]: r["sort_order"] for r in twice.collect()} == {1: 1, 2: 2, 3: 3}


def test_mark_read_twice_changes_nothing(spark):
    rows = [
        {"id": 1, "job_date": DAY, "sender_role": "admin", "body": "x", "created_at": START},
        {"id": 2, "job_date": DAY, "sender_role": "trolley", "body": "x", "created_at": START},
        {"id": 3, "job_date": DAY + dt.timedelta(days=1), "sender_role": "admin", "body": "x", "created_at": START},
    ]
    messages = table(spark, "chat_messages", rows)
    day = table(spark, "published_day", [{"id": 1, "job_date": DAY}])
    once = changes.mark_read(messages, day, F.lit(START), "Sam")
    twice = changes.mark_read(once, day, F.lit(START + dt.timedelta(hours=1)), "Kim")
    shown = {r["id"]: (r["read_at"], r["read_by"]) for r in twice.collect()}
    assert shown == {1: (START, "Sam"), 2: (None, None), 3: (None, None)}


def test_upsert_order_options(spark):
    existing = spark.createDataFrame([(1, 5), (2, 6)], "job_id long, total int")
    incoming = spark.createDataFrame(
        [(1, 7, 1, START), (1, 8, 2, START - dt.timedelta(hours=1)), (3, 9, 3, START)],
        "job_id long, total int, seq long, updated_at timestamp",
    )
    by_arrival = {r[0]: r[1] for r in changes.upsert(existing, incoming, "job_id").collect()}
    by_time = {r[0]: r[1] for r in changes.upsert(existing, incoming, "job_id", "updated_at").collect()}
    assert by_arrival == {1: 8, 2: 6, 3: 9}
    assert by_time == {1: 7, 2: 6, 3: 9}


def test_patch_separates_absent_from_null(spark):
    users = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "user_id long, name string, permission string")
    patches = spark.createDataFrame([(1, {"name": None}), (2, {"permission": "w"})], "user_id long, changes map<string,string>")
    shown = {r[0]: (r[1], r[2]) for r in changes.patch(users, patches, "user_id", ["name", "permission"]).collect()}
    assert shown == {1: (None, "x"), 2: ("b", "w"), 3: ("c", "z")}


def test_view_only_callers_cannot_toggle(spark):
    jobs = jobs_table(spark, [A])
    users = spark.createDataFrame([(1, "view_only")], "user_id long, permission string")
    toggles = spark.createDataFrame([(1, 1, 1, True)], "job_id long, seq long, caller_id long, flag boolean")
    assert changes.apply_toggles(jobs, toggles, users, "is_done").first()["is_done"] is None
    assert changes.apply_toggles(jobs, toggles, users, "is_done", require_full_access=False).first()["is_done"] is True


def test_summary_follows_new_job_columns(spark):
    jobs = jobs_table(spark, [A]).withColumn("furnace", F.lit("F1"))
    assert views.job_summary(jobs, table(spark, "counts", [])).first()["furnace"] == "F1"


def test_anon_sees_a_subset(spark):
    jobs = jobs_table(spark, [A, {**B, "job_date": DAY + dt.timedelta(days=1)}])
    day = table(spark, "published_day", [{"id": 1, "job_date": DAY}])
    floor = access.visible("jobs", "anon", jobs, day)
    assert floor.columns == ["id", "job_date"]
    office = {r["id"] for r in access.visible("jobs", "view_only", jobs, day).collect()}
    assert {r["id"] for r in floor.collect()} == {1} < office


def test_admission_keeps_every_write(spark):
    jobs = jobs_table(spark, [A])
    day = table(spark, "published_day", [{"id": 1, "job_date": DAY}])
    writes = spark.createDataFrame([(1,), (2,), (None,)], "job_id long")
    accepted, rejected = access.split(access.admit("counts", "insert", "anon", writes, day, jobs))
    assert [r["job_id"] for r in accepted.collect()] == [1]
    assert sorted((r["job_id"] or 0) for r in rejected.collect()) == [0, 2]
    denied = access.admit("counts", "delete", "full_access", writes)
    assert {r["reason"] for r in denied.collect()} == {"not granted"}


def test_no_published_day_shows_nothing(spark):
    jobs = jobs_table(spark, [A])
    none = table(spark, "published_day", [])
    assert views.published_jobs(jobs, none).count() == 0
    assert access.visible("jobs", "anon", jobs, none).count() == 0


def test_extraction_rows(spark):
    bodies = ['[{"planned_qty":3.0,"ratio":"2/1"},{"ratio":"1/1"},{"is_doubles":false,"ratio":"2/1"}]', None, "[]", '[{"a":']
    requests = spark.createDataFrame(list(enumerate(bodies)), "req_id long, body string")
    rows = ingest.normalised(ingest.extracted_rows(requests)).orderBy("row_no").collect()
    assert [(r["planned_qty"], r["is_doubles"]) for r in rows] == [(3, True), (None, False), (None, False)]
    assert [(r["req_id"], r["raw"]) for r in ingest.parse_failures(requests).collect()] == [(3, '[{"a":')]


def test_lookup_statuses(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    rows = spark.createDataFrame([(1, None), (2, "a"), (2, "b")], "k long, v string")
    shown = {r["k"]: (r["status"], r["v"]) for r in views.lookup(keys, rows, "k", ["v"]).collect()}
    assert shown == {1: ("ok", None), 2: ("multiple", None), 3: ("missing", None)}


def test_null_passes_domain_check(spark):
    rows = spark.createDataFrame([("Cr",), ("Xx",), (None,)], "element string")
    assert [r[0] for r in quality.outside_domain(rows, "element", quality.ELEMENTS).collect()] == ["Xx"]


def test_summary_of_retired_layouts(spark):
    jobs = jobs_table(spark, [job(1, is_doubles=True, weight_kg=Decimal("12.5")), job(2, weight_kg=Decimal(10))])
    first = spark.createDataFrame(
        [(1, 10, 3, None), (2, 10, 3, 40)],
        "job_id long, cores_per_trolley int, trolley_count int, manual_total_override int",
    )
    second = spark.createDataFrame(
        [(1, [3, None, 4], None), (2, None, 40)], "job_id long, trolley_entries array<int>, manual_total_override int"
    )
    listed = F.coalesce("manual_total_override", fx.entries_total("trolley_entries"))
    for counts, counted, expected in (
        (first, fx.counted_total_v0(), {1: (30, 15.0, 0.188), 2: (40, 40.0, 0.4)}),
        (second, listed, {1: (7, 3.5, 0.044), 2: (40, 40.0, 0.4)}),
    ):
        rows = views.job_summary(jobs, counts, counted).collect()
        shown = {r["id"]: (r["counted_total"], float(r["effective_qty"]), float(r["tonnage"])) for r in rows}
        assert shown == expected


def test_shown_day_falls_back_to_utc_date(spark):
    as_of = F.expr("timestamp'2024-05-06 23:30:00-05:00'")
    none, some = table(spark, "published_day", []), table(spark, "published_day", [{"id": 1, "job_date": DAY}])
    assert views.shown_day(none, as_of).first()["job_date"] == dt.date(2024, 5, 7)
    assert views.shown_day(some, as_of).first()["job_date"] == DAY


def test_fit_history_equals_refitting(spark):
    rng = random.Random(3)
    points = [("d", i, rng.choice([0.1, 0.2, 0.5]), 1000.0 + rng.randint(0, 400)) for i in range(25)]
    frame = spark.createDataFrame(points, "device string, seq long, idx double, temp double")
    shown = {r["seq"]: r for r in calibration.fit_history(frame).collect()}
    for i in range(25):
        xs, ys = [p[2] for p in points[: i + 1]], [p[3] for p in points[: i + 1]]
        n, mean_x, mean_y = len(xs), sum(xs) / len(xs), sum(ys) / len(ys)
        spread = sum((x - mean_x) ** 2 for x in xs)
        if n < 2 or n * spread < 1e-9:
            assert shown[i]["a"] is None and shown[i]["r2"] is None
            continue
        a = sum((x - mean_x) * (y - mean_y) for x, y in zip(xs, ys)) / spread
        assert shown[i]["a"] == pytest.approx(a, abs=1e-6)
        assert shown[i]["b"] == pytest.approx(mean_y - a * mean_x, abs=1e-6)


@pytest.mark.parametrize(
    "text, grades",
    [
        ('[{"grade":"G"},{"grade":null}]', ["G", None]),
        ('[{"grade":"G","planned_qty":"12"}]', ["G"]),
        ("[]", []),
        (" [ ] ", []),
        ("null", "failed"),
        ('{"grade":"G"}', "failed"),
        ('[],"complete":true} junk', "failed"),
        ('[{"grade":"G"}],[{"grade":"H"}]', "failed"),
        ('[{"grade":"G","planned_qty":"abc"}]', "failed"),
        ('[{"grade":"G","planned_qty":9999999999}]', "failed"),
        ('[{"grade":"G","weight_kg":1e30}]', "failed"),
        ('[{"grade":"G","is_trial":"perhaps"}]', "failed"),
        (None, []),
        ('[{"grade":"G"}] and more', "failed"),
        ('[{"grade":"G"}]]', "failed"),
        ('[{"grade":"G"}]}, {"rows":[]', "failed"),
        ('[{"grade":"G"}', "failed"),
        ("[{'grade':'G'}]", "failed"),
        ("", "failed"),
        ("rows", "failed"),
    ],
)
def test_only_whole_json_is_parsed(spark, text, grades):
    requests = spark.createDataFrame([(1, text)], "req_id long, body string")
    rows = [r["grade"] for r in ingest.extracted_rows(requests).orderBy("row_no").collect()]
    failed = ingest.parse_failures(requests).count() == 1
    assert ("failed" if failed else rows) == grades
    assert not (failed and rows)


def test_unreadable_elements_are_kept_apart(spark):
    text = '[1,{"am_number":"B","planned_qty":3},{"am_number":"C","weight_kg":"heavy"},null]'
    response = json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})
    requests = spark.createDataFrame([(1, response), (2, "{}")], "req_id long, response string")
    rows = ingest.normalised(ingest.extracted_rows(requests)).collect()
    assert [(r["req_id"], r["row_no"], r["am_number"], r["planned_qty"]) for r in rows] == [(1, 1, "B", 3)]
    failed = ingest.parse_failures(requests).orderBy("row_no").collect()
    assert [(r["row_no"], r["reason"]) for r in failed] == [(0, "not an object"), (2, "unreadable weight_kg"), (3, "not an object")]
    assert failed[1]["raw"] == '{"am_number":"C","weight_kg":"heavy"}'


@pytest.mark.parametrize(
    "claims, role",
    [
        ('{"role":"authenticated"}', "authenticated"),
        (' {"sub":"u", "role":"authenticated"} ', "authenticated"),
        ('{"role":"authenticated"} garbage', None),
        ("{'role':'authenticated'}", None),
        ('{"role":"authenticated","role":"anon"}', "anon"),
        ('{"role":"authenticated"},{"role":"anon"}', None),
        ('[{"role":"authenticated"}]', None),
        ('{"role":"authenticated"}],[{}', None),
        ("", None),
    ],
)
def test_claims_are_read_strictly(spark, claims, role):
    token = "Bearer h." + base64.urlsafe_b64encode(claims.encode()).decode().rstrip("=") + ".s"
    rows = spark.createDataFrame([(token, 1000, 200), (token, 1000, None)], "authorization string, image_len long, upstream_status int")
    assert [r[0] for r in rows.select(tx.role_claim("authorization")).collect()] == [role] * 2
    statuses = [r[0] for r in rows.select(ingest.admission()).collect()]
    assert statuses == (["ok", "upstream error"] if role == "authenticated" else ["authenticated caller required"] * 2)


def test_first_arrival_is_kept(spark):
    stored = spark.createDataFrame([("A", 1)], "k string, v int")
    arriving = spark.createDataFrame([("A", 5, 0), *[("B", i, i) for i in range(900, 0, -1)]], "k string, v int, seq long")
    assert sorted(map(tuple, changes.insert_missing(stored, arriving, "k").collect())) == [("A", 1), ("B", 1)]


def test_response_text(spark):
    responses = [
        '{"candidates":[{"content":{"parts":[{"text":"[{\\"grade\\":1}]"}]}}]}',
        '{"candidates":[]}',
        "{}",
    ]
    rows = spark.createDataFrame([(r,) for r in responses], "r string")
    assert [r[0] for r in rows.select(ingest.response_text("r")).collect()] == ['[{"grade":1}]', "[]", "[]"]
