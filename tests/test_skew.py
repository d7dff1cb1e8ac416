"""Hot groups and keys: same results, spread over several tasks."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from floorspark.operators import calibration, edits, parts, views
from floorspark.plans.ordered import SLICE, OrderedGroups, number_slice
from floorspark.plans.skew import lookup_join
from floorspark.sources.tables import Tables
from tests.checks import DATA, spark_rows


@pytest.fixture(scope="module")
def tables(spark):
    """The small data set with a third of all jobs and messages on one day."""
    t = Tables(spark, f"{DATA}/sf0.001")
    crowded = F.when(F.col("id") % 3 == 0, F.lit(dt.date(1998, 1, 1))).otherwise(F.col("job_date"))
    t._known["jobs"] = t.jobs.withColumn("job_date", crowded)
    t._known["chat_messages"] = t.chat_messages.withColumn("job_date", crowded)
    return t


def day_ordered(rows, keys, order):
    """Places by a plain window, for comparing."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def test_sliced_positions_equal_a_plain_window(tables):
    placed = views.positions(tables.jobs).select("id", "day_position")
    whole = day_ordered(tables.jobs, ["job_date"], views.list_order()).select("id", F.col("place").cast("long").alias("day_position"))
    assert spark_rows(placed)[1] == spark_rows(whole)[1]


def test_a_hot_group_is_cut_into_slices(spark):
    rows = spark.range(9000).select(F.when(F.col("id") < 6000, 0).otherwise(F.col("id")).alias("k"), "id")
    ordered = OrderedGroups(rows, ["k"], [F.col("id").asc()], number_slice(F.col("id"), 1000))
    sizes = ordered._rows.where("k = 0").groupBy(SLICE).count().collect()
    assert len(sizes) == 6 and max(r["count"] for r in sizes) == 1000
    placed = ordered.numbered("place").rows.where("k = 0")
    assert placed.where("place <> id + 1").count() == 0 and placed.count() == 6000


def test_slices_carry_every_kind(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), "id", (F.col("id") * 37 % 101).alias("v"))
    rows = rows.withColumn("at", F.when(F.col("id") % 7 > 0, F.col("id")))
    order = [F.col("at").asc_nulls_last(), F.col("id").asc()]
    cut = number_slice(F.col("at"), 20, F.col("id"), 50)
    got = OrderedGroups(rows, ["k"], order, cut).running(s=("sum", F.col("v")), lo=("min", F.col("v")), hi=("max", F.col("v"))).rows
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({"s": F.sum("v").over(w), "lo": F.min("v").over(w), "hi": F.max("v").over(w)})
    assert spark_rows(got)[1] == spark_rows(want)[1]
    before = OrderedGroups(rows, ["k"], order, cut).running(inclusive=False, s=("sum", F.col("v"))).rows
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    assert spark_rows(before)[1] == spark_rows(rows.withColumn("s", F.sum("v").over(w)))[1]
    after = OrderedGroups(rows.where("at is not null"), ["k"], order, cut).following("next", F.col("at")).rows
    want = rows.where("at is not null").withColumn("next", F.lead("at").over(Window.partitionBy("k").orderBy(*order)))
    assert spark_rows(after)[1] == spark_rows(want)[1]


def tied_rows(spark):
    """9,000 rows; a third of all, in one group, share a single order value."""
    tied = F.col("id") % 3 == 0
    return spark.range(9000, numPartitions=5).select(
        F.when(tied, 0).otherwise(F.col("id") % 50).alias("k"),
        F.when(tied, 7).when(F.col("id") % 100 > 1, F.col("id") % 6).alias("at"),
        (F.col("id") * 7919 % 9000).alias("id"),
        (F.col("id") * 37 % 101).alias("v"),
    )


def test_tied_rows_of_a_hot_group_are_cut(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be merged
    ordered = OrderedGroups(tied_rows(spark), ["k"], [F.col("at").asc_nulls_last(), F.col("id").asc()])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in ordered._rows.where("k = 0 and at = 7").groupBy(SLICE).count().collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 2 and max(sizes) <= 2 * 9000 / 8


def test_range_slices_carry_every_kind(spark):
    rows, order = tied_rows(spark), [F.col("at").asc_nulls_last(), F.col("id").asc()]
    w = Window.partitionBy("k").orderBy(*order)
    numbered = OrderedGroups(rows, ["k"], order).numbered("n").rows
    assert spark_rows(numbered)[1] == spark_rows(rows.withColumn("n", F.row_number().over(w).cast("long")))[1]
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    got = OrderedGroups(rows, ["k"], order).running(s=("sum", F.col("v")), lo=("min", F.col("v")), hi=("max", F.col("v"))).rows
    want = rows.withColumns({"s": F.sum("v").over(upto), "lo": F.min("v").over(upto), "hi": F.max("v").over(upto)})
    assert spark_rows(got)[1] == spark_rows(want)[1]
    timed = rows.where("at is not null")
    after = OrderedGroups(timed, ["k"], order).following("next", F.col("at")).rows
    assert spark_rows(after)[1] == spark_rows(timed.withColumn("next", F.lead("at").over(w)))[1]
    falling = [F.col("at").desc_nulls_last(), F.col("id").desc()]
    back = OrderedGroups(rows, ["k"], falling).numbered("n").rows
    w = Window.partitionBy("k").orderBy(*falling)
    assert spark_rows(back)[1] == spark_rows(rows.withColumn("n", F.row_number().over(w).cast("long")))[1]


def test_range_slices_of_nothing_and_of_null_groups(spark):
    order = [F.col("id").asc()]
    none = spark.createDataFrame([], "k int, id long")
    assert OrderedGroups(none, ["k"], order).numbered("n").rows.collect() == []
    rows = spark.createDataFrame([(None, 3), (None, 1), (2, 5)], "k int, id long")
    placed = {(r["k"], r["id"]): r["n"] for r in OrderedGroups(rows, ["k"], order).numbered("n").rows.collect()}
    assert placed == {(None, 1): 1, (None, 3): 2, (2, 5): 1}


def test_building_on_arrival_numbers_runs_no_job(spark):
    """Range partitions store the ordered keys; cuts by a number store nothing."""
    t = Tables(spark, f"{DATA}/sf0.001")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("built", "building only")
    edits.clamped_counter(t.edits)
    calibration.fit_history(t.cal_seq)
    parts.carry_forward(t.jobs, t.counts)
    views.job_summary(t.jobs, t.counts)
    assert list(tracker.getJobIdsForGroup("built")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_two_published_rows_are_an_error(tables, spark):
    days = spark.createDataFrame([(1, dt.date(1998, 1, 1)), (1, dt.date(1998, 1, 2))], "id int, job_date date")
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        views.published_jobs(tables.jobs, days).collect()


@pytest.fixture
def eager_splits(spark):
    """Thresholds low enough for skew handling to start on test data."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return df._jdf.queryExecution().executedPlan().toString(), rows


def hot_facts(spark):
    """200,000 rows, a third of them on one key."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000)
    return spark.range(200_000, numPartitions=8).select(key.alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("v"))


@pytest.mark.parametrize("kind", ["long", "string", "date"])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_lookup_keys_are_split(spark, eager_splits, kind, how):
    cast = {"long": F.col("k"), "string": F.col("k").cast("string"), "date": F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("k").cast("int"))}
    facts = hot_facts(spark).withColumn("k", cast[kind])
    table = facts.where("id < 3000").groupBy("k").agg(F.count("*").alias("n"))
    if how in ("left_semi", "left_anti"):
        table = table.select("k")
    joined = lookup_join(facts, table, ["k"], how)
    plan, rows = final_plan(joined)
    assert "skew=true" in plan
    assert len(rows) == (0 if how == "left_anti" else 200_000)


def test_hot_parts_are_split_in_operators(spark, eager_splits):
    """Cross-check and dip memory with a third of the jobs on one part."""
    facts = hot_facts(spark)
    jobs = facts.select(
        "id",
        F.concat(F.lit("P"), "k").alias("item_number"),
        F.lit("G").alias("grade"),
        F.lit(None).cast("decimal(18,3)").alias("weight_kg"),
        F.lit(False).alias("is_doubles"),
        F.lit(False).alias("needs_dipping"),
        "v",
    )
    reference = jobs.where("id < 3000").withColumn("updated_at", F.lit(dt.datetime(2024, 1, 1)))
    plan, rows = final_plan(parts.cross_check(jobs, reference))
    assert "skew=true" in plan and len(rows) == 200_000 and {r["status"] for r in rows} == {"exact"}
    memory = jobs.where("id = 0").select("item_number", F.lit(True).alias("needs_dipping"))
    plan, rows = final_plan(parts.remember_dipping(jobs, memory))
    assert "skew=true" in plan and sum(r["needs_dipping"] for r in rows) == 66_800
