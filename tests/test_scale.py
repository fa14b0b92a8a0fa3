import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablelens.operators import ordering as O, profiling as P, sampling as Sa, series as Se
from tablelens.operators.columns import first_values
from tablelens.sources import activity


def test_duplicates_are_counted_by_narrow_rows(spark, frame):
    wide = spark.range(20_000).select(*[(F.col("id") % 19_500 + k).alias(f"c{k}") for k in range(40)])
    found = P.duplicate_count(wide)
    assert found.first().duplicates == 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    first = next(line for line in reversed(plan.splitlines()) if "Exchange" in line)
    assert "__h1" in first and "c39" not in first
    rows = [(0.0, "a", None), (-0.0, "a", None), (float("nan"), "", 1), (float("nan"), "", 1), (float("nan"), None, 1)]
    table = frame(rows, "x double, t string, i int")
    assert P.duplicate_count(table).first().duplicates == table.count() - table.distinct().count() == 2
    assert P.duplicate_count(table.limit(0)).first().duplicates == 0


@pytest.mark.parametrize("method", ["linspace", "step"])
def test_systematic_samples_of_equal_and_null_rows(spark, method):
    table = spark.range(1000).select(
        F.when(F.col("id") < 600, 1).when(F.col("id") < 700, None).otherwise(F.col("id")).cast("long").alias("a"), F.lit("x").alias("row_index")
    )
    sample = O.sample_systematic(table, 90, ["a"], method)
    assert sample.columns == ["a", "row_index"] and sample.count() == 90
    ordered = sorted(((r.a is not None, r.a or 0) for r in table.collect()))
    step = 1000 // 90
    places = [int(k * 999 / 89) for k in range(90)] if method == "linspace" else [k * step for k in range(90)]
    assert sorted(((r.a is not None, r.a or 0) for r in sample.collect())) == [ordered[p] for p in places]


def test_quotas_of_many_classes_equal_one_window(spark, monkeypatch):
    table = spark.range(700).select("id", (F.col("id") * F.col("id") % 37).cast("string").alias("c"))
    few = Sa.stratified_sample(table, 101, ["id"], "c").collect()
    assert len(few) == 101
    monkeypatch.setattr(Sa, "BROADCAST_GROUPS", 5)
    monkeypatch.setattr(O, "BROADCAST_GROUPS", 5)
    assert sorted(Sa.stratified_sample(table, 101, ["id"], "c").collect()) == sorted(few)


def test_recent_activities_read_from_the_newest_day(spark, tmp_path):
    rows = [(f"{i:04d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), str(i % 3), "a", "ok") for i in range(200)]
    log = spark.createDataFrame(rows, "activity_id string, created_at timestamp, dataset_id string, action string, status string")
    place = str(tmp_path / "log")
    activity.append_activity(log, place)
    every = activity.read_activity(spark, place)
    for options in ({}, {"dataset_id": "1"}, {"dataset_id": "1", "limit": 3}, {"dataset_id": "none"}, {"limit": 500}):
        got = [r.activity_id for r in activity.recent_activities(spark, place, **options).orderBy(F.desc("created_at")).collect()]
        assert got == [r.activity_id for r in activity.list_activities(every, **options).collect()]
    with pytest.raises(ValueError):
        activity.recent_activities(spark, place, limit=0)


def test_first_values_of_dense_sparse_and_tied_columns(spark):
    table = spark.range(2000).select(
        (F.col("id") % 400).alias("k"), F.col("id").alias("dense"), F.when(F.col("id") % 97 == 5, F.col("id")).alias("sparse"),
        F.when(F.col("id") == 1999, "only").alias("rare"), F.lit("").alias("blank"), F.lit(1.5).alias("same"),
    ).repartition(5)
    names = ["dense", "sparse", "rare", "blank", "same"]
    rows = sorted(table.collect(), key=lambda r: r.k)
    for n in (1, 5, 40):
        got = {}
        for r in sorted(first_values(table, names, ["k"], n).collect()):
            got.setdefault(r.name, []).append(r.value)
        for name in names:
            cells = sorted((r.k, str(r[name])) for r in rows if r[name] not in (None, ""))
            assert got.get(name, []) == [value for _, value in cells[:n]], (name, n)
    assert first_values(table.limit(0), names, ["k"], 3).count() == 0
    assert first_values(table, [], ["k"], 3).count() == 0


def test_first_values_need_no_sort_of_the_cells(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = first_values(orders, orders.columns, ["o_orderkey"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Expand" not in plan


def brute_label(moments):
    days = sorted({m.timestamp() / 86_400 for m in moments})
    if len(days) < 2:
        return "month"
    gaps = sorted(b - a for a, b in zip(days, days[1:]))
    middle = len(gaps) // 2
    median = gaps[middle] if len(gaps) % 2 else (gaps[middle - 1] + gaps[middle]) / 2
    limits = (("day", 2), ("week", 10), ("month", 45), ("quarter", 120))
    return next((label for label, limit in limits if median <= limit), "year")


def test_frequencies_from_day_and_month_summaries(spark):
    from random import Random

    rng, utc, rows = Random(3), dt.timezone.utc, []
    for key in range(120):
        at = dt.datetime(2020, 1, 30, tzinfo=utc)
        for _ in range(rng.randint(1, 9)):
            rows.append((key, at))
            hours = rng.choice([0.001, 1, 20, 23, 24, 30, 48, 49, 80, 84, 86, 92, 24 * 10, 24 * 19.5, 24 * 44, 24 * 46, 24 * 89, 24 * 119, 24 * 130, 24 * 300])
            at += dt.timedelta(hours=hours)
    # half of the gaps lie within days, and the longest of them decides
    rows += [(200, dt.datetime(2020, 1, 1, h, tzinfo=utc)) for h in (0, 1, 21)]
    rows += [(200, dt.datetime(2020, 1, 1, 21, tzinfo=utc) + dt.timedelta(days=d)) for d in (3.5, 7.0)]
    rows += [(201, dt.datetime(2020, 1, 1, tzinfo=utc) + dt.timedelta(seconds=i)) for i in range(3000)] + [(None, dt.datetime(2020, 5, 1, tzinfo=utc))]
    table = spark.createDataFrame([(k, m.replace(tzinfo=None)) for k, m in rows], "k long, at timestamp")
    got = {r.k: (r.label, r.dates) for r in Se.infer_frequency(table, "at", ["k"]).collect()}
    assert set(got) == {k for k, _ in rows}
    for key in got:
        moments = [m for k, m in rows if k == key]
        assert got[key] == (brute_label(moments), len(set(moments))), key
    whole = Se.infer_frequency(table, "at").first()
    assert (whole.label, whole.dates) == (brute_label([m for _, m in rows]), len({m for _, m in rows}))
    assert Se.infer_frequency(table.limit(0), "at").count() == 0
