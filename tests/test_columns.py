import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablelens.functions import add_periods, format_period, parse_datetime, periods_between, safe_numeric
from tablelens.operators import columns as C
from tablelens.sources import activity, readers, writers


def test_standard_names_keep_one_pass_and_number_collisions():
    assert C.standard_names(["A  b", "a__b", "___", "x___y", "A-B"]) == ["a_b", "a_b_2", "column_3", "x__y", "a_b_3"]
    assert C.standard_names(["A  b", "__x__", "Total  Price ($)"], "snake") == ["a_b", "x", "total_price"]
    with pytest.raises(ValueError):
        C.standard_names(["a"], "camel")


def test_resolve_lists_all_missing_columns():
    assert C.resolve_columns(["order_key", "x"], ["Order Key", "x"]) == {"order_key": "Order Key", "x": "x"}
    with pytest.raises(ValueError, match="nope.*gone"):
        C.resolve_columns(["nope", "x", "gone"], ["x"])


def test_safe_numeric_reads_numbers_only(frame):
    rows = [(" 12.5 ",), ("1e3",), ("12d",), ("NaN",), ("Infinity",), ("",), (None,), ("1,000",), ("-.5",)]
    out = frame(rows, "t string").select(safe_numeric(F.col("t")).alias("n")).collect()
    assert [r.n for r in out] == [12.5, 1000.0, None, None, None, None, None, None, -0.5]


@pytest.mark.parametrize("text, expected", [
    ("2024-01-31 10:00:00", dt.datetime(2024, 1, 31, 10)),
    ("2024-01-31T10:00:00.250", dt.datetime(2024, 1, 31, 10, 0, 0, 250000)),
    ("1-2-2024", dt.datetime(2024, 2, 1)),
    ("01/31/2024", dt.datetime(2024, 1, 31)),
    ("jan 31, 2024", dt.datetime(2024, 1, 31)),
    ("January 31, 2024", dt.datetime(2024, 1, 31)),
    ("Jan-2024", dt.datetime(2024, 1, 1)),
    ("March 2024", dt.datetime(2024, 3, 1)),
    ("2024-07", dt.datetime(2024, 7, 1)),
    ("07-2024", dt.datetime(2024, 7, 1)),
    ("  2024/7/4 ", dt.datetime(2024, 7, 4)),
    ("31-31-2024", None), ("soon", None), ("2024-13-01", None),
])
def test_parse_datetime(frame, text, expected):
    assert frame([(text,)], "t string").select(parse_datetime(F.col("t"))).first()[0] == expected


def test_period_arithmetic(frame):
    table = frame([(dt.datetime(2023, 10, 1), "quarter", 2, dt.datetime(2024, 4, 1), "2023-Q4"),
                   (dt.datetime(2024, 1, 29), "week", 3, dt.datetime(2024, 2, 19), "Week of 2024-01-29"),
                   (dt.datetime(2024, 1, 1), "year", 1, dt.datetime(2025, 1, 1), "2024")],
                  "p timestamp, label string, n int, later timestamp, shown string")
    out = table.select(
        (add_periods(F.col("p"), F.col("label"), F.col("n")) == F.col("later")).alias("a"),
        (periods_between(F.col("p"), F.col("later"), F.col("label")) == F.col("n")).alias("b"),
        (format_period(F.col("p"), F.col("label")) == F.col("shown")).alias("c"),
    ).collect()
    assert all(row.a and row.b and row.c for row in out)


def test_from_records_and_guards(spark):
    rows = [{"a": 1, "b": " "}, {"a": 2.5, "c": True}]
    table = readers.from_records(spark, rows)
    assert table.columns == ["a", "b", "c"]
    assert [tuple(r) for r in table.orderBy("a").collect()] == [(1.0, None, None), (2.5, None, True)]
    with pytest.raises(ValueError):
        readers.from_records(spark, [])
    with pytest.raises(ValueError, match="table 2"):
        readers.stack_tables([spark.range(1), spark.range(1).toDF("x")])
    with pytest.raises(ValueError):
        readers.stack_tables([spark.range(1)], ["nope"])


def test_csv_export_quotes_only_where_needed(frame, tmp_path):
    place = str(tmp_path / "out")
    table = frame([("plain", 1), ('say "hi", ok', None)], "t string, n int").coalesce(1)
    writers.export_csv(table, place)
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text == 't,n\nplain,1\n"say ""hi"", ok",\n'


def test_csv_cells_that_do_not_fit_become_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2.5\n2,oops\n")
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), schema="k int, v double").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, 2.5), (2, None)]


def test_dataset_versions(frame, spark, tmp_path):
    place = str(tmp_path / "data")
    assert writers.write_dataset(frame([(1,)], "a int"), place) == 1
    assert writers.write_dataset(frame([(2,)], "a int"), place) == 2
    (tmp_path / "data" / "version=3").mkdir()  # a write that failed half-way
    assert writers.read_dataset(spark, place).first().a == 2
    assert writers.read_dataset(spark, place, 1).first().a == 1
    with pytest.raises(ValueError):
        writers.read_dataset(spark, place, 9)


def test_activity_guards(frame):
    with pytest.raises(ValueError):
        activity.activity_rows(frame([("x",)], "action string"))
    log = activity.activity_rows(frame([("x", "ok")], "action string, status string"))
    assert len(log.columns) == 18
    with pytest.raises(ValueError):
        activity.list_activities(log, limit=501)


def test_require_features_splits_rows(frame):
    table = frame([(1, "a"), (2, ""), (None, None)], "n int, t string")
    accepted, rejected = C.require_features(table, ["n", "t"])
    assert accepted.count() == 1
    assert sorted(r.missing_features for r in rejected.collect()) == [["n", "t"], ["t"]]
