import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import describe as S, distributions as D, profiling as P, quantiles as Q
from tablelens.operators.cleaning import drop_duplicates, impute
from tablelens.operators.ordering import bucket_edges, hash_rank, position_bucket, sample_systematic, with_row_index
from tablelens.plans.cleaning import clean


@pytest.fixture(scope="module")
def skewed(spark):
    generator = random.Random(5)
    values = [7.0] * 700 + [generator.expovariate(0.001) for _ in range(900)] + [-1e300, 1e300, 1e-300, 0.0]
    return values, spark.createDataFrame([(v,) for v in values], "v double")


@pytest.mark.parametrize("buffer", [1, 40, 10**6])
def test_quantiles_are_exact_whatever_fits_a_buffer(skewed, buffer):
    values, table = skewed
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = Q.quantiles(table, ["v"], shares, "lower", buffer_values=buffer)["v"]
    ordered = sorted(values)
    assert found == [ordered[int((len(ordered) - 1) * s)] for s in shares]
    linear = Q.quantiles(table, ["v"], [0.3], buffer_values=buffer)["v"][0]
    assert linear == pytest.approx(np.quantile(values, 0.3))


def test_quantiles_of_empty_and_constant_columns(frame):
    table = frame([(None, 3.0), (None, 3.0)], "a double, b double")
    assert Q.quantiles(table, ["a", "b"], [0.5], buffer_values=1) == {"a": [None], "b": [3.0]}


def test_row_index_is_dense_and_ordered_with_a_hot_key(spark):
    table = spark.range(9000).select(F.when(F.col("id") < 4000, 5).otherwise(F.col("id") % 50).alias("k"), F.lit("same").alias("t"))
    rows = with_row_index(table, ["k"]).orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(9000))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_sample_positions_match_linspace(spark):
    kept = sample_systematic(spark.range(1003).toDF("i"), 97, ["i"]).collect()
    assert sorted(r.i for r in kept) == [int(x) for x in np.linspace(0, 1002, 97, dtype=int)]


@pytest.mark.parametrize("rows, buckets", [(8, 8), (61, 60), (1000, 60), (7, 8)])
def test_position_buckets(spark, rows, buckets):
    edges = bucket_edges(rows, buckets)
    found = spark.range(rows).select("id", position_bucket(F.col("id"), edges).alias("b")).collect()
    assert all(edges[r.b] <= r.id < edges[r.b + 1] for r in found)


def test_hash_rank_is_a_permutation_per_group(spark):
    table = spark.range(3000).select("id", (F.col("id") % 3 == 0).alias("g"))
    rows = hash_rank(table, ["id"], 1, ["g"]).collect()
    for group in (True, False):
        ranks = sorted(r.hash_rank for r in rows if r.g is group)
        assert ranks == list(range(len(ranks)))
    again = hash_rank(table.repartition(5), ["id"], 1, ["g"]).collect()
    assert {(r.id, r.hash_rank) for r in rows} == {(r.id, r.hash_rank) for r in again}


def test_robust_outliers_need_twenty_values(frame):
    short = frame([(float(i),) for i in range(18)] + [(1e6,)], "v double")
    assert S.outliers_robust(short).first().status == "few_values"
    full = frame([(float(i),) for i in range(19)] + [(1e6,)], "v double")
    row = S.outliers_robust(full).first()
    assert (row.outliers, row.outlierRate, row.severity) == (1, 5.0, "high")
    flat = frame([(1.0,)] * 30 + [(float(i),) for i in range(7)], "v double")
    assert S.outliers_robust(flat).first().severity == "none"
    empty = frame([(None,)], "v double")
    assert S.outliers_robust(empty).first().status == "no_values"


def test_outliers_iqr_needs_eight_values(frame):
    assert S.outliers_iqr(frame([(float(i),) for i in range(7)], "v double")).count() == 0
    row = S.outliers_iqr(frame([(float(i % 5),) for i in range(40)] + [(99.0,)] * 3, "v double")).first()
    assert row.flagged and row.outliers == 3


def test_correlation_paths_agree_with_missing_and_constant_columns(spark):
    generator = random.Random(3)
    rows = []
    for _ in range(400):
        base = generator.gauss(1e6, 1)
        rows.append((base, base * 2 + generator.random(), None if generator.random() < 0.3 else generator.random(), 4.0, generator.random()))
    table = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    pairs = [(x, y) for i, x in enumerate("abcde") for y in "abcde"[i + 1:]]
    wide = {(r.x, r.y): (r.n, r.r) for r in S._pair_moments_matrix(table, list("abcde")).collect()}
    narrow = {}
    for x, y in pairs:
        both = table.filter(f"{x} IS NOT NULL AND {y} IS NOT NULL")
        narrow[x, y] = both.agg(F.count("*"), F.lit(None).cast("double") if "d" in (x, y) else F.corr(x, y)).first()
    assert wide.keys() == narrow.keys()
    for pair, (n, r) in narrow.items():
        assert wide[pair][0] == n
        assert (r is None) == (wide[pair][1] is None) == ("d" in pair)
        if r is not None:
            assert wide[pair][1] == pytest.approx(r, abs=1e-7)


def test_distinct_counts_agree_between_paths(frame, monkeypatch):
    table = frame(
        [(1, 1.5, "a", True, None), (2, float("nan"), "a", False, None), (1, 0.0, None, True, None), (3, -0.0, "", True, None)],
        "i int, d double, s string, b boolean, n string",
    )
    expected = {"i": 3, "d": 2, "s": 2, "b": 2, "n": 0}
    for limit in (0, 99):
        monkeypatch.setattr(P, "EXPAND_LIMIT", limit)
        assert {r.name: r.uniqueCount for r in P.distinct_counts(table, table.columns).collect()} == expected


def test_profile_skips_nested_columns_and_finds_identifiers(frame):
    table = frame([("a", [1]), ("b", None)], "s string, l array<int>")
    rows = {r.name: r for r in P.profile_columns(table).collect()}
    assert rows["s"].role == "identifier" and rows["s"].uniqueCount == 2
    assert rows["l"].nullCount == 1 and rows["l"].uniqueCount is None


def test_kde_integrates_to_one_and_ignores_constant_columns(spark):
    generator = random.Random(2)
    table = spark.createDataFrame([(generator.gauss(0, 1), 1.0) for _ in range(500)], "v double, flat double")
    points = D.kde(table, ["v", "flat"]).orderBy("point").collect()
    assert {p.column for p in points} == {"v"} and len(points) == 160
    step = points[1].x - points[0].x
    assert 0.9 < sum(p.density for p in points) * step <= 1.0
    plain = D.kde(table, "v", combine_equal=False).orderBy("point").collect()
    assert [p.density for p in plain] == pytest.approx([p.density for p in points])


def test_histogram_of_a_constant_column(frame):
    bars = D.histogram(frame([(2.0,)] * 5, "v double"), "v").collect()
    assert len(bars) == 12 and sum(b["count"] for b in bars) == 5


def test_missingness_without_gaps_is_empty(spark):
    assert D.missingness_matrix(spark.range(20), ["id"]).count() == 0


def test_no_findings_on_plain_data(spark):
    found = S.insights(spark.range(100).select((F.col("id") % 10).cast("double").alias("v"))).collect()
    assert [(r.position, r.kind, r.column) for r in found] == [(1, "none", None)]


def test_impute_rules(frame):
    table = frame([(1, "b", None, None), (2, "a", None, None), (None, None, None, None), (2, None, None, 1.0)],
                  "i int, s string, nothing string, d double")
    rows = impute(table).collect()
    assert [r.i for r in rows] == [1, 2, 2, 2]
    assert [r.s for r in rows] == ["b", "a", "a", "a"]  # smallest of equally frequent values
    assert {r.nothing for r in rows} == {"Unknown"}
    half = impute(frame([(1,), (2,), (None,)], "i int")).collect()
    assert sorted(r.i for r in half) == [1.0, 1.5, 2.0]


def test_clean_is_idempotent_and_logs_only_changes(frame):
    table = frame([("1", None, "2024-01-05"), ("1", None, "2024-01-05"), ("2", 4.0, "06-01-2024"), ("3", 5.0, "n/a")],
                  "`Row Id` string, v double, day string")
    first = clean(table)
    assert [(r.step, r.changed) for r in first.log.orderBy("position").collect()] == [
        ("names", 1), ("duplicates", 1), ("missing_values", 1), ("dates", 1),
    ]
    assert (first.rows_before, first.rows_after) == (4, 3)
    assert sorted(str(r.day) for r in first.table.collect()) == ["2024-01-05", "2024-01-06", "None"]
    kept = first.table.fillna("2024-01-09")
    again = clean(kept)
    assert sorted(map(tuple, again.table.collect())) == sorted(map(tuple, kept.collect()))
    assert [r.step for r in again.log.collect()] == ["dates"]
    assert clean(table, False, False, False, False).log.count() == 0


def test_drop_duplicates_needs_an_order(frame):
    table = frame([(1, 2), (1, 1)], "k int, v int")
    with pytest.raises(ValueError):
        drop_duplicates(table, ["k"])
    assert drop_duplicates(table, ["k"], ["v"]).collect() == [(1, 1)]


def test_large_numbers_keep_their_digits(frame):
    row = S.describe_numeric(frame([(10**17,), (10**18,), (-5 * 10**17,)], "v long")).first()
    assert (row.min, row.median, row.max) == (-5e17, 1e17, 1e18)


def test_dates_are_judged_on_all_rows(spark):
    late = F.when(F.col("id") < 50, "2024-01-05").otherwise("text")
    table = spark.range(500).select("id", late.alias("note"))
    assert clean(table).table.filter("note = 'text'").count() == 450


def test_csv_keeps_line_ends(frame, spark, tmp_path):
    from tablelens.sources import readers, writers

    table = frame([(1, 'a\nb "q", c'), (2, "c"), (3, None)], "i int, t string")
    writers.export_csv(table, f"{tmp_path}/csv")
    again = readers.read_csv(spark, f"{tmp_path}/csv", schema="i int, t string", multi_line=True)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, table.collect()))


def test_large_keys_of_many_orders(spark, tmp_path):
    import workbook

    workbook.load()
    keys = [5, 900_000, 923_000, 9_000_000, 922_337_203_685_477]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    row = workbook.QUERIES["describe_numeric_large_keys"](spark, str(tmp_path)).first()
    products = [float(k * 10**13) for k in keys]
    assert (row["column"], row["count"], row["min"], row["q1"], row["q3"], row["max"]) == ("snowflake", 5, products[0], products[1], products[3], products[4])
