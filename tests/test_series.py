import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.ml import forecasting as Mf
from tablelens.operators import forecast as Fc, series as Se
from tablelens.plans.forecasting import statistical_forecast


def monthly(spark, values, key="a", start=dt.datetime(2020, 1, 15)):
    rows = []
    for i, value in enumerate(values):
        month = start.month - 1 + i
        rows.append((key, dt.datetime(start.year + month // 12, month % 12 + 1, start.day), float(value)))
    return spark.createDataFrame(rows, "k string, at timestamp, v double")


@pytest.mark.parametrize("gaps, label", [
    ([1, 1, 60], "day"), ([2, 2.5], "week"), ([7, 7], "week"), ([1, 3], "day"), ([10, 11], "month"), ([31, 28], "month"),
    ([90], "quarter"), ([365, 366], "year"), ([], "month"),
])
def test_frequency_from_median_gap(spark, gaps, label):
    moment, rows = dt.datetime(2020, 1, 1, 7), []
    for gap in [0, *gaps]:
        moment += dt.timedelta(days=gap)
        rows.append((moment,))
    assert Se.infer_frequency(spark.createDataFrame(rows, "at timestamp"), "at").first().label == label


def test_gap_filling_keeps_the_sum(spark):
    table = monthly(spark, range(1, 30)).filter(F.month("at") != 3)
    series, rejects = Se.prepare_series(table, "at", "v", freq="month")
    rows = series.orderBy("position").collect()
    assert len(rows) == 29 and rejects.count() == 0
    assert sum(r.value for r in rows) == table.agg(F.sum("v")).first()[0]
    assert [r.value for r in rows if r.period.month == 3] == [0.0, 0.0, 0.0]
    assert rows[0].period == dt.datetime(2020, 1, 1)


def test_short_series_are_rejected(spark):
    with pytest.raises(ValueError, match="at least 6"):
        Se.prepare_series(monthly(spark, range(5)), "at", "v", freq="month")
    assert Se.prepare_series(monthly(spark, range(6)), "at", "v", freq="month")[0].count() == 6
    both = monthly(spark, range(5)).unionByName(monthly(spark, range(8), "b"))
    series, rejects = Se.prepare_series(both, "at", "v", ["k"], "month")
    assert {r.k for r in series.collect()} == {"b"}
    assert [(r.k, r.periods) for r in rejects.collect()] == [("a", 5)]
    with pytest.raises(ValueError, match="no valid rows"):
        Se.prepare_series(monthly(spark, [1]).filter("v > 5"), "at", "v")


def test_bounds_are_checked(spark):
    series, _ = Se.prepare_series(monthly(spark, range(12)), "at", "v", freq="month")
    for call in (
        lambda: Se.holdout_split(series, 5), lambda: Se.lag_features(series, 13), lambda: Fc.stat_future(series, 25),
        lambda: Se.holdout_split(series, 20, 25), lambda: Mf.ml_forecast(series, model_type="other"),
    ):
        with pytest.raises(ValueError):
            call()


def step(history, season, model):
    recent = np.mean(history[-3:])
    trend = np.mean(np.diff(history[-5:]))
    seasonal = history[-season] if season > 1 and len(history) >= season else recent
    weights = {"arima": (1, 0, 0.35), "prophet": (0.55, 0.45, 0.65), "sarima": (0.4, 0.6, 0.4)}[model]
    return max(0.0, weights[0] * recent + weights[1] * seasonal + weights[2] * trend)


@pytest.mark.parametrize("model", ["arima", "prophet", "sarima"])
@pytest.mark.parametrize("count", [6, 9, 30])
def test_recursive_forecast_by_hand(spark, model, count):
    values = [100 + 10 * math.sin(i) + i for i in range(count)]
    series, _ = Se.prepare_series(monthly(spark, values), "at", "v", freq="month")
    season = max(1, min(12, count // 2))
    history, expected = list(values), []
    for _ in range(5):
        expected.append(step(history, season, model))
        history.append(expected[-1])
    found = [r.prediction for r in Fc.stat_future(series, 5, model).orderBy("step").collect()]
    assert found == pytest.approx(expected)


def test_backtest_and_future_agree_on_the_first_step(spark):
    values = [50 + (i * 7) % 13 for i in range(24)]
    whole, _ = Se.prepare_series(monthly(spark, values), "at", "v", freq="month")
    split = Se.holdout_split(whole, 20)
    first = Fc.stat_backtest(split, "sarima").orderBy("position").first()
    head, _ = Se.prepare_series(monthly(spark, values[:first.position - 1]), "at", "v", freq="month")
    assert Fc.stat_future(head, 1, "sarima").first().prediction == pytest.approx(step(values[:first.position - 1], min(12, (first.position - 1) // 2), "sarima"))
    assert first.prediction == pytest.approx(step(values[:first.position - 1], 12, "sarima"))


def test_one_key_alone_equals_the_same_key_in_a_panel(spark):
    panel = monthly(spark, [5 + i % 4 for i in range(20)]).unionByName(monthly(spark, range(40), "b"))
    together = statistical_forecast(panel, "at", "v", ["k"], freq="month")
    alone = statistical_forecast(panel.filter("k = 'a'"), "at", "v", freq="month")
    for part in ("history", "test", "future", "metrics"):
        rows = together[part].filter("k = 'a'").drop("k")
        assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, alone[part].collect()), key=str)


def test_forecast_bounds_hold_the_prediction(spark):
    result = statistical_forecast(monthly(spark, [3, 9, 1, 7, 0, 4, 8, 2, 6, 5, 1, 9]), "at", "v", freq="month", horizon=24)
    for row in result["future"].collect():
        assert 0 <= row.lower <= row.predicted <= row.upper
    assert result["future"].count() == 24


def test_metrics_skip_zero_actuals_and_survive_empty_input(frame):
    points = frame([(0.0, 1.0), (4.0, 2.0)], "actual double, predicted double")
    row = Fc.forecast_metrics(points).first()
    assert (row.mae, row.rmse, row.mape) == (1.5, 1.58, 50.0)
    row = Fc.forecast_metrics(points.filter("actual > 9")).first()
    assert (row.mae, row.rmse, row.mape) == (0.0, 0.0, 0.0)


def test_stationarity_edges(spark):
    noise = np.random.default_rng(1).normal(size=60)
    series, _ = Se.prepare_series(monthly(spark, noise), "at", "v", freq="month")
    assert Se.stationarity(series).first().verdict == "stationary"
    walk, _ = Se.prepare_series(monthly(spark, np.cumsum(noise) + 100), "at", "v", freq="month")
    assert Se.stationarity(walk).first().p_value > 0.05
    flat, _ = Se.prepare_series(monthly(spark, [4.0] * 8), "at", "v", freq="month")
    assert Se.stationarity(flat).first().p_value == 1.0


def test_regression_forecast_follows_a_line(spark):
    series, _ = Se.prepare_series(monthly(spark, [10 + 3 * i for i in range(30)]), "at", "v", freq="month")
    result = Mf.regression_forecast(series, 4)
    assert [r.predicted for r in result["future"].orderBy("step").collect()] == pytest.approx([100, 103, 106, 109], abs=0.01)
    assert result["metrics"].first().mae == pytest.approx(0, abs=0.01)


def test_ridge_forecast_equals_closed_form(spark):
    values = [40 + 5 * (i % 6) + i for i in range(36)]
    series, _ = Se.prepare_series(monthly(spark, values), "at", "v", freq="month")
    points = Mf.ml_forecast(series, 1, model_type="ridge_regression", groups=["trend", "lags"])["points"]
    found = points.filter("part = 'future'").first().prediction
    x = np.array([[i + 1, values[i - 1], values[i - 2], values[i - 3]] for i in range(3, 36)], dtype=float)
    y = np.array(values[3:], dtype=float)
    centre = x.mean(axis=0)
    weights = np.linalg.solve((x - centre).T @ (x - centre) + np.eye(4), (x - centre).T @ (y - y.mean()))
    expected = (np.array([37, *values[:-4:-1]]) - centre) @ weights + y.mean()
    assert found == pytest.approx(expected, rel=1e-6)


def test_null_keys_stay_and_short_ones_are_rejected(spark):
    panel = monthly(spark, range(30)).unionByName(monthly(spark, [5 + i % 4 for i in range(30)], None)).unionByName(monthly(spark, range(6), "s"))
    series, _ = Se.prepare_series(panel, "at", "v", ["k"], "month")
    for result in (Mf.regression_forecast(series, 2, keys=["k"]), Mf.ml_forecast(series, 2, model_type="ridge_regression", keys=["k"])):
        found = {(r.k, r.part): r.n for r in result["points"].groupBy("k", "part").agg(F.count("*").alias("n")).collect()}
        assert found == {("a", "test"): 6, ("a", "future"): 2, (None, "test"): 6, (None, "future"): 2}
        assert [(r.k, r.periods) for r in result["rejects"].collect()] == [("s", 6)]
    chart = statistical_forecast(panel.filter("k IS NULL"), "at", "v", ["k"], freq="month")["chart"]
    assert chart.filter("k IS NULL AND backtest IS NOT NULL").count() == 6
    profile, fixed = Se.series_profile(series, ["k"]), Se.stationarity(series, ["k"])
    assert Fc.recommend_stat_models(profile, fixed, ["k"]).filter("k IS NULL").count() == 3
