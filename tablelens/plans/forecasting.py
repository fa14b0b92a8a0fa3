"""Forecast workflows: a prepared series in, backtest, metrics, future and diagnostics out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablelens.operators.forecast import (
    forecast_chart,
    forecast_metrics,
    forecast_points,
    forecast_summary,
    recommend_stat_models,
    residual_spread,
    stat_backtest,
    stat_future,
    with_spread,
)
from tablelens.operators.series import (
    holdout_split,
    prepare_series,
    series_history,
    series_profile,
    stationarity,
    training_summary,
)


def statistical_forecast(
    df: DataFrame,
    date: str,
    value: str,
    keys: Sequence[str] = (),
    horizon: int = 3,
    test_pct: int = 20,
    model: str = "sarima",
    freq: str | None = None,
) -> dict[str, DataFrame]:
    """Seasonal-heuristic forecast of one series, or of one series per key."""
    series, rejects = prepare_series(df, date, value, keys, freq)
    split = holdout_split(series, test_pct)
    spread = residual_spread(split, keys)
    test = forecast_points(with_spread(stat_backtest(split, model, keys), spread, keys), keys)
    future = forecast_points(with_spread(stat_future(series, horizon, model, keys), spread, keys), keys, "step")
    history = series_history(series, keys)
    profile, stationary = series_profile(series, keys), stationarity(series, keys)
    return {
        "history": history,
        "test": test,
        "future": future,
        "metrics": forecast_metrics(test, keys),
        "chart": forecast_chart(history, test, future, keys),
        "summary": forecast_summary(future, keys),
        "profile": profile,
        "stationarity": stationary,
        "training": training_summary(split, keys),
        "recommended": recommend_stat_models(profile, stationary, keys),
        "rejects": rejects,
    }
