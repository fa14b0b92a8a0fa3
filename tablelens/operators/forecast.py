"""Heuristic statistical forecasts, their bounds, errors and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.functions import add_periods, format_period, half_even
from tablelens.operators.columns import join_null_safe, ref
from tablelens.operators.series import _window, check_bounds, season_length

TAIL = 12  # longest look-back of a forecast step: one year of months
# fixed values: weights of (recent mean, seasonal value, trend) per model name
STEP_WEIGHTS = {"arima": (1.0, 0.0, 0.35), "prophet": (0.55, 0.45, 0.65), "sarima": (0.4, 0.6, 0.4)}


def stat_step(history: Column, season: Column, model: str) -> Column:
    """Next value from an array of past values: weighted recent level, season and trend, not below 0."""
    weight_recent, weight_season, weight_trend = STEP_WEIGHTS.get(model, STEP_WEIGHTS["sarima"])
    size = F.size(history)

    def last(n: int) -> Column:
        return F.slice(history, F.greatest(size - n + 1, F.lit(1)), n)

    recent = F.aggregate(last(3), F.lit(0.0), lambda total, x: total + x) / F.least(size, F.lit(3))
    slope = (F.element_at(history, -1) - F.element_at(last(5), 1)) / F.greatest(F.least(size, F.lit(5)) - 1, F.lit(1))
    seasonal = F.when((season > 1) & (size >= season), F.element_at(history, -season)).otherwise(recent)
    return F.greatest(weight_recent * recent + weight_season * seasonal + weight_trend * slope, F.lit(0.0))


def stat_backtest(split: DataFrame, model: str = "sarima", keys: Sequence[str] = ()) -> DataFrame:
    """One-step-ahead predictions over the test part; each step sees the actual values before it."""
    past = F.collect_list("value").over(_window(keys).rowsBetween(-TAIL, -1))
    stepped = split.withColumn("__past", past).filter("is_test")
    season = season_length(F.col("label"), F.col("periods"))
    return stepped.withColumn("prediction", stat_step(F.col("__past"), season, model)).drop("__past")


def stat_future(series: DataFrame, horizon: int, model: str = "sarima", keys: Sequence[str] = ()) -> DataFrame:
    """``horizon`` recursive predictions after each series: ``(keys…, label, step, period, prediction)``.

    Only the last values of a series enter, and the recursion is a fold over that short array.
    """
    check_bounds("horizon", horizon, 1, 24)
    by = [ref(k) for k in keys]
    tail = series.filter(F.col("position") > F.col("periods") - TAIL)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda point: point["value"])
    state = tail.groupBy(*by, "label", "periods").agg(ordered.alias("__past"), F.max("period").alias("__last"))
    season = season_length(F.col("label"), F.col("periods"))
    rolled = F.aggregate(
        F.sequence(F.lit(1), F.lit(horizon)),
        F.col("__past"),
        lambda past, _: F.concat(past, F.array(stat_step(past, season, model))),
    )
    steps = state.select(
        *by, "label", "__last", F.posexplode(F.slice(rolled, -horizon, horizon)).alias("__place", "prediction")
    )
    step = F.col("__place") + 1
    return steps.select(
        *by, "label", step.alias("step"), add_periods(F.col("__last"), F.col("label"), step).alias("period"), "prediction"
    )


def residual_spread(split: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys…, spread)``: the larger deviation of the training differences and of its last 4 values."""
    by = [ref(k) for k in keys]
    stepped = split.withColumn("__step", F.col("value") - F.lag("value").over(_window(keys)))
    train = stepped.filter(~F.col("is_test"))
    recent = F.when(F.col("position") > F.col("train_periods") - 4, F.col("value"))
    spread = F.greatest(F.coalesce(F.stddev_pop("__step"), F.lit(0.0)), F.stddev_pop(recent))
    return train.groupBy(*by).agg(spread.alias("spread"))


def forecast_bounds(prediction: Column, spread: Column) -> tuple[Column, Column]:
    """95 % band around a prediction, not below 0, to 2 decimals."""
    low = F.greatest(prediction - 1.96 * spread, F.lit(0.0))
    return half_even(low, 2), half_even(F.greatest(prediction + 1.96 * spread, low), 2)


def with_spread(points: DataFrame, spread: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Predictions with their rounded value and bounds."""
    if keys:
        condition = points[keys[0]].eqNullSafe(spread[keys[0]])
        for key in keys[1:]:
            condition = condition & points[key].eqNullSafe(spread[key])
        joined = points.join(spread, condition).select(*[points[c] for c in points.columns], "spread")
    else:
        joined = points.withColumn("spread", spread.select("spread").scalar())
    low, high = forecast_bounds(F.col("prediction"), F.col("spread"))
    return joined.withColumns({"predicted": half_even(F.col("prediction"), 2), "lower": low, "upper": high}).drop("spread")


def forecast_metrics(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys…, mae, rmse, mape)`` of ``actual`` against ``predicted``, 2 decimals, zeros when empty."""
    error = F.col("actual") - F.col("predicted")
    percent = F.when(F.col("actual") != 0, F.abs(F.try_divide(error, F.col("actual"))))
    return points.groupBy(*[ref(k) for k in keys]).agg(
        half_even(F.coalesce(F.avg(F.abs(error)), F.lit(0.0)), 2).alias("mae"),
        half_even(F.coalesce(F.sqrt(F.avg(error * error)), F.lit(0.0)), 2).alias("rmse"),
        half_even(F.coalesce(F.avg(percent) * 100, F.lit(0.0)), 2).alias("mape"),
    )


def forecast_points(points: DataFrame, keys: Sequence[str] = (), order: str = "position") -> DataFrame:
    """Presentation rows ``(keys…, order, period, actual?, predicted, lower?, upper?)``."""
    shown = {"period": format_period(F.col("period"), F.col("label"))}
    if "value" in points.columns:
        shown["actual"] = half_even(F.col("value"), 2)
    kept = [c for c in ("predicted", "lower", "upper") if c in points.columns]
    return points.select(
        *[ref(k) for k in keys], F.col(order), *[column.alias(name) for name, column in shown.items()], *kept
    )


def forecast_chart(history: DataFrame, test: DataFrame, future: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Chart rows: history with its backtest by period label, followed by the future points."""

    def bound(frame: DataFrame, name: str) -> Column:
        return F.col(name) if name in frame.columns else F.lit(None).cast("double")

    by = list(keys)
    backtest = test.select(
        *[ref(k) for k in by], "period", F.col("predicted").alias("backtest"),
        bound(test, "lower").alias("lower"), bound(test, "upper").alias("upper"),
    )
    past = join_null_safe(history.select(*[ref(k) for k in by], "period", "actual"), backtest, [*by, "period"], "left")
    ahead = future.select(
        *[ref(k) for k in by], "period", F.col("predicted").alias("forecast"),
        bound(future, "lower").alias("lower"), bound(future, "upper").alias("upper"),
    )
    rows = past.unionByName(ahead, allowMissingColumns=True)
    return rows.withColumn("confidence_range", F.when(F.col("upper").isNotNull() & F.col("lower").isNotNull(), F.greatest(F.col("upper") - F.col("lower"), F.lit(0.0))))


def forecast_summary(future: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys…, average, peak_period, peak)`` of the future points; the first of equal peaks."""
    first_peak = F.struct(F.col("predicted"), -F.col("step"))
    return future.groupBy(*[ref(k) for k in keys]).agg(
        F.avg("predicted").alias("average"),
        F.max_by("period", first_peak).alias("peak_period"),
        F.max("predicted").alias("peak"),
    )


def recommend_stat_models(profile: DataFrame, stationary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys…, model_type, recommended)`` for the three statistical models of each series."""
    by = list(keys)
    facts = join_null_safe(profile, stationary, by) if by else profile.withColumn("p_value", stationary.select("p_value").scalar())
    needed = F.when(F.col("detected_frequency") == "month", 12).when(F.col("detected_frequency") == "quarter", 8).otherwise(10)
    seasonal = F.col("usable_periods") >= needed
    choices = F.array(
        F.struct(F.lit("sarima").alias("model_type"), seasonal.alias("recommended")),
        F.struct(F.lit("prophet").alias("model_type"), (~seasonal & (F.col("p_value") >= 0.05)).alias("recommended")),
        F.struct(F.lit("arima").alias("model_type"), (F.col("p_value") < 0.05).alias("recommended")),
    )
    return facts.select(*[ref(k) for k in by], F.inline(choices))


def recommend_learned_model(feature_count: int) -> str:
    return "gradient_boosting" if feature_count >= 6 else "random_forest"
