"""Forecasts from fitted models: least squares per series, and learned models pooled over series."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelens.functions import add_periods, half_even
from tablelens.ml.estimators import FOREST_DEPTH, importance_rows
from tablelens.ml.trees import Ensemble, fit_boosting, fit_forest, from_spark
from tablelens.operators.columns import field_types, join_null_safe, ref
from tablelens.operators.forecast import forecast_metrics, forecast_points
from tablelens.operators.series import (
    FEATURE_GROUPS,
    check_bounds,
    holdout_split,
    lag_features,
    ml_feature_names,
    ml_features,
    series_history,
    training_summary,
)
from tablelens.session import reliable_checkpoint

FORECAST_MODELS = ("gradient_boosting", "random_forest", "ridge_regression")


# ---------------------------------------------------------------- least squares per series


def _split_usable(split: DataFrame, lags: int, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Series with at least 3 training rows after lagging, and the others (``keys…, periods``).

    Without keys a series that is too short is an error.
    """
    check_bounds("lag_periods", lags, 1, 12)
    enough = F.col("train_periods") - lags >= 3
    if not keys and not split.filter(enough).limit(1).count():
        raise ValueError("not enough history is available to train the forecasting model")
    short = split.filter(~enough).groupBy(*[ref(k) for k in keys]).agg(F.max("periods").alias("periods"))
    return split.filter(enough), short


def _lines(rows: DataFrame, lags: int, keys: Sequence[str]) -> DataFrame:
    """``(keys…, weights, level)``: the least-squares line of each series through its lag features."""
    types = field_types(rows)
    table = lag_features(rows, lags, keys)
    names = [c for c in table.columns if c not in rows.columns]
    named = "".join(f"`{k}` {types[k].simpleString()}, " for k in keys)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        design = frame[names].to_numpy(dtype=float)
        target, centre = frame["value"].to_numpy(dtype=float), design.mean(axis=0)
        weights = np.linalg.lstsq(design - centre, target - target.mean(), rcond=None)[0]
        line = {"weights": [weights.tolist()], "level": [float(target.mean() - centre @ weights)]}
        return pd.DataFrame({k: [frame[k].iloc[0]] for k in keys} | line)

    by = [ref(k) for k in keys] or [F.lit("all").alias("__one")]
    return table.groupBy(*by).applyInPandas(solve, f"{named}weights array<double>, level double")


def _lag_vector(past: Column, period: Column, position: Column, lags: int) -> Column:
    """The features of the period after ``past``, in the order of ``lag_features``."""
    month, quarter = F.month(period).cast("double"), F.quarter(period).cast("double")

    def mean(n: int) -> Column:
        cells = F.slice(past, F.greatest(F.size(past) - n + 1, F.lit(1)), n)
        return F.aggregate(cells, F.lit(0.0), lambda total, x: total + x) / F.size(cells)

    return F.array(
        position.cast("double"), month, quarter, F.dayofmonth(period).cast("double"), F.weekday(period).cast("double"),
        F.sin(month * (2 * np.pi / 12)), F.cos(month * (2 * np.pi / 12)), F.sin(quarter * (2 * np.pi / 4)),
        F.cos(quarter * (2 * np.pi / 4)), mean(lags), mean(3), *[F.element_at(past, -i) for i in range(1, lags + 1)],
    )


def _follow(start: DataFrame, lines: DataFrame, keys: Sequence[str], steps: Column, lags: int) -> DataFrame:
    """Recursive predictions of each line after ``(keys…, label, past, period, position)``: a fold over the last values."""
    state = join_null_safe(start, lines, keys) if keys else start.crossJoin(F.broadcast(lines))
    known = F.size("past")

    def step(past: Column, i: Column) -> Column:
        vector = _lag_vector(past, add_periods(F.col("period"), F.col("label"), i), F.col("position") + i, lags)
        line = F.aggregate(F.zip_with("weights", vector, lambda w, x: w * x), F.col("level"), lambda total, x: total + x)
        return F.concat(past, F.array(F.greatest(line, F.lit(0.0))))

    path = F.aggregate(F.sequence(F.lit(1), steps), F.col("past"), step)
    found = state.withColumn("__known", known).withColumn("__path", path)
    found = found.select(
        *[ref(k) for k in keys], "label", "period", "position",
        F.posexplode(F.slice("__path", F.col("__known") + 1, F.size("__path") - F.col("__known"))).alias("__at", "prediction"),
    )
    at = F.col("__at") + 1
    return found.select(
        *[ref(k) for k in keys], "label", at.alias("step"), (F.col("position") + at).cast("int").alias("position"),
        add_periods(F.col("period"), F.col("label"), at).alias("period"), "prediction",
    )


def regression_forecast(
    series: DataFrame, horizon: int = 3, lags: int = 3, keys: Sequence[str] = (), test_pct: int = 20,
    test_periods: int | None = None,
) -> dict[str, DataFrame]:
    """Least-squares forecast of each series from its own lag features, recursive over test and future.

    Spark makes the feature rows; one small solve per series gives its line, and the recursion is a fold over
    the series' last values, each series to its own length. Series with fewer than 3 training rows after
    lagging are listed in ``rejects``; without keys that is an error.
    """
    check_bounds("horizon", horizon, 1, 24)
    split, rejects = _split_usable(holdout_split(series, test_pct, test_periods), lags, keys)
    split = reliable_checkpoint(split)
    train, reach = split.filter(~F.col("is_test")), max(lags, 3)
    begin = _tail_state(train.withColumn("__end", F.col("train_periods")), keys, reach, F.max("periods").alias("periods"))
    tested = _follow(begin, _lines(train, lags, keys), keys, (F.col("periods") - F.col("position")).cast("int"), lags)
    actual = split.filter("is_test").select(*[ref(k) for k in keys], "position", "value")
    test = join_null_safe(tested, actual, [*keys, "position"]).withColumn("part", F.lit("test"))
    end = _tail_state(split.withColumn("__end", F.col("periods")), keys, reach)
    future = _follow(end, _lines(split, lags, keys), keys, F.lit(horizon), lags).withColumn("part", F.lit("future"))
    points = reliable_checkpoint(test.unionByName(future, allowMissingColumns=True))
    return _results(points, split, split, keys) | {"rejects": rejects}


def _results(points: DataFrame, series: DataFrame, split: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    rounded = points.withColumn("predicted", half_even(F.col("prediction"), 2))
    test = forecast_points(rounded.filter("part = 'test'"), keys)
    future = forecast_points(rounded.filter("part = 'future'").drop("value"), keys, "step")
    return {
        "points": points, "history": series_history(series, keys), "test": test, "future": future,
        "metrics": forecast_metrics(test, keys), "training": training_summary(split, keys),
    }


# ---------------------------------------------------------------- learned models


def _fit(model_type: str, rows: DataFrame, names: Sequence[str], parameters: Mapping[str, Any], seed: int) -> tuple[Predictor, np.ndarray]:
    """A function from a feature matrix to predictions, and the importance of each feature."""
    if model_type == "random_forest" and not set(parameters) - {"numTrees", "minInstancesPerNode"}:
        forest = fit_forest(rows, "value", parameters.get("numTrees", 160), parameters.get("minInstancesPerNode", 2), seed=seed)
        return Predictor(ensemble=forest), forest.importance(len(names))
    if model_type == "ridge_regression":
        facts = rows.agg(F.count("value").alias("n"), F.stddev_pop("value").alias("s")).first()
        penalty = (facts["s"] or 0.0) / max(facts["n"], 1)
        built = LinearRegression(labelCol="value", regParam=penalty, elasticNetParam=0.0, standardization=False)
        fitted = built.setParams(**parameters).fit(rows)
        weights = fitted.coefficients.toArray()
        return Predictor(weights=weights, level=fitted.intercept), np.abs(weights)
    if model_type == "gradient_boosting":
        unknown = set(parameters) - {"maxIter", "stepSize", "maxDepth", "minInstancesPerNode"}
        if unknown:
            raise ValueError(f"gradient_boosting has no parameters {sorted(unknown)}")
        boosted = fit_boosting(
            rows, None, "value", parameters.get("maxIter", 140), parameters.get("stepSize", 0.05), parameters.get("maxDepth", 3),
            parameters.get("minInstancesPerNode", 1), seed,
        )
        return Predictor(ensemble=boosted), boosted.importance(len(names), alike=False)
    built = RandomForestRegressor(
        labelCol="value", numTrees=160, minInstancesPerNode=2, maxDepth=FOREST_DEPTH, featureSubsetStrategy="all", seed=seed
    )
    fitted = built.setParams(**parameters).fit(rows)
    return Predictor(ensemble=from_spark(fitted, rows.sparkSession)), fitted.featureImportances.toArray()


@dataclass
class Predictor:
    """A fitted model inside the tasks: a line, or trees as flat arrays."""

    weights: np.ndarray | None = None
    level: float = 0.0
    ensemble: Ensemble | None = None

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return self.ensemble.evaluate(rows)[:, 0] if self.ensemble is not None else rows @ self.weights + self.level


CALENDAR = ("month_number", "quarter_number", "weekday_number", "is_month_end")


def _calendar(period: Column) -> Column:
    """The features of a period that no value changes, in the order of ``CALENDAR``."""
    month_end = F.when(F.to_date(period) == F.last_day(period), 1.0).otherwise(0.0)
    return F.array(F.month(period).cast("double"), F.quarter(period).cast("double"), F.weekday(period).cast("double"), month_end)


def _next_features(past: np.ndarray, calendar: np.ndarray, position: np.ndarray, names: Sequence[str]) -> np.ndarray:
    """Features of the period after each row of past values (right-aligned, NaN before the series)."""
    counted = ~np.isnan(past)

    def mean(n: int) -> np.ndarray:
        return np.nansum(past[:, -n:], axis=1) / np.maximum(counted[:, -n:].sum(axis=1), 1)

    columns = []
    for name in names:
        if name == "trend_index":
            columns.append(position.astype(float))
        elif name in CALENDAR:
            columns.append(calendar[:, CALENDAR.index(name)])
        elif name.startswith("lag_"):
            columns.append(past[:, -int(name[4:])])
        elif name.startswith("rolling_mean_"):
            columns.append(mean(int(name[13:])))
        else:
            level = mean(3)[:, None]
            spread = np.nansum((past[:, -3:] - level) ** 2, axis=1) / np.maximum(counted[:, -3:].sum(axis=1), 1)
            columns.append(np.sqrt(spread))
    return np.stack(columns, axis=1)


def _roll_forward(
    predictor: Predictor, start: DataFrame, keys: Sequence[str], steps: Column, lags: int, groups: Sequence[str]
) -> DataFrame:
    """Recursive predictions from ``(keys…, label, past, period, position)``, each series to its own length.

    The recursion runs inside the tasks, for all series of a batch at once; the model is sent there. However long
    the series, this is one job.
    """
    names, reach = ml_feature_names(lags, groups), max(lags, 6)
    sent = start.sparkSession.sparkContext.broadcast(predictor)
    ahead = F.transform(F.sequence(F.lit(1), steps), lambda i: add_periods(F.col("period"), F.col("label"), i))
    # the keys are carried as one column, so their names cannot clash
    state = start.where(steps > 0).select(
        F.struct(*[ref(k) for k in keys], "label").alias("key"), F.col("position").cast("int").alias("position"), "past", ahead.alias("ahead")
    )
    state = state.withColumn("calendar", F.flatten(F.transform("ahead", _calendar)))

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = sent.value
        for batch in batches:
            count = len(batch)
            if not count:
                continue
            lists, ahead = batch.column(2), batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            past = np.full((count, reach), np.nan)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes), sizes)
            past[np.repeat(np.arange(count), sizes), place] = lists.flatten().to_numpy()
            lengths = np.diff(ahead.offsets.to_numpy())
            first = np.cumsum(lengths) - lengths
            calendar = batch.column(4).flatten().to_numpy().reshape(-1, len(CALENDAR))
            origin = batch.column(1).to_numpy()
            found = np.zeros(int(lengths.sum()))
            for step in range(int(lengths.max())):
                rows = np.flatnonzero(lengths > step)
                at = first[rows] + step
                value = np.maximum(predict(_next_features(past[rows], calendar[at], origin[rows] + step + 1, names)), 0.0)
                found[at] = value
                past[rows] = np.concatenate([past[rows, 1:], value[:, None]], axis=1)
            owner = np.repeat(np.arange(count), lengths)
            step = (np.arange(len(found)) - first[owner] + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), pa.array(step), pa.array((origin[owner] + step).astype(np.int32)), ahead.flatten(), pa.array(found)],
                names=["key", "step", "position", "period", "prediction"],
            )

    kinds = {f.name: f.dataType for f in state.schema}
    made = T.StructType([
        T.StructField("key", kinds["key"]), T.StructField("step", T.IntegerType()), T.StructField("position", T.IntegerType()),
        T.StructField("period", kinds["ahead"].elementType), T.StructField("prediction", T.DoubleType()),
    ])
    rolled = state.mapInArrow(roll, made)
    return rolled.select(*[F.col("key").getField(k).alias(k) for k in [*keys, "label"]], "step", "position", "period", "prediction")


def _tail_state(series: DataFrame, keys: Sequence[str], reach: int, *more: Column) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda p: p["value"])
    return series.filter(F.col("position") > F.col("__end") - reach).groupBy(*[ref(k) for k in keys], "label").agg(
        ordered.alias("past"), F.max("period").alias("period"), F.max("position").alias("position"), *more
    )


def ml_forecast(
    series: DataFrame, horizon: int = 3, lags: int = 3, groups: Sequence[str] = FEATURE_GROUPS,
    model_type: str = "gradient_boosting", keys: Sequence[str] = (), test_pct: int = 20, seed: int = 42,
    parameters: Mapping[str, Any] | None = None,
) -> dict[str, DataFrame]:
    """Learned forecast: one model over all series, recursive backtest, refit on everything, future.

    ``parameters`` replace settings of the model, e.g. ``{"numTrees": 300}`` or ``{"maxDepth": 5}``; without a depth forests
    grow fully. The number of jobs does not depend on the lengths of series. Series with fewer than 3 training rows
    after lagging are listed in ``rejects`` and take no part; without keys that is an error.
    """
    check_bounds("horizon", horizon, 1, 24)
    if model_type not in FORECAST_MODELS:
        raise ValueError(f"model_type must be one of {FORECAST_MODELS}")
    names = ml_feature_names(lags, groups)
    if not names:
        raise ValueError(f"groups must name at least one of {FEATURE_GROUPS}")
    split, rejects = _split_usable(holdout_split(series, test_pct), lags, keys)
    split = reliable_checkpoint(split)
    series, reach = split.select(*series.columns), max(lags, 6)
    assembler = VectorAssembler(inputCols=names, outputCol="features")

    def fit(rows: DataFrame) -> tuple[Predictor, np.ndarray]:
        table = reliable_checkpoint(assembler.transform(ml_features(rows, lags, groups, keys)).select("features", "value"))
        return _fit(model_type, table, names, dict(parameters or {}), seed)

    train = split.filter(~F.col("is_test"))
    begin = _tail_state(train.withColumn("__end", F.col("train_periods")), keys, reach, F.max("periods").alias("periods"))
    predictor, _ = fit(train)
    tested = _roll_forward(predictor, begin, keys, (F.col("periods") - F.col("position")).cast("int"), lags, groups)
    actual = split.filter("is_test").select(*[ref(k) for k in keys], "position", "value")
    test = join_null_safe(tested, actual, [*keys, "position"]).withColumn("part", F.lit("test"))
    predictor, weights = fit(series)
    end = _tail_state(series.withColumn("__end", F.col("periods")), keys, reach)
    future = _roll_forward(predictor, end, keys, F.lit(horizon), lags, groups).withColumn("part", F.lit("future"))
    points = reliable_checkpoint(test.unionByName(future, allowMissingColumns=True))
    return _results(points, series, split, keys) | {
        "importance": importance_rows(weights.tolist(), names, series), "rejects": rejects,
    }
