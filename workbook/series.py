"""Period series and statistical forecasts, for one series and for one per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.functions import half_even
from tablelens.operators import forecast as Fc, series as Se
from tablelens.plans.forecasting import statistical_forecast
from workbook import query

KEYS = ["event_type"]

# monthly order value, and daily event value per type, gap-free, as the statements below read them
MONTHLY = (
    "s AS (SELECT m AS period, coalesce(v, 0.0) AS value, row_number() OVER (ORDER BY m) AS position, count(*) OVER () AS periods FROM "
    "(SELECT unnest(generate_series((SELECT min(date_trunc('month', o_orderdate)) FROM orders), (SELECT max(date_trunc('month', o_orderdate)) FROM orders), "
    "INTERVAL 1 MONTH)) AS m) LEFT JOIN (SELECT date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1) ON m = p)"
)
DAILY = (
    "d AS (SELECT event_type, date_trunc('day', ts) AS p, sum(value) AS v FROM events GROUP BY ALL), "
    "g AS (SELECT event_type, unnest(generate_series(min(p), max(p), INTERVAL 1 DAY)) AS m FROM d GROUP BY 1), "
    "s AS (SELECT g.event_type, m AS period, coalesce(v, 0.0) AS value, row_number() OVER (PARTITION BY g.event_type ORDER BY m) AS position, "
    "count(*) OVER (PARTITION BY g.event_type) AS periods FROM g LEFT JOIN d ON g.event_type = d.event_type AND m = p)"
)
# 20 % of the periods held out
SPLIT = "t AS (SELECT *, periods - least(greatest(round_even(periods * 0.2, 0), 1), greatest(periods - 4, 1))::INT AS train_periods FROM s)"




def daily(tables):
    return Se.prepare_series(tables.events, "ts", "value", KEYS, freq="day")[0]


def _frequency_sql(date: str, source: str, key: str | None = None) -> str:
    by, part = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    group = f"GROUP BY {key}" if key else ""
    return (
        f"WITH u AS (SELECT DISTINCT {by}{date} AS moment FROM {source}), "
        f"g AS (SELECT {by}moment, (epoch_us(moment) - epoch_us(lag(moment) OVER ({part}ORDER BY moment))) / 86400000000.0 AS gap FROM u) "
        f"SELECT {by}count(*) AS dates, CASE WHEN count(*) < 2 THEN 'month' WHEN median(gap) <= 2 THEN 'day' WHEN median(gap) <= 10 THEN 'week' "
        f"WHEN median(gap) <= 45 THEN 'month' WHEN median(gap) <= 120 THEN 'quarter' ELSE 'year' END AS label FROM g {group}"
    )


@query("infer_frequency", _frequency_sql("ts", "events", "event_type"))
def _(tables):
    return Se.infer_frequency(tables.events, "ts", KEYS)


@query("infer_frequency_month", _frequency_sql("m", "(SELECT o_orderpriority, date_trunc('quarter', o_orderdate) + INTERVAL 2 DAY AS m FROM orders UNION ALL SELECT o_orderpriority, date_trunc('month', o_orderdate) FROM orders)", "o_orderpriority"))
def _(tables):
    orders = tables.orders
    quarters = orders.select("o_orderpriority", (F.date_trunc("quarter", "o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("m"))
    months = orders.select("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("m"))
    return Se.infer_frequency(quarters.unionByName(months), "m", ["o_orderpriority"])


@query("resample_week", "SELECT l_returnflag, date_trunc('week', l_shipdate)::TIMESTAMP AS period, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY ALL")
def _(tables):
    weekly = Se.resample(tables.lineitem, "l_shipdate", "l_extendedprice", "week", ["l_returnflag"])
    return weekly.select("l_returnflag", F.col("period").cast("timestamp_ntz").alias("period"), F.round("value", 2).alias("value"))


@query("resample_quarter", "SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL")
def _(tables):
    rows = Se.resample(tables.orders, "o_orderdate", "o_totalprice", "quarter")
    return rows.select(F.col("period").cast("timestamp_ntz").alias("period"), F.round("value", 2).alias("value"))


@query(
    "fill_gaps",
    "WITH d AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), "
    "g AS (SELECT o_custkey, unnest(generate_series(min(p), max(p), INTERVAL 1 MONTH)) AS m FROM d GROUP BY 1) "
    "SELECT g.o_custkey, m::TIMESTAMP AS period, round(coalesce(v, 0), 2) AS value FROM g LEFT JOIN d ON m = p AND d.o_custkey = g.o_custkey",
)
def _(tables):
    monthly = Se.resample(tables.orders, "o_orderdate", "o_totalprice", "month", ["o_custkey"])
    filled = Se.fill_gaps(monthly, F.lit("month"), ["o_custkey"])
    return filled.select("o_custkey", F.col("period").cast("timestamp_ntz").alias("period"), F.round("value", 2).alias("value"))


@query("prepare_series", f"WITH {DAILY} SELECT event_type, 'day' AS label, period::TIMESTAMP AS period, round(value, 2) AS value, position, periods FROM s")
def _(tables):
    return daily(tables).withColumns({"period": F.col("period").cast("timestamp_ntz"), "value": F.round("value", 2)})


@query("prepare_series_inferred", _frequency_sql("o_orderdate", "orders").replace("SELECT count(*) AS dates, ", "SELECT ") + " ")
def _(tables):
    return Se.prepare_series(tables.orders, "o_orderdate", "o_totalprice")[0].select("label").distinct()


@query(
    "series_profile",
    f"WITH {DAILY} SELECT event_type, 'day' AS detected_frequency, count(*) AS usable_periods, round_even(stddev_pop(value) / abs(avg(value)), 4) AS volatility, "
    "round_even(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0 END), 4) AS zero_value_share FROM s GROUP BY event_type",
)
def _(tables):
    return Se.series_profile(daily(tables), KEYS)


@query(
    "season_length",
    f"WITH {DAILY} SELECT event_type, greatest(least(7, greatest(periods // 2, 1)), 1)::INT AS season FROM s GROUP BY ALL",
)
def _(tables):
    return daily(tables).select("event_type", Se.season_length(F.col("label"), F.col("periods")).alias("season")).distinct()


_ERF = "(1 / (1 + 0.3275911 * x))"
_TAIL = (
    f"({_ERF} * (0.254829592 + {_ERF} * (-0.284496736 + {_ERF} * (1.421413741 + {_ERF} * (-1.453152027 + {_ERF} * 1.061405429))))) * exp(-x * x)"
)


P_VALUE = (
    "l AS (SELECT event_type, value AS y, lag(value) OVER (PARTITION BY event_type ORDER BY position) AS b FROM s), "
    "r AS (SELECT event_type, count(*) AS n, count(b) AS m, regr_slope(y, b) AS slope, regr_sxx(y, b) AS sxx, regr_syy(y, b) AS syy, regr_sxy(y, b) AS sxy FROM l GROUP BY 1), "
    "z AS (SELECT event_type, abs((slope - 1) / sqrt(greatest((syy - slope * sxy) / greatest(m - 2, 1) / sxx, 1e-9))) / sqrt(2) AS x FROM r), "
    f"p AS (SELECT event_type, round_even(least(greatest({_TAIL}, 0), 1), 4) AS p_value FROM z)"
)


@query(
    "stationarity",
    f"WITH {DAILY}, {P_VALUE} "
    "SELECT event_type, p_value, CASE WHEN p_value < 0.05 THEN 'stationary' ELSE 'not_stationary' END AS verdict FROM p",
)
def _(tables):
    return Se.stationarity(daily(tables), KEYS)


@query("holdout_split", f"WITH {DAILY}, {SPLIT} SELECT event_type, position, train_periods, position > train_periods AS is_test FROM t")
def _(tables):
    return Se.holdout_split(daily(tables)).select("event_type", "position", "train_periods", "is_test")


@query(
    "effective_lags",
    f"WITH {DAILY}, {SPLIT} SELECT DISTINCT event_type, least(12, greatest(train_periods - 1, 1), greatest(periods - 2, 1))::INT AS lags FROM t",
)
def _(tables):
    split = Se.holdout_split(daily(tables))
    return split.select("event_type", Se.effective_lags(12, F.col("train_periods"), F.col("periods")).alias("lags")).distinct()


def _round_all(df, names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(
    "lag_features",
    f"WITH {DAILY}, w AS (SELECT event_type, position, position::DOUBLE AS trend_index, month(period)::DOUBLE AS month_number, quarter(period)::DOUBLE AS quarter_number, "
    "day(period)::DOUBLE AS day_of_month, isodow(period)::DOUBLE - 1 AS day_of_week, round(sin(2 * pi() * month(period) / 12), 4) AS month_sin, "
    "round(cos(2 * pi() * month(period) / 12), 4) AS month_cos, round(sin(2 * pi() * quarter(period) / 4), 4) AS quarter_sin, round(cos(2 * pi() * quarter(period) / 4), 4) AS quarter_cos, round(avg(value) OVER (o ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 4) AS lag_mean, "
    "round(avg(value) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS lag_last_3_mean, round(lag(value, 1) OVER o, 4) AS lag_1, "
    "round(lag(value, 2) OVER o, 4) AS lag_2, round(lag(value, 3) OVER o, 4) AS lag_3, round(lag(value, 4) OVER o, 4) AS lag_4 FROM s WINDOW o AS (PARTITION BY event_type ORDER BY position)) SELECT * FROM w WHERE position > 4",
)
def _(tables):
    names = ["trend_index", "month_number", "quarter_number", "day_of_month", "day_of_week", "month_sin", "month_cos", "quarter_sin", "quarter_cos", "lag_mean", "lag_last_3_mean", "lag_1", "lag_2", "lag_3", "lag_4"]
    features = Se.lag_features(daily(tables), 4, KEYS)
    return _round_all(features.select("event_type", "position", *names), names)


@query(
    "ml_features",
    f"WITH {DAILY}, w AS (SELECT event_type, position, position::DOUBLE AS trend_index, month(period)::DOUBLE AS month_number, quarter(period)::DOUBLE AS quarter_number, "
    "isodow(period)::DOUBLE - 1 AS weekday_number, CASE WHEN last_day(period) = period::DATE THEN 1.0 ELSE 0.0 END AS is_month_end, "
    "round(lag(value, 1) OVER o, 4) AS lag_1, round(lag(value, 2) OVER o, 4) AS lag_2, round(lag(value, 3) OVER o, 4) AS lag_3, "
    "round(avg(value) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS rolling_mean_3, round(avg(value) OVER (o ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 4) AS rolling_mean_6, "
    "round(stddev_pop(value) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS rolling_std_3 FROM s WINDOW o AS (PARTITION BY event_type ORDER BY position)) "
    "SELECT * FROM w WHERE position > 3",
)
def _(tables):
    names = Se.ml_feature_names(3)
    features = Se.ml_features(daily(tables), 3, keys=KEYS)
    return _round_all(features.select("event_type", "position", *names), names)


@query("series_history", f"WITH {DAILY} SELECT event_type, position, strftime(period, '%Y-%m-%d') AS period, round_even(value, 2) AS actual FROM s")
def _(tables):
    return Se.series_history(daily(tables), KEYS)


@query(
    "training_summary",
    f"WITH {DAILY}, {SPLIT} SELECT event_type, any_value(periods) AS total_periods, any_value(train_periods) AS train_periods, any_value(periods - train_periods) AS test_periods, "
    "round_even(any_value(train_periods) / any_value(periods) * 100, 1) AS train_percentage, round_even(any_value(periods - train_periods) / any_value(periods) * 100, 1) AS test_percentage, "
    "strftime(min(period), '%Y-%m-%d') AS train_start, strftime(max(period) FILTER (position <= train_periods), '%Y-%m-%d') AS train_end, "
    "strftime(min(period) FILTER (position > train_periods), '%Y-%m-%d') AS test_start, strftime(max(period), '%Y-%m-%d') AS test_end, "
    "strftime(max(period), '%Y-%m-%d') AS last_observed_period FROM t GROUP BY event_type",
)
def _(tables):
    return Se.training_summary(Se.holdout_split(daily(tables)), KEYS)


# ---------------------------------------------------------------- heuristic forecasts


def _step_sql(model: str, season: int, lag) -> str:
    recent, seasonal, trend = Fc.STEP_WEIGHTS[model]
    return (
        f"greatest({recent} * (({lag(1)} + {lag(2)} + {lag(3)}) / 3) + {seasonal} * {lag(season)} + {trend} * (({lag(1)} - {lag(5)}) / 4), 0)"
    )


def _backtest_cte(model: str, season: int) -> str:
    step = _step_sql(model, season, lambda k: f"lag(value, {k}) OVER o")
    return f"b AS (SELECT * FROM (SELECT *, {step} AS prediction FROM t WINDOW o AS (PARTITION BY event_type ORDER BY position)) WHERE position > train_periods)"


SPREAD = (
    "e AS (SELECT event_type, greatest(stddev_pop(step), stddev_pop(CASE WHEN position > train_periods - 4 THEN value END)) AS spread FROM "
    "(SELECT *, value - lag(value) OVER (PARTITION BY event_type ORDER BY position) AS step FROM t) WHERE position <= train_periods GROUP BY 1)"
)
BOUNDS = (
    "round_even(prediction, 2) AS predicted, round_even(greatest(prediction - 1.96 * spread, 0), 2) AS lower, "
    "round_even(greatest(prediction + 1.96 * spread, greatest(prediction - 1.96 * spread, 0)), 2) AS upper"
)


def _register_backtest(model: str) -> None:
    @query(f"stat_backtest_{model}", f"WITH {DAILY}, {SPLIT}, {_backtest_cte(model, 7)} SELECT event_type, position, round(prediction, 6) AS prediction FROM b")
    def _(tables):
        rows = Fc.stat_backtest(Se.holdout_split(daily(tables)), model, KEYS)
        return rows.select("event_type", "position", F.round("prediction", 6).alias("prediction"))


for _model in Fc.STEP_WEIGHTS:
    _register_backtest(_model)


def _future_sql(model: str, horizon: int, season: int, series: str, key: str | None) -> str:
    by = f"{key}, " if key else ""
    step = _step_sql(model, season, lambda k: f"h[len(h) - {k - 1}]")
    return (
        f"f AS (SELECT {by}0 AS step, list(value ORDER BY position) AS h FROM {series} {'GROUP BY ' + key if key else ''} UNION ALL "
        f"SELECT {by}step + 1, list_append(h, {step}) FROM f WHERE step < {horizon})"
    )


def _register_future(model: str) -> None:
    @query(
        f"stat_forecast_{model}",
        f"WITH RECURSIVE {DAILY}, {_future_sql(model, 6, 7, 's', 'event_type')} SELECT event_type, step, round(h[len(h)], 6) AS prediction FROM f WHERE step > 0",
    )
    def _(tables):
        rows = Fc.stat_future(daily(tables), 6, model, KEYS)
        return rows.select("event_type", "step", F.round("prediction", 6).alias("prediction"))


for _model in Fc.STEP_WEIGHTS:
    _register_future(_model)


@query("forecast_bounds", f"WITH {DAILY}, {SPLIT}, {_backtest_cte('sarima', 7)}, {SPREAD} SELECT event_type, position, {BOUNDS} FROM b JOIN e USING (event_type)")
def _(tables):
    split = Se.holdout_split(daily(tables))
    points = Fc.with_spread(Fc.stat_backtest(split, "sarima", KEYS), Fc.residual_spread(split, KEYS), KEYS)
    return points.select("event_type", "position", "predicted", "lower", "upper")


@query(
    "forecast_metrics",
    f"WITH {DAILY}, {SPLIT}, {_backtest_cte('sarima', 7)}, q AS (SELECT event_type, round_even(value, 2) AS a, round_even(prediction, 2) AS p FROM b) "
    "SELECT event_type, round_even(avg(abs(a - p)), 2) AS mae, round_even(sqrt(avg((a - p) * (a - p))), 2) AS rmse, "
    "round_even(coalesce(avg(abs((a - p) / NULLIF(a, 0))) * 100, 0), 2) AS mape FROM q GROUP BY 1",
)
def _(tables):
    split = Se.holdout_split(daily(tables))
    points = Fc.stat_backtest(split, "sarima", KEYS).select(
        "event_type", half_even(F.col("value"), 2).alias("actual"), half_even(F.col("prediction"), 2).alias("predicted")
    )
    return Fc.forecast_metrics(points, KEYS)


@query(
    "forecast_chart",
    f"WITH RECURSIVE {DAILY}, {SPLIT}, {_backtest_cte('sarima', 7)}, {SPREAD}, {_future_sql('sarima', 3, 7, 's', 'event_type')}, "
    f"x AS (SELECT event_type, position, {BOUNDS} FROM b JOIN e USING (event_type)), "
    f"y AS (SELECT event_type, step, {BOUNDS} FROM (SELECT event_type, step, h[len(h)] AS prediction FROM f WHERE step > 0) JOIN e USING (event_type)), "
    "c AS (SELECT s.event_type, strftime(period, '%Y-%m-%d') AS period, round_even(value, 2) AS actual, predicted AS backtest, NULL::DOUBLE AS forecast, lower, upper "
    "FROM s LEFT JOIN x ON s.event_type = x.event_type AND s.position = x.position UNION ALL "
    "SELECT y.event_type, strftime(m.last + to_days(step::INT), '%Y-%m-%d'), NULL, NULL, predicted, lower, upper FROM y JOIN (SELECT event_type, max(period) AS last FROM s GROUP BY 1) m ON y.event_type = m.event_type) "
    "SELECT *, CASE WHEN upper IS NOT NULL THEN round(greatest(upper - lower, 0), 4) END AS confidence_range FROM c",
)
def _(tables):
    chart = statistical_forecast(tables.events, "ts", "value", KEYS, freq="day")["chart"]
    return chart.withColumn("confidence_range", F.round("confidence_range", 4))


@query(
    "forecast_chart_null_key",
    f"WITH {DAILY}, {SPLIT} SELECT NULLIF(event_type, 'view') AS kind, count(CASE WHEN position > train_periods THEN 1 END) AS backtests, 3 AS ahead FROM t GROUP BY 1",
)
def _(tables):
    rows = tables.events.withColumn("kind", F.nullif("event_type", F.lit("view")))
    chart = statistical_forecast(rows, "ts", "value", ["kind"], freq="day")["chart"]
    return chart.groupBy("kind").agg(F.count("backtest").alias("backtests"), F.count("forecast").cast("int").alias("ahead"))


@query(
    "forecast_summary",
    f"WITH RECURSIVE {DAILY}, {_future_sql('sarima', 6, 7, 's', 'event_type')}, y AS (SELECT event_type, step, round_even(h[len(h)], 2) AS p FROM f WHERE step > 0) "
    "SELECT y.event_type, round(avg(p), 4) AS average, strftime(any_value(m.last) + to_days(arg_max(step, p * 1000 - step)::INT), '%Y-%m-%d') AS peak_period, max(p) AS peak "
    "FROM y JOIN (SELECT event_type, max(period) AS last FROM s GROUP BY 1) m ON y.event_type = m.event_type GROUP BY 1",
)
def _(tables):
    summary = statistical_forecast(tables.events, "ts", "value", KEYS, horizon=6, freq="day")["summary"]
    return summary.withColumn("average", F.round("average", 4))


@query(
    "recommend_forecaster",
    f"WITH {DAILY}, n AS (SELECT event_type, count(*) AS n FROM s GROUP BY 1), {P_VALUE} SELECT event_type, 'sarima' AS model_type, n >= 10 AS recommended FROM n UNION ALL "
    "SELECT event_type, 'prophet', n < 10 AND p_value >= 0.05 FROM n JOIN p USING (event_type) UNION ALL SELECT event_type, 'arima', p_value < 0.05 FROM p",
)
def _(tables):
    series = daily(tables)
    return Fc.recommend_stat_models(Se.series_profile(series, KEYS), Se.stationarity(series, KEYS), KEYS)


FLAGSHIP_SQL = (
    f"WITH RECURSIVE {MONTHLY}, {SPLIT}, e AS (SELECT greatest(stddev_pop(step), stddev_pop(CASE WHEN position > train_periods - 4 THEN value END)) AS spread FROM "
    "(SELECT *, value - lag(value) OVER (ORDER BY position) AS step FROM t) WHERE position <= train_periods), "
    f"{_future_sql('sarima', 3, 12, 's', None)}, y AS (SELECT step, h[len(h)] AS prediction FROM f WHERE step > 0) "
    f"SELECT step, strftime((SELECT max(period) FROM s) + to_months(step::INT), '%Y-%m') AS period, {BOUNDS} FROM y, e"
)


def flagship(tables):
    """Monthly order value, gap-filled, forecast three months ahead with bounds."""
    return statistical_forecast(tables.orders, "o_orderdate", "o_totalprice", freq="month")["future"]


query("monthly_revenue_forecast", FLAGSHIP_SQL)(flagship)
