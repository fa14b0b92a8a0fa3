"""Descriptive statistics, correlations, distributions, outliers and findings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablelens.operators import describe as S, distributions as D
from tablelens.operators.ordering import sample_systematic, with_row_index
from tablelens.plans.exploration import advanced_eda
from workbook import query
from workbook.fixtures import DIRTY_SQL, dirty_orders, union_all

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "gross", "flat"]
WIDE_SQL = "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * 1.1 + l_tax AS gross, 7.0::DOUBLE AS flat FROM lineitem)"


def wide_lines(tables):
    gross = F.col("l_extendedprice") * 1.1 + F.col("l_tax")
    return tables.lineitem.select(*MEASURES, gross.alias("gross"), F.lit(7.0).alias("flat"))


def _r2(value: str) -> str:
    return f"floor({value} * 100 + 0.5) / 100"


def _describe_sql(name: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS \"column\", count({name}) AS count, {_r2(f'avg({name})')} AS mean, {_r2(f'stddev_pop({name})')} AS std, "
        f"{_r2(f'min({name})')} AS min, {_r2(f'list_sort(list({name}))[floor((count({name}) - 1) * 0.25)::INT + 1]')} AS q1, "
        f"{_r2(f'quantile_cont({name}, 0.5)')} AS median, {_r2(f'list_sort(list({name}))[floor((count({name}) - 1) * 0.75)::INT + 1]')} AS q3, "
        f"{_r2(f'max({name})')} AS max FROM (SELECT {name}::DOUBLE AS {name} FROM {source} WHERE {name} IS NOT NULL)"
    )


@query("describe_numeric", union_all(_describe_sql(n, DIRTY_SQL) for n in ("o_orderkey", "o_totalprice")))
def _(tables):
    return S.describe_numeric(dirty_orders(tables))


@query("describe_numeric_lines", union_all(_describe_sql(n, "lineitem") for n in MEASURES))
def _(tables):
    return S.describe_numeric(tables.lineitem, MEASURES)


@query(
    "describe_numeric_large_keys",
    "SELECT 'snowflake' AS \"column\", count(*) AS count, min(v) AS min, list_sort(list(v))[floor((count(*) - 1) * 0.25)::INT + 1] AS q1, "
    "list_sort(list(v))[floor((count(*) - 1) * 0.75)::INT + 1] AS q3, max(v) AS max FROM "
    "(SELECT (o_orderkey * 10000000000000)::DOUBLE AS v FROM orders)",
)
def _(tables):
    # as decimals: products of keys beyond 922,337 pass the range of a long
    keys = tables.orders.select((F.col("o_orderkey").cast("decimal(20,0)") * 10000000000000).alias("snowflake"))
    return S.describe_numeric(keys).select("column", "count", "min", "q1", "q3", "max")


WIDE_COPIES = 45
_WIDE_NAMES = [f"w{i}" for i in range(WIDE_COPIES)]


def many_columns(tables):
    """45 numeric columns of lineitem; the last is a multiple of the one before."""
    price, place = F.col("l_extendedprice"), F.col("l_quantity")
    columns = [(price * (i + 1) + place * place * (100 - 7 * i)).alias(f"w{i}") for i in range(WIDE_COPIES - 1)]
    last = (price * (WIDE_COPIES - 1) + place * place * (100 - 7 * (WIDE_COPIES - 2))) * 2
    return tables.lineitem.select(*columns, last.alias(f"w{WIDE_COPIES - 1}"))


_WIDE_SQL = "(SELECT " + ", ".join(
    f"l_extendedprice * {i + 1} + l_quantity * l_quantity * {100 - 7 * i} AS w{i}" for i in range(WIDE_COPIES - 1)
) + f", (l_extendedprice * {WIDE_COPIES - 1} + l_quantity * l_quantity * {100 - 7 * (WIDE_COPIES - 2)}) * 2 AS w{WIDE_COPIES - 1} FROM lineitem)"


@query("skewness_flags_wide", "SELECT \"column\", n, round(skew, 6) AS skew, abs(skew) > 1 AS flagged FROM (" + union_all(
    f"SELECT '{n}' AS \"column\", count({n}) AS n, skewness({n}) AS skew FROM {_WIDE_SQL}" for n in _WIDE_NAMES
) + ")")
def _(tables):
    return S.skewness_flags(many_columns(tables)).select("column", "n", F.round("skew", 6).alias("skew"), "flagged")


@query("collinear_pairs_wide", "WITH t AS " + _WIDE_SQL + ", c AS (" + union_all(
    f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM t" for a, b in combinations(_WIDE_NAMES, 2)
) + ") SELECT x, y, round(r, 6) AS r FROM c WHERE abs(r) > 0.95")
def _(tables):
    return S.collinear_pairs(many_columns(tables)).withColumn("r", F.round("r", 6))


@query("describe_categorical", union_all(
    f"SELECT '{n}' AS \"column\", count({n}) AS count, count(DISTINCT {n}) AS \"unique\" FROM {DIRTY_SQL}"
    for n in ("o_orderstatus", "o_orderpriority")
))
def _(tables):
    return S.describe_categorical(dirty_orders(tables))


def _corr_sql(names, source) -> str:
    return union_all(
        f"SELECT '{a}' AS x, '{b}' AS y, {i} AS i, {j} AS j, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, "
        f"CASE WHEN stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) > 0 AND stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) > 0 "
        f"THEN corr({a}, {b}) END AS r FROM {source}"
        for (i, a), (j, b) in combinations(enumerate(names), 2)
    )


@query(
    "correlations",
    f"WITH c AS ({_corr_sql(WIDE, WIDE_SQL)}) SELECT x || ' vs ' || y AS pair, x, y, {_r2('r')} AS correlation FROM c WHERE r IS NOT NULL",
)
def _(tables):
    return S.correlations(wide_lines(tables))


GAPPY = ["o_totalprice", "day_of_year", "month_number"]
GAPPY_SQL = f"(SELECT o_totalprice, dayofyear(o_orderdate) AS day_of_year, CASE WHEN o_orderstatus IS NULL THEN NULL ELSE month(o_orderdate) END AS month_number FROM {DIRTY_SQL})"


@query(
    "correlations_missing_cells",
    f"WITH c AS ({_corr_sql(GAPPY, GAPPY_SQL)}) SELECT x, y, n, round(r, 6) AS r FROM c",
)
def _(tables):
    table = dirty_orders(tables).select(
        "o_totalprice", F.dayofyear("o_orderdate").alias("day_of_year"),
        F.when(F.col("o_orderstatus").isNotNull(), F.month("o_orderdate")).alias("month_number"),
    )
    return S.pair_correlations(table).withColumn("r", F.round("r", 6))


_MATRIX = WIDE[1:]


@query(
    "correlation_matrix",
    f"WITH c AS ({_corr_sql(_MATRIX, WIDE_SQL)}), v AS (SELECT x, y, coalesce(floor(r * 1000 + 0.5) / 1000, 0.0) AS value FROM c) "
    f"SELECT x, y, value FROM v UNION ALL SELECT y, x, value FROM v UNION ALL "
    + union_all(f"SELECT '{n}', '{n}', 1.0" for n in _MATRIX),
)
def _(tables):
    return S.correlation_matrix(wide_lines(tables), _MATRIX)


@query("collinear_pairs", f"WITH c AS ({_corr_sql(WIDE, WIDE_SQL)}) SELECT x, y, round(r, 6) AS r FROM c WHERE abs(r) > 0.95")
def _(tables):
    return S.collinear_pairs(wide_lines(tables)).withColumn("r", F.round("r", 6))


def _lower(name: str, share: float) -> str:
    return f"list_sort(list({name}))[floor((count({name}) - 1) * {share})::INT + 1]"


def _robust_sql(name: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS \"column\", {_r2('min(low)')} AS \"lowerBound\", {_r2('min(high)')} AS \"upperBound\", "
        f"count(CASE WHEN ok AND (v < low OR v > high) AND abs(0.6745 * (v - m)) / mad >= 3.5 THEN 1 END) AS outliers, count(*) AS \"sampleSize\" "
        f"FROM (SELECT v, m, mad, ok, q1 - f * iqr AS low, q3 + f * iqr AS high FROM ("
        f"SELECT v, m, q1, q3, q3 - q1 AS iqr, mad, d > 5 AND q3 > q1 AND mad > 0 AS ok, CASE WHEN d > 5 AND q3 > q1 AND mad > 0 THEN 2.2 ELSE 1.5 END AS f FROM ("
        f"SELECT v, m, q1, q3, d, quantile_cont(abs(v - m), 0.5) OVER () AS mad FROM (SELECT {name}::DOUBLE AS v FROM {source}) CROSS JOIN ("
        f"SELECT quantile_cont({name}::DOUBLE, 0.5) AS m, {_r2(_lower(name, 0.25))} AS q1, {_r2(_lower(name, 0.75))} AS q3, count(DISTINCT round({name}, 8)) AS d FROM {source}))))"
    )


@query(
    "outliers_robust",
    f"WITH o AS ({union_all([_robust_sql('value', 'events'), _robust_sql('user_id', 'events')])}), r AS (SELECT *, "
    f"floor(outliers * 1000.0 / \"sampleSize\" + 0.5) / 10 AS \"outlierRate\" FROM o) SELECT *, CASE WHEN \"outlierRate\" >= 5 THEN 'high' "
    f"WHEN \"outlierRate\" >= 2 THEN 'moderate' WHEN \"outlierRate\" > 0 THEN 'low' ELSE 'none' END AS severity, 'screened' AS status FROM r",
)
def _(tables):
    return S.outliers_robust(tables.events, ["value", "user_id"])


@query("outliers_robust_discrete", _robust_sql("l_linenumber", "(SELECT l_linenumber FROM lineitem)") + " UNION ALL " + _robust_sql("few", "(SELECT CASE WHEN l_quantity > 40 THEN 4 WHEN l_quantity > 20 THEN 2 ELSE 1 END AS few FROM lineitem)"))
def _(tables):
    few = F.when(F.col("l_quantity") > 40, 4).when(F.col("l_quantity") > 20, 2).otherwise(1)
    table = tables.lineitem.select("l_linenumber", few.alias("few"))
    return S.outliers_robust(table).select("column", "lowerBound", "upperBound", "outliers", "sampleSize")


def _iqr_sql(name: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS \"column\", count(*) AS n, count(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers "
        f"FROM (SELECT {name}::DOUBLE AS v FROM {source}) CROSS JOIN (SELECT quantile_cont({name}::DOUBLE, 0.25) AS q1, quantile_cont({name}::DOUBLE, 0.75) AS q3 FROM {source})"
    )


@query(
    "outliers_iqr",
    f"WITH o AS ({union_all(_iqr_sql(n, 'events') for n in ('event_id', 'user_id', 'value'))}) "
    f"SELECT *, outliers >= greatest(3, floor(n * 0.01)) AS flagged FROM o",
)
def _(tables):
    return S.outliers_iqr(tables.events).drop("lower", "upper")


@query("skewness_flags", union_all(
    f"SELECT '{n}' AS \"column\", count({n}) AS n, round(skewness({n}), 6) AS skew, abs(skewness({n})) > 1 AS flagged FROM events"
    for n in ("event_id", "user_id", "value")
))
def _(tables):
    return S.skewness_flags(tables.events).select("column", "n", F.round("skew", 6).alias("skew"), "flagged")


FINDINGS = ["event_id", "user_id", "value", "double_value"]
FINDINGS_SQL = "(SELECT event_id, user_id, value, value * 2.0 + user_id * 0.001 AS double_value FROM events)"


@query(
    "insights",
    "WITH m AS (" + union_all(
        [f"SELECT 1 AS part, {i} AS a, 0 AS b, 'skewed' AS kind, '{n}' AS \"column\", NULL AS other, skewness({n}) AS value "
         f"FROM {FINDINGS_SQL} HAVING abs(skewness({n})) > 1" for i, n in enumerate(FINDINGS)]
        + [f"SELECT 2, {i}, {j}, 'collinear', '{a}', '{b}', corr({a}, {b}) "
           f"FROM {FINDINGS_SQL} HAVING abs(corr({a}, {b})) > 0.95" for (i, a), (j, b) in combinations(enumerate(FINDINGS), 2)]
        + [f"SELECT 3, {i}, 0, 'outliers', '{n}', NULL, outliers FROM ({_iqr_sql(n, FINDINGS_SQL)}) WHERE outliers >= greatest(3, floor(n * 0.01))"
           for i, n in enumerate(FINDINGS)]
    ) + ") SELECT row_number() OVER (ORDER BY part, a, b) AS position, kind, \"column\", other, round(value, 6) AS value FROM m",
)
def _(tables):
    double = F.col("value") * 2.0 + F.col("user_id") * 0.001
    found = S.insights(tables.events.select("event_id", "user_id", "value", double.alias("double_value")))
    return found.withColumn("value", F.round("value", 6))


@query("ols_trend", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*) AS n FROM lineitem")
def _(tables):
    fit, _ = S.ols_trend(tables.lineitem, "l_quantity", "l_extendedprice")
    return fit.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query(
    "ols_trend_line",
    "WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) "
    "SELECT p::INT AS place, round(lo + p * (hi - lo) / 99, 6) AS x, round(s * (lo + p * (hi - lo) / 99) + i, 4) AS y FROM f, range(100) t(p)",
)
def _(tables):
    _, line = S.ols_trend(tables.lineitem, "l_quantity", "l_extendedprice")
    return line.select("place", F.round("x", 6).alias("x"), F.round("y", 4).alias("y"))


@query("interaction_points", "SELECT o_totalprice AS x, o_orderkey::DOUBLE AS y FROM " + DIRTY_SQL + " WHERE o_totalprice IS NOT NULL")
def _(tables):
    return S.interaction_points(dirty_orders(tables), "o_totalprice", "o_orderkey")


def _id_sql(name: str, text: bool, source: str) -> str:
    value = f"NULLIF(trim({name}), '')" if text else name
    valued = f"count(DISTINCT {value}) >= 50 AND count(DISTINCT {value}) / greatest(count({value}), 1) >= " + (
        f"0.85 AND avg(length({value})) >= 8" if text else "0.98"
    )
    return (
        f"SELECT '{name}' AS \"column\", count({value}) AS n, count(DISTINCT {value}) AS \"unique\", "
        f"regexp_matches('{name}', '(^|_)(id|uuid|guid|token|hash|key|session)(_|$)') OR ({valued}) AS identifier FROM {source}"
    )


@query("identifier_like", union_all(
    [_id_sql(n, False, "customer") for n in ("c_custkey", "c_nationkey", "c_acctbal")] + [_id_sql(n, True, "customer") for n in ("c_name", "c_mktsegment")]
))
def _(tables):
    return S.identifier_like(tables.customer).drop("position")


TRENDS = ["l_quantity", "l_discount", "l_tax", "gross", "net"]
TRENDS_SQL = "(SELECT l_quantity, l_discount, l_tax, l_quantity * 3 + l_tax AS gross, l_quantity * 2 - l_discount * 100 AS net FROM lineitem)"


@query(
    "top_interactions",
    "WITH c AS (" + union_all(
        f"SELECT '{a} vs {b}' AS pair, corr({a}, {b}) AS r, count(*) AS n, regr_slope({b}, {a}) AS slope, regr_intercept({b}, {a}) AS intercept FROM {TRENDS_SQL}"
        for a, b in combinations(TRENDS, 2)
    ) + ") SELECT pair, round(r, 4) AS correlation, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM c ORDER BY abs(r) DESC LIMIT 3",
)
def _(tables):
    table = tables.lineitem.select(
        "l_quantity", "l_discount", "l_tax", (F.col("l_quantity") * 3 + F.col("l_tax")).alias("gross"),
        (F.col("l_quantity") * 2 - F.col("l_discount") * 100).alias("net"),
    )
    found = S.top_interactions(table)
    return found.select("pair", F.round("correlation", 4).alias("correlation"), "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


# ---------------------------------------------------------------- distributions


def _missing_sql(names: list[str]) -> str:
    return (
        f"WITH t AS (SELECT *, row_number() OVER (ORDER BY o_orderkey, o_orderdate) - 1 AS i, count(*) OVER () AS n FROM {DIRTY_SQL}), "
        f"b AS (SELECT *, floor((i + 1) * 60 / n - 1e-12)::INT AS bucket FROM t) "
        + union_all(
            f"SELECT bucket, '{name}' AS \"column\", round_even(avg(CASE WHEN {name} IS NULL THEN 100.0 ELSE 0 END), 2) AS missing_percent FROM b GROUP BY bucket"
            for name in names
        )
    )


@query("missingness_matrix", _missing_sql(["o_orderstatus", "o_totalprice", "o_orderpriority"]))
def _(tables):
    return D.missingness_matrix(dirty_orders(tables), ["o_orderkey", "o_orderdate"]).drop("label")


@query("total_missing", f"SELECT count(*) * 3 - count(o_orderstatus) - count(o_totalprice) - count(o_orderpriority) AS total_missing FROM {DIRTY_SQL}")
def _(tables):
    return D.total_missing(dirty_orders(tables))


def _hist_sql(name: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS \"column\", g.bin::INT AS bin, round(lo + g.bin * w, 6) AS low, count(v) AS count, round(count(v) / (n * w), 9) AS density "
        f"FROM (SELECT count(v) AS n, min(v) AS lo, (max(v) - min(v)) / b AS w, b FROM (SELECT {name} AS v FROM {source}) CROSS JOIN "
        f"(SELECT least(40, greatest(12, floor(sqrt(count({name})))))::INT AS b FROM {source}) GROUP BY b) s CROSS JOIN range(s.b) g(bin) "
        f"LEFT JOIN (SELECT {name} AS v FROM {source}) x ON least(floor((x.v - s.lo) / s.w), s.b - 1) = g.bin GROUP BY g.bin, lo, w, n"
    )


@query("histogram", union_all(_hist_sql(n, "lineitem") for n in ("l_quantity", "l_extendedprice")))
def _(tables):
    bars = D.histogram(tables.lineitem, ["l_quantity", "l_extendedprice"])
    return bars.select("column", "bin", F.round("low", 6).alias("low"), "count", F.round("density", 9).alias("density"))


@query(
    "kde",
    "WITH s AS (SELECT count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, 1.06 * stddev_pop(l_quantity) * power(count(*), -0.2) AS h FROM lineitem), "
    "v AS (SELECT l_quantity AS v, count(*) AS c FROM lineitem GROUP BY 1) "
    "SELECT 'l_quantity' AS \"column\", p::INT AS point, round(lo + p * (hi - lo) / 159, 6) AS x, "
    "round(sum(c * exp(-0.5 * power((lo + p * (hi - lo) / 159 - v) / h, 2))) / (n * h * sqrt(2 * pi())), 9) AS density "
    "FROM v, s, range(160) g(p) GROUP BY p, lo, hi, n, h",
)
def _(tables):
    curve = D.kde(tables.lineitem, "l_quantity")
    return curve.select("column", "point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


def _box_sql(name: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS \"column\", count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3, "
        f"min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END) AS whisker_low, max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_high, "
        f"count(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END) AS fliers FROM (SELECT {name} AS v FROM {source}) CROSS JOIN "
        f"(SELECT quantile_cont({name}, 0.25) AS q1, quantile_cont({name}, 0.5) AS q2, quantile_cont({name}, 0.75) AS q3 FROM {source}) GROUP BY q1, q2, q3"
    )


@query("box_stats", union_all([_box_sql("value", "events")]))
def _(tables):
    box = D.box_stats(tables.events, "value")
    rounded = [F.round(c, 4).alias(c) for c in ("mean", "sd", "q1", "median", "q3")]
    return box.select("column", "n", *rounded, "whisker_low", "whisker_high", "fliers")


@query("distributions", "SELECT \"column\", sum(count)::BIGINT AS n FROM (" + union_all(_hist_sql(n, "lineitem") for n in MEASURES) + ") GROUP BY 1")
def _(tables):
    parts = D.distributions(tables.lineitem.select(*MEASURES))
    return parts["histogram"].groupBy("column").agg(F.sum("count").alias("n")).join(parts["box"].select("column"), "column")


def _kde_sql(name: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS \"column\", p::INT AS point, sum(c * exp(-0.5 * power((lo + p * (hi - lo) / 159 - v) / h, 2))) / (n * h * sqrt(2 * pi())) AS density "
        f"FROM (SELECT {name} AS v, count(*) AS c FROM {source} WHERE {name} IS NOT NULL GROUP BY 1), (SELECT count({name}) AS n, min({name}) AS lo, max({name}) AS hi, "
        f"1.06 * stddev_pop({name}) * power(count({name}), -0.2) AS h FROM {source}), range(160) g(p) GROUP BY p, n, h"
    )


@query("distributions_parts", union_all([
    "SELECT 'histogram' AS part, bin AS place, round(density, 9) AS number FROM (" + _hist_sql("value", "events") + ")",
    "SELECT 'kde', point, round(density, 9) FROM (" + _kde_sql("value", "events") + ")",
    "SELECT 'box', 0, round(median, 4) FROM (" + _box_sql("value", "events") + ")",
]))
def _(tables):
    parts = D.distributions(tables.events.select("value"))
    return (
        parts["histogram"].select(F.lit("histogram").alias("part"), F.col("bin").alias("place"), F.round("density", 9).alias("number"))
        .union(parts["kde"].select(F.lit("kde"), "point", F.round("density", 9)))
        .union(parts["box"].select(F.lit("box"), F.lit(0), F.round("median", 4)))
    )


LABEL = "CASE WHEN {0} IS NULL THEN 'Missing' WHEN trim({0}) = '' THEN '(blank)' ELSE {0} END"


@query("top_categories", union_all(
    f"SELECT '{n}' AS \"column\", label, count, distinct_labels, place FROM (SELECT label, count, count(*) OVER () AS distinct_labels, "
    f"row_number() OVER (ORDER BY count DESC, label) AS place FROM (SELECT {LABEL.format(n)} AS label, count(*) AS count FROM {DIRTY_SQL} GROUP BY 1)) WHERE place <= 10"
    for n in ("o_orderstatus", "o_orderpriority")
))
def _(tables):
    return D.top_categories(dirty_orders(tables), ["o_orderstatus", "o_orderpriority"])


@query("high_cardinality", union_all(
    f"SELECT '{n}' AS \"column\", count(DISTINCT {n}) AS unique_count FROM part HAVING count(DISTINCT {n}) > 20" for n in ("p_name", "p_brand", "p_type")
))
def _(tables):
    return D.high_cardinality(tables.part).drop("position")


# ---------------------------------------------------------------- positions


@query("row_index", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS row_index FROM events")
def _(tables):
    return with_row_index(tables.events.select("value", "event_id"), ["value", "event_id"]).select("event_id", "row_index")


@query(
    "sample_systematic",
    "WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) "
    "SELECT o_orderkey FROM t WHERE i IN (SELECT floor(k * ((SELECT count(*) FROM orders) - 1) / 999.0)::BIGINT FROM range(1000) r(k))",
)
def _(tables):
    table = tables.orders.select("o_orderkey", "o_totalprice")
    return sample_systematic(table, 1000, ["o_totalprice", "o_orderkey"]).select("o_orderkey")


@query(
    "sample_systematic_step",
    "WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) "
    "SELECT o_orderkey FROM t WHERE i % floor(n / 1000)::BIGINT = 0 AND i / floor(n / 1000)::BIGINT < 1000",
)
def _(tables):
    table = tables.orders.select("o_orderkey", "o_totalprice")
    return sample_systematic(table, 1000, ["o_totalprice", "o_orderkey"], "step").select("o_orderkey")


_EDA_NUMBERS, _EDA_TEXT = ("o_orderkey", "o_totalprice"), ("o_orderstatus", "o_orderpriority")


@query("advanced_eda", union_all([
    f"SELECT 'total_missing' AS section, '' AS name, (count(*) * 3 - count(o_orderstatus) - count(o_totalprice) - count(o_orderpriority))::DOUBLE AS number FROM {DIRTY_SQL}",
    "SELECT 'missingness', \"column\" || ':' || bucket, missing_percent FROM (" + _missing_sql(["o_orderstatus", "o_totalprice", "o_orderpriority"]) + ")",
    "SELECT 'histogram', \"column\" || ':' || bin, count::DOUBLE FROM (" + union_all(_hist_sql(n, DIRTY_SQL) for n in _EDA_NUMBERS) + ")",
    "SELECT 'box', \"column\", median FROM (" + union_all(_box_sql(n, DIRTY_SQL) for n in _EDA_NUMBERS) + ")",
    "SELECT 'kde', \"column\" || ':' || point, round(density * 1000, 6) FROM (" + union_all(_kde_sql(n, DIRTY_SQL) for n in _EDA_NUMBERS) + ")",
    *[f"SELECT 'categories', '{n}:' || {LABEL.format(n)}, count(*)::DOUBLE FROM {DIRTY_SQL} GROUP BY 2" for n in _EDA_TEXT],
]))
def _(tables):
    """The rows of the sections of the whole analysis, one number each."""
    found = advanced_eda(dirty_orders(tables), ["o_orderkey", "o_orderdate"])
    name = lambda *parts: F.concat_ws(":", *parts).alias("name")
    rows = [
        found["total_missing"].select(F.lit("total_missing").alias("section"), F.lit("").alias("name"), F.col("total_missing").cast("double").alias("number")),
        found["missingness"].select(F.lit("missingness"), name("column", "bucket"), F.col("missing_percent")),
        found["distribution_histogram"].select(F.lit("histogram"), name("column", "bin"), F.col("count").cast("double")),
        found["distribution_box"].select(F.lit("box"), name("column"), F.round("median", 4)),
        found["distribution_kde"].select(F.lit("kde"), name("column", "point"), F.round(F.col("density") * 1000, 6)),
        found["categories"].select(F.lit("categories"), name("column", "label"), F.col("count").cast("double")),
    ]
    result = rows[0]
    for part in rows[1:]:
        result = result.union(part)
    return result


@query("advanced_eda_findings", union_all([
    f"SELECT 'o_orderkey vs o_totalprice' AS pair, round(corr(o_orderkey, o_totalprice), 3) AS correlation, count(CASE WHEN o_totalprice IS NOT NULL THEN 1 END) AS rows FROM {DIRTY_SQL}",
    f"SELECT '', NULL, count(*) FROM {DIRTY_SQL}",
]))
def _(tables):
    """The only pair of numbers, and the rows that were analysed."""
    found = advanced_eda(dirty_orders(tables), ["o_orderkey", "o_orderdate"])
    pairs = found["interactions"].select("pair", F.round("correlation", 3).alias("correlation"), F.col("n").alias("rows"))
    return pairs.union(found["counts"].select(F.lit(""), F.lit(None).cast("double"), "sampled_row_count"))
