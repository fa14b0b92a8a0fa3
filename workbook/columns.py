"""Naming, selection, coercion and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.functions import PERIODS, format_period, parse_datetime, period_start
from tablelens.operators import columns as C
from workbook import query
from workbook.fixtures import CLEAN_PRIORITY, DIRTY_SQL, DUCK_LAYOUTS, DUCK_TEXT_DATE, dirty_orders, text_dates


def _odd_names(tables):
    return tables.orders.toDF("Order Key", "order-key", "__x__", "Total  Price ($)", "Order.Date", "***")


@query(
    "standardize_names",
    "SELECT o_orderkey AS order_key, o_custkey AS order_key_2, o_orderstatus AS x, o_totalprice AS total_price, "
    "o_orderdate AS order_date, o_orderpriority AS column_6 FROM orders",
)
def _(tables):
    return C.standardize_names(_odd_names(tables))


@query(
    "standardize_names_snake",
    "SELECT o_orderkey AS order_key, o_custkey AS order_key_2, o_orderstatus AS x, o_totalprice AS total_price, "
    "o_orderdate AS order_date, o_orderpriority AS column_6 FROM orders",
)
def _(tables):
    return C.standardize_names(_odd_names(tables), style="snake")


@query(
    "resolve_columns",
    "SELECT o_orderkey AS order_key, o_totalprice AS \"total price\", o_orderdate AS \"ORDER_DATE\" FROM orders",
)
def _(tables):
    table = _odd_names(tables).withColumnRenamed("Total  Price ($)", "Total-Price")
    return C.select_resolved(table, ["order_key", "total price", "ORDER_DATE"])


@query("select_required", f"SELECT o_orderkey, {CLEAN_PRIORITY} AS o_orderpriority FROM {DIRTY_SQL}")
def _(tables):
    return C.select_required(dirty_orders(tables), ["o_orderkey", "o_orderpriority"])


@query(
    "blank_to_null",
    f"SELECT o_orderkey, o_orderstatus, o_totalprice, {CLEAN_PRIORITY} AS o_orderpriority, o_orderdate FROM {DIRTY_SQL}",
)
def _(tables):
    return C.blanks_to_null(dirty_orders(tables))


@query(
    "normalize_features",
    f"SELECT o_orderkey, o_orderstatus, o_totalprice, {CLEAN_PRIORITY} AS o_orderpriority, "
    f"strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM {DIRTY_SQL}",
)
def _(tables):
    return C.normalize_features(dirty_orders(tables))


@query(
    "safe_numeric",
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN o_totalprice "
    "WHEN '3-MEDIUM' THEN 1500.0 WHEN '4-NOT SPECIFIED' THEN NULL ELSE -o_totalprice END AS amount FROM orders",
)
def _(tables):
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.col("o_totalprice").cast("string"), F.lit(" EUR")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit(" "), F.format_string("%.2f", "o_totalprice")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", "1.5e3")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Infinity")
        .otherwise(F.format_string("%.2f", -F.col("o_totalprice")))
    )
    return C.to_numeric(tables.orders.select("o_orderkey", text.alias("amount")), ["amount"])


@query(
    "parse_datetime",
    f"SELECT o_orderkey, try_strptime(trim({DUCK_TEXT_DATE}), {DUCK_LAYOUTS}) AS moment FROM orders",
)
def _(tables):
    parsed = parse_datetime(F.col("date_text")).cast("timestamp_ntz")
    return text_dates(tables).select("o_orderkey", parsed.alias("moment"))


@query(
    "detect_date_columns",
    f"WITH t AS (SELECT *, {DUCK_TEXT_DATE} AS date_text FROM orders), parsed AS ("
    f"SELECT 'date_text' AS name, date_text AS value FROM t UNION ALL "
    f"SELECT 'o_orderpriority', o_orderpriority FROM t) "
    f"SELECT name, round(avg(CASE WHEN try_strptime(trim(value), {DUCK_LAYOUTS}) IS NULL THEN 0.0 ELSE 1.0 END), 6) AS parsed_share, "
    f"avg(CASE WHEN try_strptime(trim(value), {DUCK_LAYOUTS}) IS NULL THEN 0.0 ELSE 1.0 END) >= 0.6 AS is_date "
    f"FROM parsed GROUP BY name",
)
def _(tables):
    dated = tables.orders.join(text_dates(tables).select("o_orderkey", "date_text"), "o_orderkey")
    table = dated.select("o_orderkey", "date_text", "o_orderpriority")
    return C.detect_date_columns(table).withColumn("parsed_share", F.round("parsed_share", 6))


@query(
    "convert_dates",
    f"SELECT o_orderkey, o_totalprice, strftime(try_strptime(trim({DUCK_TEXT_DATE}), {DUCK_LAYOUTS}), '%Y-%m-%d') AS date_text FROM orders",
)
def _(tables):
    return C.convert_dates(text_dates(tables), ["date_text"])


@query(
    "drop_missing",
    f"SELECT o_orderkey, o_totalprice, o_orderstatus FROM {DIRTY_SQL} WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL",
)
def _(tables):
    return C.drop_missing(dirty_orders(tables).select("o_orderkey", "o_totalprice", "o_orderstatus"), ["o_totalprice", "o_orderstatus"])


@query("columns_by_role", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def _(tables):
    names = C.columns_by_role(tables.orders, "numeric") + C.columns_by_role(tables.orders, "temporal")
    return tables.orders.select(*names)


@query("non_constant", "SELECT l_quantity, l_discount, l_extendedprice * 1.1 AS gross FROM lineitem")
def _(tables):
    table = tables.lineitem.select(
        "l_quantity", "l_discount", F.lit(7.0).alias("flat"), (F.col("l_extendedprice") * 1.1).alias("gross")
    )
    return table.select(*C.non_constant(table))


@query(
    "require_features",
    f"SELECT o_orderkey, CASE WHEN o_totalprice IS NULL AND (o_orderpriority IS NULL) THEN 'o_totalprice,o_orderpriority' "
    f"WHEN o_totalprice IS NULL THEN 'o_totalprice' ELSE 'o_orderpriority' END AS missing FROM {DIRTY_SQL} "
    f"WHERE o_totalprice IS NULL OR o_orderpriority IS NULL",
)
def _(tables):
    _, rejected = C.require_features(dirty_orders(tables), ["o_totalprice", "o_orderpriority"])
    return rejected.select("o_orderkey", F.array_join("missing_features", ",").alias("missing"))


@query(
    "require_features_accepted",
    f"SELECT o_orderkey FROM {DIRTY_SQL} WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL",
)
def _(tables):
    accepted, _ = C.require_features(dirty_orders(tables), ["o_totalprice", "o_orderpriority"])
    return accepted.select("o_orderkey")


@query(
    "format_period",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, "
    "'Week of ' || strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, strftime(o_orderdate, '%Y-%m') AS month, "
    "year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, strftime(o_orderdate, '%Y') AS year FROM orders",
)
def _(tables):
    shown = [format_period(period_start(F.col("o_orderdate"), p), p).alias(p) for p in PERIODS]
    return tables.orders.select("o_orderkey", *shown)


@query(
    "calendar_features",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date, month(o_orderdate) AS month_number, "
    "quarter(o_orderdate) AS quarter, dayofweek(o_orderdate) AS day_of_week, "
    "CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend, year(o_orderdate) AS year FROM orders",
)
def _(tables):
    empty = F.lit(None).cast("int")
    table = tables.orders.select(
        "o_orderkey", "o_orderdate", F.lit(None).cast("string").alias("order_date"),
        *[empty.alias(n) for n in ("month_number", "quarter", "day_of_week", "is_weekend", "year")],
    )
    return C.calendar_features(table, "o_orderdate").drop("o_orderdate")


@query(
    "calendar_features_fill",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 99 ELSE month(o_orderdate) END AS month_number, "
    "isodow(o_orderdate) - 1 AS weekday FROM orders",
)
def _(tables):
    table = tables.orders.select(
        "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", 99).alias("month_number"),
        F.lit(None).cast("int").alias("weekday"),
    )
    return C.calendar_features(table, "o_orderdate", mode="fill", week_start="monday").drop("o_orderdate")
