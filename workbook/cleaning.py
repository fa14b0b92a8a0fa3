"""Duplicates, imputation and the cleaning workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators.cleaning import drop_duplicates, impute
from tablelens.plans.cleaning import clean
from workbook import query
from workbook.fixtures import CLEAN_PRIORITY, DIRTY_SQL, dirty_orders


def _mode(name: str, source: str) -> str:
    return f"(SELECT {name} FROM {source} WHERE {name} IS NOT NULL GROUP BY {name} ORDER BY count(*) DESC, {name} LIMIT 1)"


@query("drop_duplicates", f"SELECT DISTINCT * FROM {DIRTY_SQL}")
def _(tables):
    return drop_duplicates(dirty_orders(tables))


@query(
    "drop_duplicates_first",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1",
)
def _(tables):
    table = tables.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return drop_duplicates(table, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("impute_numeric", f"SELECT o_orderkey, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM {DIRTY_SQL})) AS o_totalprice FROM {DIRTY_SQL}")
def _(tables):
    return impute(dirty_orders(tables).select("o_orderkey", "o_totalprice"))


@query(
    "impute_other",
    f"SELECT o_orderkey, coalesce(o_orderstatus, {_mode('o_orderstatus', DIRTY_SQL)}) AS o_orderstatus, "
    f"coalesce(o_orderpriority, {_mode('o_orderpriority', DIRTY_SQL)}) AS o_orderpriority, 'Unknown' AS nothing FROM {DIRTY_SQL}",
)
def _(tables):
    table = dirty_orders(tables).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return impute(table.withColumn("nothing", F.lit(None).cast("string")))


_DISTINCT = f"(SELECT DISTINCT o_orderkey, o_orderstatus, o_totalprice, {CLEAN_PRIORITY} AS o_orderpriority, o_orderdate FROM {DIRTY_SQL})"


@query(
    "clean",
    f"SELECT o_orderkey AS order_key, coalesce(o_orderstatus, {_mode('o_orderstatus', _DISTINCT)}) AS o_orderstatus, "
    f"coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM {_DISTINCT})) AS o_totalprice, "
    f"coalesce(o_orderpriority, {_mode('o_orderpriority', _DISTINCT)}) AS o_orderpriority, "
    f"strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM {_DISTINCT}",
)
def _(tables):
    return clean(dirty_orders(tables).withColumnRenamed("o_orderkey", "Order Key")).table


@query(
    "cleaning_log",
    f"SELECT 0 AS position, 'names' AS step, 1 AS changed UNION ALL "
    f"SELECT 1, 'duplicates', (SELECT count(*) FROM {DIRTY_SQL}) - (SELECT count(*) FROM {_DISTINCT}) UNION ALL "
    f"SELECT 2, 'missing_values', 3 UNION ALL SELECT 3, 'dates', 1",
)
def _(tables):
    result = clean(dirty_orders(tables).withColumnRenamed("o_orderkey", "Order Key"))
    return result.log.drop("timestamp")
