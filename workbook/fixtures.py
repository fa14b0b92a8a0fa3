"""Derived inputs, written once as expressions both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame

# whole orders table with missing and blank cells, and the open orders delivered twice
DIRTY = [
    "o_orderkey",
    "CASE WHEN o_orderstatus = 'P' AND o_totalprice < 250000 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
    "CASE WHEN day(o_orderdate) = 13 THEN NULL ELSE o_totalprice END AS o_totalprice",
    "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN NULL "
    "WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN '  ' ELSE o_orderpriority END AS o_orderpriority",
    "o_orderdate",
]
DIRTY_SQL = (
    f"(SELECT {', '.join(DIRTY)} FROM orders UNION ALL "
    f"SELECT {', '.join(DIRTY)} FROM orders WHERE o_orderstatus = 'O')"
)
CLEAN_PRIORITY = "CASE WHEN trim(o_orderpriority) = '' THEN NULL ELSE o_orderpriority END"

# order dates as text, one layout per priority, and none for part of the finished orders
SPARK_TEXT_DATE = (
    "CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 'n/a' "
    "WHEN o_orderpriority = '1-URGENT' THEN date_format(o_orderdate, 'yyyy-MM-dd') "
    "WHEN o_orderpriority = '2-HIGH' THEN date_format(o_orderdate, 'dd-MM-yyyy') "
    "WHEN o_orderpriority = '3-MEDIUM' THEN date_format(o_orderdate, 'MMM dd, yyyy') "
    "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN date_format(o_orderdate, 'MM/dd/yyyy') "
    "ELSE date_format(o_orderdate, ' yyyy/M/d ') END AS date_text"
)
DUCK_TEXT_DATE = (
    "CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 'n/a' "
    "WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') "
    "WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%d-%m-%Y') "
    "WHEN o_orderpriority = '3-MEDIUM' THEN strftime(o_orderdate, '%b %d, %Y') "
    "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%m/%d/%Y') "
    "ELSE strftime(o_orderdate, ' %Y/%-m/%-d ') END"
)
# fixed values: the accepted layouts in order
DUCK_LAYOUTS = (
    "['%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d', "
    "'%d-%m-%Y', '%m-%d-%Y', '%d/%m/%Y', '%m/%d/%Y', '%Y/%m/%d', '%b %d, %Y', '%B %d, %Y', '%b-%Y', '%B-%Y', "
    "'%b %Y', '%B %Y', '%Y-%m', '%m-%Y']"
)


def dirty_orders(tables) -> DataFrame:
    rows = tables.orders
    return rows.selectExpr(*DIRTY).unionAll(rows.filter("o_orderstatus = 'O'").selectExpr(*DIRTY))


def text_dates(tables) -> DataFrame:
    return tables.orders.selectExpr("o_orderkey", "o_totalprice", SPARK_TEXT_DATE)


def union_all(parts) -> str:
    return " UNION ALL ".join(parts)
