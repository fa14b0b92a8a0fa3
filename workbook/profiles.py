"""Column profiles and suggestions read off them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import advisor as A, profiling as P
from workbook import query
from workbook.fixtures import DIRTY_SQL, dirty_orders, union_all

ORDER_TYPES = {  # name: (dtype, role fixed by the type)
    "o_orderkey": ("bigint", "'numeric'"), "o_orderstatus": ("string", None), "o_totalprice": ("double", "'numeric'"),
    "o_orderpriority": ("string", None), "o_orderdate": ("timestamp_ntz", "'datetime'"),
}


def profile_sql(source: str, types: dict[str, tuple[str, str | None]], with_role: bool = True) -> str:
    return union_all(
        f"SELECT {i} AS position, '{name}' AS name, '{dtype}' AS dtype, count({name}) AS \"nonNull\", "
        f"count(*) - count({name}) AS \"nullCount\", count(DISTINCT {name}) AS \"uniqueCount\", "
        + (role or f"CASE WHEN count(DISTINCT {name}) = count(*) THEN 'identifier' ELSE 'categorical' END")
        + f" AS role FROM {source}"
        for i, (name, (dtype, role)) in enumerate(types.items())
    )


ORDERS_PROFILE = profile_sql("orders", {
    "o_orderkey": ("bigint", "'numeric'"), "o_custkey": ("bigint", "'numeric'"), "o_orderstatus": ("string", None),
    "o_totalprice": ("double", "'numeric'"), "o_orderdate": ("timestamp_ntz", "'datetime'"), "o_orderpriority": ("string", None),
})
DIRTY_PROFILE = profile_sql(DIRTY_SQL, ORDER_TYPES)
CUSTOMER_PROFILE = profile_sql("customer", {
    "c_custkey": ("bigint", "'numeric'"), "c_name": ("string", None), "c_nationkey": ("int", "'numeric'"),
    "c_acctbal": ("double", "'numeric'"), "c_mktsegment": ("string", None),
})
ID_NAME = "(" + " OR ".join(f"lower(name) LIKE '%{e}'" for e in A.ID_ENDINGS if e != "_id") + ")"
ID_LIKE = (
    f"({ID_NAME} OR (\"uniqueCount\" = \"nonNull\" AND \"uniqueCount\" > 10 AND \"nonNull\" > 20) OR role = 'identifier')"
)


@query("profile_columns", DIRTY_PROFILE)
def _(tables):
    return P.profile_columns(dirty_orders(tables))


@query("profile_columns_wide", profile_sql("lineitem", {
    "l_orderkey": ("bigint", "'numeric'"), "l_partkey": ("bigint", "'numeric'"), "l_suppkey": ("bigint", "'numeric'"),
    "l_linenumber": ("int", "'numeric'"), "l_quantity": ("double", "'numeric'"), "l_extendedprice": ("double", "'numeric'"),
    "l_discount": ("double", "'numeric'"), "l_tax": ("double", "'numeric'"), "l_returnflag": ("string", None),
    "l_linestatus": ("string", None), "l_shipdate": ("timestamp_ntz", "'datetime'"),
}))
def _(tables):
    return P.profile_columns(tables.lineitem)


def _sample_sql(name: str, source: str, key: str) -> str:
    return (
        f"(SELECT string_agg(v, '|' ORDER BY p) FROM (SELECT {name}::VARCHAR AS v, row_number() OVER (ORDER BY {key}, {name}::VARCHAR) AS p "
        f"FROM {source} WHERE {name} IS NOT NULL AND {name}::VARCHAR <> '') WHERE p <= 5)"
    )


def _values_sql(name: str, dtype: str, role: str, position: int, source: str, key: str) -> str:
    return (
        f"SELECT {position} AS position, '{name}' AS name, '{dtype}' AS dtype, count({name}) AS \"nonNull\", "
        f"count(*) - count({name}) AS \"nullCount\", count(DISTINCT {name}) AS \"uniqueCount\", {role} AS role, "
        f"{_sample_sql(name, source, key)} AS sample FROM {source}"
    )


@query("profile_values", union_all([
    _values_sql("c_custkey", "number", "'identifier'", 0, "customer", "c_custkey"),
    _values_sql("c_name", "string", "'identifier'", 1, "customer", "c_custkey"),
    _values_sql("c_nationkey", "number", "'numeric'", 2, "customer", "c_custkey"),
    _values_sql("c_mktsegment", "string", "'categorical'", 3, "customer", "c_custkey"),
]))
def _(tables):
    table = tables.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return P.profile_values(table, ["c_custkey"]).withColumn("sample", F.array_join("sample", "|"))


@query("profile_values_patterns", union_all([
    "SELECT 'day' AS name, 'date' AS dtype, 'datetime' AS role, count(DISTINCT strftime(o_orderdate, '%Y-%m-%d')) AS \"uniqueCount\" FROM orders",
    "SELECT 'flag', 'boolean', 'boolean', 2 FROM orders HAVING count(*) > 0",
    "SELECT 'price_text', 'number', 'numeric', count(DISTINCT CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'unknown' ELSE o_totalprice::VARCHAR END) FROM orders",
]))
def _(tables):
    table = tables.orders.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("o_totalprice") > 200000, "Yes").otherwise("no").alias("flag"),
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F"), "unknown")
        .otherwise(F.col("o_totalprice").cast("string")).alias("price_text"),
    )
    return P.profile_values(table, ["o_orderkey"]).filter("name <> 'o_orderkey'").select("name", "dtype", "role", "uniqueCount")


@query("enrich_samples", union_all(
    f"SELECT '{n}' AS name, {_sample_sql(n, DIRTY_SQL, 'o_orderkey')} AS sample" for n in ("o_orderstatus", "o_orderpriority")
))
def _(tables):
    table = dirty_orders(tables).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    enriched = P.enrich_samples(P.profile_columns(table), table, ["o_orderkey"])
    return enriched.filter("name <> 'o_orderkey'").select("name", F.array_join("sample", "|").alias("sample"))


@query("duplicate_count", f"SELECT (SELECT count(*) FROM {DIRTY_SQL}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DIRTY_SQL})) AS duplicates")
def _(tables):
    return P.duplicate_count(dirty_orders(tables))


@query(
    "estimate_memory",
    "WITH s AS (SELECT count(*) AS rows, sum(length(json_object('c_custkey', c_custkey, 'c_name', c_name, 'c_nationkey', c_nationkey, "
    "'c_mktsegment', c_mktsegment)::VARCHAR)) * 2 + count(*) * 32 AS bytes FROM customer) "
    "SELECT rows, bytes::DOUBLE AS bytes, CASE WHEN bytes < 1048576 THEN round(bytes / 1024, 2) || ' KB' ELSE round(bytes / 1048576, 2) || ' MB' END AS display FROM s",
)
def _(tables):
    size = P.estimate_memory(tables.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    return size.withColumn("bytes", F.round("bytes", 3))


@query(
    "completeness",
    f"WITH p AS ({DIRTY_PROFILE}) SELECT floor(1000.0 * sum(\"nonNull\") / sum(\"nonNull\" + \"nullCount\") + 0.5) / 10 AS completeness, "
    f"sum(\"nullCount\")::BIGINT AS missing_cells FROM p",
)
def _(tables):
    return P.completeness(P.profile_columns(dirty_orders(tables)))


@query(
    "quality_signals",
    f"WITH p AS ({DIRTY_PROFILE}) SELECT * FROM (SELECT name, \"nullCount\", "
    f"floor(\"nullCount\" * 100.0 / (\"nonNull\" + \"nullCount\") + 0.5)::BIGINT AS missing_percent FROM p WHERE \"nullCount\" > 0 "
    f"ORDER BY \"nullCount\" DESC, position LIMIT 3)",
)
def _(tables):
    return P.quality_signals(P.profile_columns(dirty_orders(tables)))["sparsest"].drop("position")


@query("quality_signals_missing", f"WITH p AS ({DIRTY_PROFILE}) SELECT name, \"nullCount\" FROM p WHERE \"nullCount\" > 0")
def _(tables):
    return P.quality_signals(P.profile_columns(dirty_orders(tables)))["missing"].select("name", "nullCount")


@query("quality_signals_near_unique", f"WITH p AS ({ORDERS_PROFILE}) SELECT name, \"uniqueCount\" FROM p WHERE \"uniqueCount\" / (\"nonNull\" + \"nullCount\") >= 0.9")
def _(tables):
    return P.quality_signals(P.profile_columns(tables.orders))["near_unique"].select("name", "uniqueCount")


@query("role_counts", f"WITH p AS ({ORDERS_PROFILE}) SELECT role, count(*) AS columns FROM p GROUP BY role")
def _(tables):
    return P.quality_signals(P.profile_columns(tables.orders))["roles"]


@query("is_id_like", f"WITH p AS ({CUSTOMER_PROFILE}) SELECT name, {ID_LIKE} AS id_like FROM p")
def _(tables):
    return A.mark_id_like(P.profile_columns(tables.customer)).select("name", "id_like")


@query(
    "detect_problem_type",
    f"WITH p AS ({DIRTY_PROFILE}) SELECT name, CASE WHEN role = 'numeric' THEN 'regression' ELSE 'classification' END AS problem_type, "
    "CASE WHEN role = 'numeric' AND \"uniqueCount\" / \"nonNull\" > 0.9 AND \"uniqueCount\" > 10 THEN 70 "
    "WHEN role = 'numeric' AND \"nonNull\" / (\"nonNull\" + \"nullCount\") > 0.8 THEN 90 WHEN role = 'numeric' THEN 60 "
    "WHEN role IN ('categorical', 'boolean') THEN 85 WHEN \"uniqueCount\" / \"nonNull\" < 0.3 AND \"uniqueCount\" <= 20 THEN 75 "
    "ELSE 60 END AS confidence FROM p",
)
def _(tables):
    return A.detect_problem_type(P.profile_columns(dirty_orders(tables))).drop("position")


@query(
    "suggest_target",
    "SELECT 'l_returnflag' AS name, 'few categories' AS rule FROM lineitem HAVING count(DISTINCT l_returnflag) <= 5",
)
def _(tables):
    table = tables.lineitem.select("l_partkey", "l_shipdate", "l_returnflag", "l_extendedprice", "l_discount")
    return A.suggest_target(P.profile_columns(table.withColumnRenamed("l_partkey", "l_part")))


@query("suggest_features", f"WITH p AS ({CUSTOMER_PROFILE}) SELECT name FROM p WHERE name <> 'c_mktsegment' AND NOT {ID_LIKE} AND role <> 'datetime'")
def _(tables):
    return A.suggest_features(P.profile_columns(tables.customer), "c_mktsegment").select("name")


@query(
    "pick_series_columns",
    f"WITH p AS ({ORDERS_PROFILE}) SELECT (SELECT name FROM p WHERE role = 'numeric' AND "
    "regexp_matches(lower(name), 'sales|revenue|amount|profit|price|total|qty') ORDER BY position LIMIT 1) AS target, "
    "(SELECT name FROM p WHERE role = 'datetime' AND lower(name) LIKE '%date%' ORDER BY position LIMIT 1) AS date",
)
def _(tables):
    return A.pick_series_columns(P.profile_columns(tables.orders))
