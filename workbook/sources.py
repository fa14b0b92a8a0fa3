"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators.columns import json_safe
from tablelens.sources import activity, readers, writers
from workbook import query, scratch

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("read_table", "SELECT o_orderkey, o_totalprice FROM orders")
def _(tables):
    return readers.read_table(tables.spark, f"{tables.folder}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("read_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(tables):
    place = scratch(tables.spark)
    writers.export_csv(tables.customer, place)
    return readers.read_csv(tables.spark, place).select(
        F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )


@query("read_tsv", "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part")
def _(tables):
    place = scratch(tables.spark)
    tables.part.select("p_partkey", "p_name", "p_brand", "p_retailprice").write.csv(place, sep="\t", header=True)
    return readers.read_tsv(tables.spark, place, schema="p_partkey long, p_name string, p_brand string, p_retailprice double")


@query(
    "stack_tables",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL "
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
)
def _(tables):
    parts = [tables.orders.filter("o_orderstatus = 'F'"), tables.orders.filter("o_orderstatus <> 'F'")]
    return readers.stack_tables(parts, ["o_orderkey", "o_orderstatus"])


@query("row_count", "SELECT count(*) AS row_count FROM lineitem")
def _(tables):
    return readers.row_count(tables.lineitem)


@query("preview", f"SELECT {', '.join(LINE_ORDER)} FROM lineitem ORDER BY {', '.join(LINE_ORDER)} LIMIT 20000")
def _(tables):
    return readers.preview(tables.lineitem.select(*LINE_ORDER), LINE_ORDER)[0]


@query(
    "preview_facts",
    "SELECT count(*) AS row_count, least(count(*), 20000) AS loaded, count(*) > 20000 AS preview_loaded FROM lineitem",
)
def _(tables):
    return readers.preview(tables.lineitem, LINE_ORDER)[1]


@query("write_dataset", "SELECT o_orderkey, o_orderstatus, o_totalprice * 2 AS doubled FROM orders")
def _(tables):
    place = scratch(tables.spark)
    rows = tables.orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("doubled"))
    writers.write_dataset(rows, place)
    writers.write_dataset(rows.withColumn("doubled", F.col("doubled") * 2), place)
    return writers.read_dataset(tables.spark, place)


@query(
    "export_csv",
    "SELECT doc_id, text, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang FROM documents",
)
def _(tables):
    place = scratch(tables.spark)
    rows = tables.documents.select("doc_id", "text", F.nullif("lang", F.lit("en")).alias("lang"))
    writers.export_csv(rows, place)
    return readers.read_csv(tables.spark, place, schema="doc_id long, text string, lang string", multi_line=True)


@query(
    "json_safe",
    "SELECT event_id, CASE WHEN event_type = 'error' OR event_type = 'signup' THEN NULL ELSE value END AS value, "
    "CAST(value AS DECIMAL(12,2))::DOUBLE AS amount, strftime(ts, '%Y-%m-%d') AS day, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microseconds', ts) % 1000000 = 0 THEN '' "
    "ELSE '.' || strftime(ts, '%f') END AS ts FROM events",
)
def _(tables):
    odd = F.when(F.col("event_type") == "error", float("nan")).when(F.col("event_type") == "signup", float("inf"))
    rows = tables.events.select(
        "event_id", odd.otherwise(F.col("value")).alias("value"), F.col("value").cast("decimal(12,2)").alias("amount"),
        F.to_date("ts").alias("day"), "ts",
    )
    return json_safe(rows)


def _events_as_activity(tables):
    return tables.events.select(
        F.format_string("%010d", "event_id").alias("activity_id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.col("user_id").cast("string").alias("client_session_id"), F.col("event_type").alias("action"),
        F.lit("success").alias("status"), F.col("value").alias("duration_ms"),
    )


@query(
    "append_activity",
    "SELECT lpad(event_id::VARCHAR, 10, '0') AS activity_id, user_id::VARCHAR AS client_session_id, "
    "event_type AS action, 'workflow' AS activity_type, value AS duration_ms FROM events",
)
def _(tables):
    place = scratch(tables.spark)
    rows = _events_as_activity(tables)
    activity.append_activity(rows.filter("action = 'error'"), place)
    activity.append_activity(rows.filter("action <> 'error'"), place)
    return activity.read_activity(tables.spark, place).select(
        "activity_id", "client_session_id", "action", "activity_type", "duration_ms"
    )


@query(
    "list_activities",
    "SELECT lpad(event_id::VARCHAR, 10, '0') AS activity_id, event_type AS action FROM events WHERE user_id = 8 "
    "ORDER BY ts DESC, event_id DESC LIMIT 100",
)
def _(tables):
    log = activity.activity_rows(_events_as_activity(tables))
    return activity.list_activities(log, client_session_id="8").select("activity_id", "action")


@query(
    "recent_activities",
    "SELECT lpad(event_id::VARCHAR, 10, '0') AS activity_id, event_type AS action FROM events WHERE user_id = 8 "
    "ORDER BY ts DESC, event_id DESC LIMIT 100",
)
def _(tables):
    """The same rows from a written log, read from its newest day on."""
    place = scratch(tables.spark)
    activity.append_activity(_events_as_activity(tables), place)
    return activity.recent_activities(tables.spark, place, client_session_id="8").select("activity_id", "action")


@query(
    "prediction_history_rows",
    "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS \"Timestamp\", event_type AS \"Prediction\", "
    "CASE WHEN event_type = 'view' THEN '' ELSE '50.0%' END AS \"Confidence\", 'user=' || user_id AS \"Features\" FROM events",
)
def _(tables):
    history = tables.events.select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("prediction"),
        F.when(F.col("event_type") != "view", 0.5).alias("confidence"),
        F.create_map(F.lit("user"), F.col("user_id")).alias("features"),
    )
    return writers.prediction_history_rows(history)
