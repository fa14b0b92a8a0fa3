"""Append-only log of workflow events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# fixed values: the columns of the log
ACTIVITY_SCHEMA = {
    "activity_id": "string", "created_at": "timestamp", "client_session_id": "string", "server_session_id": "string",
    "dataset_id": "string", "model_id": "string", "activity_type": "string", "action": "string", "status": "string",
    "api_path": "string", "http_method": "string", "status_code": "int", "duration_ms": "double", "file_name": "string",
    "detail": "string", "metadata_json": "string", "client_ip": "string", "user_agent": "string",
}
REQUIRED = ("action", "status")


def activity_rows(events: DataFrame) -> DataFrame:
    """Events in the log's layout: absent columns null, ids, times and types filled in."""
    absent = [c for c in REQUIRED if c not in events.columns]
    if absent:
        raise ValueError(f"activity rows need columns: {absent}")
    defaults = {
        "activity_id": F.expr("replace(uuid(), '-', '')"),
        "created_at": F.current_timestamp(),
        "activity_type": F.lit("workflow"),
    }
    columns = []
    for name, kind in ACTIVITY_SCHEMA.items():
        given = F.col(name) if name in events.columns else F.lit(None)
        value = F.coalesce(given, defaults[name]) if name in defaults else given
        columns.append(value.cast(kind).alias(name))
    return events.select(*columns)


def append_activity(events: DataFrame, location: str) -> None:
    """Append events, stored in one folder per day."""
    rows = activity_rows(events).withColumn("day", F.to_date("created_at"))
    rows.write.mode("append").partitionBy("day").parquet(location)


def read_activity(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.parquet(location).drop("day")


def list_activities(
    log: DataFrame,
    dataset_id: str | None = None,
    client_session_id: str | None = None,
    server_session_id: str | None = None,
    limit: int = 100,
    order: str = "created_at",
) -> DataFrame:
    """The newest events, optionally of one dataset or session."""
    _check_limit(limit)
    wanted = _wanted(log, dataset_id, client_session_id, server_session_id)
    return wanted.orderBy(F.desc(order), F.desc("activity_id")).limit(limit)


def _check_limit(limit: int) -> None:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")


def _wanted(log: DataFrame, dataset_id: str | None, client_session_id: str | None, server_session_id: str | None) -> DataFrame:
    wanted = {
        "dataset_id": dataset_id, "client_session_id": client_session_id, "server_session_id": server_session_id,
    }
    for name, value in wanted.items():
        if value:
            log = log.filter(F.col(name) == value)
    return log


def recent_activities(
    spark: SparkSession,
    location: str,
    dataset_id: str | None = None,
    client_session_id: str | None = None,
    server_session_id: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """The newest events of a written log, like ``list_activities``, without reading all of it.

    The log has a folder per day. Days are read from the newest on, one, two, four, ... at a time, until ``limit`` events are
    found; the file names tell which days there are. A log without events of the wanted kind is read once.
    """
    _check_limit(limit)
    log = spark.read.parquet(location)
    days = sorted({name.split("day=", 1)[1].split("/", 1)[0] for name in log.inputFiles() if "day=" in name}, reverse=True)
    found, start, width = None, 0, 1
    while start < len(days):
        some = log.where(F.col("day").cast("string").isin(days[start:start + width])).drop("day")
        left = limit - (0 if found is None else found.num_rows)
        rows = list_activities(_wanted(some, dataset_id, client_session_id, server_session_id), limit=left).toArrow()
        found = rows if found is None else pa.concat_tables([found, rows])
        if found.num_rows >= limit:
            break
        start, width = start + width, 2 * width
    empty = log.drop("day").limit(0)
    return empty if found is None else spark.createDataFrame(found, empty.schema)
