"""Writing tables: versioned datasets and CSV exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablelens.operators.columns import field_types, json_safe, ref


def _path(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, location: str) -> list[int]:
    """Numbers of the versions that were written to the end."""
    path, files = _path(spark, location)
    if not files.exists(path):
        return []
    found = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def write_dataset(df: DataFrame, location: str, partition_by: list[str] | None = None) -> int:
    """Write a new version of a dataset and return its number.

    Readers see the newest complete version; a job that fails half-way leaves the current
    one in place.
    """
    spark = df.sparkSession
    version = (_versions(spark, location) or [0])[-1] + 1
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{location}/version={version}")
    return version


def read_dataset(spark: SparkSession, location: str, version: int | None = None) -> DataFrame:
    versions = _versions(spark, location)
    if not versions:
        raise ValueError(f"no dataset at {location}")
    chosen = versions[-1] if version is None else version
    if chosen not in versions:
        raise ValueError(f"version {version} not found; available: {versions}")
    return spark.read.parquet(f"{location}/version={chosen}")


def csv_text(df: DataFrame) -> DataFrame:
    """All columns as the text an export shows; nested ones as JSON."""
    safe = json_safe(df)
    types = field_types(safe)
    nested = (T.ArrayType, T.MapType, T.StructType)
    return safe.select(*[
        (F.to_json(ref(n)) if isinstance(types[n], nested) else ref(n).cast("string")).alias(n) for n in safe.columns
    ])


def export_csv(df: DataFrame, location: str, mode: str = "errorifexists") -> None:
    """CSV with header: values quoted only when they need it, quotes doubled, missing cells empty.

    One file per partition, written in parallel, each with the header.
    """
    csv_text(df).write.mode(mode).options(
        header=True, quote='"', escape='"', nullValue="", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(location)


def prediction_history_rows(history: DataFrame) -> DataFrame:
    """Export form of ``(timestamp, prediction, confidence?, features map)`` rows."""
    pairs = F.transform(F.map_entries("features"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    confidence = F.when(
        F.col("confidence").isNotNull(), F.concat(F.format_string("%.1f", F.col("confidence") * 100), F.lit("%"))
    ).otherwise("")
    return history.select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("Timestamp"),
        F.col("prediction").cast("string").alias("Prediction"),
        confidence.alias("Confidence"),
        F.array_join(pairs, "; ").alias("Features"),
    )


def export_prediction_history(history: DataFrame, location: str, mode: str = "errorifexists") -> None:
    prediction_history_rows(history).write.mode(mode).options(header=True, quoteAll=True, escape='"').csv(location)


def write_metadata(spark: SparkSession, location: str, values: dict) -> None:
    """A small JSON document beside a saved model."""
    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(location)


def read_metadata(spark: SparkSession, location: str) -> dict:
    return json.loads(spark.read.text(location, wholetext=True).first()["value"])
