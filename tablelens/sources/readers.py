"""Reading tables: files, records, previews, stacked tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablelens.operators.columns import blanks_to_null, ref

PREVIEW_ROWS = 20_000


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, n_rows: int | None = None
) -> DataFrame:
    """A parquet table; only the named columns are read."""
    df = spark.read.parquet(path)
    if columns is not None:
        absent = [c for c in columns if c not in df.columns]
        if absent:
            raise ValueError(f"missing columns: {absent}")
        df = df.select(*[ref(c) for c in columns])
    return df if n_rows is None else df.limit(n_rows)


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    schema: T.StructType | str | None = None,
    sampling: float = 1.0,
    multi_line: bool = False,
) -> DataFrame:
    """A delimited file with a header. Cells that do not fit their column's type become null.

    ``multi_line`` reads quoted cells that hold line ends; such a file is one task, so write many files.
    Without ``schema`` the types are inferred in one pass over the ``sampling`` share of the
    rows; a column whose unsampled cells do not fit keeps its type and gets nulls there.
    """
    reader = spark.read.options(header=True, sep=sep, mode="PERMISSIVE", multiLine=multi_line, escape='"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.options(inferSchema=True, samplingRatio=sampling).csv(path)


def read_tsv(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def from_records(spark: SparkSession, rows: Sequence[Mapping[str, Any]]) -> DataFrame:
    """A table from dictionaries; blank text becomes null."""
    if not rows:
        raise ValueError("the dataset must hold at least one row")
    names = list(dict.fromkeys(name for row in rows for name in row))
    # one JSON document per row lets Spark infer and reconcile the column types
    lines = spark.sparkContext.parallelize([json.dumps(dict(row), default=str) for row in rows])
    parsed = spark.read.json(lines)
    present = [ref(n) if n in parsed.columns else F.lit(None).cast("string").alias(n) for n in names]
    return blanks_to_null(parsed.select(*present))


def stack_tables(tables: Sequence[DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """All rows of tables with the same column names in the same order."""
    if not tables:
        raise ValueError("no tables to stack")
    first = tables[0].columns
    for place, table in enumerate(tables[1:], start=2):
        if table.columns != first:
            raise ValueError(f"cannot stack tables with different columns: table {place} does not match the first")
    if columns is not None:
        absent = [c for c in columns if c not in first]
        if absent:
            raise ValueError(f"missing columns: {absent}")
        tables = [table.select(*[ref(c) for c in columns]) for table in tables]
    return reduce(DataFrame.unionByName, tables)


def row_count(df: DataFrame) -> DataFrame:
    """One row ``row_count``; parquet answers it without reading column data."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def preview(df: DataFrame, order_by: Sequence[str], n: int = PREVIEW_ROWS) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows, and one row ``(row_count, loaded, preview_loaded)``."""
    if n < 1:
        raise ValueError("n must be at least 1")
    facts = row_count(df).select(
        "row_count", F.least("row_count", F.lit(n)).alias("loaded"), (F.col("row_count") > n).alias("preview_loaded")
    )
    return df.orderBy(*[ref(c) for c in order_by]).limit(n), facts
