"""Inputs of batch scoring: feature profiles, scenarios, carried-forward values."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablelens.functions import finite, half_up
from tablelens.operators.cleaning import column_modes
from tablelens.operators.columns import field_types, is_numeric, long_form, ref
from tablelens.operators.profiling import one_row_per_column


def feature_input_profile(df: DataFrame, features: Sequence[str], order_by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(name, is_number, min, max, mean, last_value)`` per feature, and ``(name, value)`` distinct texts.

    The distinct values of text features stay a distributed table.
    """
    types = field_types(df)
    numeric = [n for n in features if is_numeric(types[n])]
    order = F.struct(*[ref(c) for c in order_by])
    aggregates = []
    for i, name in enumerate(features):
        number = finite(ref(name)) if name in numeric else F.lit(None).cast("double")
        filled = F.when(ref(name).cast("string") != "", ref(name).cast("string"))
        aggregates += [
            F.min(number).alias(f"min_{i}"),
            F.max(number).alias(f"max_{i}"),
            F.avg(number).alias(f"mean_{i}"),
            F.lit(name in numeric).alias(f"is_number_{i}"),
            F.max_by(filled, F.when(filled.isNotNull(), order)).alias(f"last_value_{i}"),
        ]
    metrics = {"is_number": "boolean", "min": "double", "max": "double", "mean": "double", "last_value": "string"}
    summary = one_row_per_column(df.agg(*aggregates), features, metrics).drop("position")
    text = [n for n in features if n not in numeric]
    if not text:
        return summary, summary.select("name", F.col("last_value").alias("value")).limit(0)
    values = long_form(df, text).filter(F.col("value").isNotNull()).distinct()
    return summary, values


def scenario_frame(df: DataFrame, features: Sequence[str], periods: int, start: dt.date) -> DataFrame:
    """One row per future step of 30 days with average numeric and most frequent other features."""
    if periods < 1:
        raise ValueError("periods must be at least 1")
    types = field_types(df)
    numeric = [n for n in features if is_numeric(types[n])]
    other = [n for n in features if n not in numeric]
    filled = df.select(*[F.coalesce(ref(n).cast("string"), F.lit("")).alias(n) for n in other]) if other else df
    modes = column_modes(filled, other)
    counted = df.agg(*[half_up(F.avg(finite(ref(n))), 4).alias(n) for n in numeric], F.count(F.lit(1)).alias("__rows"))
    values = [ref(n) if n in numeric else F.lit(modes[n]).alias(n) for n in features]
    step = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")
    steps = counted.select(*values, step)
    return steps.select("step", F.date_add(F.lit(start), F.col("step") * 30).alias("date"), *[ref(n) for n in features])


def carry_forward_target(df: DataFrame, target: str, order_by: Sequence[str], column: str = "previous_month") -> DataFrame:
    """Fill the empty cells of ``column`` with the last numeric target value of the table."""
    value = finite(ref(target))
    order = F.struct(*[ref(c) for c in order_by])
    last = df.agg(F.max_by(value, F.when(value.isNotNull(), order)).alias("last")).select("last").scalar()
    current = ref(column) if column in df.columns else F.lit(None).cast("double")
    empty = current.isNull() | (current.cast("string") == "")
    return df.withColumn(column, F.when(empty, last).otherwise(current.cast("double")))
