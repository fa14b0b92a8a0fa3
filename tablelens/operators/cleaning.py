"""Duplicate removal and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tablelens.functions import quote_name
from tablelens.operators.columns import (
    NESTED,
    field_types,
    finite_numbers,
    is_numeric,
    long_form,
    missing,
    ref,
)
from tablelens.operators.quantiles import medians


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """One row of each group of equal rows.

    With ``subset``, other columns may differ inside a group and the first row by
    ``order_by`` stays. It is found by a minimum, which combines map-side, so a group
    holding a large part of the table is reduced before it is shuffled.
    """
    if subset is None:
        return df.dropDuplicates()
    if not order_by:
        raise ValueError("order_by is needed to say which row of a group stays")
    rest = [c for c in df.columns if c not in subset]
    first = F.min(F.struct(*[ref(c).alias(f"__o{i}") for i, c in enumerate(order_by)], *[ref(c) for c in rest]))
    grouped = df.groupBy(*[ref(c) for c in subset]).agg(first.alias("__first"))
    kept = {c: F.col(f"__first.{quote_name(c)}") for c in rest}
    return grouped.select(*[(kept[c].alias(c) if c in kept else ref(c)) for c in df.columns])


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value of each column as text, the smallest on ties; None for an all-null column.

    Values are counted first and the winner is an aggregate of the counts, so even a column
    of unique values needs no large buffer.
    """
    if not columns:
        return {}
    counts = (
        long_form(df, columns)
        .filter(F.col("value").isNotNull())
        .groupBy("name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    winners = counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode")).collect()
    found = {row["name"]: row["mode"] for row in winners}
    return {name: found.get(name) for name in columns}


def imputation_values(df: DataFrame) -> dict[str, object]:
    """Fill value of every column with missing cells: median, or mode, or the stated fallback."""
    types = field_types(df)
    flat = [n for n in df.columns if not isinstance(types[n], NESTED)]
    row = df.agg(*[F.count_if(missing(df, n)).alias(f"m{i}") for i, n in enumerate(flat)]).first()
    gaps = [n for i, n in enumerate(flat) if row[f"m{i}"]]
    numeric = [n for n in gaps if is_numeric(types[n])]
    other = [n for n in gaps if n not in numeric]
    values: dict[str, object] = {}
    if numeric:
        middle = medians(finite_numbers(df, numeric), numeric)
        values |= {n: 0.0 if middle[n] is None else middle[n] for n in numeric}
    modes = column_modes(df, other)
    for name in other:
        if modes[name] is not None:
            values[name] = modes[name]
        elif isinstance(types[name], T.StringType):
            values[name] = "Unknown"
    return values


def impute(df: DataFrame, values: dict[str, object] | None = None) -> DataFrame:
    """Fill missing cells: numeric columns with the median, others with the mode.

    An all-null numeric column gets 0 and an all-null text column ``Unknown``. An integer
    column whose median is not whole becomes double.
    """
    values = imputation_values(df) if values is None else values
    types = field_types(df)
    updates = {}
    for name, value in values.items():
        dtype = types[name]
        if isinstance(dtype, T.IntegralType) and value != int(value):
            updates[name] = F.coalesce(ref(name).cast("double"), F.lit(float(value)))
        elif is_numeric(dtype):
            updates[name] = F.when(missing(df, name), F.lit(value).cast(dtype)).otherwise(ref(name))
        else:
            updates[name] = F.coalesce(ref(name), F.lit(value).cast(dtype))
    return df.withColumns(updates) if updates else df
