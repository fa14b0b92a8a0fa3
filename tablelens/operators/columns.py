"""Column-level operators: naming, selection, type coercion, row filters."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablelens.functions import blank_to_null, calendar_parts, finite, parse_datetime, quote_name, safe_numeric
from tablelens.session import small_table

TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
CALENDAR_TARGETS = {
    # fixed values: recognised feature names per calendar part
    "iso_date": ("year_month", "date", "invoice_date", "order_date", "period", "ds"),
    "month": ("month_number", "year_month_month"),
    "day_of_week": ("day_of_week", "weekday"),
    "quarter": ("quarter",),
    "is_weekend": ("is_weekend", "weekend"),
    "year": ("year_number", "year"),
}


def ref(name: str) -> Column:
    """Column by exact name, dots and spaces included."""
    return F.col(quote_name(name))


def field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {field.name: field.dataType for field in df.schema.fields}


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def columns_by_role(df: DataFrame, role: str) -> list[str]:
    """Names of the numeric, categorical (text or boolean) or temporal columns, in table order."""
    tests = {
        "numeric": is_numeric,
        "categorical": lambda dtype: isinstance(dtype, (T.StringType, T.BooleanType)),
        "temporal": lambda dtype: isinstance(dtype, TEMPORAL),
    }
    if role not in tests:
        raise ValueError(f"unknown role {role!r}; expected one of {sorted(tests)}")
    return [field.name for field in df.schema.fields if tests[role](field.dataType)]


def missing(df: DataFrame, name: str) -> Column:
    """True where the cell is null, or NaN in a floating column."""
    value = ref(name)
    if isinstance(field_types(df)[name], (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """Rows of ``(kept columns, name, value)``, one per cell of the named columns, values as text."""
    kept = [column.alias(f"__keep{i}") for i, column in enumerate(keep)]
    cells = df.select(*kept, *[ref(name).cast("string").alias(name) for name in columns])
    ids = [F.col(f"__keep{i}") for i in range(len(kept))]
    return cells.unpivot(ids, [ref(name) for name in columns], "name", "value")


HEAD_ROWS = 4  # times the wanted number of values, of rows looked at first


def first_values(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` non-empty values of each column by ``order_by``: ``(name, place, value)``; ties go to the smaller value.

    The first rows of the table settle most columns: each task keeps a bounded heap of rows, and nothing is sorted. A
    column is settled if it has ``n`` values before the last of those rows. The others are looked for once more among rows that
    have a value in one of them; what is still open is ranked column by column.
    """
    found, left = [], list(dict.fromkeys(columns))
    for turn in range(2):
        if left:
            settled = _head_values(df, left, order_by, n, every=turn == 0)
            found += [(name, place, value) for name, values in settled.items() for place, value in enumerate(values, 1)]
            left = [name for name in left if name not in settled]
    known = small_table(df.sparkSession, found, "name string, place int, value string")
    if not left:
        return known
    cells = long_form(df, left, [ref(c) for c in order_by]).filter(F.col("value").isNotNull() & (F.col("value") != ""))
    order = [F.col(f"__keep{i}") for i in range(len(order_by))] + [F.col("value")]
    place = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    return known.unionByName(cells.withColumn("place", place).filter(F.col("place") <= n).select("name", "place", "value"))


def _head_values(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], n: int, every: bool) -> dict[str, list[str]]:
    """The first values of the columns that the first rows settle."""
    cells = [F.when(ref(name).cast("string") != "", ref(name).cast("string")).alias(f"v{i}") for i, name in enumerate(columns)]
    keys = [ref(name).alias(f"k{i}") for i, name in enumerate(order_by)]
    rows = df.select(*keys, *cells)
    if not every:
        rows = rows.where(F.coalesce(*[F.col(f"v{i}") for i in range(len(columns))]).isNotNull())
    most = max(HEAD_ROWS * n, 20)
    # rows that tie with the last one may have ties behind it, so they settle nothing
    table = rows.orderBy(*[F.col(f"k{i}") for i in range(len(keys))]).limit(most).collect()
    whole = len(table) < most
    plain = lambda value: value + 0.0 if isinstance(value, float) else value
    key = lambda row: repr([plain(row[f"k{i}"]) for i in range(len(keys))])
    last = None if whole or not table else key(table[-1])
    blocks = [list(rows) for same, rows in groupby(table, key) if whole or same != last]
    settled = {}
    for i, name in enumerate(columns):
        values = [value for block in blocks for value in sorted(row[f"v{i}"] for row in block if row[f"v{i}"] is not None)][:n]
        if whole or len(values) == n:
            settled[name] = values
    return settled


# ---------------------------------------------------------------- names


def plain_name(name: str) -> str:
    """Each non-alphanumeric character to ``_``, lower case, trimmed, one pass of ``__`` to ``_``."""
    return re.sub(r"[\W_]", "_", name.lower()).strip("_").replace("__", "_")


def snake_name(name: str) -> str:
    """Lower case, each run of other characters to one ``_``, one ``_`` dropped at each end."""
    return re.sub(r"^_|_$", "", re.sub(r"[^a-z0-9]+", "_", name.lower()))


def standard_names(names: Sequence[str], style: str = "plain") -> list[str]:
    """New names for all columns; empty ones become ``column_i``, collisions get ``_2``, ``_3``…"""
    if style not in ("plain", "snake"):
        raise ValueError("style must be 'plain' or 'snake'")
    convert = plain_name if style == "plain" else snake_name
    taken: set[str] = set()
    result = []
    for position, name in enumerate(names, start=1):
        base = convert(name) or f"column_{position}"
        candidate, suffix = base, 2
        while candidate in taken:
            candidate, suffix = f"{base}_{suffix}", suffix + 1
        taken.add(candidate)
        result.append(candidate)
    return result


def standardize_names(df: DataFrame, style: str = "plain") -> DataFrame:
    return df.toDF(*standard_names(df.columns, style))


def names_would_change(df: DataFrame, style: str = "snake") -> bool:
    return standard_names(df.columns, style) != df.columns


def resolve_columns(requested: Iterable[str], available: Sequence[str]) -> dict[str, str]:
    """Requested name to table name: exact, else equal after normalising (first column wins)."""
    normalised: dict[str, str] = {}
    for name in available:
        normalised.setdefault(plain_name(name), name)
    resolved, absent = {}, []
    for name in requested:
        match = name if name in available else normalised.get(plain_name(name))
        if match is None:
            absent.append(name)
        else:
            resolved[name] = match
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return resolved


def select_resolved(df: DataFrame, requested: Sequence[str]) -> DataFrame:
    resolved = resolve_columns(requested, df.columns)
    return df.select(*[ref(resolved[name]).alias(name) for name in requested])


def select_required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The requested columns with blank text read as missing."""
    return blanks_to_null(select_resolved(df, columns))


# ---------------------------------------------------------------- values


def blanks_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            blank_to_null(ref(name)).alias(name) if isinstance(dtype, T.StringType) else ref(name)
            for name, dtype in field_types(df).items()
        ]
    )


def normalize_features(df: DataFrame) -> DataFrame:
    """Model input form: blank text to null, temporal columns to text."""

    def form(name: str, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StringType):
            return blank_to_null(ref(name)).alias(name)
        if isinstance(dtype, TEMPORAL):
            return F.date_format(ref(name), "yyyy-MM-dd HH:mm:ss").alias(name)
        return ref(name)

    return df.select(*[form(name, dtype) for name, dtype in field_types(df).items()])


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coerce the named columns to double; what does not read as a finite number becomes null."""
    types = field_types(df)
    return df.withColumns({name: safe_numeric(ref(name), types[name]) for name in columns})


def finite_values(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The named numeric columns as doubles, null instead of NaN and infinities."""
    types = field_types(df)
    floating = (T.DoubleType, T.FloatType)
    return [finite(ref(name)) if isinstance(types[name], floating) else ref(name).cast("double") for name in columns]


def finite_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named numeric columns, as doubles without NaN and infinities."""
    return df.select(*[value.alias(name) for name, value in zip(columns, finite_values(df, columns))])


def json_safe(df: DataFrame) -> DataFrame:
    """Values as a JSON document can hold them: no NaN or infinity, no decimals, temporal as ISO text."""

    def form(name: str, dtype: T.DataType) -> Column:
        value = ref(name)
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return finite(value).alias(name)
        if isinstance(dtype, T.DecimalType):
            return value.cast("double").alias(name)
        if isinstance(dtype, T.DateType):
            return F.date_format(value, "yyyy-MM-dd").alias(name)
        if isinstance(dtype, TEMPORAL):
            seconds = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(value, "SSSSSS")
            return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros)).alias(name)
        return value

    return df.select(*[form(name, dtype) for name, dtype in field_types(df).items()])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where two nulls are equal; the keys of the left side are kept."""
    renamed = right.withColumnsRenamed({k: f"__right_{i}" for i, k in enumerate(keys)})
    condition = F.lit(True)
    for i, key in enumerate(keys):
        condition = condition & left[f"`{key}`"].eqNullSafe(renamed[f"__right_{i}"])
    return left.join(renamed, condition, how).drop(*[f"__right_{i}" for i in range(len(keys))])


# ---------------------------------------------------------------- dates


def detect_date_columns(
    df: DataFrame, order_by: Sequence[str] = (), min_ratio: float = 0.6, sample: int | None = None
) -> DataFrame:
    """Share of parsable dates among the non-null values of each text column.

    One aggregation over all rows, or, if asked for, over the first ``sample`` values per column in ``order_by`` order.
    """
    if not 0 < min_ratio <= 1:
        raise ValueError("min_ratio must be in (0, 1]")
    text = [name for name, dtype in field_types(df).items() if isinstance(dtype, T.StringType)]
    if not text:
        return small_table(df.sparkSession, [], "name string, parsed_share double, is_date boolean")
    if sample is None:
        shares = df.agg(*[
            F.avg(F.when(ref(n).isNotNull(), F.when(parse_datetime(ref(n)).isNotNull(), 1.0).otherwise(0.0))).alias(f"d{i}")
            for i, n in enumerate(text)
        ])
        cells = [F.struct(F.lit(n).alias("name"), F.col(f"d{i}").alias("parsed_share")) for i, n in enumerate(text)]
        found = shares.select(F.inline(F.array(*cells))).filter("parsed_share IS NOT NULL")
        return found.withColumn("is_date", F.col("parsed_share") >= min_ratio)
    first = first_values(df, text, order_by, sample)
    parsed = F.when(parse_datetime(F.col("value")).isNotNull(), 1.0).otherwise(0.0)
    return (
        first.groupBy("name")
        .agg(F.avg(parsed).alias("parsed_share"))
        .withColumn("is_date", F.col("parsed_share") >= min_ratio)
    )


def convert_dates(df: DataFrame, columns: Sequence[str], as_type: str = "text") -> DataFrame:
    """The named columns as ``yyyy-MM-dd`` text (or dates); what does not parse becomes null."""
    if as_type not in ("text", "date"):
        raise ValueError("as_type must be 'text' or 'date'")
    types = field_types(df)

    def convert(name: str) -> Column:
        moment = parse_datetime(ref(name), types[name])
        return F.to_date(moment) if as_type == "date" else F.date_format(moment, "yyyy-MM-dd")

    return df.withColumns({name: convert(name) for name in columns})


def calendar_features(
    df: DataFrame,
    date_column: str,
    targets: Mapping[str, Sequence[str]] | None = None,
    mode: str = "overwrite",
    week_start: str = "sunday",
) -> DataFrame:
    """Fill calendar features from a date.

    ``targets`` maps a calendar part to the columns that hold it; by default the columns
    already in the table that carry a recognised name. ``mode='fill'`` touches only empty cells.
    """
    if mode not in ("overwrite", "fill"):
        raise ValueError("mode must be 'overwrite' or 'fill'")
    types = field_types(df)
    parts = calendar_parts(parse_datetime(ref(date_column), types[date_column]), week_start)
    if targets is None:
        lowered = {name.lower(): name for name in df.columns}
        targets = {
            part: [lowered[known] for known in names if known in lowered and lowered[known] != date_column]
            for part, names in CALENDAR_TARGETS.items()
        }
    updates = {}
    for part, names in targets.items():
        for name in names:
            value = parts[part]
            if mode == "fill" and name in types:
                empty = ref(name).isNull() | (ref(name).cast("string") == "")
                value = F.when(empty, value.cast(types[name])).otherwise(ref(name))
            updates[name] = value
    return df.withColumns(updates)


# ---------------------------------------------------------------- rows


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def require_features(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every feature present, and the rejected rest with the list of what is absent."""
    absent_names = F.array_compact(
        F.array(*[
            F.when(ref(name).isNull() | (ref(name).cast("string") == ""), F.lit(name))
            for name in features
        ])
    )
    marked = df.withColumn("missing_features", absent_names)
    accepted = marked.filter(F.size("missing_features") == 0).drop("missing_features")
    return accepted, marked.filter(F.size("missing_features") > 0)


def non_constant(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns with more than one distinct finite value; one aggregation over the table."""
    names = list(columns) if columns is not None else columns_by_role(df, "numeric")
    if not names:
        return []
    spread = [
        (F.min(finite(ref(name))) != F.max(finite(ref(name)))).alias(f"c{i}") for i, name in enumerate(names)
    ]
    row = df.agg(*spread).first()
    return [name for i, name in enumerate(names) if row[f"c{i}"]]
