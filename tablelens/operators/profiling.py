"""Column profiles and what is read off them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelens.functions import half_up, safe_numeric
from tablelens.operators.columns import (
    NESTED,
    TEMPORAL,
    field_types,
    first_values,
    is_numeric,
    missing,
    ref,
)
from tablelens.session import small_table

EXPAND_LIMIT = 4  # distinct counts computed inside one aggregation; beyond it the cells are unpivoted
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no")  # fixed values
DATE_SHAPE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"


def one_row_per_column(stats: DataFrame, columns: Sequence[str], metrics: dict[str, str]) -> DataFrame:
    """Turn a one-row frame with columns ``{metric}_{i}`` into rows ``(position, name, metrics…)``."""
    records = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("name"),
            *[F.col(f"{metric}_{i}").cast(kind).alias(metric) for metric, kind in metrics.items()],
        )
        for i, name in enumerate(columns)
    ]
    return stats.select(F.inline(F.array(*records)))


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """``(name, uniqueCount)`` of each column, nulls left out.

    Exact counts turn the cells into narrow ``(column, value)`` pairs, deduplicate them
    before the shuffle and spread them by value, so no column and no value becomes one
    task's load and the shuffled rows stay small however wide the table is.
    """
    if not columns:
        return small_table(df.sparkSession, [], "name string, uniqueCount long")
    types = field_types(df)
    value = {name: F.when(~missing(df, name), ref(name)) for name in columns}
    if approx or len(columns) <= EXPAND_LIMIT:
        count = F.approx_count_distinct if approx else F.count_distinct
        stats = df.agg(*[count(value[name]).alias(f"uniqueCount_{i}") for i, name in enumerate(columns)])
        return one_row_per_column(stats, columns, {"uniqueCount": "long"}).select("name", "uniqueCount")
    records = []
    for i, name in enumerate(columns):
        whole, real, text = _typed(value[name], types[name])
        records.append(F.struct(F.lit(i).alias("slot"), whole.alias("whole"), real.alias("real"), text.alias("text")))
    cells = df.select(F.inline(F.array(*records))).filter("whole IS NOT NULL OR real IS NOT NULL OR text IS NOT NULL")
    counted = cells.distinct().groupBy("slot").agg(F.count(F.lit(1)).alias("uniqueCount"))
    every = small_table(df.sparkSession, list(enumerate(columns)), "slot int, name string")
    joined = every.join(F.broadcast(counted), "slot", "left")
    return joined.select("name", F.coalesce("uniqueCount", F.lit(0)).alias("uniqueCount"))


def _typed(value: Column, dtype: T.DataType) -> tuple[Column, Column, Column]:
    """A cell as (whole number, real number, text), two of them null, so equal cells stay equal."""
    whole, real, text = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return value.cast("long"), real, text
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return whole, value.cast("double") + 0.0, text
    if isinstance(dtype, TEMPORAL):
        return F.unix_micros(value.cast("timestamp")), real, text
    return whole, real, value.cast("string")


def role_of(dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if is_numeric(dtype):
        return "numeric"
    if isinstance(dtype, TEMPORAL):
        return "datetime"
    return None


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """``(position, name, dtype, nonNull, nullCount, uniqueCount, role)`` of every column.

    Nested columns get null counts only.
    """
    types = field_types(df)
    names = df.columns
    flat = [name for name in names if not isinstance(types[name], NESTED)]
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(~missing(df, name)).alias(f"nonNull_{i}") for i, name in enumerate(names)],
    )
    for i in range(len(names)):
        stats = stats.withColumn(f"nullCount_{i}", F.col("rows") - F.col(f"nonNull_{i}"))
        stats = stats.withColumn(f"rows_{i}", F.col("rows"))
    counts = one_row_per_column(stats, names, {"nonNull": "long", "nullCount": "long", "rows": "long"})
    fixed = small_table(
        df.sparkSession,
        [(name, types[name].simpleString(), role_of(types[name])) for name in names],
        "name string, dtype string, typed_role string",
    )
    unique = distinct_counts(df, flat, approx)
    identifier = (F.col("uniqueCount") == F.col("rows")) & (F.col("rows") > 0)
    role = F.coalesce("typed_role", F.when(identifier, "identifier"), F.lit("categorical"))
    return (
        counts.join(F.broadcast(fixed), "name")
        .join(F.broadcast(unique), "name", "left")
        .select("position", "name", "dtype", "nonNull", "nullCount", "uniqueCount", role.alias("role"))
    )


def profile_values(df: DataFrame, order_by: Sequence[str], samples: int = 5) -> DataFrame:
    """Profile from what the cells look like, whatever the declared type.

    A column is boolean, date or number when its non-empty values are (dates and numbers: more
    than 80 %), else string; a name holding "id" or all-distinct values make it an identifier.
    """
    names = df.columns
    text = {name: F.when(ref(name).cast("string") != "", ref(name).cast("string")) for name in names}
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        value = text[name]
        word = F.lower(value)
        aggregates += [
            F.count(value).alias(f"nonNull_{i}"),
            F.count_if(word.isin(*BOOLEAN_WORDS)).alias(f"boolean_{i}"),
            F.size(F.collect_set(F.when(word.isin(*BOOLEAN_WORDS), word))).alias(f"words_{i}"),
            F.count_if(value.rlike(DATE_SHAPE)).alias(f"dates_{i}"),
            F.count(safe_numeric(value)).alias(f"numbers_{i}"),
        ]
    stats = df.agg(*aggregates)
    stats = stats.withColumns({f"rows_{i}": F.col("rows") for i in range(len(names))})
    metrics = {m: "long" for m in ("rows", "nonNull", "boolean", "words", "dates", "numbers")}
    counts = one_row_per_column(stats, names, metrics)
    unique = distinct_counts(df.select(*[text[name].alias(name) for name in names]), names)
    filled = F.col("nonNull")
    dtype = (
        F.when(filled == 0, "string")
        .when((F.col("boolean") == filled) & (F.col("words") <= 2), "boolean")
        .when(F.col("dates") / filled > 0.8, "date")
        .when(F.col("numbers") / filled > 0.8, "number")
        .otherwise("string")
    )
    all_distinct = (F.col("uniqueCount") == F.col("rows")) & (F.col("rows") > 1)
    role = (
        F.when(F.lower("name").contains("id") | all_distinct, "identifier")
        .when(F.col("dtype") == "number", "numeric")
        .when(F.col("dtype") == "boolean", "boolean")
        .when(F.col("dtype") == "date", "datetime")
        .otherwise("categorical")
    )
    profile = (
        counts.join(F.broadcast(unique), "name")
        .withColumn("dtype", dtype)
        .select(
            "position", "name", "dtype", "nonNull",
            (F.col("rows") - filled).alias("nullCount"), "uniqueCount", role.alias("role"),
        )
    )
    return enrich_samples(profile, df, order_by, samples)


def enrich_samples(profile: DataFrame, df: DataFrame, order_by: Sequence[str], samples: int = 5) -> DataFrame:
    """Give profile rows without a ``sample`` the column's first non-empty values."""
    flat = [n for n, dtype in field_types(df).items() if not isinstance(dtype, NESTED)]
    ordered = F.array_sort(F.collect_list(F.struct("place", "value")))
    taken = first_values(df, flat, order_by, samples).groupBy("name").agg(ordered["value"].alias("__sample"))
    joined = profile.join(F.broadcast(taken), "name", "left")
    empty = F.array().cast("array<string>")
    if "sample" in profile.columns:
        keep = F.when(F.size("sample") > 0, F.col("sample"))
        return joined.withColumn("sample", F.coalesce(keep, "__sample", empty)).drop("__sample")
    return joined.withColumn("sample", F.coalesce("__sample", empty)).drop("__sample")


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row ``duplicates``: rows beyond the first of each group of equal rows.

    Rows are first counted by two 64-bit hashes, which is all that is shuffled of them; whole rows are compared only where
    several rows share both.
    """
    columns = [ref(c) for c in df.columns]
    if not columns:
        return df.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("duplicates"))
    hashed = [F.to_json(ref(f.name)) if isinstance(f.dataType, T.MapType) else ref(f.name) for f in df.schema.fields]
    keys = [F.xxhash64(F.lit(k), *hashed).alias(f"__h{k}") for k in (1, 2)]
    shared = df.select(*keys).groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    alike = df.select(*columns, *keys).join(shared.select("__h1", "__h2"), ["__h1", "__h2"], "left_semi")
    groups = alike.groupBy("__h1", "__h2", *columns).agg(F.count(F.lit(1)).alias("__copies"))
    return groups.agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicates"))


def estimate_memory(df: DataFrame) -> DataFrame:
    """One row ``(rows, bytes, display)``: mean JSON length of the rows, two bytes a character, and 32 a row."""
    size = df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.avg(F.length(F.to_json(F.struct("*")))), F.lit(0.0)).alias("width")
    )
    size = size.select("rows", (F.col("width") * 2 * F.col("rows") + F.col("rows") * 32).alias("bytes"))
    return size.withColumn("display", display_bytes(F.col("bytes")))


def display_bytes(size: Column) -> Column:
    units = ("Bytes", "KB", "MB", "GB", "TB", "PB")
    text: Column | None = None
    for power, unit in enumerate(units):
        scaled = F.concat(F.round(size / float(1024**power), 2).cast("string"), F.lit(f" {unit}"))
        test = size < float(1024 ** (power + 1))
        text = F.when(test, scaled) if text is None else text.when(test, scaled)
    return text.otherwise(scaled)


def completeness(profile: DataFrame) -> DataFrame:
    """One row: share of filled cells in percent (1 decimal) and the number of missing cells."""
    cells = F.sum(F.col("nonNull") + F.col("nullCount"))
    share = F.when(cells > 0, half_up(100.0 * F.sum("nonNull") / F.nullif(cells, F.lit(0)), 1)).otherwise(0.0)
    return profile.agg(share.alias("completeness"), F.coalesce(F.sum("nullCount"), F.lit(0)).alias("missing_cells"))


def quality_signals(profile: DataFrame, sparse: int = 3, unique_share: float = 0.9) -> dict[str, DataFrame]:
    """Columns with gaps, the sparsest of them, near-unique columns, and the number of columns per role."""
    rows = F.col("nonNull") + F.col("nullCount")
    with_gaps = profile.filter("nullCount > 0").select(
        "position", "name", "nullCount",
        F.floor(F.col("nullCount") / F.greatest(rows, F.lit(1)) * 100 + 0.5).cast("long").alias("missing_percent"),
    )
    return {
        "missing": with_gaps,
        "sparsest": with_gaps.orderBy(F.desc("nullCount"), "position").limit(sparse),
        "near_unique": profile.filter((rows > 0) & (F.col("uniqueCount") / rows >= unique_share)).select("position", "name", "uniqueCount"),
        "roles": profile.groupBy("role").agg(F.count(F.lit(1)).alias("columns")),
    }
