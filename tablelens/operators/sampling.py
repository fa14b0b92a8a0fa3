"""Exact-size, reproducible samples, splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.operators.columns import ref
from tablelens.operators.ordering import BROADCAST_GROUPS, hash_rank, mark_lowest, with_row_index
from tablelens.session import reliable_checkpoint


def _quotas(df: DataFrame, label: str, share: Column, wanted: Column, groups: int) -> DataFrame:
    """``(label, quota)`` by largest remainder: whole parts first, then one more to the largest fractions.

    Up to 10,000 classes are ranked in one window; more are ranked by range partitions.
    """
    classes = df.groupBy(ref(label).alias("__class")).agg(F.count(F.lit(1)).alias("__n"))
    if groups > BROADCAST_GROUPS:
        classes = reliable_checkpoint(classes)
    total = F.broadcast(classes.agg(F.sum("__n").alias("__total")))
    sized = classes.join(total)
    exact = F.col("__n") * wanted / F.col("__total") if share is None else F.col("__n") * share
    sized = sized.withColumn("__exact", exact).withColumn("__whole", F.floor("__exact"))
    target = wanted if share is None else F.ceil(F.col("__total") * share)
    sized = sized.withColumn("__part", F.col("__whole") - F.col("__exact"))
    left = F.broadcast(sized.groupBy("__total").agg(F.sum("__whole").alias("__given")).withColumn("__left", target - F.col("__given")))
    if groups > BROADCAST_GROUPS:
        ranked = with_row_index(sized, ["__part", "__class"], "__rank")
    else:
        place = F.row_number().over(Window.partitionBy("__total").orderBy("__part", "__class")) - 1
        ranked = sized.withColumn("__rank", place)
    ranked = ranked.join(left.select("__left"))
    extra = F.when(F.col("__rank") < F.col("__left"), 1).otherwise(0)
    return ranked.select("__class", (F.col("__whole") + extra).alias("__quota"))


def _class_facts(df: DataFrame, label: str | None) -> tuple[int, int, int]:
    """Number of rows, number of classes and size of the smallest class."""
    counts = df.groupBy(*([ref(label)] if label else [])).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("groups"), F.min("n").alias("least")).first()
    return row["total"] or 0, row["groups"], row["least"] or 0


def stratified_sample(df: DataFrame, n: int, key: Sequence[str], label: str | None = None, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if fewer) in reproducible pseudo-random choice, class shares kept.

    ``key`` names the columns that identify a row.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    total, groups, _ = _class_facts(df, label)
    if total <= n:
        return df
    if label is None:
        quotas = df.sparkSession.range(1).select(F.lit(0).alias("__class"), F.lit(n).alias("__quota"))
    else:
        quotas = _quotas(df, label, None, F.lit(n), groups)
    return mark_lowest(df, key, seed, quotas, label, groups, "__kept").filter("__kept").drop("__kept")


def mark_test_rows(
    df: DataFrame, test_size: float, key: Sequence[str], label: str | None = None, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: ``ceil(test_size * N)`` rows, stratified when every class has two rows."""
    if not 0.1 <= test_size <= 0.4:
        raise ValueError("test_size must be between 0.1 and 0.4")
    _, groups, smallest = _class_facts(df, label)
    if label is not None and smallest < 2:
        label, groups = None, 1
    if label is None:
        quotas = df.agg(F.lit(0).alias("__class"), F.ceil(F.count(F.lit(1)) * test_size).alias("__quota"))
    else:
        quotas = _quotas(df, label, F.lit(test_size), F.lit(0), groups)
    return mark_lowest(df, key, seed, quotas, label, groups, "is_test")


def train_test_split(
    df: DataFrame, test_size: float, key: Sequence[str], label: str | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    marked = mark_test_rows(df, test_size, key, label, seed)
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")


def assign_folds(df: DataFrame, folds: int, key: Sequence[str], label: str | None = None, seed: int = 42) -> DataFrame:
    """Add ``fold``: shuffled, equal-sized up to one row, spread evenly inside each class."""
    if not 2 <= folds <= 10:
        raise ValueError("cv_folds must be between 2 and 10")
    ranked = hash_rank(df, key, seed, [label] if label else [])
    return ranked.withColumn("fold", (F.col("hash_rank") % folds).cast("int")).drop("hash_rank")
