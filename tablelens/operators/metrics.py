"""Scores of predictions and what they say about a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablelens.functions import half_even
from tablelens.operators.columns import ref


def regression_metrics(scored: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, n, r2, rmse, mae)`` to 6 decimals."""
    error = ref(actual) - ref(predicted)
    squares = F.sum(error * error)
    spread = F.var_pop(ref(actual)) * F.count(ref(actual))
    r2 = F.when(spread > 0, 1.0 - squares / F.nullif(spread, F.lit(0.0))).when(squares == 0, 1.0).otherwise(0.0)
    return scored.groupBy(*[ref(c) for c in by]).agg(
        F.count(error).alias("n"),
        half_even(r2, 6).alias("r2"),
        half_even(F.sqrt(F.avg(error * error)), 6).alias("rmse"),
        half_even(F.avg(F.abs(error)), 6).alias("mae"),
    )


def classification_metrics(scored: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, n, accuracy, precision, recall, f1)``, class-weighted, to 6 decimals; 0 for empty ratios.

    Rows are reduced to the confusion counts first; the rest works on one row per class pair.
    """
    groups = list(by)
    confusion = scored.groupBy(*[ref(c) for c in groups], ref(actual).alias("a"), ref(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = confusion.select(*[ref(c) for c in groups], F.inline(F.array(
        F.struct(F.col("a").alias("class"), F.col("n").alias("support"), zero.alias("chosen"), hit.cast("long").alias("hits")),
        F.struct(F.col("p").alias("class"), zero.alias("support"), F.col("n").alias("chosen"), zero.alias("hits")),
    )))
    classes = sides.groupBy(*[ref(c) for c in groups], "class").agg(
        F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hits").alias("hits")
    )
    precision = F.coalesce(F.try_divide("hits", "chosen"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    total = F.sum("support")

    def weighted(score):
        return half_even(F.sum(score * F.col("support")) / total, 6)

    return classes.groupBy(*[ref(c) for c in groups]).agg(
        total.alias("n"),
        half_even(F.sum("hits") / total, 6).alias("accuracy"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
        weighted(f1).alias("f1"),
    )


# fixed values: (status, least train score, least train-test gap, least train-validation gap)
OVERFIT_RULES = {
    "regression": [("detected", 0.85, 0.15, 0.12), ("watch", 0.75, 0.08, 0.08)],
    "classification": [("detected", 0.95, 0.08, 0.08), ("watch", 0.85, 0.04, 0.04)],
}


def overfit_verdict(scores: DataFrame, problem_type: str) -> DataFrame:
    """Add ``generalization_gap``, ``cv_gap`` and ``status`` to rows of ``train_score, test_score, cv_mean``.

    A null ``cv_mean`` means no cross-validation was run.
    """
    if problem_type not in OVERFIT_RULES:
        raise ValueError(f"problem_type must be one of {sorted(OVERFIT_RULES)}")
    gaps = scores.withColumns({
        "generalization_gap": half_even(F.col("train_score") - F.col("test_score"), 6),
        "cv_gap": half_even(F.col("train_score") - F.col("cv_mean"), 6),
    })
    status = F.when(F.lit(False), "")
    for name, least_train, least_gap, least_cv in OVERFIT_RULES[problem_type]:
        cv_wide = F.coalesce(F.col("cv_gap") >= least_cv, F.lit(False))
        wide = (F.col("generalization_gap") >= least_gap) | cv_wide
        status = status.when((F.col("train_score") >= least_train) & wide, name)
    return gaps.withColumn("status", status.otherwise("healthy"))
