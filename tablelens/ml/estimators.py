"""Spark estimators with the settings of the named models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tablelens.functions import half_even
from tablelens.session import small_table

FOREST_DEPTH = 30  # of Spark's forests, the most it allows; without further parameters forests grow fully (``trees.fit_forest``)
BINS = 128  # candidate splits of a numeric feature

REGRESSION_MODELS = {
    "ridge_regression": "Ridge Regression",
    "lasso_regression": "Lasso Regression",
    "elasticnet": "Elastic Net",
    "random_forest": "Random Forest",
    "gradient_boosting": "Gradient Boosting",
    "decision_tree": "Decision Tree",
    "knn_regressor": "K-Nearest Neighbors",
}
CLASSIFICATION_MODELS = {
    "logistic_regression": "Logistic Regression",
    "random_forest": "Random Forest",
    "gradient_boosting": "Gradient Boosting",
    "svm": "Support Vector Machine",
    "decision_tree": "Decision Tree",
    "knn": "K-Nearest Neighbors",
}


@dataclass
class TargetFacts:
    """What the penalties depend on: training rows and the target's population deviation."""

    rows: int
    spread: float
    classes: int = 2


def target_facts(train: DataFrame, label: str, problem_type: str) -> TargetFacts:
    value = F.col(label)
    if problem_type == "regression":
        row = train.agg(F.count(value).alias("n"), F.stddev_pop(value).alias("s")).first()
        return TargetFacts(row["n"], row["s"] or 0.0)
    row = train.agg(F.count(value).alias("n"), F.max(value).alias("top")).first()
    return TargetFacts(row["n"], 0.0, int(row["top"]) + 1)


def _linear(l1: float, l2: float, facts: TargetFacts, **columns: str) -> LinearRegression:
    """Least squares with penalties ``l1 * |w|`` and ``l2 / 2 * |w|²`` per row.

    Spark divides the quadratic part, but not the absolute part, by the target's deviation.
    """
    quadratic = l2 * facts.spread
    total = l1 + quadratic
    share = l1 / total if total > 0 else 0.0
    return LinearRegression(regParam=total, elasticNetParam=share, standardization=False, maxIter=5000, tol=1e-9, **columns)


def regressor(model_type: str, facts: TargetFacts, seed: int = 42, depth: int = FOREST_DEPTH, **columns: str) -> Estimator:
    if model_type == "ridge_regression":
        return _linear(0.0, 1.0 / max(facts.rows, 1), facts, **columns)
    if model_type == "lasso_regression":
        return _linear(0.001, 0.0, facts, **columns)
    if model_type == "elasticnet":
        return _linear(0.0005, 0.0005, facts, **columns)
    if model_type == "random_forest":
        return RandomForestRegressor(
            numTrees=100, minInstancesPerNode=2, maxDepth=depth, featureSubsetStrategy="all", maxMemoryInMB=1024,
            maxBins=BINS, seed=seed, **columns,
        )
    if model_type == "gradient_boosting":
        return GBTRegressor(maxIter=100, stepSize=0.05, maxDepth=3, maxBins=BINS, seed=seed, **columns)
    if model_type == "decision_tree":
        return DecisionTreeRegressor(maxDepth=8, maxBins=BINS, seed=seed, **columns)
    raise ValueError(f"model {model_type!r} is not available for regression; expected one of {sorted(REGRESSION_MODELS)}")


def classifier(model_type: str, facts: TargetFacts, seed: int = 42, depth: int = FOREST_DEPTH, **columns: str) -> Estimator:
    if model_type == "logistic_regression":
        return LogisticRegression(regParam=1.0 / max(facts.rows, 1), standardization=False, maxIter=2000, **columns)
    if model_type == "random_forest":
        return RandomForestClassifier(
            numTrees=100, minInstancesPerNode=2, maxDepth=depth, maxMemoryInMB=1024, maxBins=BINS, seed=seed, **columns
        )
    if model_type == "decision_tree":
        return DecisionTreeClassifier(maxDepth=8, maxBins=BINS, seed=seed, **columns)
    if model_type == "gradient_boosting":
        boosted = GBTClassifier(maxIter=100, stepSize=0.05, maxDepth=3, maxBins=BINS, seed=seed, **columns)
        return boosted if facts.classes == 2 else OneVsRest(classifier=boosted, parallelism=4, **columns)
    if model_type == "svm":
        linear = LinearSVC(regParam=1.0 / max(facts.rows, 1), standardization=False, **columns)
        return linear if facts.classes == 2 else OneVsRest(classifier=linear, parallelism=4, **columns)
    raise ValueError(
        f"model {model_type!r} is not available for classification; expected one of {sorted(CLASSIFICATION_MODELS)}"
    )


def estimator(
    problem_type: str, model_type: str, facts: TargetFacts, seed: int = 42, parameters: Mapping[str, Any] | None = None,
    **columns: str,
) -> Estimator:
    """The named model; ``parameters`` replace its settings (of the inner model where classes are fitted one by one)."""
    build = regressor if problem_type == "regression" else classifier
    built = build(model_type, facts, seed, **columns)
    if parameters:
        inner = built.getClassifier() if isinstance(built, OneVsRest) else built
        inner.setParams(**parameters)
        if inner is not built:
            built.setClassifier(inner)
    return built


def importance(model: Model, names: Sequence[str], df: DataFrame) -> DataFrame:
    """``(name, importance)``: tree importances or absolute coefficients to 4 decimals, largest first."""
    if hasattr(model, "featureImportances"):
        values = [float(v) for v in model.featureImportances.toArray()]
    elif hasattr(model, "coefficients"):
        values = [abs(float(v)) for v in model.coefficients.toArray()]
    else:
        values = [1.0] * len(names)
    return importance_rows(values, names, df)


def importance_rows(values: Sequence[float], names: Sequence[str], df: DataFrame) -> DataFrame:
    rows = small_table(df.sparkSession, list(zip(names, values)), "name string, importance double")
    return rows.withColumn("importance", half_even(F.col("importance"), 4)).orderBy(F.desc("importance"), "name")
