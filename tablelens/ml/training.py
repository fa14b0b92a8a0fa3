"""Train, evaluate, compare, save and apply supervised models."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelens.functions import half_even
from tablelens.ml.estimators import CLASSIFICATION_MODELS, REGRESSION_MODELS, estimator, target_facts
from tablelens.ml.permutation import moved_variants, packed_ranks
from tablelens.ml.preparation import encode_labels, fit_preparation, normal_form, prepare_training, split_preparation
from tablelens.ml.trees import Ensemble, fit_boosting, fit_forest, load_ensemble, probabilities, save_ensemble, scorer
from tablelens.operators.columns import ref
from tablelens.operators.metrics import classification_metrics, overfit_verdict, regression_metrics
from tablelens.operators.neighbours import knn_predict, nearest_neighbours, neighbour_weights
from tablelens.operators.ordering import hash_order
from tablelens.operators.sampling import assign_folds, mark_test_rows
from tablelens.session import reliable_checkpoint, small_table
from tablelens.sources.writers import read_metadata, write_metadata


PARALLEL_FOLDS = 4  # folds that are fitted at the same time
FOREST_PARAMETERS = {"numTrees", "minInstancesPerNode", "seed"}  # of a fully grown forest; others ask for Spark's
NEIGHBOURS = ("knn", "knn_regressor")
NEIGHBOUR_PARAMETERS = {"n_neighbors", "broadcast_values", "block_rows"}
ROW_PARAMETERS = {"minInstancesPerNode", "subsamplingRate", "weightCol", "validationIndicatorCol"}  # that look at single rows
BOOSTING_PARAMETERS = {"maxIter", "stepSize", "maxDepth", "minInstancesPerNode", "seed"}  # of joint boosting


@dataclass
class TrainedModel:
    """A fitted preparation and model.

    ``ensemble`` holds the trees of forests and joint boosting, ``memory`` the training rows ``(key, vector, label)`` of nearest
    neighbours with their ``options``; both follow the pipeline.
    """

    pipeline: PipelineModel
    features: list[str]
    target: str
    problem_type: str
    model_type: str
    labels: list[str] = field(default_factory=list)
    trained_at: str = ""
    ensemble: Ensemble | None = None
    memory: DataFrame | None = None
    options: dict[str, int] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows with ``prediction``; helper columns of the preparation dropped."""
        rows = normal_form(df, self.features)
        kept = {c: f"__kept_{i}" for i, c in enumerate(rows.columns) if c not in self.features}
        scored = self.predict_prepared(self.pipeline.transform(rows.withColumnsRenamed(kept)))
        made = [c for c in scored.columns if c in ("prediction", "probability", "rawPrediction")]
        given = [ref(c).alias(c) if c in self.features else F.col(kept[c]).alias(c) for c in rows.columns if c not in made]
        return scored.select(*given, *made)

    def predict_prepared(self, scored: DataFrame) -> DataFrame:
        """What the pipeline gave, with the predictions of models that follow it."""
        if self.ensemble is not None:
            scored = self._by_trees(scored)
        if self.memory is not None:
            scored = self._by_neighbours(scored)
        return scored

    def _by_trees(self, prepared: DataFrame) -> DataFrame:
        scored = prepared.withColumn("__outputs", scorer(self.ensemble)(vector_to_array("features")))
        outputs = F.col("__outputs")
        if self.problem_type == "regression":
            return scored.withColumn("prediction", outputs[0])
        shares = probabilities(outputs) if self.model_type == "gradient_boosting" else outputs
        first = (F.array_position(outputs, F.array_max(outputs)) - 1).cast("double")
        return scored.withColumns({"probability": array_to_vector(shares), "prediction": first})


    def _by_neighbours(self, prepared: DataFrame) -> DataFrame:
        """Every distinct feature vector is one query; its answer goes to all rows that have it."""
        rows = prepared.withColumn("__vector", vector_to_array("features"))
        asked = rows.select("__vector").distinct().select(F.monotonically_increasing_id().alias("key"), F.col("__vector").alias("vector"))
        asked = reliable_checkpoint(asked)
        limits = {name: self.options[name] for name in ("broadcast_values", "block_rows") if name in self.options}
        near = neighbour_weights(
            nearest_neighbours(self.memory, asked, "vector", "key", "label", self.options.get("n_neighbors", 7), **limits)
        )
        if self.problem_type == "regression":
            answer = near.groupBy("query").agg((F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).alias("prediction"))
        else:
            votes = near.groupBy("query", F.col("label").cast("int").alias("label")).agg(F.sum("weight").alias("votes"))
            by_class = votes.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("label", "votes"))).alias("votes"))
            numbers = F.transform(F.sequence(F.lit(0), F.lit(len(self.labels) - 1)), lambda c: F.coalesce(F.try_element_at("votes", c), F.lit(0.0)))
            total = F.aggregate("numbers", F.lit(0.0), lambda a, b: a + b)
            first = (F.array_position("numbers", F.array_max("numbers")) - 1).cast("double")
            answer = by_class.select("query", numbers.alias("numbers")).select(
                "query", first.alias("prediction"), array_to_vector(F.transform("numbers", lambda v: v / total)).alias("probability")
            )
        answer = asked.join(answer, asked["key"] == answer["query"]).drop("key", "query").withColumnRenamed("vector", "__vector")
        return rows.join(answer, "__vector")


def fit_model(
    train: DataFrame, features: Sequence[str], target: str, problem_type: str, model_type: str, seed: int = 42,
    labels: Sequence[str] = (), parameters: Mapping[str, Any] | None = None,
) -> TrainedModel:
    """Fit preparation and estimator on prepared rows (for classes: with their encoded ``label``)."""
    label = target if problem_type == "regression" else "label"
    preparation = fit_preparation(train, features)
    facts = target_facts(train, label, problem_type)
    if problem_type == "classification":
        facts.classes = max(len(labels), 2)
    needed = train.select(*[ref(c) for c in dict.fromkeys([*features, label])])
    vectors = preparation.transform(needed).select("features", label)
    if model_type in NEIGHBOURS:
        unknown = set(parameters or {}) - NEIGHBOUR_PARAMETERS
        if unknown:
            raise ValueError(f"nearest neighbours have no parameters {sorted(unknown)}")
        memory = vectors.select(
            F.monotonically_increasing_id().alias("key"), vector_to_array("features").alias("vector"), F.col(f"`{label}`").cast("double").alias("label")
        )
        return TrainedModel(
            preparation, list(features), target, problem_type, model_type, list(labels), dt.datetime.now(dt.timezone.utc).isoformat(),
            memory=reliable_checkpoint(memory), options=dict(parameters or {}),
        )
    ensemble, fitted = _fit_trees(vectors, label, problem_type, model_type, facts.classes, seed, dict(parameters or {})), []
    if ensemble is None:
        columns = {"featuresCol": "features", "labelCol": label}
        if model_type == "gradient_boosting" and not set(parameters or {}) & ROW_PARAMETERS:
            lines = _equal_rows(vectors, label, problem_type, facts.rows)
            if lines is not None:
                vectors, columns = lines, columns | {"weightCol": "__weight"}
        built = estimator(problem_type, model_type, facts, seed, parameters, **columns)
        fitted = [built.fit(vectors)]
    return TrainedModel(
        PipelineModel([*preparation.stages, *fitted]), list(features), target, problem_type, model_type, list(labels),
        dt.datetime.now(dt.timezone.utc).isoformat(), ensemble,
    )


def _fit_trees(
    vectors: DataFrame, label: str, problem_type: str, model_type: str, classes: int, seed: int, parameters: dict[str, Any]
) -> Ensemble | None:
    """Fully grown forests and joint boosting of several classes; None for models that Spark fits."""
    few = problem_type == "classification"
    if model_type == "random_forest" and not set(parameters) - FOREST_PARAMETERS:
        return fit_forest(
            vectors, label, parameters.get("numTrees", 100), parameters.get("minInstancesPerNode", 2), classes if few else None,
            parameters.get("seed", seed),
        )
    if model_type == "gradient_boosting" and few and classes > 2:
        unknown = set(parameters) - BOOSTING_PARAMETERS
        if unknown:
            raise ValueError(f"parameters of boosting with several classes are {sorted(BOOSTING_PARAMETERS)}, not {sorted(unknown)}")
        return fit_boosting(
            vectors, classes, label, parameters.get("maxIter", 100), parameters.get("stepSize", 0.05), parameters.get("maxDepth", 3),
            parameters.get("minInstancesPerNode", 1), parameters.get("seed", seed),
        )
    return None


def _equal_rows(vectors: DataFrame, label: str, problem_type: str, rows: int) -> DataFrame | None:
    """Rows of equal features (and class) as one line with the mean target and their number as ``__weight``.

    Boosting reads its rows hundreds of times; the gradients of such rows add up to the same sums. None where the lines are more than half
    of the rows, or a target is missing.
    """
    target = F.col(f"`{label}`")
    keys = ["features"] if problem_type == "regression" else ["features", label]
    value = F.avg(target.cast("double")).alias(label) if problem_type == "regression" else None
    lines = vectors.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("__weight"), *([] if value is None else [value]))
    lines = reliable_checkpoint(lines)
    facts = lines.agg(F.count(F.lit(1)).alias("n"), F.sum("__weight").alias("rows")).first()
    return lines if facts["rows"] == rows and 2 * facts["n"] <= rows else None


def knn_batch(
    train: DataFrame, test: DataFrame, features: Sequence[str], target: str, problem_type: str, key: str, k: int = 7
) -> DataFrame:
    """``(query, prediction)`` of distance-weighted nearest neighbours on the prepared features.

    ``key`` is a whole-number column that identifies a row. This model has no fitted
    parameters besides its preparation: the training rows are the model.
    """
    preparation = fit_preparation(normal_form(train, features), features)

    def vectors(rows: DataFrame) -> DataFrame:
        prepared = preparation.transform(normal_form(rows, features))
        return prepared.withColumn("vector", vector_to_array("features")).select(ref(key), ref(target), "vector")

    return knn_predict(vectors(train), vectors(test), "vector", key, target, k, problem_type)


def score(model: TrainedModel, rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of the model on rows that hold the target (or encoded ``label``)."""
    scored = model.transform(rows)
    if model.problem_type == "regression":
        return regression_metrics(scored, model.target, "prediction", by)
    return classification_metrics(scored, "label", "prediction", by)


def main_metric(problem_type: str) -> str:
    return "r2" if problem_type == "regression" else "accuracy"


def cross_validate(
    rows: DataFrame, features: Sequence[str], target: str, problem_type: str, model_type: str, key: Sequence[str],
    folds: int = 5, seed: int = 42, labels: Sequence[str] = (), parameters: Mapping[str, Any] | None = None,
) -> list[float]:
    """Main metric on each held-out fold; folds are shuffled, and stratified for classes."""
    label = "label" if problem_type == "classification" else None
    if label:
        smallest = rows.groupBy("label").count().agg(F.min("count")).first()[0]
        folds = max(2, min(folds, smallest))
    folded = reliable_checkpoint(assign_folds(rows, folds, key, label, seed))

    def held_out(fold: int) -> float:
        model = fit_model(folded.filter(F.col("fold") != fold), features, target, problem_type, model_type, seed, labels, parameters)
        return score(model, folded.filter(F.col("fold") == fold)).first()[main_metric(problem_type)]

    # folds are independent: their jobs share the cluster instead of waiting for each other
    with ThreadPoolExecutor(min(folds, PARALLEL_FOLDS)) as pool:
        return list(pool.map(inheritable_thread_target(rows.sparkSession)(held_out), range(folds)))


def offset_of(rows: int, feature: int, repeat: int, seed: int) -> int:
    """How far one repeat moves a feature's values along the ranks: 1 to rows - 1, from the MD5 of seed, feature and repeat."""
    digits = hashlib.md5(f"{seed}|{feature}|{repeat}".encode()).hexdigest()[:15]
    return 1 + int(digits, 16) % max(rows - 1, 1)


def permutation_importance(
    model: TrainedModel, rows: DataFrame, key: Sequence[str], repeats: int = 3, seed: int = 42
) -> DataFrame:
    """``(name, importance)``: mean drop of the main metric when one feature's values are exchanged.

    Rows get exact pseudo-random ranks once. A repeat moves a feature's values by an offset of its own along the
    ranks, round the end. Features are imputed, scaled and looked up once per row; their numbers meet the moved ones as packed blocks in
    one exchange, and all variants are scored in one job, so the number of jobs does not depend on features or repeats.
    """
    metric = main_metric(model.problem_type)
    label = model.target if model.problem_type == "regression" else "label"
    preparing, columns, scoring = split_preparation(model.pipeline, model.features)
    ties = [f"__key{i}" for i in range(len(key))]
    needed = normal_form(rows.select(
        *[ref(c) for c in dict.fromkeys(model.features)], hash_order(key, seed).alias("__order"),
        *[ref(c).alias(t) for c, t in zip(key, ties)], ref(label).cast("double").alias("__actual"),
    ), model.features)
    # a missing target is told by a number of its own: numbers travel packed
    numbers = preparing.transform(needed).select("__order", *ties, *columns, F.coalesce("__actual", F.lit(0.0)).alias("__actual"), (
        F.col("__actual").isNotNull().cast("double").alias("__known")
    ))
    chunks, starts = packed_ranks(numbers, "__order", ties, [*columns, "__actual", "__known"])
    total = starts[-1]
    if not total:
        raise ValueError("permutation importance needs at least one row")
    moves = [(f, offset_of(total, f, k, seed)) for f in range(len(model.features)) for k in range(repeats)]
    variants = moved_variants(chunks, starts, len(columns) + 2, moves)
    actual, known = f"c{len(columns)}", f"c{len(columns) + 1}"
    prepared = scoring.transform(variants.select(
        "variant", F.when(F.col(known) == 1.0, F.col(actual)).alias("__actual"), *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
    ))
    measure = regression_metrics if model.problem_type == "regression" else classification_metrics
    found = measure(model.predict_prepared(prepared), "__actual", "prediction", ["variant"]).collect()
    scores = {divmod(r["variant"] - 1, max(repeats, 1)) if r["variant"] else (-1, 0): r[metric] for r in found}
    base = scores[-1, 0]
    records = [
        (name, base - sum(scores[f, k] for k in range(repeats)) / repeats) for f, name in enumerate(model.features)
    ] if repeats else [(name, 0.0) for name in model.features]
    table = small_table(rows.sparkSession, records, "name string, importance double")
    return table.withColumn("importance", half_even(F.col("importance"), 6)).orderBy(F.desc("importance"), "name")


@dataclass
class TrainResult:
    model: TrainedModel
    metrics: DataFrame
    cv_scores: list[float]
    importance: DataFrame | None
    sample_predictions: DataFrame


def train(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    problem_type: str,
    model_type: str,
    key: Sequence[str],
    test_size: float = 0.2,
    cv_folds: int = 5,
    seed: int = 42,
    importance_repeats: int = 3,
    parameters: Mapping[str, Any] | None = None,
) -> TrainResult:
    """The whole training workflow; ``key`` names the columns that identify a row.

    ``cv_folds=0`` and ``importance_repeats=0`` leave those steps out; ``parameters`` replace settings of
    the model, e.g. ``{"maxDepth": 10, "numTrees": 300}``.
    """
    _check_model(problem_type, model_type)
    marked, labels = _split_once(df, features, target, problem_type, key, test_size, seed)
    return _train_on(
        marked, labels, features, target, problem_type, model_type, key, cv_folds, seed, importance_repeats, parameters
    )


def _check_model(problem_type: str, model_type: str) -> None:
    if model_type not in (REGRESSION_MODELS if problem_type == "regression" else CLASSIFICATION_MODELS):
        raise ValueError(f"model {model_type!r} is not available for {problem_type}")


def _split_once(
    df: DataFrame, features: Sequence[str], target: str, problem_type: str, key: Sequence[str], test_size: float, seed: int
) -> tuple[DataFrame, list[str]]:
    """Prepared rows with ``is_test``, checkpointed since every fit and score reads them, and the class labels."""
    kept = df.select(*[ref(c) for c in dict.fromkeys([*key, *features, target])])
    rows = prepare_training(kept, features, target, problem_type)
    labels: list[str] = []
    if problem_type == "classification":
        rows, labels = encode_labels(rows, target)
    return reliable_checkpoint(mark_test_rows(rows, test_size, key, "label" if labels else None, seed)), labels


def _train_on(
    marked: DataFrame, labels: list[str], features: Sequence[str], target: str, problem_type: str, model_type: str,
    key: Sequence[str], cv_folds: int, seed: int, importance_repeats: int, parameters: Mapping[str, Any] | None,
) -> TrainResult:
    train_rows = marked.filter(~F.col("is_test"))
    test_rows = marked.filter("is_test")
    model = fit_model(train_rows, features, target, problem_type, model_type, seed, labels, parameters)
    main = main_metric(problem_type)
    scores = {row["is_test"]: row for row in score(model, marked, ["is_test"]).collect()}
    cv = []
    if cv_folds:
        cv = cross_validate(marked.drop("is_test"), features, target, problem_type, model_type, key, cv_folds, seed, labels, parameters)
    cv_mean = round(sum(cv) / len(cv), 6) if cv else None
    cv_std = round(math.sqrt(sum((s - sum(cv) / len(cv)) ** 2 for s in cv) / len(cv)), 6) if cv else None
    details = [c for c in scores[True].asDict() if c not in ("is_test", "n", main)]
    record = (
        model_type, scores[False]["n"], scores[True]["n"], scores[False][main], scores[True][main], cv_mean, cv_std,
        *[scores[True][c] for c in details],
    )
    schema = "model_type string, train_rows long, test_rows long, train_score double, test_score double, cv_mean double, cv_std double"
    schema += "".join(f", test_{c} double" for c in details)
    metrics = overfit_verdict(small_table(marked.sparkSession, [record], schema), problem_type)
    importances = None
    if importance_repeats:
        importances = permutation_importance(model, test_rows.drop("is_test"), key, importance_repeats, seed)
    return TrainResult(model, metrics, cv, importances, sample_predictions(model, test_rows, key))


def sample_predictions(model: TrainedModel, rows: DataFrame, key: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows by key as ``(actual, predicted)``, with the padded axis range for numbers."""
    first = rows.orderBy(*[ref(c) for c in key]).limit(n)
    if model.problem_type == "classification":
        return predict_batch(model, first).select(ref(model.target).alias("actual"), F.col("prediction_label").alias("predicted"))
    pairs = model.transform(first).select(ref(model.target).alias("actual"), F.col("prediction").alias("predicted"))
    low = F.least(F.min("actual"), F.min("predicted"))
    high = F.greatest(F.max("actual"), F.max("predicted"))
    pad = F.when(low == high, 1.0).otherwise((high - low) * 0.05)
    axis = pairs.agg((low - pad).alias("axis_low"), (high + pad).alias("axis_high"))
    return pairs.withColumn("axis_low", axis.select("axis_low").scalar()).withColumn("axis_high", axis.select("axis_high").scalar())


def compare_models(
    df: DataFrame, features: Sequence[str], target: str, problem_type: str, models: Sequence[str], key: Sequence[str],
    test_size: float = 0.2, cv_folds: int = 5, seed: int = 42, importance_repeats: int = 3,
    parameters: Mapping[str, Mapping[str, Any]] | None = None,
) -> tuple[DataFrame, TrainResult]:
    """Metrics of each model, ``position`` in the given order and ``best`` marked, and the best result.

    The rows are split and prepared once; ``parameters`` holds settings by model.
    """
    if not models:
        raise ValueError("no models to compare")
    for model in models:
        _check_model(problem_type, model)
    marked, labels = _split_once(df, features, target, problem_type, key, test_size, seed)
    results = [
        _train_on(
            marked, labels, features, target, problem_type, model, key, cv_folds, seed, importance_repeats,
            (parameters or {}).get(model),
        )
        for model in models
    ]
    scores = [result.metrics.select("test_score").first()[0] for result in results]
    best = scores.index(max(scores))
    table = None
    for position, result in enumerate(results):
        rows = result.metrics.withColumns({"position": F.lit(position), "best": F.lit(position == best)})
        table = rows if table is None else table.unionByName(rows)
    return table, results[best]


def predict_batch(model: TrainedModel, df: DataFrame, as_integer: bool = False) -> DataFrame:
    """Score a table: ``prediction``, ``prediction_label`` and, for classes, probabilities and confidence.

    Rows with a missing feature should be split off first with ``require_features``.
    """
    absent = [c for c in model.features if c not in df.columns]
    if absent:
        raise ValueError(f"missing features: {absent}")
    scored = model.transform(df)
    if model.problem_type == "regression":
        value = half_even(F.col("prediction"), 0) if as_integer else F.col("prediction")
        return scored.withColumn("prediction", value).withColumn("prediction_label", value.cast("string"))
    names = F.array(*[F.lit(name) for name in model.labels])
    labelled = scored.withColumn("prediction_label", F.element_at(names, F.col("prediction").cast("int") + 1))
    if "probability" not in scored.columns:
        return labelled.drop("rawPrediction")
    shares = F.transform(vector_to_array("probability"), lambda p: F.bround(p, 6))
    return labelled.withColumns({
        "probabilities": F.map_from_arrays(names, shares),
        "confidence": F.array_max(shares),
        "top_class": F.element_at(names, F.array_position(shares, F.array_max(shares)).cast("int")),
    }).drop("rawPrediction", "probability")


def save_model(spark: SparkSession, model: TrainedModel, location: str) -> None:
    model.pipeline.write().overwrite().save(f"{location}/pipeline")
    facts = {k: getattr(model, k) for k in ("features", "target", "problem_type", "model_type", "labels", "trained_at")}
    facts |= {"trees": model.ensemble is not None, "rows": model.memory is not None, "options": model.options}
    if model.memory is not None:
        model.memory.write.mode("overwrite").parquet(f"{location}/rows")
    if model.ensemble is not None:
        save_ensemble(spark, model.ensemble, f"{location}/trees")
    write_metadata(spark, f"{location}/metadata", facts)


def load_model(spark: SparkSession, location: str) -> TrainedModel:
    facts = read_metadata(spark, f"{location}/metadata")
    ensemble = load_ensemble(spark, f"{location}/trees") if facts.pop("trees", False) else None
    memory = spark.read.parquet(f"{location}/rows") if facts.pop("rows", False) else None
    return TrainedModel(PipelineModel.load(f"{location}/pipeline"), **facts, ensemble=ensemble, memory=memory)
