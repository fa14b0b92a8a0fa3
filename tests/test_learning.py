import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablelens.ml import preparation as Pr, training as Tr
from tablelens.operators import advisor as A, metrics as Me, sampling as Sa, scoring as Sc
from tablelens.operators.neighbours import knn_predict, nearest_neighbours, visited_cells

PROFILE = "position int, name string, nonNull long, nullCount long, uniqueCount long, role string"


@pytest.fixture(scope="module")
def people(spark):
    generator = random.Random(11)
    rows = []
    for i in range(300):
        age, city = generator.gauss(40, 10), generator.choice(["x", "x", "y", "z'q"])
        city = "rare" if i < 4 else None if i < 8 else city
        rows.append((i, None if i % 17 == 0 else age, city, 3 * age + (20 if city == "y" else 0) + generator.gauss(0, 1)))
    return spark.createDataFrame(rows, "id long, age double, city string, pay double")


def test_preparation_literals(people):
    stages = Pr.fit_preparation(people, ["age", "city"])
    prepared = stages.transform(people)
    slots = np.array(prepared.select(vector_to_array("features").alias("v")).toPandas()["v"].tolist())
    assert slots[:, 0].mean() == pytest.approx(0) and slots[:, 0].std() == pytest.approx(1)
    assert (slots[:, 1:].sum(axis=1) == 1).all()
    unseen = people.limit(1).withColumn("city", F.lit("moon"))
    rare = people.filter("city = 'rare'").limit(1)
    tail = [stages.transform(t).select(vector_to_array("features").alias("v")).first().v[1:] for t in (unseen, rare)]
    assert tail[0] == tail[1]


@pytest.mark.parametrize("model_type, penalty", [("ridge_regression", 1.0), ("lasso_regression", 0.0)])
def test_linear_models_follow_the_data(people, model_type, penalty):
    result = Tr.train(people, ["age", "city"], "pay", "regression", model_type, ["id"], cv_folds=2, importance_repeats=1)
    row = result.metrics.first()
    assert row.train_rows + row.test_rows == 300 and row.test_rows == 60
    assert row.test_score > 0.7
    names = [r.name for r in result.importance.collect()]
    assert names[0] == "age"


def test_ridge_equals_closed_form(people):
    rows = people.dropna().select("age", "pay")
    model = Tr.fit_model(rows, ["age"], "pay", "regression", "ridge_regression")
    local = rows.toPandas()
    x = (local.age - local.age.mean()) / local.age.std(ddof=0)
    weight = (x * (local.pay - local.pay.mean())).sum() / (len(x) + 1)
    expected = local.pay.mean() + weight * x
    found = model.transform(rows).toPandas()["prediction"]
    assert np.allclose(sorted(found), sorted(expected), rtol=1e-6)


def test_classification_round_trip(people, spark, tmp_path):
    table = people.withColumn("group", F.when(F.col("pay") > 125, "high").otherwise("low"))
    result = Tr.train(table, ["age", "city"], "group", "classification", "logistic_regression", ["id"], cv_folds=2, importance_repeats=0)
    assert result.metrics.first().test_score > 0.8
    Tr.save_model(spark, result.model, str(tmp_path / "m"))
    loaded = Tr.load_model(spark, str(tmp_path / "m"))
    rows = Tr.predict_batch(loaded, people).collect()
    assert {r.prediction_label for r in rows} == {"high", "low"}
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-5 and r.confidence == max(r.probabilities.values()) for r in rows)
    with pytest.raises(ValueError, match="missing features"):
        Tr.predict_batch(loaded, people.drop("city"))


def test_training_guards(people, frame):
    few = people.limit(9)
    with pytest.raises(ValueError, match="10"):
        Pr.prepare_training(few, ["age"], "pay", "regression")
    with pytest.raises(ValueError, match="two target classes"):
        Pr.prepare_training(people.withColumn("one", F.lit("a")), ["age"], "one", "classification")
    with pytest.raises(ValueError, match="not available"):
        Tr.train(people, ["age"], "pay", "regression", "svr", ["id"])
    with pytest.raises(ValueError):
        Sa.mark_test_rows(people, 0.5, ["id"])
    with pytest.raises(ValueError):
        Sa.assign_folds(people, 11, ["id"])


def test_split_sizes_and_shares(spark):
    table = spark.range(1000).select("id", F.when(F.col("id") < 900, "a").otherwise("b").alias("c"))
    train, test = Sa.train_test_split(table, 0.25, ["id"], "c")
    assert (train.count(), test.count()) == (750, 250)
    assert test.filter("c = 'b'").count() == 25
    assert train.join(test, "id").count() == 0
    lonely = table.withColumn("c", F.when(F.col("id") == 0, "single").otherwise("rest"))
    assert Sa.train_test_split(lonely, 0.2, ["id"], "c")[1].count() == 200
    folds = Sa.assign_folds(table, 7, ["id"], "c").groupBy("fold").count().collect()
    assert len(folds) == 7 and sum(r["count"] for r in folds) == 1000
    assert Sa.stratified_sample(table, 5000, ["id"], "c").count() == 1000


def test_neighbours_equal_brute_force_in_both_paths(spark):
    generator = np.random.default_rng(4)
    # a third of the training rows are copies of one point
    points = np.round(generator.normal(size=(240, 3)), 2)
    points[:80] = points[0]
    queries = np.round(generator.normal(size=(50, 3)), 2)
    queries[0] = points[0]
    train = spark.createDataFrame([(i, p.tolist(), i % 3) for i, p in enumerate(points)], "k long, f array<double>, y int")
    test = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "k long, f array<double>")
    expected = set()
    for i, query in enumerate(queries):
        distance = np.sqrt(((points - query) ** 2).sum(axis=1))
        expected |= {(i, int(j)) for j in np.lexsort((np.arange(240), distance))[:7]}
    for limits in ({}, {"broadcast_values": 1, "block_rows": 30}):
        found = nearest_neighbours(train, test, "f", "k", "y", **limits).collect()
        assert {(r["query"], r.neighbour) for r in found} == expected
    label = {r["query"]: r.prediction for r in knn_predict(train, test, "f", "k", "y").collect()}
    assert label[0] == 0  # seven exact copies vote with equal weight: labels 0,1,2,0,1,2,0


def test_overfit_thresholds(frame):
    rows = [(0.85, 0.70, None), (0.85, 0.71, 0.73), (0.75, 0.67, None), (0.74, 0.1, 0.1), (0.9, 0.9, None)]
    table = frame(rows, "train_score double, test_score double, cv_mean double")
    assert [r.status for r in Me.overfit_verdict(table, "regression").collect()] == ["detected", "detected", "watch", "healthy", "healthy"]
    rows = [(0.95, 0.87, None), (0.85, 0.81, None), (0.84, 0.1, None)]
    table = frame(rows, "train_score double, test_score double, cv_mean double")
    assert [r.status for r in Me.overfit_verdict(table, "classification").collect()] == ["detected", "watch", "healthy"]


def test_constant_target_scores(frame):
    table = frame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert Me.regression_metrics(table, "y", "p").first().r2 == 1.0
    assert Me.regression_metrics(table, "y", "y").first().n == 2


def test_target_rules(frame):
    def pick(rows):
        found = A.suggest_target(frame([(i, *r) for i, r in enumerate(rows)], PROFILE)).collect()
        return found[0].name if found else None

    number, text = (100, 0, 90, "numeric"), (100, 0, 3, "categorical")
    assert pick([("sales", *number), ("Deposit", *text)]) == "Deposit"
    assert pick([("sales", *number), ("churn_label", *text)]) == "churn_label"
    assert pick([("a", *number), ("color", *text)]) == "color"
    assert pick([("unit_price", *number), ("b", *number)]) == "unit_price"
    assert pick([("a", *number), ("b", *number), ("month", *number)]) == "b"
    assert pick([("order_id", *number)]) is None


def test_problem_type_confidence(frame):
    rows = [(0, "a", 100, 0, 95, "numeric"), (1, "b", 100, 0, 50, "numeric"), (2, "c", 10, 90, 5, "numeric"),
            (3, "d", 100, 0, 3, "boolean"), (4, "e", 100, 0, 10, "identifier"), (5, "f", 100, 0, 90, "datetime")]
    found = A.detect_problem_type(frame(rows, PROFILE)).orderBy("position").collect()
    assert [(r.problem_type, r.confidence) for r in found] == [
        ("regression", 70), ("regression", 90), ("regression", 60), ("classification", 85), ("classification", 75), ("classification", 60),
    ]


def test_series_columns(frame):
    rows = [(0, "when", 9, 0, 9, "datetime"), (1, "order_date", 9, 0, 9, "datetime"), (2, "x", 9, 0, 9, "numeric"), (3, "Revenue", 9, 0, 9, "numeric")]
    row = A.pick_series_columns(frame(rows, PROFILE)).first()
    assert (row.target, row.date) == ("Revenue", "order_date")


def test_scenario_has_flat_features(people):
    import datetime as dt

    rows = Sc.scenario_frame(people, ["age", "city"], 3, dt.date(2024, 1, 1)).orderBy("step").collect()
    assert [str(r.date) for r in rows] == ["2024-01-31", "2024-03-01", "2024-03-31"]
    assert len({(r.age, r.city) for r in rows}) == 1 and rows[0].city == "x"


def test_user_columns_survive_and_infinite_cells_are_filled(spark):
    rows = [(float(i), 2.0 * i + 1, f"n{i}", i) for i in range(20)] + [(float("inf"), 7.0, "odd", 99)]
    table = spark.createDataFrame(rows, "x double, y double, __mine string, features int")
    model = Tr.fit_model(table.filter("y < 40"), ["x"], "y", "regression", "ridge_regression")
    scored = model.transform(table)
    assert scored.columns == ["x", "y", "__mine", "features", "prediction"]
    odd = scored.filter("features = 99").first()
    assert odd["__mine"] == "odd" and np.isfinite(odd.prediction)


def test_parameters_reach_the_model(spark):
    table = spark.range(64).select(F.col("id").cast("double").alias("x"), (F.col("id") % 8).cast("double").alias("y"))
    flat = Tr.fit_model(table, ["x"], "y", "regression", "decision_tree", parameters={"maxDepth": 1})
    assert flat.transform(table).select("prediction").distinct().count() == 2


def test_neighbours_are_a_model(people, spark, tmp_path):
    table = people.withColumn("group", F.when(F.col("pay") > 130, "high").when(F.col("pay") > 115, "mid").otherwise("low"))
    result = Tr.train(table, ["age", "city"], "group", "classification", "knn", ["id"], cv_folds=2, importance_repeats=1, parameters={"n_neighbors": 5})
    row = result.metrics.first()
    assert row.test_score > 0.7 and row.train_score > 0.95 and len(result.cv_scores) == 2
    assert [r.name for r in result.importance.collect()][0] == "age"
    Tr.save_model(spark, result.model, str(tmp_path / "m"))
    loaded = Tr.load_model(spark, str(tmp_path / "m"))
    assert loaded.options == {"n_neighbors": 5}
    scored = Tr.predict_batch(loaded, people.unionByName(people.limit(3)))
    assert scored.count() == 303 and scored.columns == [*people.columns, "prediction", "prediction_label", "probabilities", "confidence", "top_class"]
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-5 and r.top_class == r.prediction_label for r in scored.collect())
    table, best = Tr.compare_models(people, ["age", "city"], "pay", "regression", ["knn_regressor", "ridge_regression"], ["id"], cv_folds=0, importance_repeats=0)
    scores = {r.model_type: r.test_score for r in table.collect()}
    assert scores["knn_regressor"] > 0.4 and best.model.model_type == "ridge_regression"
    with pytest.raises(ValueError, match="no parameters"):
        Tr.fit_model(people, ["age"], "pay", "regression", "knn_regressor", parameters={"depth": 3})


def test_few_cells_are_visited_on_clustered_rows(spark):
    generator = np.random.default_rng(9)
    centres = generator.normal(size=(40, 8)) * 100
    points = np.repeat(centres, 100, axis=0) + generator.normal(size=(4000, 8))
    queries = centres[:20] + generator.normal(size=(20, 8))
    train = spark.createDataFrame([(i, p.tolist(), i % 3) for i, p in enumerate(points)], "k long, f array<double>, y int")
    test = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "k long, f array<double>")
    found = {(r["query"], r.neighbour) for r in nearest_neighbours(train, test, "f", "k", "y", broadcast_values=0).collect()}
    expected = {(i, int(j)) for i, q in enumerate(queries) for j in np.argsort(((points - q) ** 2).sum(axis=1))[:7]}
    assert found == expected
    visits = visited_cells(train, test, "f", "k", "y").collect()
    assert len(visits) == 20 and visits[0]["of"] > 30
    assert sum(r.cells for r in visits) / 20 < visits[0]["of"] / 4


def test_neighbours_of_few_rows_and_no_queries(spark):
    train = spark.createDataFrame([(1, [0.0], 1), (2, [0.0], 2), (3, [5.0], 3)], "k long, f array<double>, y int")
    test = spark.createDataFrame([(9, [1.0])], "k long, f array<double>")
    for limits in ({}, {"broadcast_values": 0}):
        rows = nearest_neighbours(train, test, "f", "k", "y", 5, **limits).orderBy("distance", "neighbour").collect()
        assert [(r.distance, r.neighbour) for r in rows] == [(1.0, 1), (1.0, 2), (4.0, 3)]
        assert nearest_neighbours(train, test.limit(0), "f", "k", "y", **limits).count() == 0


@pytest.mark.parametrize("problem_type", ["regression", "classification"])
def test_boosting_fits_lines_of_equal_rows(spark, monkeypatch, problem_type):
    rows = spark.range(900).select(
        F.col("id"), (F.col("id") % 3).cast("double").alias("a"), F.concat(F.lit("c"), F.col("id") % 4).alias("c"),
        ((F.col("id") * F.col("id") * 7919) % 101 / 10 + F.col("id") % 3 * 4 + F.col("id") % 4 * F.col("id") % 4).cast("double").alias("y"), F.when(F.col("id") % 7 < F.col("id") % 3 + 2, "u").otherwise("v").alias("g"),
    )
    target = "y" if problem_type == "regression" else "g"
    encoded, labels = (rows, []) if problem_type == "regression" else Pr.encode_labels(rows, "g")
    plain, seen = Tr.estimator, []

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, table):
            seen.append(table.count())
            return self.inner.fit(table)

    monkeypatch.setattr(Tr, "estimator", lambda *a, **k: Watched(plain(*a, **k)))
    fitted = [
        Tr.fit_model(encoded, ["a", "c"], target, problem_type, "gradient_boosting", labels=labels, parameters={"maxIter": 4, "seed": 1, **more})
        for more in ({}, {"minInstancesPerNode": 1})
    ]
    assert seen[0] <= 24 and seen[1] == 900
    one, each = (sorted((r.id, r.prediction) for r in m.transform(encoded).select("id", "prediction").collect()) for m in fitted)
    assert np.allclose(one, each)


def test_many_pairs_are_met_by_cells_in_blocks(spark, monkeypatch):
    """Where distances rule nothing out, rows are sent once per block of the other side, whatever the number of cells."""
    from tablelens.operators import neighbours as Ne

    generator = np.random.default_rng(3)
    points, queries = generator.normal(size=(900, 24)), generator.normal(size=(90, 24))
    needed = np.ones((30, 30), bool)
    assert Ne._merge(needed, np.full(30, 3), np.full(30, 30), 2_000) >= 30
    assert Ne._merge(np.eye(300, dtype=bool), np.full(300, 5_000), np.full(300, 20_000), 20_000) == 1
    train = spark.createDataFrame([(i, p.tolist(), i % 3) for i, p in enumerate(points)], "k long, f array<double>, y int")
    test = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "k long, f array<double>")
    expected = {(i, int(j)) for i, q in enumerate(queries) for j in np.argsort(((points - q) ** 2).sum(axis=1))[:7]}
    monkeypatch.setattr(Ne, "BROADCAST_PAIRS", 1000)  # more pairs than that, though the points would fit a task
    plain, used = Ne._search_cells, []
    monkeypatch.setattr(Ne, "_search_cells", lambda *a: used.append(1) or plain(*a))
    found = nearest_neighbours(train, test, "f", "k", "y", block_rows=200).collect()
    assert used and {(r["query"], r.neighbour) for r in found} == expected and len(found) == 7 * 90
    texts = knn_predict(train.withColumn("y", F.concat(F.lit("t"), "y")), test, "f", "k", "y").collect()
    numbers = {r["query"]: r.prediction for r in knn_predict(train, test, "f", "k", "y").collect()}
    assert {r["query"]: r.prediction for r in texts} == {q: f"t{p}" for q, p in numbers.items()}
