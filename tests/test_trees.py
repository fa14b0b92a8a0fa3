import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tablelens.ml import forecasting as Mf, training as Tr, trees
from tablelens.ml.preparation import encode_labels
from tablelens.operators import series as Se


def brute_tree(x, y, w, min_leaf):
    """Nested (feature, threshold, low, high) or the leaf's value, by trying every split of every node."""
    def grow(rows):
        weight, sums = w[rows].sum(), (y[rows] * w[rows][:, None]).sum(axis=0)
        best = None
        if ((y[rows] - y[rows][0]) ** 2).sum() > 1e-15:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for a, b in zip(values[:-1], values[1:]):
                    low, high = rows[x[rows, f] <= a], rows[x[rows, f] > a]
                    if min(len(low), len(high)) >= min_leaf:
                        score = sum((((y[s] * w[s][:, None]).sum(axis=0)) ** 2).sum() / w[s].sum() for s in (low, high))
                        if best is None or score > best[0] * (1 + 1e-9):
                            best = (score, f, (a + b) / 2, low, high)
        if best is None:
            return tuple(np.round(sums / weight, 8))
        return best[1], round(best[2], 9), grow(best[3]), grow(best[4])

    return grow(np.flatnonzero(w > 0))


def nested(grown, n=0):
    if grown["feature"][n] == trees.LEAF:
        return tuple(np.round(grown["value"][n], 8))
    sides = (nested(grown, grown[side][n]) for side in ("low", "high"))
    return int(grown["feature"][n]), round(float(grown["threshold"][n]), 9), *sides


def test_growth_equals_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(40):
        n, features = rng.integers(3, 60), rng.integers(1, 4)
        x = rng.integers(0, rng.integers(2, 20), (n, features)).astype(float)
        y = rng.normal(size=(n, 1)) if trial % 2 else np.eye(3)[rng.integers(0, 3, n)]
        w, least = rng.poisson(1, n), int(rng.integers(1, 4))
        if w.sum():
            assert nested(trees.grow_tree(x, y, w, least, features, rng)) == brute_tree(x, y, w.astype(float), least)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(600, 3)), 3)
    y = np.round(np.where(x[:, 0] > 0, 3.0, 0.0) + x[:, 1] ** 2 + rng.normal(size=600) * 0.1, 3)
    kind = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    table = spark.createDataFrame([(*map(float, a), float(b), float(c)) for a, b, c in zip(x, y, kind)], "a double, b double, c double, y double, kind double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(table), x, y, kind


@pytest.mark.parametrize("estimator,options", [
    (GBTRegressor, {"maxIter": 8, "seed": 1}), (RandomForestRegressor, {"numTrees": 6, "seed": 1}), (DecisionTreeRegressor, {}),
])
def test_flat_trees_equal_spark(points, spark, estimator, options):
    table, x, _, _ = points
    model = estimator(labelCol="y", **options).fit(table)
    flat = trees.from_spark(model, spark)
    rows = model.transform(table).select("a", "b", "c", "prediction").toPandas()
    assert np.allclose(flat.evaluate(rows[["a", "b", "c"]].to_numpy()), rows[["prediction"]].to_numpy(), rtol=1e-12)
    assert np.allclose(flat.importance(3, estimator is not GBTRegressor), model.featureImportances.toArray(), atol=1e-9)


@pytest.mark.parametrize("classes", [None, 3])
def test_forest_upper_levels_and_local_growth(points, classes):
    table, x, y, kind = points
    label, target = ("y", y) if classes is None else ("kind", kind)
    whole = trees.fit_forest(table, label, 12, classes=classes)
    split = trees.fit_forest(table, label, 12, classes=classes, local_values=3 * 150)
    for forest in (whole, split):
        found = forest.evaluate(x)
        if classes is None:
            assert 1 - ((found[:, 0] - target) ** 2).sum() / ((target - target.mean()) ** 2).sum() > 0.95
        else:
            assert np.allclose(found.sum(axis=1), 1) and (found.argmax(axis=1) == target).mean() > 0.97
        assert len(forest.roots) == 12 and (forest.feature != trees.LEAF).sum() > 12 * 20
        if classes is None:  # grown to the end
            leaves = np.bincount(forest.leaves(x)[:, 0], minlength=len(forest.feature))
            assert leaves[leaves > 0].max() < 60
    numbered, _, _ = trees._numbered(table, label)
    held = numbered.toArrow().combine_chunks()
    w = trees.draws(held["id"].to_numpy(), 0, 42)
    assert w.mean() == pytest.approx(1, abs=0.15) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.06)


def test_forest_of_one_value_per_row_equals_a_local_tree(points):
    table, x, y, _ = points
    forest = trees.fit_forest(table, "y", 3, seed=7)
    held = trees._numbered(table, "y")[0].toArrow().combine_chunks()
    ids, rows = held["id"].to_numpy(), trees._matrix(held["x"].combine_chunks(), 3)
    for t in range(3):
        grown = trees.grow_tree(rows, held["y"].to_numpy()[:, None], trees.draws(ids, t, 7), 2, 3, np.random.default_rng([7, t]))
        single = trees.Ensemble(
            np.array([0]), np.array([1.0]), grown["feature"].astype(np.int64), grown["threshold"],
            grown["low"].astype(np.int64), grown["high"].astype(np.int64), grown["value"], grown["gain"],
        )
        at = forest.leaves(rows)[:, t]
        assert np.allclose(forest.value[at], single.evaluate(rows))


@pytest.mark.parametrize("classes", [None, 3])
def test_forest_of_many_rows_with_few_distinct_features(spark, monkeypatch, classes):
    """Nodes follow the distinct rows, so many rows are no reason to refuse; trees on sums equal trees on rows."""
    table = spark.range(4000).select(
        (F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 7 % 3 - 1.5).alias("b"), ((F.col("id") * 31) % 101 / 10).cast("double").alias("y"),
        ((F.col("id") % 4 + F.col("id") % 7 % 3) % 3).cast("double").alias("kind"),
    )
    table = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(table)
    label = "y" if classes is None else "kind"
    rows = table.select("a", "b").distinct().toPandas().to_numpy()
    whole = trees.fit_forest(table, label, 6, classes=classes)
    monkeypatch.setattr(trees, "NODE_LIMIT", 100)
    summed = trees.fit_forest(table, label, 6, classes=classes, local_values=200)
    assert np.allclose(summed.evaluate(rows), whole.evaluate(rows)) and len(summed.feature) == len(whole.feature)
    assert np.allclose(summed.importance(2), whole.importance(2))
    with pytest.raises(ValueError, match="nodes"):
        trees.fit_forest(table, label, 12, classes=classes, local_values=200)


def test_boosting_is_the_same_in_one_task_and_spread(points):
    table, x, _, kind = points
    one = trees.fit_boosting(table, 3, "kind", rounds=12, rate=0.2)
    many = trees.fit_boosting(table, 3, "kind", rounds=12, rate=0.2, local_values=1)
    assert np.allclose(one.evaluate(x), many.evaluate(x), atol=1e-9)
    assert (one.evaluate(x).argmax(axis=1) == kind).mean() > 0.97


def test_boosting_works_on_lines_of_equal_bins(spark, monkeypatch):
    """Rounds must not depend on the number of rows behind a line of bins and class."""
    table = spark.range(6000).select(
        (F.col("id") % 6).cast("double").alias("a"), F.when(F.col("id") % 5 == 0, 0.0).otherwise((F.col("id") % 3).cast("double")).alias("kind")
    )
    table = VectorAssembler(inputCols=["a"], outputCol="features").transform(table)

    class Never:
        def __init__(self, *args):
            raise AssertionError("12 lines need no job a level")

    monkeypatch.setattr(trees, "_Spread", Never)
    found = trees.fit_boosting(table, 3, "kind", rounds=60, rate=0.3, local_values=100).evaluate(np.arange(6.0)[:, None])
    shares = np.full((6, 3), 0.0)
    for i in range(6000):
        shares[i % 6, 0 if i % 5 == 0 else i % 3] += 1 / 1000
    assert np.allclose(trees._softmax(found), shares, atol=0.01)


def test_boosting_of_a_number_nears_group_means(points):
    table, x, y, _ = points
    halves = table.withColumn("y", F.when(F.col("a") > 0, 8.0).otherwise(2.0))
    target = np.where(x[:, 0] > 0, 8.0, 2.0)
    for options in ({}, {"local_values": 1}):
        found = trees.fit_boosting(halves, None, "y", rounds=11, rate=0.1, **options).evaluate(x)[:, 0]
        assert np.allclose(found, target + (target.mean() - target) * 0.9**11)


def test_boosting_follows_the_gradient():
    """One leaf per class on a constant feature: scores must stay at the class shares, which are the optimum."""
    y = np.array([0] * 5 + [1] * 3 + [2] * 2)
    base = np.log(np.bincount(y) / 10)
    cuts = [np.array([])]
    grown = trees.boost(trees._Held(np.zeros((10, 1)), y, cuts, base), cuts, base, 4, 0.5, 3, 1, 1)
    scores = trees._class_trees(grown, 3, base).evaluate(np.zeros((1, 1)))
    assert np.allclose(trees._softmax(scores), [[0.5, 0.3, 0.2]])


def test_multi_class_models_have_probabilities_and_can_be_saved(points, spark, tmp_path):
    table, _, _, _ = points
    rows = table.select("a", "b", F.concat(F.lit("k"), F.col("kind").cast("int")).alias("group"))
    encoded, labels = encode_labels(rows, "group")
    for name, options in (("gradient_boosting", {"maxIter": 15, "stepSize": 0.3}), ("random_forest", {"numTrees": 15}), ("random_forest", {"numTrees": 5, "maxDepth": 4})):
        model = Tr.fit_model(encoded, ["a", "b"], "group", "classification", name, labels=labels, parameters=options)
        assert (model.ensemble is None) == ("maxDepth" in options)
        Tr.save_model(spark, model, str(tmp_path / name))
        scored = Tr.predict_batch(Tr.load_model(spark, str(tmp_path / name)), rows)
        found = scored.agg(
            F.avg((F.col("prediction_label") == F.col("group")).cast("int")).alias("right"),
            F.min(F.col("top_class") == F.col("prediction_label")).alias("top"),
            F.max(F.abs(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, b: a + b) - 1)).alias("off"),
        ).first()
        assert found.right > 0.9 and found.top and found.off < 1e-5
    with pytest.raises(ValueError, match="parameters"):
        Tr.fit_model(encoded, ["a"], "group", "classification", "gradient_boosting", labels=labels, parameters={"subsamplingRate": 0.5})


def test_forest_guards(points, frame):
    table, *_ = points
    with pytest.raises(ValueError, match="nodes"):
        trees.fit_forest(table, "y", trees=10**8)
    with pytest.raises(ValueError, match="no training rows"):
        trees.fit_forest(table.limit(0), "y", 2)


def by_steps(predictor, values, first, count, lags, names):
    past, out = list(values), []
    for step in range(count):
        features = {"trend_index": float(len(past) + 1), "rolling_mean_3": np.mean(past[-3:]), "rolling_mean_6": np.mean(past[-6:]), "rolling_std_3": np.std(past[-3:])}
        features |= {f"lag_{i}": past[-i] for i in range(1, lags + 1)}
        at = first + np.timedelta64(step, "D")
        day = at.astype("datetime64[D]").item()
        features |= {"month_number": day.month, "quarter_number": (day.month + 2) // 3, "weekday_number": day.weekday(), "is_month_end": float((at + np.timedelta64(1, "D")).item().day == 1)}
        value = max(0.0, float(predictor(np.array([[features[n] for n in names]], float))[0]))
        past.append(value), out.append(value)
    return out


@pytest.mark.parametrize("model_type", Mf.FORECAST_MODELS)
def test_recursion_in_tasks_equals_a_loop(spark, model_type):
    import datetime as dt

    rng = np.random.default_rng(2)
    rows = []
    for key, length in (("long", 60), ("mid", 31), (None, 17)):
        rows += [(key, dt.date(2024, 1, 20) + dt.timedelta(days=i), float(50 + 9 * (i % 7) + rng.normal())) for i in range(length)]
    series, _ = Se.prepare_series(spark.createDataFrame(rows, "label string, at date, v double").withColumnRenamed("label", "key"), "at", "v", ["key"], "day")
    options = {"numTrees": 4} if model_type == "random_forest" else {"maxIter": 4} if model_type == "gradient_boosting" else {}
    seen = {}
    plain = Mf._fit

    def remember(*args):
        seen["last"] = plain(*args)
        return seen["last"]

    Mf._fit = remember
    try:
        result = Mf.ml_forecast(series, 5, 4, model_type=model_type, keys=["key"], parameters=options)
    finally:
        Mf._fit = plain
    names = Se.ml_feature_names(4)
    got = {(r.key, r.step): r.prediction for r in result["points"].where("part = 'future'").collect()}
    for key, length in (("long", 60), ("mid", 31), (None, 17)):
        values = [v for k, _, v in rows if k == key]
        first = np.datetime64("2024-01-20") + np.timedelta64(length, "D")
        expected = by_steps(seen["last"][0], values, first, 5, 4, names)
        assert [got[key, s] for s in range(1, 6)] == pytest.approx(expected, rel=1e-9)
    counts = {(r.key, r.part): r["count"] for r in result["points"].groupBy("key", "part").count().collect()}
    assert counts[None, "test"] == 3 and counts["long", "test"] == 12
    assert sum(r.importance for r in result["importance"].collect()) > 0


def test_forecast_depth_is_a_parameter(spark):
    import datetime as dt

    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 7)) for i in range(50)]
    series, _ = Se.prepare_series(spark.createDataFrame(rows, "at date, v double"), "at", "v", freq="day")
    flat = Mf.ml_forecast(series, 7, groups=["calendar"], model_type="random_forest", parameters={"maxDepth": 0, "numTrees": 3})["points"]
    full = Mf.ml_forecast(series, 7, groups=["calendar"], model_type="random_forest", parameters={"numTrees": 9})["points"]
    assert flat.where("part = 'future'").select("prediction").distinct().count() == 1
    assert full.where("part = 'future'").select(F.round("prediction", 1)).distinct().count() == 7
    with pytest.raises(ValueError, match="groups"):
        Mf.ml_forecast(series, 7, groups=["other"])


def test_permutation_importance_equals_a_loop(spark):
    from tablelens.operators.ordering import hash_rank

    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), str(rng.choice(["u", "v'", "w"])), float(rng.normal())) for i in range(120)]
    rows = [(i, a, s, t, 3 * a + (2 if s == "u" else 0)) for i, a, s, t in rows]
    table = spark.createDataFrame(rows, "id long, a double, s string, t double, y double")
    model = Tr.fit_model(table, ["a", "s", "t"], "y", "regression", "ridge_regression")
    got = {r.name: r.importance for r in Tr.permutation_importance(model, table, ["id"], repeats=2, seed=5).collect()}
    ranked = hash_rank(table, ["id"], 5, name="rank").toPandas().sort_values("rank").reset_index(drop=True)

    def r2(frame):
        found = model.transform(spark.createDataFrame(frame)).toPandas().sort_values("rank")
        return 1 - ((found.y - found.prediction) ** 2).sum() / ((found.y - found.y.mean()) ** 2).sum()

    base = r2(ranked)
    for f, name in enumerate(["a", "s", "t"]):
        drops = []
        for k in range(2):
            moved = ranked.copy()
            moved[name] = np.roll(ranked[name].to_numpy(), Tr.offset_of(120, f, k, 5))
            drops.append(base - r2(moved))
        assert got[name] == pytest.approx(np.mean(drops), abs=2e-6)
    assert got["a"] > got["s"] > abs(got["t"])


def test_moved_variants_equal_rolled_columns(spark, monkeypatch):
    from tablelens.ml import permutation as Pe

    monkeypatch.setattr(Pe, "BLOCK_ROWS", 50)
    table = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("order"), "id", F.col("id").cast("double").alias("a"), (
        F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("id") * 0.5).alias("b")
    ))
    chunks, starts = Pe.packed_ranks(table, "order", ["id"], ["a", "b"])
    assert starts[-1] == 5000 and chunks.agg(F.sum("size")).first()[0] == 5000
    moves = [(0, 1), (1, 4999), (1, 2600)]
    found = Pe.moved_variants(chunks, starts, 2, moves).toPandas()
    own = table.orderBy("order").select("a", "b").toPandas()
    for variant, move in enumerate([(0, 0), *moves]):
        expected = own.copy()
        expected.iloc[:, move[0]] = np.roll(own.iloc[:, move[0]].to_numpy(), move[1])
        got = found[found.variant == variant][["c0", "c1"]].to_numpy()
        rows = np.round(np.nan_to_num(expected.to_numpy(), nan=-1.0), 1)
        assert sorted(map(tuple, np.round(np.nan_to_num(got, nan=-1.0), 1))) == sorted(map(tuple, rows))


def test_permutation_importance_prepares_every_row_once(spark, monkeypatch):
    """Variants are built from prepared numbers: raw rows do not pass the whole model once per feature and repeat."""
    rows = [(i, "u" if i % 3 else None, i % 2 == 0, float(i % 5), None if i % 11 == 0 else float(i % 3 + i % 5)) for i in range(200)]
    table = spark.createDataFrame(rows, "id long, `s x` string, flag boolean, a double, y double")
    features = ["s x", "a", "flag"]
    model = Tr.fit_model(table.where("y IS NOT NULL"), features, "y", "regression", "decision_tree")
    expected = {}
    from tablelens.operators.ordering import hash_rank

    ranked = hash_rank(table, ["id"], 42, name="rank").toPandas().sort_values("rank").reset_index(drop=True)

    def r2(frame):
        given = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "id long, `s x` string, flag boolean, a double, y double, rank long")
        return Tr.score(model, given).first()["r2"]

    base = r2(ranked)
    for f, name in enumerate(features):
        moved = ranked.copy()
        moved[name] = np.roll(ranked[name].to_numpy(), Tr.offset_of(200, f, 0, 42))
        expected[name] = base - r2(moved)
    monkeypatch.setattr(Tr.TrainedModel, "transform", lambda *_: pytest.fail("whole model on raw rows"))
    got = {r.name: r.importance for r in Tr.permutation_importance(model, table, ["id"], repeats=1).collect()}
    assert got == pytest.approx(expected, abs=2e-6) and got["a"] > 0.1
    with pytest.raises(ValueError, match="at least one row"):
        Tr.permutation_importance(model, table.limit(0), ["id"])
