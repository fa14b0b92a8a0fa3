"""Supervised learning, learned forecasts, splits, metrics and scoring inputs."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablelens.ml import forecasting as Mf, preparation as Pr, training as Tr
from tablelens.operators import metrics as Me, sampling as Sa, scoring as Sc, series as Se
from tablelens.operators.neighbours import knn_predict
from tablelens.session import small_table
from workbook import query, scratch
from workbook.fixtures import DIRTY_SQL, dirty_orders, union_all
from workbook.series import DAILY, KEYS, SPLIT, daily

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
REG_FEATURES = ["l_quantity", "l_discount", "p_size", "p_retailprice", "p_brand"]
CLS_FEATURES = ["o_totalprice", "o_orderpriority", "c_mktsegment", "c_acctbal"]


def reg_table(tables):
    joined = tables.lineitem.join(tables.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(*LINE_KEY, *REG_FEATURES)


def cls_table(tables):
    joined = tables.orders.join(tables.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", *CLS_FEATURES, "o_orderstatus")


# ---------------------------------------------------------------- splits


def _order(key: str, seed: int) -> str:
    return f"md5(concat_ws('|', {key}, '{seed}'))"


def _quota_sql(target: str, share: str) -> str:
    """Largest-remainder quotas per order status; ``share`` gives the exact part of n."""
    return (
        f"c AS (SELECT o_orderstatus, count(*) AS n, sum(count(*)) OVER () AS total FROM orders GROUP BY 1), x AS (SELECT *, {share} AS exact FROM c), "
        f"q AS (SELECT o_orderstatus, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, o_orderstatus) <= {target} - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM x), "
        f"r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_order('o_orderkey', 42)}, o_orderkey) - 1 AS rank FROM orders)"
    )


@query(
    "stratified_sample",
    f"WITH {_quota_sql('1001', 'n * 1001 / total')} SELECT o_orderkey, r.o_orderstatus FROM r JOIN q ON r.o_orderstatus = q.o_orderstatus WHERE rank < quota",
)
def _(tables):
    return Sa.stratified_sample(tables.orders, 1001, ["o_orderkey"], "o_orderstatus").select("o_orderkey", "o_orderstatus")


@query(
    "sample_rows",
    f"SELECT o_orderkey FROM orders ORDER BY {_order('o_orderkey', 7)}, o_orderkey LIMIT 1001",
)
def _(tables):
    return Sa.stratified_sample(tables.orders, 1001, ["o_orderkey"], seed=7).select("o_orderkey")


@query(
    "train_test_split",
    f"WITH {_quota_sql('ceil(total * 0.25)', 'n * 0.25')} SELECT o_orderkey, rank < quota AS is_test FROM r JOIN q ON r.o_orderstatus = q.o_orderstatus",
)
def _(tables):
    return Sa.mark_test_rows(tables.orders, 0.25, ["o_orderkey"], "o_orderstatus").select("o_orderkey", "is_test")


@query(
    "assign_folds",
    f"SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_order('o_orderkey', 42)}, o_orderkey) - 1) % 5)::INT AS fold FROM orders",
)
def _(tables):
    return Sa.assign_folds(tables.orders, 5, ["o_orderkey"], "o_orderstatus").select("o_orderkey", "fold")


# ---------------------------------------------------------------- preparation


@query("prepare_training", f"SELECT o_orderkey, o_totalprice, CASE WHEN trim(o_orderpriority) <> '' THEN o_orderpriority END AS o_orderpriority FROM {DIRTY_SQL} WHERE o_totalprice IS NOT NULL")
def _(tables):
    rows = dirty_orders(tables).select("o_orderkey", "o_totalprice", "o_orderpriority")
    return Pr.prepare_training(rows, ["o_orderpriority"], "o_totalprice", "regression")


@query("encode_labels", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1.0 AS label FROM orders")
def _(tables):
    encoded, _ = Pr.encode_labels(tables.orders, "o_orderpriority")
    return encoded.select("o_orderkey", "label")


@query(
    "preprocess",
    f"WITH f AS (SELECT o_orderkey, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM {DIRTY_SQL})) AS p, coalesce(o_orderpriority, "
    f"(SELECT o_orderpriority FROM {DIRTY_SQL} WHERE o_orderpriority IS NOT NULL AND trim(o_orderpriority) <> '' GROUP BY 1 ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS c "
    f"FROM (SELECT o_orderkey, o_totalprice, CASE WHEN trim(o_orderpriority) <> '' THEN o_orderpriority END AS o_orderpriority FROM {DIRTY_SQL})) "
    "SELECT o_orderkey, round((p - avg(p) OVER ()) / stddev_pop(p) OVER (), 6) AS scaled, dense_rank() OVER (ORDER BY c) AS hot FROM f",
)
def _(tables):
    rows = Pr.normal_form(dirty_orders(tables), ["o_totalprice", "o_orderpriority"])
    prepared = Pr.fit_preparation(rows, ["o_totalprice", "o_orderpriority"]).transform(rows)
    slots = vector_to_array("features")
    hot = F.array_position(F.slice(slots, 2, F.size(slots) - 1), F.lit(1.0))
    return prepared.select("o_orderkey", F.round(slots[0], 6).alias("scaled"), hot.alias("hot"))


# ---------------------------------------------------------------- estimators


def _one_feature_sql(weight: str, wanted: str = "round(ybar + w * x, 4) AS prediction") -> str:
    """Penalised least squares with one standardised feature, in closed form."""
    return (
        "WITH m AS (SELECT avg(l_quantity) AS qbar, stddev_pop(l_quantity) AS qsd, avg(l_extendedprice) AS ybar, count(*) AS n FROM lineitem), "
        "z AS (SELECT (l_quantity - qbar) / qsd AS x, l_quantity, l_extendedprice - ybar AS y, ybar, n FROM lineitem, m), "
        f"s AS (SELECT sum(x * y) AS sxy, any_value(n) AS n FROM z), k AS (SELECT {weight} AS w FROM s) "
        f"SELECT DISTINCT l_quantity, {wanted} FROM z, k"
    )


def _register_linear(model_type: str, weight: str) -> None:
    @query(f"estimator_{model_type}", _one_feature_sql(weight))
    def _(tables):
        rows = tables.lineitem.select("l_quantity", "l_extendedprice")
        model = Tr.fit_model(rows, ["l_quantity"], "l_extendedprice", "regression", model_type)
        scored = model.transform(rows.select("l_quantity").distinct())
        return scored.select("l_quantity", F.round("prediction", 4).alias("prediction"))


_register_linear("ridge_regression", "sxy / (n + 1)")
_register_linear("lasso_regression", "sign(sxy) * greatest(abs(sxy) / n - 0.001, 0)")
_register_linear("elasticnet", "sign(sxy) * greatest(abs(sxy) / n - 0.0005, 0) / 1.0005")


FLAG_SQL = "(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 ELSE 3.0 END)"


def _register_tree_regression(model_type: str, wanted: str, compared: str) -> None:
    """With three feature values a tree that splits them all predicts the means of the three groups."""

    @query(f"estimator_{model_type}_regression", f"SELECT {FLAG_SQL}::DOUBLE AS flag, {wanted} FROM lineitem GROUP BY 1")
    def _(tables):
        rows = tables.lineitem.select(F.expr(FLAG_SQL).cast("double").alias("flag"), "l_extendedprice")
        model = Tr.fit_model(rows, ["flag"], "l_extendedprice", "regression", model_type)
        means = rows.groupBy("flag").agg(F.avg("l_extendedprice").alias("mean"))
        return model.transform(means).selectExpr("flag", compared)


_EXACT = "round(prediction, 3) AS prediction"
_register_tree_regression("decision_tree", "round(avg(l_extendedprice), 3) AS prediction", _EXACT)
_register_tree_regression("gradient_boosting", "round(avg(l_extendedprice), 3) AS prediction", _EXACT)
# trees of a forest see resampled rows
_register_tree_regression("random_forest", "true AS near", "abs(prediction / mean - 1) < 0.01 AS near")

PRIORITY_SQL = "substr(o_orderpriority, 1, 1)::DOUBLE"
# each priority is its own class in about four of five orders
NOISY_SQL = "CASE WHEN o_orderkey % 5 < 4 THEN o_orderpriority ELSE '1-URGENT' END"
TWO_SQL = "CASE WHEN o_orderkey % 5 < 4 AND o_orderpriority < '3' THEN 'high' ELSE 'low' END"


def _register_classes(model_type: str, target: str) -> None:
    """With one value per group a classifier predicts the group's most frequent class."""

    @query(
        f"estimator_{model_type}_classification",
        f"SELECT priority, class AS prediction FROM (SELECT {PRIORITY_SQL} AS priority, {target} AS class, count(*) AS n FROM orders GROUP BY 1, 2) "
        "QUALIFY row_number() OVER (PARTITION BY priority ORDER BY n DESC) = 1",
    )
    def _(tables):
        rows = tables.orders.selectExpr("cast(substr(o_orderpriority, 1, 1) AS double) AS priority", f"{target} AS class")
        rows, labels = Pr.encode_labels(rows, "class")
        model = Tr.fit_model(rows, ["priority"], "class", "classification", model_type, labels=labels)
        scored = Tr.predict_batch(model, rows.select("priority").distinct())
        return scored.select("priority", F.col("prediction_label").alias("prediction"))


_register_classes("decision_tree", NOISY_SQL)
_register_classes("random_forest", NOISY_SQL)
_register_classes("gradient_boosting", TWO_SQL)


@query(
    "estimator_gradient_boosting_classes",
    "WITH c AS (SELECT substr(o_orderpriority, 1, 1)::DOUBLE AS priority, CASE WHEN o_orderkey % 5 < 4 THEN o_orderpriority ELSE '1-URGENT' END AS class FROM orders), "
    "s AS (SELECT priority, class, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY priority) AS share FROM c GROUP BY 1, 2) "
    "SELECT priority, class AS prediction, true AS near, true AS whole FROM s QUALIFY row_number() OVER (PARTITION BY priority ORDER BY share DESC) = 1",
)
def _(tables):
    """Joint boosting of five classes: with one value per group the probabilities come near the shares of the group and sum to one."""
    rows = tables.orders.selectExpr("cast(substr(o_orderpriority, 1, 1) AS double) AS priority", f"{NOISY_SQL} AS class")
    shares = rows.groupBy("priority", "class").count()
    shares = shares.join(rows.groupBy("priority").agg(F.count("*").alias("all")), "priority").selectExpr("priority", "class", "count / all AS share")
    encoded, labels = Pr.encode_labels(rows, "class")
    model = Tr.fit_model(encoded, ["priority"], "class", "classification", "gradient_boosting", labels=labels)
    scored = Tr.predict_batch(model, rows.select("priority").distinct())
    own = scored.join(shares, (scored["prediction_label"] == shares["class"]) & (scored["priority"] == shares["priority"]))
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, b: a + b)
    near = (F.abs(F.col("confidence") - F.col("share")) < 0.02) & (F.col("top_class") == F.col("prediction_label"))
    return own.select(scored["priority"], F.col("prediction_label").alias("prediction"), near.alias("near"), (F.abs(total - 1) < 1e-5).alias("whole"))


@query("estimator_svm_classification", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS prediction FROM orders")
def _(tables):
    """Two classes with a wide gap between them."""
    gap = F.when(F.col("o_orderstatus") == "O", 10.0).otherwise(-10.0) + F.col("o_orderkey") % 7
    rows = tables.orders.select("o_orderkey", gap.alias("gap"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("other").alias("class"))
    rows, labels = Pr.encode_labels(rows, "class")
    model = Tr.fit_model(rows, ["gap"], "class", "classification", "svm", labels=labels)
    return Tr.predict_batch(model, rows).select("o_orderkey", F.col("prediction_label").alias("prediction"))


@query("estimator_logistic_regression_classification", "SELECT o_orderstatus, round(count(*) / (SELECT count(*) FROM orders), 2) AS share FROM orders GROUP BY 1")
def _(tables):
    """With free intercepts the mean probability of a class is its share."""
    rows, labels = Pr.encode_labels(tables.orders, "o_orderstatus")
    model = Tr.fit_model(rows, ["o_totalprice"], "o_orderstatus", "classification", "logistic_regression", labels=labels)
    shares = Tr.predict_batch(model, rows).select(F.explode("probabilities").alias("o_orderstatus", "p"))
    return shares.groupBy("o_orderstatus").agg(F.round(F.avg("p"), 2).alias("share"))


def _ridge_scores(parts: str, penalty: str = "sxy / (n + 1)") -> str:
    """R2 of the one-feature line of o_totalprice on o_custkey, fitted on the rows of each part that are not held out.

    ``parts`` is a table (part, o_custkey, o_totalprice, held_out).
    """
    return (
        f"d AS ({parts}), m AS (SELECT part, avg(o_custkey) AS xbar, stddev_pop(o_custkey) AS xsd, avg(o_totalprice) AS ybar FROM d WHERE NOT held_out GROUP BY 1), "
        "z AS (SELECT d.part, held_out, (o_custkey - xbar) / xsd AS x, o_totalprice AS y, ybar FROM d JOIN m ON d.part = m.part), "
        "s AS (SELECT part, sum(x * (y - ybar)) AS sxy, count(*) AS n FROM z WHERE NOT held_out GROUP BY 1), "
        f"k AS (SELECT part, {penalty} AS w FROM s), "
        "r2 AS (SELECT z.part, held_out, count(*) AS n, 1 - sum(power(y - ybar - w * x, 2)) / (var_pop(y) * count(*)) AS r2 FROM z JOIN k ON z.part = k.part GROUP BY 1, 2)"
    )


_TESTED = f"SELECT 0 AS part, o_custkey::DOUBLE AS o_custkey, o_totalprice, row_number() OVER (ORDER BY {_order('o_orderkey', 42)}, o_orderkey) - 1 < ceil(0.2 * count(*) OVER ()) AS held_out FROM orders"
_PLAIN = {"cv_folds": 0, "importance_repeats": 0}


@query(
    "train_regression",
    f"WITH {_ridge_scores(_TESTED)} SELECT 'ridge_regression' AS model_type, max(CASE WHEN NOT held_out THEN n END) AS train_rows, max(CASE WHEN held_out THEN n END) AS test_rows, "
    "round(max(CASE WHEN NOT held_out THEN r2 END), 4) AS train_score, round(max(CASE WHEN held_out THEN r2 END), 4) AS test_score FROM r2",
)
def _(tables):
    options = {"cv_folds": 3, "importance_repeats": 1}
    metrics = Tr.train(tables.orders, ["o_custkey"], "o_totalprice", "regression", "ridge_regression", ["o_orderkey"], **options).metrics
    scores = [F.round(c, 4).alias(c) for c in ("train_score", "test_score")]
    return metrics.select("model_type", "train_rows", "test_rows", *scores)


_TEST_VECTORS = f"(SELECT vec_id, embedding::DOUBLE[] AS v, label, row_number() OVER (ORDER BY {_order('vec_id', 42)}, vec_id) - 1 < ceil(0.2 * count(*) OVER ()) AS is_test FROM embeddings)"
_NEAREST = (
    f"e AS {_TEST_VECTORS}, n AS (SELECT q.vec_id AS query, t.label, list_distance(q.v, t.v) AS d, "
    "row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS r FROM e q, e t WHERE q.is_test AND NOT t.is_test), k AS (SELECT * FROM n WHERE r <= 7)"
)


@query(
    "knn_classification",
    f"WITH {_NEAREST}, w AS (SELECT query, label, sum(1 / d) AS votes FROM k GROUP BY ALL) "
    "SELECT query, label AS prediction FROM w QUALIFY row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) = 1",
)
def _(tables):
    train, test = Sa.train_test_split(tables.embeddings, 0.2, ["vec_id"])
    return knn_predict(train, test, "embedding", "vec_id", "label")


@query(
    "knn_classification_by_cells",
    f"WITH {_NEAREST}, w AS (SELECT query, label, sum(1 / d) AS votes FROM k GROUP BY ALL) "
    "SELECT query, label AS prediction FROM w QUALIFY row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) = 1",
)
def _(tables):
    """The search for training tables that do not fit a task."""
    train, test = Sa.train_test_split(tables.embeddings, 0.2, ["vec_id"])
    return knn_predict(train, test, "embedding", "vec_id", "label", broadcast_values=0)


@query("knn_regression", f"WITH {_NEAREST} SELECT query, round(sum(label / d) / sum(1 / d), 6) AS prediction FROM k GROUP BY query")
def _(tables):
    train, test = Sa.train_test_split(tables.embeddings, 0.2, ["vec_id"])
    near = knn_predict(train, test, "embedding", "vec_id", "label", problem_type="regression")
    return near.withColumn("prediction", F.round("prediction", 6))


@query(
    "knn_prepared_features",
    f"WITH c AS (SELECT *, row_number() OVER (ORDER BY {_order('c_custkey', 42)}, c_custkey) - 1 < ceil(0.2 * count(*) OVER ()) AS is_test FROM customer), "
    "m AS (SELECT avg(c_acctbal) AS am, stddev_pop(c_acctbal) AS asd, avg(c_nationkey) AS nm, stddev_pop(c_nationkey) AS nsd FROM c WHERE NOT is_test), "
    "e AS (SELECT c_custkey AS id, c_mktsegment AS label, is_test, [(c_acctbal - am) / asd, (c_nationkey - nm) / nsd] AS v FROM c, m), "
    "n AS (SELECT q.id AS query, t.label, list_distance(q.v, t.v) AS d, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, t.v), t.id) AS r "
    "FROM e q, e t WHERE q.is_test AND NOT t.is_test), w AS (SELECT query, label, sum(1 / d) AS votes FROM n WHERE r <= 7 GROUP BY ALL) "
    "SELECT query, label AS prediction FROM w QUALIFY row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) = 1",
)
def _(tables):
    train, test = Sa.train_test_split(tables.customer, 0.2, ["c_custkey"])
    return Tr.knn_batch(train, test, ["c_acctbal", "c_nationkey"], "c_mktsegment", "classification", "c_custkey")


# ---------------------------------------------------------------- metrics


@query(
    "regression_metrics",
    "SELECT l_returnflag, count(*) AS n, round_even(1 - sum(power(l_extendedprice - p, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2, "
    "round_even(sqrt(avg(power(l_extendedprice - p, 2))), 6) AS rmse, round_even(avg(abs(l_extendedprice - p)), 6) AS mae "
    "FROM (SELECT *, l_extendedprice * 0.8 + l_quantity * 100 AS p FROM lineitem) GROUP BY 1",
)
def _(tables):
    guess = F.col("l_extendedprice") * 0.8 + F.col("l_quantity") * 100
    return Me.regression_metrics(tables.lineitem.withColumn("p", guess), "l_extendedprice", "p", ["l_returnflag"])


_GUESS = "CASE WHEN l_quantity > 35 THEN 'A' WHEN l_discount > 0.07 THEN 'X' ELSE 'R' END"


@query(
    "classification_metrics",
    f"WITH p AS (SELECT l_returnflag AS a, {_GUESS} AS p FROM lineitem), c AS (SELECT a AS class, count(*) AS support, count(CASE WHEN a = p THEN 1 END) AS hits FROM p GROUP BY 1), "
    "h AS (SELECT c.*, (SELECT count(*) FROM p WHERE p.p = c.class) AS chosen FROM c), "
    "s AS (SELECT *, coalesce(hits / NULLIF(chosen, 0), 0) AS pr, hits / support AS re FROM h), "
    "f AS (SELECT *, coalesce(2 * pr * re / NULLIF(pr + re, 0), 0) AS f1 FROM s) "
    "SELECT sum(support)::BIGINT AS n, round_even(sum(hits) / sum(support), 6) AS accuracy, round_even(sum(pr * support) / sum(support), 6) AS precision, "
    "round_even(sum(re * support) / sum(support), 6) AS recall, round_even(sum(f1 * support) / sum(support), 6) AS f1 FROM f",
)
def _(tables):
    return Me.classification_metrics(tables.lineitem.withColumn("guess", F.expr(_GUESS)), "l_returnflag", "guess")


@query(
    "overfit_verdict",
    "WITH s AS (SELECT l_returnflag, l_linenumber, round_even(0.7 + avg(l_discount) * 6 * l_linenumber / 7, 6) AS train_score, round_even(0.6 + avg(l_tax) * 5, 6) AS test_score, "
    "CASE WHEN l_linenumber > 3 THEN round_even(0.7 + avg(l_tax), 6) END AS cv_mean FROM lineitem GROUP BY 1, 2), "
    "g AS (SELECT *, round_even(train_score - test_score, 6) AS generalization_gap, round_even(train_score - cv_mean, 6) AS cv_gap FROM s) "
    "SELECT *, CASE WHEN train_score >= 0.85 AND (generalization_gap >= 0.15 OR coalesce(cv_gap >= 0.12, false)) THEN 'detected' "
    "WHEN train_score >= 0.75 AND (generalization_gap >= 0.08 OR coalesce(cv_gap >= 0.08, false)) THEN 'watch' ELSE 'healthy' END AS status FROM g",
)
def _(tables):
    scores = tables.lineitem.groupBy("l_returnflag", "l_linenumber").agg(
        F.bround(0.7 + F.avg("l_discount") * 6 * F.col("l_linenumber") / 7, 6).alias("train_score"),
        F.bround(0.6 + F.avg("l_tax") * 5, 6).alias("test_score"),
        F.bround(F.when(F.col("l_linenumber") > 3, 0.7 + F.avg("l_tax")), 6).alias("cv_mean"),
    )
    return Me.overfit_verdict(scores, "regression")


_FOLDED = (
    f"SELECT f.fold AS part, o_custkey::DOUBLE AS o_custkey, o_totalprice, rank % 3 = f.fold AS held_out FROM "
    f"(SELECT *, row_number() OVER (ORDER BY {_order('o_orderkey', 42)}, o_orderkey) - 1 AS rank FROM orders), range(3) f(fold)"
)


@query("cross_validate", f"WITH {_ridge_scores(_FOLDED)} SELECT part::INT AS fold, round(r2, 4) AS r2 FROM r2 WHERE held_out")
def _(tables):
    rows = Pr.prepare_training(tables.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "regression")
    scores = Tr.cross_validate(rows, ["o_custkey"], "o_totalprice", "regression", "ridge_regression", ["o_orderkey"], 3)
    return small_table(tables.spark, [(i, round(s, 4)) for i, s in enumerate(scores)], "fold int, r2 double")


_MOVED = ("(SELECT ('0x' || substr(md5('42|0|' || k), 1, 15))::BIGINT % greatest((SELECT count(*) FROM t) - 1, 1) + 1 AS shift, k FROM range(3) r(k))")


@query(
    "permutation_importance",
    "WITH t AS (SELECT l_orderkey, sum(l_quantity)::DOUBLE AS quantity, sum(l_extendedprice)::DOUBLE AS price FROM lineitem GROUP BY 1), "
    f"k AS (SELECT *, row_number() OVER (ORDER BY {_order('l_orderkey', 42)}, l_orderkey) - 1 AS rank, count(*) OVER () AS n FROM t), "
    "m AS (SELECT avg(quantity) AS xbar, stddev_pop(quantity) AS xsd, avg(price) AS ybar, var_pop(price) * count(*) AS sst FROM t), "
    "w AS (SELECT sum((quantity - xbar) / xsd * (price - ybar)) / (count(*) + 1) AS w FROM t, m), "
    f"v AS (SELECT a.rank, a.price, b.quantity, o.k FROM k a, {_MOVED} o, k b WHERE b.rank = (a.rank - o.shift + a.n) % a.n UNION ALL SELECT rank, price, quantity, -1 FROM k), "
    "s AS (SELECT k, 1 - sum(power(price - ybar - w * (quantity - xbar) / xsd, 2)) / any_value(sst) AS r2 FROM v, m, w GROUP BY 1) "
    "SELECT 'quantity' AS name, round((SELECT r2 FROM s WHERE k = -1) - avg(r2), 5) AS importance FROM s WHERE k >= 0",
)
def _(tables):
    """The drop of R2 of a line when the moved quantities take the place of the own ones."""
    rows = tables.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").cast("double").alias("quantity"), F.sum("l_extendedprice").cast("double").alias("price"))
    model = Tr.fit_model(rows, ["quantity"], "price", "regression", "ridge_regression")
    return Tr.permutation_importance(model, rows, ["l_orderkey"]).withColumn("importance", F.round("importance", 5))


@query("permutation_importance_features")
def _(tables):
    rows = reg_table(tables)
    model = Tr.fit_model(rows, ["l_quantity", "p_retailprice", "p_brand"], "l_extendedprice", "regression", "ridge_regression")
    return Tr.permutation_importance(model, rows, LINE_KEY, repeats=2)


_LASSO = "sign(sxy) * greatest(abs(sxy) / n - 0.001, 0)"


@query(
    "compare_models",
    f"SELECT 0 AS position, 'ridge_regression' AS model_type, round(r2, 4) AS test_score FROM (WITH {_ridge_scores(_TESTED)} SELECT * FROM r2 WHERE held_out) UNION ALL "
    f"SELECT 1, 'lasso_regression', round(r2, 4) FROM (WITH {_ridge_scores(_TESTED, _LASSO)} SELECT * FROM r2 WHERE held_out)",
)
def _(tables):
    table, _ = Tr.compare_models(
        tables.orders, ["o_custkey"], "o_totalprice", "regression", ["ridge_regression", "lasso_regression"], ["o_orderkey"], **_PLAIN
    )
    return table.select("position", "model_type", F.round("test_score", 4).alias("test_score"))


@query(
    "sample_predictions",
    "WITH m AS (SELECT avg(l_quantity) AS qbar, stddev_pop(l_quantity) AS qsd, avg(l_extendedprice) AS ybar, count(*) AS n FROM lineitem), "
    "k AS (SELECT sum((l_quantity - qbar) / qsd * (l_extendedprice - ybar)) / (any_value(n) + 1) AS w FROM lineitem, m) "
    "SELECT l_extendedprice AS actual, round(ybar + w * (l_quantity - qbar) / qsd, 4) AS predicted FROM lineitem, m, k "
    "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 10",
)
def _(tables):
    rows = tables.lineitem.select("l_quantity", *LINE_KEY)
    model = Tr.fit_model(rows, ["l_quantity"], "l_extendedprice", "regression", "ridge_regression")
    return Tr.sample_predictions(model, rows, LINE_KEY).select("actual", F.round("predicted", 4).alias("predicted"))


# ---------------------------------------------------------------- prediction


@query("predict_batch", _one_feature_sql("sxy / (n + 1)", "round_even(ybar + w * x, 0) AS prediction"))
def _(tables):
    rows = tables.lineitem.select("l_quantity", "l_extendedprice")
    model = Tr.fit_model(rows, ["l_quantity"], "l_extendedprice", "regression", "ridge_regression")
    return Tr.predict_batch(model, rows.select("l_quantity").distinct(), as_integer=True).drop("prediction_label")


@query(
    "predict_batch_classes",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS prediction_label, true AS agrees FROM orders",
)
def _(tables):
    """Separable classes: the label, the top class and a confidence above one half go together."""
    gap = F.when(F.col("o_orderstatus") == "O", 10.0).otherwise(-10.0) + F.col("o_orderkey") % 7
    rows = tables.orders.select("o_orderkey", gap.alias("gap"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("other").alias("class"))
    rows, labels = Pr.encode_labels(rows, "class")
    scored = Tr.predict_batch(Tr.fit_model(rows, ["gap"], "class", "classification", "logistic_regression", labels=labels), rows)
    shares = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda total, p: total + p)
    agrees = (F.col("top_class") == F.col("prediction_label")) & (F.col("confidence") > 0.5) & (F.abs(shares - 1) < 1e-5)
    return scored.select("o_orderkey", "prediction_label", agrees.alias("agrees"))


@query("save_and_load_model", _one_feature_sql("sxy / (n + 1)"))
def _(tables):
    rows = tables.lineitem.select("l_quantity", "l_extendedprice")
    place = scratch(tables.spark)
    Tr.save_model(tables.spark, Tr.fit_model(rows, ["l_quantity"], "l_extendedprice", "regression", "ridge_regression"), place)
    scored = Tr.load_model(tables.spark, place).transform(rows.select("l_quantity").distinct())
    return scored.select("l_quantity", F.round("prediction", 4).alias("prediction"))


@query("feature_input_profile", union_all([
    f"SELECT 'o_totalprice' AS name, true AS is_number, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS mean, "
    f"arg_max(o_totalprice, o_orderkey)::VARCHAR AS last_value FROM {DIRTY_SQL}",
    f"SELECT 'o_orderstatus', false, NULL, NULL, NULL, arg_max(o_orderstatus, o_orderkey) FROM {DIRTY_SQL}",
]))
def _(tables):
    summary, _ = Sc.feature_input_profile(dirty_orders(tables), ["o_totalprice", "o_orderstatus"], ["o_orderkey"])
    return summary.withColumn("mean", F.round("mean", 4))


@query("feature_input_values", "SELECT DISTINCT 'p_brand' AS name, p_brand AS value FROM part UNION ALL SELECT DISTINCT 'p_type', p_type FROM part")
def _(tables):
    return Sc.feature_input_profile(tables.part, ["p_size", "p_brand", "p_type"], ["p_partkey"])[1]


@query(
    "scenario_frame",
    "SELECT i::INT AS step, (DATE '2024-01-01' + (i * 30)::INT)::DATE AS date, floor(p * 10000 + 0.5) / 10000 AS o_totalprice, s AS o_orderstatus FROM range(1, 7) r(i), "
    "(SELECT avg(o_totalprice) AS p FROM orders), (SELECT o_orderstatus AS s FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
)
def _(tables):
    return Sc.scenario_frame(tables.orders, ["o_totalprice", "o_orderstatus"], 6, dt.date(2024, 1, 1))


@query(
    "carry_forward_target",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE (SELECT o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) END AS previous_month FROM orders",
)
def _(tables):
    table = tables.orders.withColumn("previous_month", F.when(F.col("o_orderstatus") == "F", 1.0))
    return Sc.carry_forward_target(table, "o_totalprice", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "previous_month")


# ---------------------------------------------------------------- learned forecasts


@query(
    "regression_forecast",
    "WITH m AS (SELECT max(datediff('month', DATE '1990-01-01', o_orderdate)) AS last FROM orders) "
    "SELECT step::INT AS step, round(100.0 + 3 * (last + step), 1) AS predicted FROM m, range(1, 7) r(step)",
)
def _(tables):
    """A monthly value that is linear in time; least squares must continue the line."""
    month = F.floor(F.months_between(F.trunc("o_orderdate", "month"), F.lit("1990-01-01"))).cast("int")
    months = tables.orders.groupBy(month.alias("month")).agg(F.min("o_orderdate").alias("at"))
    line = months.select("at", (F.lit(100.0) + 3 * F.col("month")).alias("value"))
    series = Se.prepare_series(line, "at", "value", freq="month")[0]
    points = Mf.regression_forecast(series, 6)["points"].filter("part = 'future'")
    return points.select("step", F.round("prediction", 1).alias("predicted"))


_AHEAD = "(SELECT event_type, periods, max(period) AS last FROM t GROUP BY ALL), range(1, 7) r(i)"


@query(
    "regression_forecast_panel",
    "WITH p AS (SELECT o_orderpriority, min(date_trunc('month', o_orderdate)) AS a, max(date_trunc('month', o_orderdate)) AS b, avg(o_totalprice) / 1000 AS level FROM orders GROUP BY 1), "
    "g AS (SELECT o_orderpriority, level, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS period FROM p), "
    "s AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY period) AS position, count(*) OVER (PARTITION BY o_orderpriority) AS periods FROM g), "
    f"{SPLIT} SELECT o_orderpriority, 'test' AS part, position::INT AS position, round(level + 3 * position, 1) AS predicted FROM t WHERE position > train_periods "
    "UNION ALL SELECT o_orderpriority, 'future', (periods + i)::INT, round(level + 3 * (periods + i), 1) FROM (SELECT DISTINCT o_orderpriority, level, periods FROM t), range(1, 7) r(i)",
)
def _(tables):
    """Monthly values of each priority laid on a line of its own; least squares must continue every line."""
    keys = ["o_orderpriority"]
    series = Se.prepare_series(tables.orders, "o_orderdate", "o_totalprice", keys, freq="month")[0]
    levels = tables.orders.groupBy(*keys).agg((F.avg("o_totalprice") / 1000).alias("level"))
    lines = series.join(levels, keys).withColumn("value", F.col("level") + 3 * F.col("position")).select(*series.columns)
    points = Mf.regression_forecast(lines, 6, keys=keys)["points"]
    return points.select(*keys, "part", "position", F.round("prediction", 1).alias("predicted"))


def _trend_sql(wanted: str) -> str:
    """The pooled ridge line over positions after the three lags, for the backtest and for the future."""
    return (
        f"WITH {DAILY}, {SPLIT}, r AS (SELECT 'test' AS part, position, value FROM t WHERE position > 3 AND position <= train_periods UNION ALL SELECT 'future', position, value FROM t WHERE position > 3), "
        "m AS (SELECT part, avg(position) AS xbar, avg(value) AS ybar FROM r GROUP BY 1), "
        "w AS (SELECT part, any_value(xbar) AS xbar, any_value(ybar) AS ybar, sum((position - xbar) * (value - ybar)) / (sum(power(position - xbar, 2)) + 1) AS w FROM r JOIN m USING (part) GROUP BY 1) "
        + wanted
    )


@query(
    "ml_forecast_ridge_regression",
    _trend_sql(
        "SELECT event_type, part, position::INT AS position, round(greatest(ybar + w * (position - xbar), 0), 4) AS predicted FROM t, w WHERE part = 'test' AND position > train_periods "
        f"UNION ALL SELECT event_type, part, (periods + i)::INT, round(greatest(ybar + w * (periods + i - xbar), 0), 4) FROM {_AHEAD}, w WHERE part = 'future'"
    ),
)
def _(tables):
    """One line through the days of all types."""
    points = Mf.ml_forecast(daily(tables), 6, groups=["trend"], model_type="ridge_regression", keys=KEYS)["points"]
    return points.select("event_type", "part", "position", F.round("prediction", 4).alias("predicted"))


def _register_forecast(model_type: str, kept: str) -> None:
    """``kept``: the share of a day's distance to the mean that the model does not learn."""

    @query(
        f"ml_forecast_{model_type}",
        f"WITH {DAILY}, {SPLIT}, a AS (SELECT isodow(period) > 5 AS rest, avg(value) AS level FROM t GROUP BY 1), "
        "v AS (SELECT t.*, level FROM t JOIN a ON rest = (isodow(period) > 5)), "
        "b AS (SELECT avg(CASE WHEN position > 3 AND position <= train_periods THEN level END) AS early, avg(CASE WHEN position > 3 THEN level END) AS whole FROM v) "
        f"SELECT event_type, 'test' AS part, position::INT AS position, round(level + (early - level) * {kept}, 3) AS predicted FROM v, b WHERE position > train_periods "
        f"UNION ALL SELECT event_type, 'future', (periods + i)::INT, round(level + (whole - level) * {kept}, 3) FROM {_AHEAD}, a, b WHERE rest = (isodow(last + INTERVAL 1 DAY * i) > 5)",
    )
    def _(tables):
        """Values that depend on the weekend alone; trees over the calendar must find that split."""
        series = daily(tables).withColumn("rest", F.weekday("period") > 4)
        levels = series.groupBy("rest").agg(F.avg("value").alias("level"))
        steps = series.join(levels, "rest").withColumn("value", F.col("level")).drop("rest", "level")
        points = Mf.ml_forecast(steps, 6, groups=["calendar"], model_type=model_type, keys=KEYS)["points"]
        return points.select("event_type", "part", "position", F.round("prediction", 3).alias("predicted"))

    @query(f"ml_forecast_{model_type}_all_features")
    def _(tables):
        return Mf.ml_forecast(daily(tables), 6, model_type=model_type, keys=KEYS)["points"]


_register_forecast("gradient_boosting", "power(0.95, 140)")
_register_forecast("random_forest", "0")


@query("forecast_importance", _trend_sql("SELECT 'trend_index' AS name, round_even(abs(w), 4) AS importance FROM w WHERE part = 'future'"))
def _(tables):
    return Mf.ml_forecast(daily(tables), 1, groups=["trend"], model_type="ridge_regression", keys=KEYS)["importance"]
