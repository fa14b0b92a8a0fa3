"""Fitted trees as flat arrays: evaluation without Spark jobs, exact growth of forests, boosting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablelens.session import reliable_checkpoint, small_table

NODES = "tree int, node int, feature int, threshold double, low int, high int, value array<double>, gain double"
LEAF = -1
LOCAL_VALUES = 4_000_000  # numbers of a feature matrix that one task may hold (32 MB)
NODE_LIMIT = 50_000_000  # nodes of a forest that is kept as one model (about 3 GB)
BINS = 128  # candidate splits of a feature where rows are counted and not held
WAVE = 8  # trees whose rows are dealt out at once
HISTOGRAM_CELLS = 4_000_000  # numbers of all histograms of one pass
REST = 10  # rounds of boosting after which scores are written


@dataclass
class Ensemble:
    """Trees side by side. A row goes to ``low`` of a node where its feature is at most the threshold, else to ``high``.

    The result is ``base`` and the sum of the reached leaves' values, each by its tree's weight.
    """

    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    base: np.ndarray = field(default_factory=lambda: np.zeros(1))

    @classmethod
    def from_nodes(cls, nodes: pa.Table, weights: Sequence[float], base: Sequence[float] = (0.0,)) -> Ensemble:
        """From rows of ``NODES``; node numbers start at 0 (the root) in every tree."""
        nodes = nodes.sort_by([("tree", "ascending"), ("node", "ascending")]).combine_chunks()
        tree, node = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        place = {(t, n): i for i, (t, n) in enumerate(zip(tree.tolist(), node.tolist()))}
        feature = nodes["feature"].to_numpy().astype(np.int64)
        ends = [
            np.array([place[t, c] if f != LEAF else 0 for t, c, f in zip(tree.tolist(), nodes[side].to_pylist(), feature.tolist())], np.int64)
            for side in ("low", "high")
        ]
        return cls(
            np.array([place[t, 0] for t in range(len(weights))], np.int64), np.array(weights, float), feature,
            nodes["threshold"].to_numpy().astype(float), *ends, np.array(nodes["value"].to_pylist(), float).reshape(len(tree), -1),
            nodes["gain"].to_numpy().astype(float), np.array(base, float),
        )

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row (first axis) in every tree (second axis)."""
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        line = np.arange(len(rows))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature != LEAF
            if not inner.any():
                return at
            below = rows[line, np.where(inner, feature, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(below, self.low[at], self.high[at]), at)

    def evaluate(self, rows: np.ndarray) -> np.ndarray:
        """One row of outputs per row of features, some rows at a time to bound memory."""
        out = np.empty((len(rows), self.value.shape[1]))
        step = max(1, 2_000_000 // max(len(self.roots), 1))
        for start in range(0, len(rows), step):
            reached = self.value[self.leaves(rows[start : start + step])]
            out[start : start + step] = self.base + np.einsum("rto,t->ro", reached, self.weights)
        return out

    def table(self) -> pa.Table:
        """Rows of ``NODES``, the places of nodes as their numbers within the tree."""
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1
        first = self.roots[tree]
        inner = self.feature != LEAF
        ends = [pa.array(np.where(inner, side - first, -1).astype(np.int32)) for side in (self.low, self.high)]
        return pa.table({
            "tree": pa.array(tree.astype(np.int32)), "node": pa.array((np.arange(len(tree)) - first).astype(np.int32)),
            "feature": pa.array(self.feature.astype(np.int32)), "threshold": pa.array(self.threshold), "low": ends[0], "high": ends[1],
            "value": pa.array(list(self.value), pa.list_(pa.float64())), "gain": pa.array(self.gain),
        })

    def importance(self, features: int, alike: bool = True) -> np.ndarray:
        """Share of each feature in the weighted impurity decrease; trees count alike, or (boosting) by their decrease."""
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1
        inner = self.feature != LEAF
        total = np.zeros(features)
        sums = np.bincount(tree[inner], self.gain[inner], len(self.roots)) if alike else np.ones(len(self.roots))
        share = self.gain[inner] / np.where(sums[tree[inner]] > 0, sums[tree[inner]], 1.0)
        np.add.at(total, self.feature[inner], share)
        return total / total.sum() if total.sum() else total


def _model_folder(spark: SparkSession) -> str:
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{shared or Path(tempfile.mkdtemp(prefix='tablelens-')).as_uri()}/trees-{uuid.uuid4().hex}"


def from_spark(model: Model, spark: SparkSession) -> Ensemble:
    """A fitted tree, forest or boosted regressor of Spark as flat arrays; continuous features only.

    Nodes are read from the model's own saved table, so no tree is walked node by node from Python.
    """
    folder = _model_folder(spark)
    model.write().save(folder)
    table = spark.read.parquet(f"{folder}/data")
    node = F.col("nodeData") if "nodeData" in table.columns else F.struct("*")
    tree = F.col("treeID") if "treeID" in table.columns else F.lit(0)
    table = table.select(tree.cast("int").alias("tree"), node.alias("n"))
    if table.where("n.split.numCategories >= 0").limit(1).count():
        raise ValueError("trees with categorical splits are not supported")
    inner = F.col("n.leftChild") >= 0
    nodes = table.select(
        "tree", F.col("n.id").alias("node"), F.when(inner, F.col("n.split.featureIndex")).otherwise(LEAF).alias("feature"),
        F.when(inner, F.col("n.split.leftCategoriesOrThreshold")[0]).otherwise(0.0).alias("threshold"),
        F.col("n.leftChild").alias("low"), F.col("n.rightChild").alias("high"), F.array("n.prediction").alias("value"),
        F.when(inner, F.col("n.gain") * F.col("n.rawCount")).otherwise(0.0).alias("gain"),
    ).toArrow()
    weights = list(getattr(model, "treeWeights", None) or [1.0])
    if type(model).__name__.startswith("RandomForest"):
        weights = [1.0 / len(weights)] * len(weights)
    return Ensemble.from_nodes(nodes, weights)


# ---------------------------------------------------------------- exact growth of one tree


def _scores(weight: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """What a side adds to a split's score: for one number its share of explained variance, for classes of purity."""
    return np.einsum("...k,...k->...", sums, sums) / np.maximum(weight, 1e-300)


def grow_tree(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, min_leaf: int, tries: int, generator: np.random.Generator,
    depth: int | None = None, many: np.ndarray | None = None, squares: np.ndarray | None = None,
) -> dict[str, np.ndarray]:
    """Grow a tree on rows with weights until its leaves are pure, too small to split or equal in all features.

    ``y`` has a column per output (one number, or one per class); a split maximises the explained sum of squares (for classes:
    minimises Gini impurity) over every threshold between two values. All nodes of a level are split together: rows are kept sorted
    by each feature and regrouped by node. Each node looks at ``tries`` features that can split it, in random order;
    a side has at least ``min_leaf`` rows. Ties go to the first feature and the smallest threshold.

    A line may stand for ``many`` rows of equal features, with their mean as ``y`` and their weighted sum of squares in ``squares``.
    """
    some = w > 0
    many = np.ones(some.sum(), np.int64) if many is None else many[some]
    squares = (w * (y**2).sum(axis=1) if squares is None else squares)[some]
    x, y, w = x[some], y[some], w[some].astype(float)
    count, features = x.shape
    wy = y * w[:, None]
    feature, threshold, low, high, value, gain = [], [], [], [], [], []

    def add(weight: np.ndarray, sums: np.ndarray) -> None:
        for a, b in zip(weight.tolist(), sums):
            feature.append(LEAF), threshold.append(0.0), low.append(-1), high.append(-1), gain.append(0.0)
            value.append(b / a if a else b * 0.0)

    add(np.array([w.sum()]), wy.sum(axis=0)[None])
    orders = [np.argsort(x[:, f], kind="stable") for f in range(features)]
    node = np.zeros(count, np.int64)  # place of the row's node in this level; -1: finished
    names = np.zeros(1, np.int64)
    level = 0
    while len(names) and count and (depth is None or level < depth):
        nodes = len(names)
        best = np.full((features, nodes), -np.inf)
        cuts, sides = np.zeros((features, nodes)), np.zeros((features, nodes, 2))
        for f in range(features):
            rows = orders[f][node[orders[f]] >= 0]
            rows = rows[np.argsort(node[rows], kind="stable")]
            orders[f] = rows
            if not len(rows):
                continue
            at, cell = node[rows], x[rows, f]
            sizes = np.bincount(at, minlength=nodes)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            upto = np.cumsum(many[rows])
            before = np.concatenate([[0], upto])[starts]
            held = upto[ends - 1] - before
            left_w, left_y = np.cumsum(w[rows]), np.cumsum(wy[rows], axis=0)
            before_w = np.concatenate([[0.0], left_w])[starts]
            before_y = np.concatenate([np.zeros((1, y.shape[1])), left_y])[starts]
            all_w, all_y = left_w[ends - 1] - before_w, left_y[ends - 1] - before_y
            left_w, left_y = left_w - before_w[at], left_y - before_y[at]
            inner = upto - before[at]
            valid = np.zeros(len(rows), bool)
            valid[:-1] = (at[1:] == at[:-1]) & (cell[1:] > cell[:-1])
            valid &= (inner >= min_leaf) & (held[at] - inner >= min_leaf)
            score = np.full(len(rows), -np.inf)
            v = np.flatnonzero(valid)
            score[v] = _scores(left_w[v], left_y[v]) + _scores(all_w[at[v]] - left_w[v], all_y[at[v]] - left_y[v])
            top = np.maximum.reduceat(score, starts)
            hits = np.flatnonzero(valid & (score >= top[at] - 1e-9 * np.abs(top[at])))
            owner, first = np.unique(at[hits], return_index=True)
            place = hits[first]
            best[f, owner] = top[owner]
            middle = (cell[place] + cell[place + 1]) / 2
            cuts[f, owner] = np.where(middle < cell[place + 1], middle, cell[place])
        parent = np.array([np.sum(value[n] ** 2) for n in names])
        weight = np.bincount(node[node >= 0], w[node >= 0], nodes)
        mixed_y = np.bincount(node[node >= 0], squares[node >= 0], nodes) - weight * parent
        impure = mixed_y > 1e-12 * np.maximum(weight * parent, 1e-300)
        usable = np.isfinite(best)
        if tries < features:
            turn = generator.random((features, nodes)).argsort(axis=0).argsort(axis=0)
            place = np.where(usable, turn, features)
            usable &= place <= np.sort(place, axis=0)[min(tries, features) - 1]
        ranked = np.where(usable, best, -np.inf)
        top = ranked.max(axis=0)
        split = np.flatnonzero(np.isfinite(top) & impure)
        chosen = np.argmax(ranked >= top - 1e-9 * np.abs(top), axis=0)
        child = np.full(nodes, -1, np.int64)
        child[split] = 2 * np.arange(len(split))
        rows = np.flatnonzero(node >= 0)
        rows = rows[child[node[rows]] >= 0]
        f = chosen[node[rows]]
        right = x[rows, f] > cuts[f, node[rows]]
        following = np.full(count, -1, np.int64)
        following[rows] = child[node[rows]] + right
        made = len(feature)
        side_w = np.bincount(following[rows], w[rows], 2 * len(split))
        side_y = np.stack([np.bincount(following[rows], wy[rows, k], 2 * len(split)) for k in range(y.shape[1])], axis=1)
        add(side_w, side_y)
        for k, n in enumerate(split):
            name = names[n]
            feature[name], threshold[name] = int(chosen[n]), float(cuts[chosen[n], n])
            low[name], high[name] = made + 2 * k, made + 2 * k + 1
            gain[name] = float(top[n] - weight[n] * parent[n])
        node, names, level = following, made + np.arange(2 * len(split)), level + 1
    return {
        "feature": np.array(feature, np.int32), "threshold": np.array(threshold, float), "low": np.array(low, np.int32),
        "high": np.array(high, np.int32), "value": np.array(value, float).reshape(len(value), -1), "gain": np.maximum(np.array(gain, float), 0.0),
    }


def _node_batch(tree: int, grown: dict[str, np.ndarray]) -> pa.RecordBatch:
    size, outputs = grown["value"].shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * outputs, pa.int32()), pa.array(grown["value"].ravel()))
    columns = [
        pa.array(np.full(size, tree, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(grown["feature"]), pa.array(grown["threshold"]),
        pa.array(grown["low"]), pa.array(grown["high"]), lists, pa.array(grown["gain"]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["tree", "node", "feature", "threshold", "low", "high", "value", "gain"])


# ---------------------------------------------------------------- forests


def _mix(values: np.ndarray) -> np.ndarray:
    z = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))


def draws(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's resample: Poisson with mean 1, from a hash of row, tree and seed."""
    seeds = _mix(np.array([tree * 1_000_003 + seed], np.uint64))
    return np.searchsorted(_POISSON, (_mix(ids.astype(np.uint64) ^ seeds) >> np.uint64(11)) * 2.0**-53).astype(np.int64)


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), features)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    size, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * width, pa.int32()), pa.array(matrix.ravel()))


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix of doubles and the place of each row among them."""
    rows = np.ascontiguousarray(rows + 0.0)  # -0.0 is 0.0
    _, first, at = np.unique(rows.view(f"V{rows.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    return rows[first], at.ravel()


def _outputs(y: np.ndarray, classes: int | None) -> np.ndarray:
    return y[:, None].astype(float) if classes is None else np.eye(classes)[y.astype(np.int64)]


def _numbered(rows: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    """``(id, x, y)`` in the checkpoint folder, so ids are fixed, and the numbers of rows and features."""
    table = rows.select(vector_to_array("features").alias("x"), F.col(f"`{label}`").cast("double").alias("y"))
    table = reliable_checkpoint(table.select(F.monotonically_increasing_id().alias("id"), "x", "y"))
    facts = table.agg(F.count("y").alias("n"), F.max(F.size("x")).alias("f")).first()
    if not facts["n"]:
        raise ValueError("no training rows")
    return table, facts["n"], facts["f"]


def fit_forest(
    rows: DataFrame, label: str = "label", trees: int = 100, min_leaf: int = 2, classes: int | None = None, seed: int = 42,
    local_values: int = LOCAL_VALUES,
) -> Ensemble:
    """A forest of fully grown trees on resampled rows; values are means, or class shares with ``classes``.

    A regression split looks at all features, a classification split at the square root of their number. A feature matrix
    of at most ``local_values`` numbers goes to the tasks and each grows whole trees. Of a larger one whose distinct rows are fewer than a
    quarter and keep that limit Spark sums each tree's resample by distinct row, and tasks grow whole trees on the sums. Otherwise Spark grows
    the upper levels: histograms of all nodes with more rows than that are summed over the table, level by level, with up to 128
    candidate splits a feature. Then each row goes, once per tree, to its node, and every node is finished in
    one task by exact growth, so no depth is set. Rows of eight trees are dealt at a time.

    A full tree has about a node per distinct row; a forest that would pass 50 million nodes is refused. Bound it by ``min_leaf`` or use
    Spark's forests with ``maxDepth``.
    """
    table, n, features = _numbered(rows, label)
    most, lines = n // max(min_leaf, 1), n
    if n * features > local_values or trees * most > NODE_LIMIT:
        lines = table.select("x", *(["y"] if classes else [])).distinct().count()
        points = table.select("x").distinct().count() if classes else lines
        if trees * min(most, points) > NODE_LIMIT:
            raise ValueError(f"a fully grown forest of {trees} trees on {n} rows has too many nodes; set minInstancesPerNode or maxDepth")
    spark = rows.sparkSession
    tries = features if classes is None else max(1, int(np.sqrt(features)))
    if lines * features <= local_values and 4 * lines < n:
        nodes = _grown_on_sums(table, features, trees, min_leaf, tries, classes, seed)
    elif n * features <= local_values:
        held = table.toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((
            held["id"].to_numpy(), _matrix(held["x"].combine_chunks(), features), held["y"].to_numpy(),
        ))

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x, y = sent.value
            outputs = _outputs(y, classes)
            for batch in batches:
                for tree in batch.column(0).to_pylist():
                    generator = np.random.default_rng([seed, tree])
                    yield _node_batch(tree, grow_tree(x, outputs, draws(ids, tree, seed), min_leaf, tries, generator))

        parts = min(trees, 4 * spark.sparkContext.defaultParallelism)
        nodes = spark.range(0, trees, 1, parts).mapInArrow(grow, NODES).toArrow()
    else:
        upper = _upper_levels(table, features, trees, min_leaf, tries, classes, seed, max(local_values // features, 2 * min_leaf))
        waves = [
            _finished(table, features, upper, range(start, min(start + WAVE, trees)), min_leaf, tries, classes, seed)
            for start in range(0, trees, WAVE)
        ]
        nodes = _grafted(upper, pa.concat_tables(waves))
    return Ensemble.from_nodes(nodes, [1.0 / trees] * trees, np.zeros(1 if classes is None else classes))


def _grown_on_sums(table: DataFrame, features: int, trees: int, min_leaf: int, tries: int, classes: int | None, seed: int) -> pa.Table:
    """Whole trees on the resample of each, summed by distinct features (and class): ``NODES`` as grown on the single rows."""

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, x, y = batch.column(0).to_numpy(), _matrix(batch.column(1), features), batch.column(2).to_numpy()
            lines, at = _distinct(np.column_stack([x, y if classes else np.zeros(len(y))]))
            held, group = _lists(lines[:, :-1]), pa.array(lines[:, -1])
            for t in range(trees):
                w = draws(ids, t, seed)
                sums = [np.bincount(at, v, len(lines)) for v in (w > 0, w, w * y, w * y**2)]
                rows = pa.array(np.flatnonzero(sums[0]))
                columns = [pa.array(np.full(len(rows), t, np.int32)), held.take(rows), group.take(rows), *[pa.array(v).take(rows) for v in sums]]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "x", "y", *names])

    def grow(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part, tree = part.combine_chunks(), key[0].as_py()
        x, y = _matrix(part["x"].combine_chunks(), features), part["y"].to_numpy()
        order = np.lexsort((y, *x.T))  # lines come in any order; sums must not depend on it
        many, w, total, squares = (part[name].to_numpy()[order] for name in names)
        outputs = _outputs(y[order], classes) if classes else (total / w)[:, None]
        generator = np.random.default_rng([seed, tree])
        grown = grow_tree(x[order], outputs, w, min_leaf, tries, generator, None, many.astype(np.int64), None if classes else squares)
        return pa.Table.from_batches([_node_batch(tree, grown)])

    names = ["many", "w", "total", "squares"]
    resampled = table.mapInArrow(resample, "tree int, x array<double>, y double, " + ", ".join(f"{name} double" for name in names))
    summed = resampled.groupBy("tree", "x", "y").agg(*[F.sum(name).alias(name) for name in names])
    return summed.groupBy("tree").applyInArrow(grow, NODES).toArrow()


def feature_cuts(table: DataFrame, features: int, bins: int = BINS) -> list[np.ndarray]:
    """Candidate thresholds of each feature: up to ``bins`` - 1 quantiles, without the largest value."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    row = table.agg(
        *[F.percentile_approx(F.col("x")[f], shares, 10_000).alias(f"q{f}") for f in range(features)],
        *[F.max(F.col("x")[f]).alias(f"m{f}") for f in range(features)],
    ).first()
    return [np.array(sorted({v for v in row[f"q{f}"] if v < row[f"m{f}"]}), float) for f in range(features)]


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)


def histogram(bins: np.ndarray, slot: np.ndarray, stats: np.ndarray, slots: int, width: int) -> np.ndarray:
    """Sums of ``stats`` (rows x numbers) by slot, feature and bin."""
    features, numbers = bins.shape[1], stats.shape[1]
    out = np.zeros((slots, features, width, numbers))
    flat = out.reshape(slots * features * width, numbers)
    for f in range(features):
        cell = (slot * features + f) * width + bins[:, f]
        for k in range(numbers):
            flat[:, k] += np.bincount(cell, stats[:, k], len(flat))
    return out


def choose(table: np.ndarray, cuts: list[np.ndarray], min_leaf: int, tries: int, generator: np.random.Generator, used: slice):
    """The best split of a node from its histogram: ``(feature, threshold, gain, left sums, right sums)``, or None.

    The first two numbers of a cell are the count of rows and their weight; ``used`` are the sums whose squares count.
    """
    left = np.cumsum(table, axis=1)
    whole = left[0, -1]
    right = whole - left
    valid = (left[..., 0] >= min_leaf) & (right[..., 0] >= min_leaf)
    valid &= np.arange(table.shape[1]) < np.array([len(c) for c in cuts])[:, None]
    score = np.where(valid, _scores(left[..., 1], left[..., used]) + _scores(right[..., 1], right[..., used]), -np.inf)
    per = score.max(axis=1)
    usable = np.isfinite(per)
    if not usable.any():
        return None
    if tries < len(per):
        order = generator.permutation(len(per))
        usable[[f for f in order if usable[f]][tries:]] = False
    per = np.where(usable, per, -np.inf)
    f = int(np.argmax(per >= per.max() - 1e-9 * abs(per.max())))
    b = int(np.argmax(score[f] >= per[f] - 1e-9 * abs(per[f])))
    gain = per[f] - _scores(whole[1], whole[used])
    return f, float(cuts[f][b]), float(max(gain, 0.0)), left[f, b], right[f, b]


def _summed(table: DataFrame, make, numbers: int) -> pa.Table:
    """Histogram rows of all tasks, summed by Spark and collected by slot: a bounded number of cells."""
    names = [f"s{k}" for k in range(numbers)]
    schema = "slot int, feature int, bin int, " + ", ".join(f"{name} double" for name in names)
    found = table.mapInArrow(make, schema).groupBy("slot", "feature", "bin").agg(*[F.sum(name).alias(name) for name in names])
    return found.toArrow()


def _cells(found: pa.Table, slots: int, features: int, width: int, numbers: int) -> np.ndarray:
    out = np.zeros((slots, features, width, numbers))
    at = tuple(found[name].to_numpy() for name in ("slot", "feature", "bin"))
    for k in range(numbers):
        out[(*at, k)] = found[f"s{k}"].to_numpy()
    return out


def _cell_batch(total: np.ndarray) -> pa.RecordBatch:
    at = np.nonzero(total[..., 0])
    columns = [pa.array(a.astype(np.int32)) for a in at] + [pa.array(total[(*at, k)]) for k in range(total.shape[-1])]
    return pa.RecordBatch.from_arrays(columns, names=["slot", "feature", "bin", *[f"s{k}" for k in range(total.shape[-1])]])


def _upper_levels(table, features, trees, min_leaf, tries, classes, seed, most) -> dict[int, list]:
    """Nodes of every tree down to those with at most ``most`` rows: lists of [feature, threshold, low, high, value, gain]."""
    spark, outputs = table.sparkSession, 1 if classes is None else classes
    cuts = feature_cuts(table, features)
    width, numbers = max(map(len, cuts)) + 1, 3 + outputs  # count, weight, sums, sum of squares
    grown = {t: [[LEAF, 0.0, -1, -1, [0.0] * outputs, 0.0]] for t in range(trees)}
    frontier = [(t, 0) for t in range(trees)]
    at_once = max(1, HISTOGRAM_CELLS // (features * width * numbers))
    while frontier:
        following = []
        for start in range(0, len(frontier), at_once):
            some = frontier[start : start + at_once]
            sent = spark.sparkContext.broadcast((_partial(grown), some, cuts))

            def make(batches, sent=sent):
                ensemble, wanted, cuts = sent.value
                slots = np.full(len(ensemble.feature), -1)
                for k, (t, node) in enumerate(wanted):
                    slots[ensemble.roots[t] + node] = k
                total = np.zeros((len(wanted), features, width, numbers))
                for batch in batches:
                    ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), features)
                    y = _outputs(batch.column(2).to_numpy(), classes)
                    bins, leaves = _bins(x, cuts), ensemble.leaves(x)
                    for t in sorted({t for t, _ in wanted}):
                        w, slot = draws(ids, t, seed), slots[leaves[:, t]]
                        rows = (w > 0) & (slot >= 0)
                        v = w[rows, None].astype(float)
                        stats = np.concatenate([np.ones_like(v), v, v * y[rows], v * (y[rows] ** 2).sum(axis=1, keepdims=True)], axis=1)
                        total += histogram(bins[rows], slot[rows], stats, len(wanted), width)
                yield _cell_batch(total)

            found = _cells(_summed(table, make, numbers), len(some), features, width, numbers)
            for (t, node), cells in zip(some, found):
                whole = cells[0].sum(axis=0)
                nodes = grown[t]
                nodes[node][4] = (whole[2:-1] / max(whole[1], 1.0)).tolist()
                pure = whole[-1] - _scores(whole[1], whole[2:-1]) <= 1e-12 * max(abs(whole[-1]), 1e-300)
                best = None if whole[0] <= most or pure else choose(cells, cuts, min_leaf, tries, np.random.default_rng([seed, t, node]), slice(2, -1))
                if best is None:
                    continue
                f, threshold, gain, left, right = best
                nodes[node][:4] = [f, threshold, len(nodes), len(nodes) + 1]
                nodes[node][5] = gain
                for side in (left, right):
                    if side[0] > most:
                        following.append((t, len(nodes)))
                    nodes.append([LEAF, 0.0, -1, -1, (side[2:-1] / max(side[1], 1.0)).tolist(), 0.0])
        frontier = following
    return grown


def _node_table(grown: dict[int, list]) -> pa.Table:
    rows = [(t, k, *node) for t, nodes in grown.items() for k, node in enumerate(nodes)]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64()]
    names = ["tree", "node", "feature", "threshold", "low", "high", "value", "gain"]
    return pa.table([pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)], names=names)


def _partial(grown: dict[int, list]) -> Ensemble:
    return Ensemble.from_nodes(_node_table(grown), [1.0] * len(grown))


def _finished(table, features, upper, trees, min_leaf, tries, classes, seed) -> pa.Table:
    """The subtrees below the upper levels: ``NODES`` and ``graft``, the upper leaf they grow from."""
    sent = table.sparkSession.sparkContext.broadcast(_partial(upper))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ensemble = sent.value
        for batch in batches:
            ids, leaves = batch.column(0).to_numpy(), ensemble.leaves(_matrix(batch.column(1), features))
            for t in trees:
                w = draws(ids, t, seed)
                rows = np.flatnonzero(w)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), t, np.int32)), pa.array((leaves[rows, t] - ensemble.roots[t]).astype(np.int32)),
                        batch.column(1).take(take), batch.column(2).take(take), pa.array(w[rows]),
                    ],
                    names=["tree", "graft", "x", "y", "w"],
                )

    def grow(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        tree, graft = (k.as_py() for k in key)
        x, w = _matrix(part["x"].combine_chunks(), features), part["w"].to_numpy()
        y = _outputs(part["y"].to_numpy(), classes)
        order = np.lexsort((w, part["y"].to_numpy(), *x.T))  # rows come in any order; sums must not depend on it
        generator = np.random.default_rng([seed, tree, graft])
        made = _node_batch(tree, grow_tree(x[order], y[order], w[order], min_leaf, tries, generator))
        return pa.Table.from_batches([made]).append_column("graft", pa.array(np.full(len(made), graft, np.int32)))

    dealt = table.mapInArrow(deal, "tree int, graft int, x array<double>, y double, w long")
    return dealt.groupBy("tree", "graft").applyInArrow(grow, NODES + ", graft int").toArrow()


def _grafted(upper: dict[int, list], below: pa.Table) -> pa.Table:
    """Upper nodes and subtrees under one numbering per tree: a subtree's root takes the place of its upper leaf."""
    below = below.sort_by([("tree", "ascending"), ("graft", "ascending"), ("node", "ascending")]).combine_chunks()
    tree, graft, node = (below[name].to_numpy() for name in ("tree", "graft", "node"))
    new = np.ones(len(tree), bool)
    new[1:] = (tree[1:] != tree[:-1]) | (graft[1:] != graft[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(tree)))
    base = np.zeros(len(first), np.int64)
    running = {t: len(nodes) for t, nodes in upper.items()}
    for k, start in enumerate(first):
        base[k] = running[int(tree[start])] - 1
        running[int(tree[start])] += int(sizes[k]) - 1
    shift = np.repeat(base, sizes)
    number = np.where(node == 0, graft, shift + node)
    ends = {side: np.where(below["feature"].to_numpy() == LEAF, -1, shift + below[side].to_numpy()) for side in ("low", "high")}
    moved = pa.table({
        "tree": below["tree"], "node": pa.array(number.astype(np.int32)), "feature": below["feature"], "threshold": below["threshold"],
        "low": pa.array(ends["low"].astype(np.int32)), "high": pa.array(ends["high"].astype(np.int32)), "value": below["value"], "gain": below["gain"],
    })
    kept = {t: [(k, n) for k, n in enumerate(nodes)] for t, nodes in upper.items()}
    replaced = set(zip(tree[first].tolist(), graft[first].tolist()))
    rows = [(t, k, *n) for t, nodes in kept.items() for k, n in nodes if (t, k) not in replaced]
    if not rows:
        return moved
    return pa.concat_tables([moved, pa.table([pa.array(list(c), kind) for c, kind in zip(zip(*rows), moved.schema.types)], names=moved.schema.names)])


# ---------------------------------------------------------------- boosting


def _softmax(scores: np.ndarray) -> np.ndarray:
    shares = np.exp(scores - scores.max(axis=1, keepdims=True))
    return shares / shares.sum(axis=1, keepdims=True)


def _residuals(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative gradient and curvature of the loss: of the softmax for classes, of the square for one number."""
    if scores.shape[1] == 1:
        residual = y[:, None] - scores
        return residual, np.ones_like(residual)
    residual = np.eye(scores.shape[1])[y.astype(np.int64)] - _softmax(scores)
    return residual, np.abs(residual) * (1 - np.abs(residual))


def boost(source, cuts: list[np.ndarray], base: np.ndarray, rounds: int, rate: float, depth: int, min_leaf: int, seed: int) -> list[list]:
    """Trees of boosting: in every round one tree per class on the residuals of that round's shared probabilities.

    ``source(nodes, wanted)`` gives the histograms (count, weight, residual, curvature) of the wanted (class, node) pairs,
    given all nodes of the round so far; ``source.close(nodes)`` takes the round's trees over into the scores. A leaf adds
    ``rate * (K - 1) / K * sum(residual) / sum(curvature)``. One number has one tree a round, and its leaves add the rate times
    their mean residual.
    """
    classes, done = len(base), []
    factor = (classes - 1) / classes if classes > 1 else 1.0
    for turn in range(rounds):
        nodes = [[[LEAF, 0.0, -1, -1, 0.0, 0.0]] for _ in range(classes)]
        wanted = [(k, 0) for k in range(classes)]
        for _ in range(depth):
            following = []
            for (k, node), cells in zip(wanted, source(nodes, wanted)):
                best = choose(cells, cuts, min_leaf, len(cuts), np.random.default_rng([seed, turn, k, node]), slice(2, 3))
                sides = []
                if best is not None:
                    f, threshold, gain, *sides = best
                    nodes[k][node][:4] = [f, threshold, len(nodes[k]), len(nodes[k]) + 1]
                    nodes[k][node][5] = gain
                    following += [(k, len(nodes[k])), (k, len(nodes[k]) + 1)]
                whole = cells[0].sum(axis=0)
                for target, sums in zip([node] if not sides else [None, None], sides or [whole]):
                    leaf = factor * sums[2] / sums[3] if sums[3] > 1e-150 else 0.0
                    if target is None:
                        nodes[k].append([LEAF, 0.0, -1, -1, rate * leaf, 0.0])
                    else:
                        nodes[k][target][4] = rate * leaf
            wanted = following
            if not wanted:
                break
        source.close(nodes)
        done += nodes
    return done


def _class_trees(trees: list[list], classes: int, base: np.ndarray) -> Ensemble:
    """Trees of rounds (one per class, in order) as an ensemble of class scores."""
    if not trees:
        raise ValueError("at least one round is needed")
    spread = lambda k, v: [v if c == k else 0.0 for c in range(classes)]
    grown = {t: [[*n[:4], spread(t % classes, n[4]), n[5]] for n in nodes] for t, nodes in enumerate(trees)}
    return Ensemble.from_nodes(_node_table(grown), [1.0] * len(trees), base)


class _Held:
    """Histograms of a matrix in memory; ``weight`` is the number of rows behind each of its lines."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], base: np.ndarray, weight: np.ndarray | None = None):
        self.x, self.y, self.classes = x, y, len(base)
        self.weight = np.ones(len(y)) if weight is None else weight
        self.bins, self.width = _bins(x, cuts), max(map(len, cuts)) + 1
        self.scores = np.tile(base, (len(y), 1))
        self.residual, self.curve = _residuals(self.scores, self.y)

    def __call__(self, nodes: list[list], wanted: list[tuple[int, int]]) -> list[np.ndarray]:
        return list(round_histograms(self.x, self.bins, self.residual, self.curve, self.weight, nodes, wanted, self.width))

    def close(self, nodes: list[list]) -> None:
        self.scores += _class_trees(nodes, self.classes, np.zeros(self.classes)).evaluate(self.x)
        self.residual, self.curve = _residuals(self.scores, self.y)


def round_histograms(x, bins, residual, curve, weight, nodes, wanted, width) -> np.ndarray:
    classes = residual.shape[1]
    ensemble = _class_trees(nodes, classes, np.zeros(classes))
    leaves = ensemble.leaves(x)
    out = np.zeros((len(wanted), bins.shape[1], width, 4))
    for k in sorted({k for k, _ in wanted}):
        slots = np.full(len(ensemble.feature), -1)
        for place, (c, node) in enumerate(wanted):
            if c == k:
                slots[ensemble.roots[k] + node] = place
        slot = slots[leaves[:, k]]
        rows = slot >= 0
        w = weight[rows]
        out += histogram(bins[rows], slot[rows], np.stack([w, w, w * residual[rows, k], w * curve[rows, k]], axis=1), len(wanted), width)
    return out


class _Spread:
    """Histograms of a table of ``_binned`` lines, one job each; scores are written every ``REST`` rounds."""

    def __init__(self, table: DataFrame, features: int, cuts: list[np.ndarray], base: np.ndarray):
        self.features, self.cuts, self.base = features, cuts, base
        self.table = table.select("x", "y", "n", F.array(*[F.lit(float(b)) for b in base]).alias("s"))
        self.recent: list[list] = []
        self.width, self.rounds = max(map(len, cuts)) + 1, 0

    def _ensemble(self) -> Ensemble | None:
        return _class_trees(self.recent, len(self.base), np.zeros(len(self.base))) if self.recent else None

    def __call__(self, nodes: list[list], wanted: list[tuple[int, int]]) -> list[np.ndarray]:
        features, width, classes = self.features, self.width, len(self.base)
        sent = self.table.sparkSession.sparkContext.broadcast((self._ensemble(), nodes, wanted, self.cuts))

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ensemble, nodes, wanted, cuts = sent.value
            total = np.zeros((len(wanted), features, width, 4))
            for batch in batches:
                x, y = _matrix(batch.column(0), features), batch.column(1).to_numpy()
                scores = _matrix(batch.column(3), classes)
                scores = scores if ensemble is None else scores + ensemble.evaluate(x)
                total += round_histograms(x, _bins(x, cuts), *_residuals(scores, y), batch.column(2).to_numpy(), nodes, wanted, width)
            yield _cell_batch(total)

        return list(_cells(_summed(self.table, make, 4), len(wanted), features, width, 4))

    def close(self, nodes: list[list]) -> None:
        self.recent += nodes
        self.rounds += 1
        if self.rounds % REST == 0:
            scores = scorer(self._ensemble())
            self.table = reliable_checkpoint(self.table.select("x", "y", "n", F.zip_with("s", scores(F.col("x")), lambda a, b: a + b).alias("s")))
            self.recent = []


def _binned(table: DataFrame, features: int, cuts: list[np.ndarray], classes: int) -> DataFrame:
    """``(x, y, n)``: rows that no split can tell apart as one line, with the largest values of their bins and their number.

    Trees see a row through its bins alone. Classes make lines of their own; of a number a line has the mean, from which the sum of
    the residuals follows.
    """
    ends = [np.append(c, np.inf) for c in cuts]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = _matrix(batch.column(0), features), batch.column(1).to_numpy()
            group = y if classes > 1 else np.zeros(len(y))
            lines, at = _distinct(np.column_stack([_bins(x, cuts), group]))
            place = lines[:, :-1].astype(np.int64)
            held = np.stack([ends[f][place[:, f]] for f in range(features)], axis=1)
            columns = [_lists(held), pa.array(lines[:, -1]), pa.array(np.bincount(at, minlength=len(lines)).astype(float)), pa.array(np.bincount(at, y, len(lines)))]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "n", "total"])

    folded = table.select("x", "y").mapInArrow(fold, "x array<double>, y double, n double, total double")
    added = folded.groupBy("x", "y").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return added.select("x", F.col("y") if classes > 1 else (F.col("total") / F.col("n")).alias("y"), "n")


def fit_boosting(
    rows: DataFrame, classes: int | None, label: str = "label", rounds: int = 100, rate: float = 0.05, depth: int = 3, min_leaf: int = 1,
    seed: int = 42, local_values: int = LOCAL_VALUES,
) -> Ensemble:
    """Class scores by joint boosting of all classes, whose softmax are the probabilities; without ``classes`` boosting of a number.

    Scores start at the logarithms of the class shares, or at the mean. Splits are chosen from histograms over at most 128 quantile bins a
    feature, so rows of equal bins (and class) are counted as one line. Lines of at most ``local_values`` numbers are boosted in one
    task; of more each level of a round is one sum over their table, and the trees are the same up to rounding.
    """
    table, n, features = _numbered(rows, label)
    if classes is None:
        base, classes = np.array([table.agg(F.avg("y")).first()[0]]), 1
    else:
        counts = {int(r["y"]): r["count"] for r in table.groupBy("y").count().collect()}
        base = np.log(np.maximum([counts.get(k, 0) for k in range(classes)], 1e-9 * n) / n)
    cuts = feature_cuts(table, features)
    lines = reliable_checkpoint(_binned(table, features, cuts, classes))
    if lines.count() * features > local_values:
        return _class_trees(boost(_Spread(lines, features, cuts, base), cuts, base, rounds, rate, depth, min_leaf, seed), classes, base)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(_matrix(b.column(0), features), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if len(b)]
        x, y, weight = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((y, *x.T))  # lines come in any order; sums must not depend on it
        trees = boost(_Held(x[order], y[order], cuts, base, weight[order]), cuts, base, rounds, rate, depth, min_leaf, seed)
        for t, nodes in enumerate(trees):
            yield from _node_table({t: [[*node[:4], [node[4]], node[5]] for node in nodes]}).to_batches()

    nodes = lines.coalesce(1).mapInArrow(whole, NODES).toArrow().sort_by([("tree", "ascending"), ("node", "ascending")]).to_pylist()
    trees: list[list] = [[] for _ in range(rounds * classes)]
    for r in nodes:
        trees[r["tree"]].append([r["feature"], r["threshold"], r["low"], r["high"], r["value"][0], r["gain"]])
    return _class_trees(trees, classes, base)


# ---------------------------------------------------------------- scoring


def scorer(ensemble: Ensemble):
    """A function from an array column of features to the array of outputs; the trees go to the tasks once."""
    sent = SparkSession.active().sparkContext.broadcast(ensemble)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def outputs(rows: pa.Array) -> pa.Array:
        found = sent.value.evaluate(_matrix(rows, len(rows.flatten()) // max(len(rows), 1)))
        offsets = pa.array(np.arange(len(rows) + 1) * found.shape[1], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))

    return outputs


def probabilities(scores: Column) -> Column:
    """Softmax of an array of scores."""
    shares = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    return F.transform(shares, lambda s: s / total)


# ---------------------------------------------------------------- files


def save_ensemble(spark: SparkSession, ensemble: Ensemble, location: str) -> None:
    """Nodes, and per tree its weight; the base is a tree of number -1 there."""
    spark.createDataFrame(ensemble.table()).write.mode("overwrite").parquet(f"{location}/nodes")
    weights = [(t, [float(w)]) for t, w in enumerate(ensemble.weights)] + [(-1, ensemble.base.tolist())]
    small_table(spark, weights, "tree int, numbers array<double>").write.mode("overwrite").parquet(f"{location}/weights")


def load_ensemble(spark: SparkSession, location: str) -> Ensemble:
    weights = {r["tree"]: r["numbers"] for r in spark.read.parquet(f"{location}/weights").collect()}
    base = weights.pop(-1)
    nodes = spark.read.parquet(f"{location}/nodes").toArrow()
    return Ensemble.from_nodes(nodes, [weights[t][0] for t in range(len(weights))], base)
