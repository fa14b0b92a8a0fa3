"""Exact k-nearest-neighbour prediction without comparing all pairs at scale."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablelens.operators.columns import field_types, ref
from tablelens.session import reliable_checkpoint

BROADCAST_VALUES = 4_000_000  # largest training matrix sent to every task (32 MB)
BROADCAST_PAIRS = 200_000_000  # most pairs of rows that are compared without looking for cells
BLOCK_ROWS = 20_000  # rows of one side in one comparison block
BLOCK_VALUES = 2_000_000  # numbers of one side in one comparison block (16 MB)
SLICE_QUERIES = 512  # queries that are compared with one run of points
MOST_CELLS = 2_000  # so that lists of pairs of cells stay small
PAIR_ROWS = 1_000  # rows whose sending costs as much as one more block
PIVOT_VALUES = 2_000_000  # largest matrix of pivots (16 MB)
NEIGHBOUR = "query long, distance double, neighbour long, label {label}"


def _vectors(df: DataFrame, features: Sequence[str] | str, key: str, label: str | None = None) -> DataFrame:
    vector = ref(features).cast("array<double>") if isinstance(features, str) else F.array(
        *[ref(f).cast("double") for f in features]
    )
    columns = [ref(key).cast("long").alias("key"), vector.alias("vector")]
    return df.select(*columns, *([ref(label).alias("label")] if label else []))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def _chunks(queries: np.ndarray, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Squared distances by a matrix product, some queries at a time to bound memory, and how wrong a row of them may be."""
    squares, most = (points**2).sum(axis=1), float((points**2).sum(axis=1).max())
    unit = 8 * (points.shape[1] + 4) * np.finfo(float).eps
    chunk = max(1, 2_000_000 // len(points))
    for start in range(0, len(queries), chunk):
        some = queries[start:start + chunk]
        own = (some**2).sum(axis=1)
        yield start, np.maximum(own[:, None] + squares - 2 * (some @ points.T), 0.0), unit * (own + most)


def _exact(queries: np.ndarray, points: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for start in range(0, len(rows), 50_000):
        at = slice(start, start + 50_000)
        out[at] = np.sqrt(((queries[rows[at]] - points[columns[at]]) ** 2).sum(axis=1))
    return out


def _nearest(query_keys, queries, keys, points, labels, k: int, bounds: np.ndarray | None = None) -> pd.DataFrame:
    """The ``k`` nearest points of each query: candidates by matrix products, chosen by exact distances, ties by key."""
    k = min(k, len(keys))
    found = []
    for start, squares, slack in _chunks(queries, points):
        limit = np.partition(squares, k - 1, axis=1)[:, k - 1] + 2 * slack
        if bounds is not None:
            limit = np.minimum(limit, bounds[start:start + len(squares)] ** 2 * (1 + 1e-9) + slack)
        rows, columns = np.nonzero(squares <= limit[:, None])
        distance = _exact(queries[start:start + len(squares)], points, rows, columns)
        order = np.lexsort((keys[columns], distance, rows))
        rows, columns, distance = rows[order], columns[order], distance[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < k
        found.append((query_keys[start + rows[kept]], distance[kept], keys[columns[kept]], labels[columns[kept]]))
    parts = [np.concatenate(part) for part in zip(*found)] if found else [[], [], [], []]
    return pd.DataFrame(dict(zip(("query", "distance", "neighbour", "label"), parts)))


def nearest_neighbours(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str] | str,
    key: str,
    label: str,
    k: int = 7,
    broadcast_values: int = BROADCAST_VALUES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query, distance, neighbour, label)``: the ``k`` nearest training rows of each test row.

    Exact; equal distances go to the smaller key. A training matrix below
    ``broadcast_values`` numbers that few queries meet is sent to the tasks. A larger one, or one of too many pairs, is cut into cells around
    pivot rows; a query first searches the cell nearest to it, and with the k-th distance found there the
    triangle inequality tells which others can still hold neighbours (``visited_cells`` counts them). Cells are
    compared in blocks of bounded size however full they are.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    points, queries = _vectors(train, features, key, label), _vectors(test, features, key)
    label_type = field_types(points)["label"].simpleString()
    schema = NEIGHBOUR.format(label=label_type)
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not size["n"]:
        raise ValueError("no training rows")
    if size["n"] * size["d"] <= broadcast_values and size["n"] * queries.count() <= BROADCAST_PAIRS:
        local = points.toPandas()
        shared = train.sparkSession.sparkContext.broadcast((
            local["key"].to_numpy(), _matrix(local["vector"]), local["label"].to_numpy(),
        ))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, matrix, labels = shared.value
            for batch in batches:
                if len(batch):
                    yield _nearest(batch["key"].to_numpy(), _matrix(batch["vector"]), keys, matrix, labels, k)

        return queries.mapInPandas(search, schema)
    return _search_cells(points, queries, size["n"], size["d"], k, block_rows)[0]


def visited_cells(
    train: DataFrame, test: DataFrame, features: Sequence[str] | str, key: str, label: str, k: int = 7, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(query, cells, of)``: how many of all cells the search of a large training table visits for each test row."""
    points, queries = _vectors(train, features, key, label), _vectors(test, features, key)
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    return _search_cells(points, queries, size["n"], size["d"], k, block_rows)[1]


def _side_by_side(points: np.ndarray) -> np.ndarray:
    """Points in an order that keeps near ones together: halves by the widest feature, over and over."""
    if len(points) <= 2:
        return points
    order = np.argsort(points[:, np.argmax(points.std(axis=0))], kind="stable")
    half = len(points) // 2
    return np.concatenate([_side_by_side(points[order[:half]]), _side_by_side(points[order[half:]])])


def _pivots(points: DataFrame, n: int, d: int) -> np.ndarray:
    """About sqrt(n) rows by the hash of their key, as many as a bounded matrix holds."""
    wanted = int(max(2, min(np.sqrt(n), MOST_CELLS, PIVOT_VALUES / max(d, 1))))
    share = min(1.0, wanted / n)
    drawn = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)
    chosen = points.where(drawn).select("vector").limit(4 * wanted + 100).toPandas()
    if not len(chosen):
        chosen = points.select("vector").limit(1).toPandas()
    return _side_by_side(np.unique(_matrix(chosen["vector"]), axis=0))


def _near_slices(query_part: pd.DataFrame, train_part: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """``_nearest`` of some queries at a time, each with the points no farther along the widest feature than the bounds allow."""
    queries, points = _matrix(query_part["vector"]), _matrix(train_part["vector"])
    bound, keys, labels = query_part["bound"].to_numpy(), train_part["key"].to_numpy(), train_part["label"].to_numpy()
    axis = int(np.argmax(points.std(axis=0)))
    at = np.argsort(points[:, axis], kind="stable")
    points, keys, labels = points[at], keys[at], labels[at]
    order = np.argsort(queries[:, axis], kind="stable")
    for start in range(0, len(order), SLICE_QUERIES):
        some = order[start:start + SLICE_QUERIES]
        place, reach = queries[some, axis], bound[some] * (1 + 1e-9)
        first = np.searchsorted(points[:, axis], (place - reach).min(), side="left")
        last = np.searchsorted(points[:, axis], (place + reach).max(), side="right")
        if first < last:
            yield _nearest(query_part["key"].to_numpy()[some], queries[some], keys[first:last], points[first:last], labels[first:last], k, bound[some])


def _merge(needed: np.ndarray, asking: np.ndarray, counts: np.ndarray, block_rows: int) -> int:
    """How many neighbouring cells to compare as one, so that the fewest rows are sent.

    ``needed`` tells which cells (columns) the queries of a home cell (rows) ask for. A pair of merged cells sends all its queries to
    every block of its points and all its points to every slice of its queries, and costs as much as ``PAIR_ROWS`` rows besides.
    """
    best, least, merged = 1, np.inf, 1
    while True:
        starts = np.arange(0, len(counts), merged)
        pairs = np.add.reduceat(np.add.reduceat(needed.astype(np.int64), starts, axis=0), starts, axis=1) > 0
        q, n = np.add.reduceat(asking, starts), np.add.reduceat(counts, starts)
        slices, blocks = -(-q // block_rows), -(-n // block_rows)
        cost = (pairs * (q[:, None] * blocks + slices[:, None] * n + PAIR_ROWS * slices[:, None] * blocks)).sum()
        if cost < least:
            best, least = merged, cost
        if merged >= len(counts):
            return best
        merged *= 2


def _search_cells(points: DataFrame, queries: DataFrame, n: int, d: int, k: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Bound-first search over cells around pivots, in two waves.

    Each query lives in the cell of its nearest pivot. The first wave compares it with that cell's rows; the k-th distance there, or the
    k rows that cells hold by ``distance to pivot + radius``, bounds its search. The second wave visits the cells whose least
    distance, ``distance to pivot - radius``, keeps the bound. Only the pairs of home and visited cell are listed, at most
    ``MOST_CELLS`` squared; rows then meet in blocks of bounded size. Where bounds rule out little, neighbouring cells are merged, so
    that a row is sent once per block of the other side and not once per query or cell.
    """
    spark = points.sparkSession
    # labels of any type stay behind; numbers of their rows go through the search
    given = reliable_checkpoint(points.withColumn("row", F.monotonically_increasing_id()))
    points, schema = given.select("key", "vector", F.col("row").alias("label")), NEIGHBOUR.format(label="long")
    block_rows = max(1, min(block_rows, BLOCK_VALUES // max(d, 1)))
    pivots = _pivots(points, n, d)
    sent = spark.sparkContext.broadcast(pivots)

    def to_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = _matrix(batch["vector"])
            cell = np.concatenate([squares.argmin(axis=1) for _, squares, _ in _chunks(vectors, sent.value)]).astype(np.int32)
            yield batch.assign(cell=cell, reach=_exact(vectors, sent.value, np.arange(len(vectors)), cell))

    added = [T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())]
    held = reliable_checkpoint(points.mapInPandas(to_cell, T.StructType([*points.schema.fields, *added])))
    found = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")).toPandas()
    counts, radii = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    counts[found["cell"]], radii[found["cell"]] = found["n"], found["radius"]
    asking = reliable_checkpoint(queries.mapInPandas(to_cell, T.StructType([*queries.schema.fields, *added])).drop("reach"))
    homes = asking.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()
    asked = np.zeros(len(pivots), np.int64)
    asked[homes["cell"]] = homes["n"]
    facts = spark.sparkContext.broadcast((counts, radii))

    def least(vectors: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per some queries: their better bounds and which cells can hold rows within them."""
        counts, radii = facts.value
        for start, squares, slack in _chunks(vectors, sent.value):
            # a distance may be off by the error of its square
            far = np.sqrt(squares + slack[:, None]) + radii * (1 + 1e-9)
            far[:, counts == 0] = np.inf
            order = np.argsort(far, axis=1)
            enough = np.cumsum(counts[order], axis=1) >= k
            at = np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1)
            reach = np.where(enough[:, -1], np.take_along_axis(far, at, axis=1)[:, 0], np.inf) * (1 + 1e-9)
            better = np.minimum(bound[start:start + len(squares)], reach)
            near = np.sqrt(np.maximum(squares - slack[:, None], 0.0)) - radii * (1 + 1e-9)
            yield start, better, (near <= (better * (1 + 1e-9))[:, None]) & (counts > 0)

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                parts = [(better, wanted.sum(axis=1)) for _, better, wanted in least(_matrix(batch["vector"]), batch["bound"].to_numpy())]
                better, cells = (np.concatenate(part) for part in zip(*parts))
                yield batch.assign(bound=better, cells=cells)

    def pairs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(sent.value), len(sent.value)), bool)
        for batch in batches:
            if len(batch):
                home = batch["cell"].to_numpy()
                for start, _, wanted in least(_matrix(batch["vector"]), batch["bound"].to_numpy()):
                    row, cell = np.nonzero(wanted)
                    seen[home[start + row], cell] = True
        home, cell = np.nonzero(seen)
        yield pd.DataFrame({"home": home.astype(np.int32), "cell": cell.astype(np.int32)})

    def compare(train_part: pd.DataFrame, query_part: pd.DataFrame) -> pd.DataFrame:
        parts = list(_near_slices(query_part, train_part, k)) if len(train_part) and len(query_part) else []
        if not parts:
            return pd.DataFrame({"query": [], "distance": [], "neighbour": [], "label": []})
        return pd.concat(parts)

    def meet(bounded: DataFrame, needed: np.ndarray, merged: int) -> DataFrame:
        """The ``k`` nearest rows of each query in the cells its home needs, ``merged`` neighbouring cells at a time."""
        starts = np.arange(0, len(counts), merged)
        wanted = np.add.reduceat(np.add.reduceat(needed.astype(np.int64), starts, axis=0), starts, axis=1) > 0
        slices, blocks = (np.maximum(-(-np.add.reduceat(v, starts) // block_rows), 1) for v in (asked, counts))
        home, cell = np.nonzero(wanted)
        records = pa.table({name: pa.array(v.astype(np.int32)) for name, v in (("home", home), ("part", cell), ("slices", slices[home]), ("blocks", blocks[cell]))})
        pairs = F.broadcast(spark.createDataFrame(records))
        slot = lambda size: F.pmod(F.xxhash64("key", F.lit(11)), F.col(size)).cast("int")
        every = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
        unit = ["home", "part", "slice", "block"]
        merge = F.floor(F.col("cell") / merged).cast("int")
        left = held.select("key", "vector", "label", merge.alias("part")).join(pairs, "part").withColumn("block", slot("blocks")).withColumn("slice", every("slices"))
        right = bounded.select("key", "vector", "bound", merge.alias("home")).join(pairs, "home").withColumn("slice", slot("slices")).withColumn("block", every("blocks"))
        left = left.select("key", "vector", "label", *unit).groupBy(*unit)
        near = left.cogroup(right.select("key", "vector", "bound", *unit).groupBy(*unit)).applyInPandas(compare, schema)
        place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
        return near.withColumn("__r", place).where(F.col("__r") <= k).drop("__r")

    first = meet(asking.withColumn("bound", F.lit(float("inf"))), np.eye(len(counts), dtype=bool) & (asked > 0), 1)
    reached = first.groupBy("query").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("found"))
    own = asking.join(reached, asking["key"] == reached["query"], "left").select(
        "key", "vector", "cell", F.when(F.col("found") >= k, F.col("far")).otherwise(F.lit(float("inf"))).alias("bound")
    )
    own = reliable_checkpoint(own.mapInPandas(bounded, "key long, vector array<double>, cell int, bound double, cells long"))
    listed = own.mapInPandas(pairs_of, "home int, cell int").distinct().toPandas()
    needed = np.zeros((len(counts), len(counts)), bool)
    needed[listed["home"], listed["cell"]] = True
    best = meet(own, needed, _merge(needed, asked, counts, block_rows)).withColumnRenamed("label", "row")
    best = best.join(given.select("row", "label"), "row").select("query", "distance", "neighbour", "label")
    return best, own.select(F.col("key").alias("query"), "cells", F.lit(int((counts > 0).sum())).alias("of"))


def neighbour_weights(near: DataFrame) -> DataFrame:
    """Neighbours with ``weight``: inverse distance; exact matches outweigh all others."""
    exact = F.min("distance").over(Window.partitionBy("query")) == 0
    weight = F.when(exact, F.when(F.col("distance") == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    return near.withColumn("weight", weight)


def knn_predict(
    train: DataFrame, test: DataFrame, features: Sequence[str] | str, key: str, label: str, k: int = 7,
    problem_type: str = "classification", **limits: int,
) -> DataFrame:
    """``(query, prediction)``: neighbours weighted by inverse distance; exact matches outweigh all others."""
    near = nearest_neighbours(train, test, features, key, label, k, **limits)
    weighted = neighbour_weights(near)
    if problem_type == "regression":
        mean = F.sum(F.col("weight") * F.col("label")) / F.sum("weight")
        return weighted.groupBy("query").agg(mean.alias("prediction"))
    votes = weighted.groupBy("query", "label").agg(F.sum("weight").alias("votes"))
    return votes.groupBy("query").agg(F.min_by("label", F.struct(-F.col("votes"), "label")).alias("prediction"))
