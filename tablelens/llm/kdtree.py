"""Exact search for the largest inner products with k-d trees per shard."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tablelens.llm.common import pin_batches, written

SHARD = 8192  # vectors of a shard
LEAF = 64  # vectors of a tree's leaf
CUT_SAMPLE = 20_000  # vectors that place the cuts between shards; all are indexed
SENT_BOXES = 4096  # shard boxes that go to the tasks at a time


class Tree:
    """Median splits of the widest dimension; every node has the tight box of its vectors."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order, low, high, children, spans, cuts = np.arange(len(points)), [], [], [], [], []
        stack = [(0, len(points), -1, 0)]
        while stack:
            begin, end, parent, side = stack.pop()
            here = points[order[begin:end]]
            node = len(spans)
            low.append(here.min(0))
            high.append(here.max(0))
            children.append([-1, -1])
            cuts.append((0, 0.0))
            spans.append((begin, end))
            if parent >= 0:
                children[parent][side] = node
            width = high[-1] - low[-1]
            if end - begin > leaf and width.max() > 0:
                axis, middle = int(width.argmax()), (end - begin) // 2
                part = np.argpartition(here[:, axis], middle)
                order[begin:end] = order[begin:end][part]
                cuts[node] = (axis, float(points[order[begin + middle], axis]))
                stack.append((begin + middle, end, node, 1))
                stack.append((begin, begin + middle, node, 0))
        self.points, self.ids = points[order], ids[order]
        self.low, self.high = np.array(low), np.array(high)
        self.children, self.spans, self.cuts = children, spans, cuts

    def search(self, query: np.ndarray, own: int, k: int, least: float) -> list[tuple[float, int]]:
        """The k best (score, id) of other rows than ``own`` that reach ``least``: higher scores, then smaller ids.

        Nodes are visited by falling bound, the product of the query with the best corner of the box; the search ends
        when the best bound left is below the k-th score known so far, here or from another shard.
        """
        bounds = self.high @ np.maximum(query, 0) + self.low @ np.minimum(query, 0)
        heap, best = [(-bounds[0], 0)], []  # best: heap of (score, -id), the worst first
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[1]
            if self.children[node][0] >= 0:
                for child in self.children[node]:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            begin, end = self.spans[node]
            scores = self.points[begin:end] @ query
            for at in np.flatnonzero(scores >= least):
                one = (scores[at], -int(self.ids[begin + at]))
                if -one[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, one)
                elif one > best[0]:
                    heapq.heapreplace(best, one)
            if len(best) == k:
                least = max(least, best[0][0])
        return [(score, -negative) for score, negative in sorted(best, reverse=True)]

    def cell(self, points: np.ndarray) -> np.ndarray:
        """Which leaf's side of all cuts each point is on."""
        at = np.zeros(len(points), np.int32)
        while True:
            moved = False
            for node in np.unique(at):
                if self.children[node][0] >= 0:
                    rows, (axis, cut) = at == node, self.cuts[node]
                    at[rows] = np.where(points[rows, axis] < cut, *self.children[node])
                    moved = True
            if not moved:
                return at


def _numbers(column: pa.Array) -> np.ndarray:
    """Integer vectors of one length as doubles, or as integers where doubles cannot hold the products."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    points = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)
    top = float(np.abs(points.astype(float)).max(initial=0))
    return points.astype(float) if top * top * points.shape[1] < 2.0**52 else points


_TREE = pa.schema([("shard", pa.int64()), ("rows", pa.int64()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())),
                   ("ids", pa.list_(pa.int64())), ("points", pa.binary())])
_HIT = pa.schema([("query_id", pa.int64()), ("mark", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _shard_row(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A shard as one row: its box, ids and vectors."""
    points = np.ascontiguousarray(table["point"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1))
    return pa.table({
        "shard": [key[0].as_py()], "rows": [table.num_rows], "low": [points.min(0)], "high": [points.max(0)],
        "ids": [table["vec_id"].to_numpy()], "points": [points.astype(np.int64).tobytes()],
    }, schema=_TREE)


def _search(k: int):
    """Shard rows, each followed by the queries that visit it: build the tree once, then search."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, shard = None, None
        for batch in batches:
            out: dict[str, list] = {name: [] for name in _HIT.names}
            queries = batch.column(3)
            for at, place in enumerate(batch.column(0).to_pylist()):
                blob = batch.column(6)[at].as_py()
                if blob is not None:
                    ids = np.array(batch.column(5)[at].as_py(), np.int64)
                    tree, shard = _tree(ids, blob), place
                    continue
                if place != shard:
                    continue
                query = np.array(queries[at].as_py())
                query = query.astype(float) if tree.points.dtype == float and np.abs(query).max(initial=0) < 2**26 else query
                own, mark = batch.column(1)[at].as_py(), batch.column(2)[at].as_py()
                least = batch.column(4)[at].as_py()
                for score, vec_id in tree.search(query, own, k, -math.inf if least is None else least):
                    for name, value in zip(_HIT.names, (own, mark, vec_id, int(score))):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_HIT)

    return search


def _worth(spark: SparkSession, block: list[Row]):
    """For each query, which of these shards' boxes could reach its k-th score so far."""
    box = spark.sparkContext.broadcast(
        (np.array([row["shard"] for row in block]), *(np.array([row[side] for row in block], float) for side in ("low", "high")))
    )

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def worth(column: pa.Array, least: pa.Array) -> pa.Array:
        shard, low, high = box.value
        query = _numbers(column).astype(float)
        bound = np.maximum(query, 0) @ high.T + np.minimum(query, 0) @ low.T
        need = np.nan_to_num(least.to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)[:, None]
        # a little slack, for products that doubles cannot hold exactly
        reach = bound + 1e-9 * np.abs(bound) >= need
        return pa.array([shard[row] for row in reach], pa.list_(pa.int64()))

    return worth


def _tree(ids: np.ndarray, blob: bytes) -> Tree:
    points = np.frombuffer(blob, np.int64).reshape(len(ids), -1)
    top = float(np.abs(points).max(initial=0))
    return Tree(points.astype(float) if top * top * points.shape[1] < 2.0**52 else points, ids)


def quantised(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``vec_id`` and ``point`` = floor(scale * x) per component; rows with unusable vectors or without an id are left out."""
    vector = F.col(f"`{vector_column}`")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(vector.isNotNull() & (F.size(vector) > 0) & fine & F.col(f"`{id_column}`").isNotNull())
    return rows.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("point"),
    )


def top_products(points: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD) -> DataFrame:
    """The ``k`` rows of ``points`` with the largest integer inner product for each row of ``queries``, exactly.

    Both have ``vec_id`` and ``point`` (array of long); shorter vectors count as padded with zeros. Space is cut
    into cells of about ``shard_rows`` vectors by medians of a bounded sample, a cell with more is dealt over several shards,
    so equal vectors never pile up in one. Every query first searches a shard of its own cell; the k-th
    score found goes with it to those other shards whose box could reach that score. Trees are built once per
    wave and shard, queries stream past them.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``; ties go to the smaller id. Rows with the query's id count as
    the query's own; repeated queries count once, repeated other rows each; fewer than k candidates give all. Scores must fit a
    long. Other columns are not carried.
    """
    spark = pin_batches(points.sparkSession)
    facts = points.agg(F.count("*").alias("n"), F.max(F.size("point")).alias("width")).first()
    n, width = facts["n"], facts["width"] or 1
    pad = lambda c: F.concat(c, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(c)))
    points = points.select("vec_id", pad("point").alias("point"))
    fits = F.slice(pad("point"), 1, width)  # a query longer than every vector
    queries = queries.select("vec_id", fits.alias("point")).withColumn("mark", F.xxhash64("point")).dropDuplicates(["vec_id", "mark"])
    cells = 1 << max(0, math.ceil(math.log2(max(n, 1) / shard_rows)))
    sample = points.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(CUT_SAMPLE).select("point").toArrow().combine_chunks()
    known = _numbers(sample["point"].combine_chunks()) if len(sample) else np.zeros((1, width))
    top = Tree(known, np.zeros(len(known), np.int64), max(1, math.ceil(len(known) / cells)) if cells > 1 else len(known))
    sent = spark.sparkContext.broadcast((top.children, top.cuts))

    @F.arrow_udf(T.IntegerType())
    def cell(column: pa.Array) -> pa.Array:
        tree = Tree.__new__(Tree)
        tree.children, tree.cuts = sent.value
        return pa.array(tree.cell(_numbers(column)))

    placed = written(points.withColumn("cell", cell("point")), "cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    sizes = written(sizes.withColumn("salts", F.ceil(F.col("n") / (2 * shard_rows))), "sizes")
    salted = placed.join(sizes.select("cell", "salts"), "cell")
    salt = F.pmod(F.xxhash64("vec_id", "point"), F.col("salts"))
    salted = salted.select("vec_id", "point", (F.col("cell").cast("long") * (1 << 32) + salt).alias("shard"))
    shards = written(salted.groupBy("shard").applyInArrow(_shard_row, from_arrow_schema(_TREE)), "shards")

    home = queries.withColumn("cell", cell("point")).join(sizes.select("cell", "salts"), "cell", "left")
    own = F.col("cell").cast("long") * (1 << 32) + F.pmod(F.col("mark"), F.coalesce("salts", F.lit(1)))
    home = written(home.select("vec_id", "mark", "point", own.alias("shard")), "queries")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    empty = F.lit(None)

    def wave(visits: DataFrame) -> DataFrame:
        trees = shards.select(
            "shard", empty.cast("long").alias("vec_id"), empty.cast("long").alias("mark"),
            empty.cast("array<long>").alias("point"), empty.cast("double").alias("least"), "ids", "points", F.lit(0).alias("turn"),
        )
        asked = visits.select(
            "shard", "vec_id", "mark", "point", "least", empty.cast("array<long>").alias("ids"),
            empty.cast("binary").alias("points"), F.lit(1).alias("turn"),
        )
        rows = trees.unionByName(asked).repartition(parts, "shard").sortWithinPartitions("shard", "turn")
        return rows.drop("turn").mapInArrow(_search(k), from_arrow_schema(_HIT))

    first = written(wave(home.withColumn("least", empty.cast("double"))), "hits")
    reached = first.groupBy("query_id", "mark").agg(F.count("*").alias("found"), F.min("score").alias("worst"))
    reached = reached.select("query_id", F.col("mark").alias("seen"), F.when(F.col("found") >= k, F.col("worst").cast("double")).alias("least"))
    asking = home.join(reached, (home["vec_id"] == reached["query_id"]) & (home["mark"] == reached["seen"]), "left")
    boxes = shards.select("shard", "low", "high").orderBy("shard").toLocalIterator(prefetchPartitions=True)
    targets = asking.withColumn("target", F.lit(-1).cast("long")).where("false")
    while block := list(islice(boxes, SENT_BOXES)):
        worth = _worth(spark, block)
        targets = targets.unionByName(asking.withColumn("target", F.explode(worth("point", "least"))))
    visits = targets.where(F.col("target") != F.col("shard")).select(
        F.col("target").alias("shard"), "vec_id", "mark", "point", "least"
    )
    hits = first.unionByName(wave(visits))
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


NEAREST_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS point FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.point, c.point)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""
