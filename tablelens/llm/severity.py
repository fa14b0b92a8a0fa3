"""Severity of toxic language by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tablelens.llm.common import in_pieces, pin_batches, written
from tablelens.llm.features import labelled_sample, terms
from tablelens.llm.infilling import unused

SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 12000  # labelled rows that the model is fitted on, at most
TERMS = 4096  # terms with a weight, at most
LEAST_ROWS = 3  # sample rows that a term must occur in
GRADES = 3  # 0 clean, 1 mild, 2 severe
REJECT = 0.25  # expected severity from which a document goes


@dataclass
class SeverityModel:
    """Shared term weights and one threshold per grade boundary: P(grade > k) = s(w x - theta_k)."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for each text and boundary."""
        out = np.zeros((len(texts), len(self.thresholds)))
        for first, part in in_pieces(texts):
            row, column, times = counted(part, self.keys)
            line = np.bincount(row, np.log1p(times) * self.weights[column], len(part))
            out[first : first + len(part)] = _s(line[:, None] - self.thresholds[None, :])
        return out


def _s(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def counted(texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and frequency of the terms in ``keys`` (sorted)."""
    owner, found = terms(texts)
    if not len(keys) or not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    hit = keys[at] == found
    pairs, times = np.unique(owner[hit] * len(keys) + at[hit], return_counts=True)
    return pairs // len(keys), pairs % len(keys), times.astype(float)


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int,
        rate: float = 2e-5, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights of at least 0 and ordered thresholds, by accelerated proximal gradient with an L1 penalty.

    No term makes a text milder, so a long clean part cannot hide a toxic one.
    """
    n = max(len(grades), 1)
    above = (grades[:, None] > np.arange(GRADES - 1)[None, :]).astype(float)
    share = np.clip(above.mean(0) if len(grades) else np.full(GRADES - 1, 0.5), 1e-3, 1 - 1e-3)
    theta = -np.log(share / (1 - share))
    weights, look, back = np.zeros(width), np.zeros(width), 1.0
    # a bound of the curvature for each weight: a quarter per boundary times the row sums of its rows
    row_sums = np.bincount(rows, values, n)
    curve = 0.25 * (GRADES - 1) * np.bincount(columns, values * row_sums[rows], max(width, 1))[:width] / n
    step = 1 / np.maximum(curve, 1e-6)
    for _ in range(steps):
        line = np.bincount(rows, values * look[columns], n)
        # logistic loss at every boundary, with one line for all of them
        wrong = _s(line[:, None] - theta[None, :])[: len(grades)] - above
        slope = np.bincount(columns, values * wrong.sum(1)[rows], max(width, 1))[:width] / n
        new = look - step * slope
        new = np.maximum(new - step * rate, 0)
        ahead = (1 + np.sqrt(1 + 4 * back * back)) / 2
        look, weights, back = new + (back - 1) / ahead * (new - weights), new, ahead
        theta = np.maximum.accumulate(theta + 4.0 * wrong.mean(0) if len(grades) else theta)
    return weights, theta


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (label, term) of each sample row, summed over a batch."""
    for batch in batches:
        for first, part in in_pieces(batch.column(1)):
            label = batch.column(0).slice(first, len(part)).to_numpy().astype(np.int64)
            owner, found = terms(part)
            key, term = np.unique(found, return_inverse=True)
            pairs = np.unique(owner * max(len(key), 1) + term)
            row, term = pairs // max(len(key), 1), pairs % max(len(key), 1)
            yield pa.RecordBatch.from_pydict({
                "term": key.view(np.int64),
                "toxic": np.bincount(term, label[row], len(key)).astype(np.int64),
                "rows": np.bincount(term, minlength=len(key)).astype(np.int64),
            })


def _sparse_rows(keys: np.ndarray):
    kind = pa.schema([
        ("label", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.float64()))
    ])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in in_pieces(batch.column(1)):
                row, column, times = counted(part, keys)
                cut = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(part)).cast(pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(column.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(times)),
                ], schema=kind)

    return sparse, from_arrow_schema(kind)


def train(docs: DataFrame, labels: DataFrame) -> SeverityModel:
    """Fit on at most 4,000 toxic and 12,000 clean labelled rows that are not held out.

    Terms are the words and word beginnings that toxic sample rows hold more often than clean ones,
    counted by Spark. ``labels.toxic`` knows no grades: toxic rows with more marker terms than the median toxic
    row are severe, the others mild.
    """
    spark = docs.sparkSession
    toxic, _ = labelled_sample(labels, "toxic", SAMPLE_TOXIC)
    clean, _ = labelled_sample(labels, "toxic", SAMPLE_CLEAN)
    chosen = toxic.where("label = 1").unionByName(clean.where("label = 0"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(written(chosen, "chosen")), "doc_id").select("label", "text")
    # copies of one text are one case
    rows = written(rows.groupBy("text").agg(F.max("label").alias("label")).select("label", "text"), "sample")
    n = {row["label"]: row["n"] for row in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    counts = rows.mapInArrow(_term_rows, "term long, toxic long, rows long").groupBy("term")
    counts = counts.agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows")).where(F.col("rows") >= LEAST_ROWS)
    in_bad, in_good = F.col("toxic") + 0.5, F.col("rows") - F.col("toxic") + 0.5
    odds = F.log(in_bad / (bad + 1)) - F.log(in_good / (good + 1))
    strength = odds / F.sqrt(1 / in_bad + 1 / in_good)
    ranked = counts.select("term", strength.alias("z"), odds.alias("odds")).where("z > 2.5").orderBy(F.desc("z"), "term").limit(TERMS)
    table = ranked.toArrow().to_pandas()
    keys = table["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, markers = keys[order], ((table["z"] > 3) & (table["odds"] > 1)).to_numpy()[order]
    sparse, schema = _sparse_rows(keys)
    got = rows.mapInArrow(sparse, schema).toArrow().combine_chunks()
    label = got["label"].to_numpy()
    cells, times = got["terms"].combine_chunks(), got["times"].combine_chunks()
    rows_at = np.repeat(np.arange(len(label)), np.diff(cells.offsets.to_numpy()))
    columns = cells.flatten().to_numpy().astype(np.int64)
    values = times.flatten().to_numpy().astype(float)
    amount = np.bincount(rows_at, np.log1p(values) * markers[columns], len(label))
    middle = np.median(amount[label == 1]) if (label == 1).any() else 0.0
    grades = np.where(label == 1, np.where(amount > middle, 2, 1), 0)
    weights, theta = fit(rows_at, columns, np.log1p(values), grades, len(keys))
    used = weights != 0
    return SeverityModel(keys[used], weights[used], theta)


def score_severity(df: DataFrame, model: SeverityModel, text_column: str = "text") -> DataFrame:
    """Add ``p_mild`` = P(grade > 0), ``p_severe`` = P(grade > 1) and ``severity``, the expected grade (0 to 2).

    Whole texts are scored row by row, without a shuffle; the model is at most 4,096 weights.
    Null and empty texts get the score of a text without known terms; repeated rows get equal scores; earlier
    columns with these three names are replaced, all others kept.
    """
    spark = pin_batches(df.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def above(texts: pa.Array) -> pa.Array:
        chances = sent.value.score(texts)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * chances.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(chances.ravel()))

    name = unused("above", df.columns)
    scored = df.withColumn(name, above(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))))
    return (
        scored.withColumn("p_mild", F.col(name)[0]).withColumn("p_severe", F.col(name)[1])
        .withColumn("severity", F.col("p_mild") + F.col("p_severe")).drop(name)
    )
