"""Lempel-Ziv phrase fingerprints and the likeness of documents by them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tablelens.llm.common import mixed, pin_batches
from tablelens.session import small_table

SIGNATURE = 128  # smallest phrase hashes kept
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FIRST = -(1 << 63)  # where rows without an id stand in the order
NEIGHBOURS = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}


def phrase_ends(text: str) -> list[int]:
    """Where the new dictionary phrases of ``text`` end: each is the longest known phrase and one more character.

    A rest that is already in the dictionary adds no phrase.
    """
    known: set[str] = set()
    learn, ends, phrase = known.add, [], ""
    found = ends.append
    for place, character in enumerate(text, 1):
        phrase += character
        if phrase not in known:
            learn(phrase)
            phrase = ""
            found(place)
    return ends


def signature(text: str | None, size: int = SIGNATURE) -> np.ndarray:
    """The ``size`` smallest 32-bit hashes of the text's phrases, ascending (all, if there are fewer)."""
    ends = np.array(phrase_ends(text or ""), np.int64)
    if not len(ends):
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")[: ends[-1]].astype(np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    lengths = ends - starts
    power = np.cumprod(np.full(int(lengths.max()) + 1, _BASE, np.uint64))
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    sums = np.add.reduceat((codes + np.uint64(1)) * power[place], starts)
    hashes = (mixed(sums + lengths.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 4 * size:
        hashes = np.partition(hashes, 2 * size)[: 2 * size]  # twice as many, as equal hashes count once
    return np.unique(hashes)[:size]


def as_text(values: np.ndarray) -> str:
    """A signature as hexadecimal digits, eight a hash."""
    return values.astype(">u4").tobytes().hex()


def likeness(one: np.ndarray, other: np.ndarray, size: int = SIGNATURE) -> float:
    """Estimated share of common phrases (Jaccard): common hashes among the smallest of the union."""
    if not len(one) and not len(other):
        return 1.0
    union = np.union1d(one, other)[:size]
    common = np.intersect1d(one, other, assume_unique=True)
    return float(np.isin(union, common, assume_unique=True).sum() / len(union))


@F.arrow_udf(T.StringType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([as_text(signature(text)) for text in texts.to_pylist()], pa.string())


def fingerprint(df: DataFrame, text_column: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add each text's phrase fingerprint; equal texts have equal ones, null counts as empty (""). No shuffle."""
    pin_batches(df.sparkSession)
    return df.withColumn(name, _fingerprints(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))))


def _bucket(bounds: list[int]):
    edges = np.array(bounds, np.int64)

    @F.arrow_udf(T.IntegerType())
    def bucket(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, ids.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    return bucket


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of a sorted run of documents; rows of kind 1, at the end, only say what follows the run."""
    before = None
    for batch in batches:
        out: dict[str, list] = {name: [] for name in NEIGHBOURS}
        for doc_id, text, kind in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if kind and before is None:
                continue
            own = signature(text)
            if before is not None:
                first_id, first, mark = before
                half = len(first) // 2
                edited = first[: len(first) - half] + text[:half]
                edited_mark = signature(edited)
                out["doc_id"].append(first_id)
                out["n_chars"].append(len(first))
                out["edited_sha256"].append(hashlib.sha256(edited.encode("utf-8")).hexdigest())
                out["fingerprint"].append(as_text(mark))
                out["edited_fingerprint"].append(as_text(edited_mark))
                out["near_edited"].append(likeness(mark, edited_mark))
                out["near_next"].append(likeness(mark, own))
            before = None if kind else (doc_id, text, own)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema(NEIGHBOURS.items()))


def fingerprint_with_edits(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", parts: int | None = None
) -> DataFrame:
    """Fingerprint every text, its edited text and its successor's, and compare them.

    The edited text has its last floor(n/2) code points replaced by the first as many (or
    all) of the next document in ascending id; the first document follows the last. Ids are cut into
    ``parts`` ranges (the shuffle partitions by default) at approximate quantiles, so
    the texts are shuffled once and each task reads a sorted run. What follows a run is the
    first document of the next range: one row per range, added to the run. Only the ranges'
    first ids, one number each, pass the driver.

    Null texts count as empty; two empty texts have likeness 1, an empty and another one 0.
    Rows without an id come first; rows with equal ids follow each other by text, so
    repeated rows are each other's successors. An empty table gives no rows. Other columns are not
    carried.
    """
    spark = pin_batches(df.sparkSession)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("at", F.coalesce("id", F.lit(_FIRST)))
    shares = [k / parts for k in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("at", shares, F.lit(100 * parts)).alias("cuts")).first()["cuts"] if shares else []
    bucket = _bucket(sorted(set(cuts or [])))
    rows = rows.withColumn("bucket", bucket("at"))
    heads = sorted(
        (row["bucket"], row["first"]) for row in rows.groupBy("bucket").agg(F.min("at").alias("first")).collect()
    )
    follows = [(first, heads[place - 1][0]) for place, (_, first) in enumerate(heads)]
    follow = small_table(spark, follows, "first long, target int")
    after = (
        rows.join(F.broadcast(follow), rows["at"] == follow["first"])
        .select("id", "text", "at", F.col("target").alias("bucket"), F.lit(1).alias("kind"))
    )
    runs = rows.select("id", "text", "at", "bucket", F.lit(0).alias("kind")).unionByName(after)
    runs = runs.repartitionById(parts, "bucket").sortWithinPartitions("kind", "at", "text")
    return runs.select("id", "text", "kind").mapInArrow(_neighbours, from_arrow_schema(pa.schema(NEIGHBOURS.items())))
