"""Helpers shared by the corpus operators: bounded Arrow batches, words as numbers, shared folders."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "2000"
BATCH_BYTES = "8m"  # of text per Arrow batch, so that one Python worker holds a few dozen MB
PIECE_BYTES = 1_000_000  # of text that the number work below handles at once
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pin_batches(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches of texts small by rows and by bytes, and let workers on this machine import the library."""
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``; local sessions may go without that setting."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tablelens-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, is computed once, outlives executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of splitmix64)."""
    z = values.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    base = ends[0] if len(ends) else 0
    raw = np.frombuffer(data, np.uint8)[base : ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
    return raw, ends - base


def in_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) in runs of about ``limit`` bytes; a longer text is a run of its own."""
    column = column.cast(pa.large_string())
    _, offsets = utf8(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, column.slice(start, stop - start)
        start = stop


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of every word: a longest run without ASCII white space."""
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    before = np.concatenate([[False], solid[:-1]]) if len(raw) else solid
    starts = np.flatnonzero(solid & (first | ~before))
    after = np.concatenate([solid[1:], [False]]) if len(raw) else solid
    last = np.concatenate([first[1:], [True]]) if len(raw) else first
    ends = np.flatnonzero(solid & (last | ~after)) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every batch and task."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    power = np.cumprod(np.full(int(lengths.max()) + 1, _STEP, np.uint64))
    weight = (raw[inside].astype(np.uint64) + np.uint64(1)) * power[place]
    return mixed(np.add.reduceat(weight, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
