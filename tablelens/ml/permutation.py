"""Values moved along exact pseudo-random ranks, exchanged as packed blocks of numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelens.session import reliable_checkpoint

CUT_BITS = 13  # leading bits of the hash that name a part: 8,192 parts
CHUNK_ROWS = 2_048  # rows of a packed chunk
BLOCK_ROWS = 8_192  # ranks whose variants are built together, at most
BLOCK_NUMBERS = 4_000_000  # numbers of the variants of such a block


def packed_ranks(rows: DataFrame, order: str, ties: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """Chunks ``(part, first, size, numbers)`` of the rows in hexadecimal ``order``, and the first rank of every part.

    A part is a range of hashes, sorted inside one task; a chunk holds ``columns`` (doubles) of consecutive rows as bytes, ``first`` is its
    place inside its part. The chunks are checkpointed; only one count per part reaches the driver.
    """
    part = F.shiftright(F.conv(F.substring(order, 1, 4), 16, 10).cast("int"), 16 - CUT_BITS)
    dealt = rows.withColumn("__part", part).repartition("__part")
    # a part holds neighbours in this order; with the hash first, its leading bytes settle most comparisons
    ordered = dealt.sortWithinPartitions(order, *ties).select("__part", *columns)
    chunks = reliable_checkpoint(ordered.mapInArrow(_pack, "part int, first long, size int, numbers binary"))
    sizes = {r["part"]: r["rows"] for r in chunks.groupBy("part").agg(F.sum("size").alias("rows")).collect()}
    starts = [0]
    for part in range(1 << CUT_BITS):
        starts.append(starts[-1] + sizes.get(part, 0))
    return chunks, starts


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, first = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column(0).to_numpy()
        numbers = np.stack([column.to_numpy(zero_copy_only=False) for column in batch.columns[1:]])
        edges = {*range(0, len(parts), CHUNK_ROWS), *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)}
        chunks = []
        for a, b in pairwise(sorted(edges)):
            if parts[a] != part:
                part, first = parts[a], 0
            chunks.append((part, first, b - a, numbers[:, a:b].tobytes()))
            first += b - a
        yield _batch(chunks, [pa.int32(), pa.int64(), pa.int32(), pa.binary()], ["part", "first", "size", "numbers"])


def _batch(records: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*records), types)], names)


def moved_variants(chunks: DataFrame, starts: Sequence[int], width: int, moves: Sequence[tuple[int, int]]) -> DataFrame:
    """``(variant, c0, c1, …)``: the rows as they are (variant 0) and once per move ``(column, offset)``, in its order.

    A move takes the column's values ``offset`` ranks on, round the end. Each block of ranks gets the slices that fall into it, so
    one exchange of packed numbers serves all moves.
    """
    total = starts[-1]
    block = int(min(BLOCK_ROWS, max(1, BLOCK_NUMBERS // ((len(moves) + 1) * (width + 1)))))
    pieces = chunks.mapInArrow(_slices(starts, width, moves, block), "block long, slot int, at int, numbers binary")
    schema = "variant int" + "".join(f", c{c} double" for c in range(width))
    return pieces.groupBy("block").applyInArrow(_variants(total, width, moves, block), schema)


def _slices(starts: Sequence[int], width: int, moves: Sequence[tuple[int, int]], block: int) -> Callable:
    total = starts[-1]
    taken = [(slice(None), 0), *moves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, size, packed in zip(*[column.to_pylist() for column in batch.columns]):
                numbers = np.frombuffer(packed).reshape(width, size)
                pieces = []
                for slot, (column, offset) in enumerate(taken):
                    at = 0
                    while at < size:
                        rank = (starts[part] + first + at + offset) % total
                        length = min(size - at, total - rank, block - rank % block)
                        pieces.append((rank // block, slot, rank % block, numbers[column, at : at + length].tobytes()))
                        at += length
                yield _batch(pieces, [pa.int64(), pa.int32(), pa.int32(), pa.binary()], ["block", "slot", "at", "numbers"])

    return run


def _variants(total: int, width: int, moves: Sequence[tuple[int, int]], block: int) -> Callable:
    names = ["variant", *[f"c{c}" for c in range(width)]]

    def run(pieces: pa.Table) -> pa.Table:
        number = pieces.column("block")[0].as_py()
        size = min(block, total - number * block)
        own, moved = np.empty((width, size)), np.empty((len(moves), size))
        for slot, at, packed in zip(*[pieces.column(name).to_pylist() for name in ("slot", "at", "numbers")]):
            values = np.frombuffer(packed)
            if slot:
                moved[slot - 1, at : at + len(values)] = values
            else:
                own[:, at : at + len(values) // width] = values.reshape(width, -1)
        variants = np.repeat(own[:, None, :], len(moves) + 1, axis=1)
        for slot, (column, _) in enumerate(moves, 1):
            variants[column, slot] = moved[slot - 1]
        which = np.repeat(np.arange(len(moves) + 1, dtype=np.int32), size)
        return pa.Table.from_arrays([pa.array(which), *[pa.array(values.ravel()) for values in variants]], names=names)

    return run
