"""Words of texts as sparse features, and labelled samples to learn from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tablelens.llm.common import mixed, utf8

STEMS = (4, 5, 6)  # bytes of a word's beginning that are features of their own
_WORD = np.zeros(256, bool)  # letters, digits and all bytes of non-ASCII characters
for _low, _high in ((48, 57), (97, 122), (128, 255)):
    _WORD[_low : _high + 1] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of each term occurrence: lower-case words and their stems."""
    raw, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    solid = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lengths = ends - starts
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    power = np.cumprod(np.full(int(lengths.max()) + 1, np.uint64(0x9E3779B97F4A7C15)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw[solid].astype(np.uint64) + np.uint64(1)) * power[place])])
    begins = np.cumsum(lengths) - lengths
    owner = np.searchsorted(offsets, starts, side="right") - 1
    owners, found = [owner], [mixed(sums[begins + lengths] - sums[begins])]
    for size in STEMS:
        long = lengths > size
        owners.append(owner[long])
        found.append(mixed(sums[begins[long] + size] - sums[begins[long]] + np.uint64(size)))
    return np.concatenate(owners), np.concatenate(found)


def held_out(doc_id: Column) -> Column:
    """The rows that no label may be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, float]:
    """Up to ``per_class`` ids of each label value outside the held-out rows, by hash, and the share of label 1.

    Repeated labels of an id vote, ties count as 1; null labels and ids are left out.
    """
    votes = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    votes = votes.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    share = votes.agg(F.avg("label")).first()[0]
    luck = F.xxhash64("doc_id", F.lit(11))
    chosen = [votes.where(F.col("label") == value).orderBy(luck, "doc_id").limit(per_class) for value in (0, 1)]
    return chosen[0].unionByName(chosen[1]), 0.5 if share is None else float(share)
