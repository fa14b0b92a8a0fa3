"""Token counts per document from counts per distinct pre-token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablelens.llm.common import in_pieces, mixed, pin_batches, utf8, written

MODEL = "piece_bpe_32k.model"
FREQUENT = 1 << 19  # pre-tokens whose counts are sent to every task
FREQUENT_BYTES = 32  # longest of them: together with the hash and count at most 24 MB
SPACE = "▁"  # what the tokenizer writes for a blank
_RUN = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+$")


def pre_tokens(text: str) -> list[str]:
    """Cut a text where a blank follows something else; no piece of the vocabulary reaches over such a cut.

    Each pre-token stands without its first blank, which the tokenizer itself puts before a
    text; a lone blank at the end is "".
    """
    runs = _RUN.findall(text)
    return runs[:1] + [run[1:] for run in runs[1:]]


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Text number and pre-token, for all pre-tokens of an array of texts."""
    texts = texts.cast(pa.large_string())
    odd = pc.or_(
        pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)),
        pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")),
    ).to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    plain, rest = np.flatnonzero(~odd & ~empty), np.flatnonzero(odd)
    lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
    owner = plain[pc.list_parent_indices(lists).to_numpy()]
    cells = lists.flatten()
    if len(rest):
        cut = [pre_tokens(text) for text in texts.take(pa.array(rest)).to_pylist()]
        owner = np.concatenate([owner, np.repeat(rest, [len(c) for c in cut])])
        cells = pa.concat_arrays([cells, pa.array([c for one in cut for c in one], pa.large_string())])
    return owner, cells


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_pieces(path: str, cells: list[str]) -> list[int]:
    """Pieces of each pre-token behind one blank."""
    return [len(ids) if cell else 1 for cell, ids in zip(cells, _model(path).encode(cells, num_threads=1))]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, cells = split(batch.column(0))
        counted = pc.value_counts(cells)
        yield pa.RecordBatch.from_arrays(
            [counted.field("values").cast(pa.string()), counted.field("counts")], names=["cell", "n"]
        )


def pre_token_counts(df: DataFrame, text_column: str, path: str) -> DataFrame:
    """Every distinct pre-token once: ``cell``, how often it occurs (``n``) and its ``pieces``."""

    @F.arrow_udf(T.IntegerType())
    def pieces(cells: pa.Array) -> pa.Array:
        return pa.array(count_pieces(path, cells.to_pylist()), pa.int32())

    cells = df.select(text_column).mapInArrow(_tally, "cell string, n long")
    return cells.groupBy("cell").agg(F.sum("n").alias("n")).withColumn("pieces", pieces("cell"))


def hashes(cells: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    raw, offsets = utf8(cells)
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if len(full):
        sizes = lengths[full]
        place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        power = np.cumprod(np.full(int(sizes.max()) + 1, np.uint64(0x9E3779B97F4A7C15)))
        weight = (raw.astype(np.uint64) + np.uint64(1)) * power[place]
        out[full] = mixed(np.add.reduceat(weight, offsets[:-1][full]) + sizes.astype(np.uint64))
    return out


class Frequent:
    """Counts of frequent pre-tokens, found by hash and confirmed by comparing the strings."""

    def __init__(self, cells: pa.Array, pieces: np.ndarray):
        keys = hashes(cells)
        order = np.argsort(keys, kind="stable")
        self.keys, self.pieces = keys[order], pieces[order].astype(np.int32)
        self.cells = cells.cast(pa.large_string()).take(pa.array(order))

    def find(self, cells: pa.Array) -> np.ndarray:
        """Pieces of each pre-token, -1 where it is not one of these."""
        if not len(self.keys) or not len(cells):
            return np.full(len(cells), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes(cells)), len(self.keys) - 1)
        same = pc.equal(self.cells.take(pa.array(at)), cells).to_numpy(zero_copy_only=False)
        return np.where(same, self.pieces[at], -1).astype(np.int64)


PARTS = "doc_id long, mark long, cell string, times long, tokens long, document long, bytes long"


def _parts(frequent):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_pieces(batch.column(2)):
                ids = batch.column(0).slice(first, len(texts))
                marks = batch.column(1).slice(first, len(texts))
                owner, cells = split(texts)
                coded = cells.dictionary_encode()
                distinct, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                known = frequent.value.find(distinct)[code]
                sums = np.bincount(owner, np.where(known > 0, known, 0), len(texts)).astype(np.int64)
                rare = known < 0
                pairs, times = np.unique(owner[rare] * max(len(distinct), 1) + code[rare], return_counts=True)
                rows, words = np.divmod(pairs, max(len(distinct), 1))
                # a row of its own for each document; it matches no pre-token that counts
                own = pc.binary_join_element_wise("\x00", marks.cast(pa.string()), "")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([ids, ids.take(pa.array(rows))]),
                        pa.concat_arrays([marks, marks.take(pa.array(rows))]),
                        pa.concat_arrays([own, distinct.take(pa.array(words)).cast(pa.string())]),
                        pa.array(np.concatenate([np.zeros(len(texts), np.int64), times])),
                        pa.array(np.concatenate([sums, np.zeros(len(rows), np.int64)])),
                        pa.array(np.concatenate([np.ones(len(texts), np.int64), np.zeros(len(rows), np.int64)])),
                        pa.array(np.concatenate([np.diff(utf8(texts)[1]), np.zeros(len(rows), np.int64)])),
                    ],
                    names=["doc_id", "mark", "cell", "times", "tokens", "document", "bytes"],
                )

    return parts


def _threshold(counts: DataFrame, most: int) -> int | None:
    """The smallest count that at most ``most`` pre-tokens reach, from a histogram of counts; None if there is none.

    Counts from 128 on share a bin with those within a 64th of their power of two, so the histogram has at most some
    4,000 rows, and no task sees more than its own bins.
    """
    shift = F.greatest(F.floor(F.log2("n")) - 6, F.lit(0)).cast("int")
    edge = F.expr("shiftleft(shiftright(n, shift), shift)")
    bins = counts.withColumn("shift", shift).groupBy(edge.alias("edge")).agg(F.count("*").alias("rows")).collect()
    reached, least = 0, None
    for row in sorted(bins, key=lambda r: -r["edge"]):
        reached += row["rows"]
        if reached > most:
            break
        least = row["edge"]
    return least


def _send_frequent(spark: SparkSession, counts: DataFrame, most: int):
    """The frequent pre-tokens at every task, and a condition for all others."""
    short = F.octet_length("cell") <= FREQUENT_BYTES
    least = _threshold(counts.where(short), most)
    often = short & (F.col("n") >= least) if least is not None else F.lit(False)
    table = counts.where(often).select("cell", "pieces").toArrow().combine_chunks()
    cells = table["cell"].combine_chunks() if len(table) else pa.array([], pa.string())
    pieces = table["pieces"].to_numpy() if len(table) else np.zeros(0, np.int32)
    return spark.sparkContext.broadcast(Frequent(cells, pieces)), ~often


def count_tokens(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    model_path: str | None = None,
    limit: int = 4096,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Tokens of every whole text without encoding the texts.

    Pieces of the model never reach over a blank that follows something else, so a text's
    count is the sum over its pre-tokens. All distinct pre-tokens are counted once, after a
    shuffle with map-side sums, and written to the shared folder. The ``frequent`` ones, a table of at
    most 24 MB by its two bounds, go to every task; the rest are joined to the rows
    (document, pre-token, frequency) and summed per document. Token ids of documents never exist.

    Returns ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``
    (``n_tokens > limit``), one row per row of ``df``. Null texts count as empty (0 tokens);
    repeated rows are counted together and given back as often as they occur; other columns are not
    carried.
    """
    spark = pin_batches(df.sparkSession)
    path = model_path or public_tokenizers.path(MODEL)
    docs = df.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    )
    docs = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    counts = written(pre_token_counts(docs, "text", path), "pre-tokens")
    sent, others = _send_frequent(spark, counts, frequent)
    rare = counts.where(others).select("cell", "pieces")
    parts = docs.mapInArrow(_parts(sent), PARTS)
    tokens = F.col("times") * F.coalesce("pieces", F.lit(0)) + F.col("tokens")
    sums = (
        parts.join(rare, "cell", "left")
        .groupBy("doc_id", "mark")
        .agg(F.sum(tokens).alias("tokens"), F.sum("bytes").alias("bytes"), F.sum("document").alias("rows"))
    )
    return sums.select(
        "doc_id",
        F.expr("bytes div rows").alias("n_bytes"),
        F.expr("tokens div rows").alias("n_tokens"),
        F.expr("tokens div rows").__gt__(limit).alias("over_limit"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"),
    ).drop("copy")
