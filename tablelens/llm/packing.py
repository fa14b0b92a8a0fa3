"""Harmonic packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tablelens.llm.common import in_pieces, pin_batches, written

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 1
REMEMBERED = 120_000  # parts of words in one generation of a worker's memory; there are two, about 50 MB together
PIECE_BYTES = 4_000_000  # of text that is encoded at once
PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, share int, worker int, bin long, "
    "slot int, offset long"
)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# How the tokenizer normalises and cuts; words of these characters can be cut here
NORMALISES = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
CUTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PLAIN = "^[!-&(-;=-~À-ÖØ-öø-ÿ]*$"  # no apostrophes, no <, no character that NFC or lower case would lengthen
_PARTS = "([a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints, else the next one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in printed]
    return {byte: chr(byte) for byte in printed} | {byte: chr(256 + place) for place, byte in enumerate(others)}


class Encoder:
    """Ids of texts from the ids of the parts of their words.

    The tokenizer drops white space and never merges over it, so the ids of a text are those
    of its runs without blanks, tabs and line ends, in order; each distinct run of a piece of text is looked at once. With the
    rules above, a run of plain characters is its lower-case letter, digit and other parts, in order: those are cut by Arrow,
    and only parts that the worker does not remember are encoded. Other runs are encoded whole.
    """

    def __init__(self, path: str):
        self.whole, self.letters = _tokenizer(path), _byte_letters()
        rules = json.loads(self.whole.to_str())
        before = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.cuts = (rules.get("normalizer") or {}).get("normalizers") == NORMALISES and [
            before[0].get("pattern"), *[one.get("type") for one in before[1:]]
        ] == [{"Regex": CUTS}, "ByteLevel"]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _part_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, four bytes each. Two generations are kept: parts not met while a new one fills are forgotten, never all at once."""
        recent, older, model, letters = self.recent, self.older, self.whole.model, self.letters
        out = []
        for part in parts:
            ids = recent.get(part)
            if ids is None:
                ids = older.get(part)
                if ids is None:
                    ids = array("I", [one.id for one in model.tokenize("".join([letters[byte] for byte in part.encode()]))]).tobytes()
                recent[part] = ids
            out.append(ids)
        if len(recent) > REMEMBERED:
            self.recent, self.older = {}, recent
        return out

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after the other, and where each word's begin and end."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False) if self.cuts else np.zeros(len(words), bool)
        lengths = np.zeros(len(words), np.int64)
        marked = pc.replace_substring_regex(pc.utf8_lower(words.filter(pa.array(plain))), _PARTS, "\\1\x01")
        lists = pc.split_pattern(marked, "\x01")
        coded = lists.flatten().dictionary_encode()
        found = self._part_ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        code = coded.indices.to_numpy()
        own = _gather(flat, (np.cumsum(sizes) - sizes)[code], sizes[code])
        ends = np.concatenate([[0], np.cumsum(sizes[code])])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        lengths[plain] = np.diff(ends)
        rest = [one.ids for one in self.whole.encode_batch_fast(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        lengths[~plain] = list(map(len, rest))
        ids = np.zeros(int(lengths.sum()), np.uint32)
        of_plain = np.repeat(plain, lengths)
        ids[of_plain] = own
        ids[~of_plain] = np.fromiter(chain.from_iterable(rest), np.uint32, len(ids) - len(own))
        return ids, np.concatenate([[0], np.cumsum(lengths)])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        spaced = pc.replace_substring_regex(texts.cast(pa.large_string()), "[ \t\r\n]+", " ")
        lists = pc.split_pattern(spaced, " ")
        coded = lists.flatten().dictionary_encode()
        known, bounds = self._word_ids(coded.dictionary)
        code = coded.indices.to_numpy()
        lengths = np.diff(bounds)[code]
        ids = _gather(known, bounds[:-1][code], lengths)
        cuts = np.concatenate([[0], np.cumsum(lengths)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _gather(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of ``values``, one after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder per Python worker: what it remembers serves all its tasks."""
    return Encoder(path)


def cut(tokens: int, capacity: int = CAPACITY, slack: float = 0.02) -> list[int]:
    """Lengths of the pieces of a document: whole sequences, then pieces that nearly fill a 1/k share.

    A rest in (capacity/(k+1), capacity/k] stays whole if k of its kind leave at most ``slack`` of
    a sequence empty; else a piece of capacity/(k+1) is cut off and the remainder treated alike.
    """
    whole, rest = divmod(tokens, capacity)
    pieces = [capacity] * whole
    while rest:
        share = capacity // rest
        if capacity - share * rest <= slack * capacity:
            pieces.append(rest)
            break
        pieces.append(capacity // (share + 1))
        rest -= pieces[-1]
    return pieces


def _fill(path: str, capacity: int, slack: float, with_ids: bool):
    """Tokenise, cut and fill the bins of each class inside one task."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, worker = _encoder(path), TaskContext.get().partitionId()
        waiting: dict[int, list[tuple]] = {}
        bins = 0
        done: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*rows))
            names = [field.split()[0] for field in PIECE.split(", ")]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            if with_ids:
                names, arrays = names + ["ids"], arrays + [pa.array(columns[-1], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for first, texts in in_pieces(batch.column(1), PIECE_BYTES):
                docs = batch.column(0).slice(first, len(texts)).to_pylist()
                for doc_id, ids in zip(docs, encoder.encode(texts)):
                    ids = np.append(ids, np.uint32(END_ID))
                    start = 0
                    for length in cut(len(ids), capacity, slack):
                        own = ids[start : start + length]
                        share = capacity // length
                        piece = (doc_id, start, length, zlib.crc32(own.astype("<u4").tobytes()), len(ids), share, worker)
                        line = waiting.setdefault(share, [])
                        line.append((piece, own.astype(np.int32) if with_ids else None))
                        start += length
                        if len(line) == share:
                            offset = 0
                            for slot, (one, values) in enumerate(line):
                                done.append((*one, bins, slot, offset, values))
                                offset += one[2]
                            bins += 1
                            line.clear()
                if done:
                    yield batch_of(done)
                    done = []
        # pieces of bins that this task could not fill, numbered in their class
        rest = [
            (*one, None, slot, None, values)
            for line in waiting.values() for slot, (one, values) in enumerate(line)
        ]
        if rest:
            yield batch_of(rest)

    return fill


def _first_fit(capacity: int):
    """Pack the few pieces of bins that stayed open in every class: longest first, into the first sequence with room."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        used: list[int] = []
        bins, offsets = [], []
        for length in rows["length"]:
            place = next((k for k, filled in enumerate(used) if filled + length <= capacity), len(used))
            if place == len(used):
                used.append(0)
            bins.append(place)
            offsets.append(used[place])
            used[place] += int(length)
        return rows.assign(sequence_id=[4 * k + 2 for k in bins], offset=offsets)

    return pack


def pack(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    slack: float = 0.02,
    with_ids: bool = False,
) -> DataFrame:
    """Pack every document's token ids and an end id into sequences of at most ``capacity`` tokens.

    Each task tokenises its documents, cuts them (see ``cut``) and sorts the pieces into classes: class k holds
    lengths in (capacity/(k+1), capacity/k], and a bin of class k takes exactly k of them, so tasks
    fill bins without knowing of each other. Texts are never shuffled. The pieces of bins that a
    task leaves open, fewer than k per class, are ranked over all tasks by per-task counts and fill
    further bins of k; then fewer than k pieces a class remain, a number that depends on ``capacity`` alone,
    and these share the last sequences, first fit by falling length.

    Returns one row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32`` (of the little-endian 32-bit
    ids), ``doc_tokens``, ``sequence_id``, ``offset``, ``share`` (k) and, on request, ``ids``. A null or empty text is
    the end id alone; repeated rows are packed once each; other columns are not carried.
    """
    spark = pin_batches(df.sparkSession)
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    docs = df.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    )
    schema = PIECE + (", ids array<int>" if with_ids else "")
    pieces = written(docs.mapInArrow(_fill(path, capacity, slack, with_ids), schema), "pieces")
    extra = ["ids"] if with_ids else []
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "share", *extra]
    filled = pieces.where("bin IS NOT NULL").withColumn(
        "sequence_id", (F.shiftleft(F.col("worker").cast("long"), 32) + F.col("bin")) * 4
    )
    open_ = pieces.where("bin IS NULL").drop("bin", "offset")
    # per class: where each task's pieces begin in the order of all tasks, and how many there are
    by_worker = open_.groupBy("share", "worker").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("share").orderBy("worker")
    places = by_worker.select(
        "share", "worker",
        (F.sum("n").over(earlier) - F.col("n")).alias("base"),
        F.sum("n").over(Window.partitionBy("share")).alias("all"),
    )
    ranked = open_.join(places, ["share", "worker"]).withColumn("rank", F.col("base") + F.col("slot"))
    ranked = ranked.withColumn("bin", F.expr("rank div share"))
    merged = ranked.where("(bin + 1) * share <= all")
    before = Window.partitionBy("share", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    merged = merged.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumn(
        "sequence_id", (F.shiftleft(F.col("share").cast("long"), 40) + F.col("bin")) * 4 + 1
    )
    last = ranked.where("(bin + 1) * share > all").select(*[c for c in columns if c not in ("sequence_id", "offset")])
    kinds = ", ".join(f"{name} {kind}" for name, kind in last.dtypes) + ", all boolean"
    last = last.withColumn("all", F.lit(True))
    ends = last.groupBy("all").applyInPandas(_first_fit(capacity), f"{kinds}, sequence_id long, offset long")
    return filled.select(*columns).unionByName(merged.select(*columns)).unionByName(ends.select(*columns))
