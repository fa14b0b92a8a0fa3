"""Spelling variants: near words by a bit-sliced position index, and the form each word leads to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelens.llm.common import pin_batches, written

LETTERS = "a-zÀ-ÿ"  # of a run, after A-Z became a-z
LEAST_LENGTH = 7
LEAST_COUNT = 2
DOMINANCE = 10  # times a word's count that its form must have
NOISE = 31  # a run loses a letter where this divides its hash
LARGEST_GROUP = 4096  # words that share a key; larger groups get longer keys
BLOCK = 1024  # words of one index, made of small groups; a larger group has an index of its own
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    noise: int | None = None,
) -> DataFrame:
    """``word`` and how often it occurs (``n``): maximal runs of letters, A-Z lower-cased, of all whole texts.

    With ``noise`` a run whose CRC-32 of ``id:run`` it divides loses the letter at the hash modulo the length. Words that are
    short or rare after that are left out. Null texts have no words; a null id counts as the empty text. Built-in functions only; counts are
    summed in each task before the shuffle.
    """
    text = F.translate(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")), _UPPER, _LOWER)
    runs = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_length},}}+"), F.lit(0))
    rows = df.select(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word = F.col("run")
    if noise:
        rows = rows.withColumn("hash", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "utf-8")))
        place = (F.col("hash") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
        word = F.when(F.col("hash") % noise == 0, cut).otherwise(F.col("run"))
    words = rows.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _codes(texts: list[str], width: int) -> tuple[np.ndarray, int]:
    """Letters as numbers below the second result, one row a text; what is missing at the end has that number."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    alphabet, numbers = np.unique(letters, return_inverse=True)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    table = np.full((len(texts), width), len(alphabet), np.int64)
    table[np.arange(width) < lengths[:, None]] = numbers
    return table, len(alphabet)


def near_pairs(texts: list[str], groups: np.ndarray, length: int, later: bool) -> tuple[np.ndarray, np.ndarray]:
    """All ordered pairs of texts of one group that differ by one letter, as two arrays of places.

    Texts have ``length`` letters or one more; pairs of two longer ones are left out. ``bits[position, letter]`` is the set of texts
    with that letter there, 64 texts a word. For all texts at once, letter by letter, four sets are carried on: equal so far (``same``), one
    letter replaced (``other``), the candidate has one more letter (``more``: its positions are shifted by one) or one less
    (``less``). With ``later`` a pair whose extra letter may stand first is left out: a group with an earlier hole has it.
    """
    count, words = len(texts), (len(texts) + 63) // 64
    table, size = _codes(texts, length + 1)
    long = table[:, length] != size
    bit = np.uint64(1) << (np.arange(count, dtype=np.uint64) & np.uint64(63))
    bits = np.zeros((length + 1, size + 1, words), np.uint64)
    places = np.broadcast_to(np.arange(length + 1), table.shape)
    cells = np.broadcast_to((np.arange(count) >> 6)[:, None], table.shape)
    np.bitwise_or.at(bits, (places, table, cells), np.broadcast_to(bit[:, None], table.shape))
    bits[:, size] = 0

    def of(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(words, np.uint64)
        np.bitwise_or.at(out, np.flatnonzero(mask) >> 6, bit[mask])
        return out

    short_set, long_set = of(~long), of(long)
    member = np.zeros((int(groups.max()) + 1, words), np.uint64)
    np.bitwise_or.at(member, (groups, np.arange(count) >> 6), bit)
    left, right = [], []
    for is_long in (False, True):
        if is_long and long.all():
            continue
        chosen = np.flatnonzero(long == is_long)
        for start in range(0, len(chosen), BLOCK):
            rows = chosen[start : start + BLOCK]
            same = member[groups[rows]]
            zero = np.zeros_like(same)
            if is_long:  # the candidates have one letter less
                less, first = zero, same
                for i in range(length + 1):
                    letter = table[rows, i]
                    if i:
                        step = bits[i - 1, letter]
                        less, first = less & step, first & step
                    less = less | same
                    same = same & bits[i, letter]
                found = less & short_set
                if later:
                    found &= ~first
            else:
                other, more, first = zero, same, same
                for i in range(length):
                    letter = table[rows, i]
                    step, shifted = bits[i, letter], bits[i + 1, letter]
                    other = (other & step) | (same & ~step)
                    same = same & step
                    more = (more & shifted) | same
                    first = first & shifted
                found = more & long_set
                if later:
                    found &= ~first
                found |= other & short_set
            row, cell = np.nonzero(found)
            if len(row):
                ones = np.unpackbits(found[row, cell].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                hit, offset = np.nonzero(ones)
                left.append(rows[row[hit]])
                right.append(cell[hit] * 64 + offset)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


ROWS = "word string, n_near long, other string, other_n long"


def _best(words: list[str], counts: list[int], groups: list[int], length: int, later: bool) -> pa.RecordBatch | None:
    """For each word of some groups: its near words' number, and the most frequent of them (ties: the smallest)."""
    holes, names = words
    one, other = near_pairs(holes, np.array(groups, np.int64), length, later)
    if not len(one):
        return None
    order = sorted(range(len(names)), key=lambda i: (-counts[i], names[i]))
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    best = np.full(len(names), len(names), np.int64)
    np.minimum.at(best, one, rank[other])
    near = np.bincount(one, minlength=len(names))
    rows = np.flatnonzero(near)
    chosen = [order[k] for k in best[rows]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([names[i] for i in rows], pa.string()), pa.array(near[rows], pa.int64()),
            pa.array([names[i] for i in chosen], pa.string()), pa.array([counts[i] for i in chosen], pa.int64()),
        ],
        names=["word", "n_near", "other", "other_n"],
    )


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, low, high, class, word, n), sorted by hole length, place and key, group by group."""
    kind, key = None, None
    block: tuple[list, list, list, list] = ([], [], [], [])  # holes, words, counts, groups
    group: list[tuple[str, str, int]] = []

    def close() -> None:
        if len(group) > 1:
            number = block[3][-1] + 1 if block[3] else 0
            for hole, word, n in group:
                for part, value in zip(block, (hole, word, n, number)):
                    part.append(value)
        group.clear()

    def flush() -> Iterator[pa.RecordBatch]:
        if block[0]:
            found = _best((block[0], block[1]), block[2], block[3], *kind)
            if found is not None:
                yield found
            for part in block:
                part.clear()

    for batch in batches:
        for row_key, low, high, size, word, n in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if row_key != key:
                close()
                row_kind = (high - low, low > 0)
                if row_kind != kind or len(block[0]) >= BLOCK:
                    yield from flush()
                key, kind = row_key, row_kind
            group.append((word[low : len(word) - (size - high)], word, n))
            if len(group) > 1 and len(block[0]) + len(group) > BLOCK and block[0]:
                yield from flush()
    close()
    yield from flush()


def _key(low: Column, high: Column, size: Column) -> Column:
    """What two words of a group have in common: the class and all letters outside the hole."""
    tail = F.substring("word", F.length("word") - (size - high) + 1, size - high)
    return F.concat_ws(" ", size, low, high, F.concat(F.substring("word", F.lit(1), low), F.lit(" "), tail))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with the two halves of their hole."""
    middle = F.expr("low + (high - low) div 2")
    holes = F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high"))
    )
    rows = rows.select("word", "n", "size", F.explode(holes).alias("hole"))
    rows = rows.select("word", "n", "size", "hole.low", "hole.high").where("high > low")
    return rows.withColumn("key", _key(F.col("low"), F.col("high"), F.col("size")))


def near_words(counts: DataFrame, largest: int = LARGEST_GROUP) -> DataFrame:
    """``n_near``, ``other`` and ``other_n`` of every word with near words.

    A pair of words that differ by one letter has a class, the smaller length. One of the two halves of that length
    holds the difference, so the words have all letters outside it in common: that is the key of a group. Every word
    is in four groups (two classes, two halves). Groups of more than ``largest`` words halve their hole again, until a
    group is small or its hole is one letter (then the alphabet bounds it). A pair counts where its difference can stand first only.
    """
    halves = F.array(F.length("word"), F.length("word") - 1)
    rows = _dealt(counts.select("word", "n", F.explode(halves).alias("size")).where("size > 0").select(
        "word", "n", "size", F.lit(0).alias("low"), F.col("size").alias("high")))
    leaves = None
    while True:
        sizes = rows.groupBy("key", (F.col("high") - F.col("low")).alias("hole")).count()
        large = written(sizes.where((F.col("count") > largest) & (F.col("hole") > 1)).select("key"), "large-groups")
        done = large.isEmpty()
        part = rows if done else rows.join(large, "key", "left_anti")
        leaves = part if leaves is None else leaves.unionByName(part)
        if done:
            break
        rows = _dealt(rows.join(large, "key", "left_semi").select("word", "n", "size", "low", "high"))
    dealt = leaves.repartition("key").sortWithinPartitions(F.col("high") - F.col("low"), F.col("low") > 0, "key")
    found = dealt.select("key", "low", "high", "size", "word", "n").mapInArrow(_search, ROWS)
    first = F.min(F.struct((-F.col("other_n")).alias("order"), F.col("other")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("best")).select(
        "word", "n_near", F.col("best.other").alias("other"), (-F.col("best.order")).alias("other_n"))


def _roots(links: DataFrame) -> DataFrame:
    """``word`` and ``root``: the end of the chain of forms, by doubling the known part in each step."""
    known = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = known.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = known.join(on, F.col("root") == F.col("at"), "left")
        known = written(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if known.where("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def group_spellings(counts: DataFrame, dominance: int = DOMINANCE, largest: int = LARGEST_GROUP) -> DataFrame:
    """Spelling variants among words with counts (``word``, ``n``; distinct words).

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's ``form`` is its near word of
    largest ``n`` (ties: the smallest) if that is at least ``dominance`` times the word's; ``root`` is the end of the
    chain of forms, the word itself without one. Also returns ``n``, ``n_near`` (0 without near words) and
    ``form_n``. ``dominance`` must be above 1, so chains end; with counts below 2^63 they are at most 18 long at 10. Words are
    matched as strings of code points: no case folding, no normal forms. Null words are left out.
    """
    if dominance <= 1:
        raise ValueError("dominance must be above 1")
    pin_batches(counts.sparkSession)
    counts = written(counts.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "word-counts")
    has = F.col("other_n") >= F.lit(dominance) * F.col("n")
    formed = counts.join(near_words(counts, largest), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has, F.col("other")).alias("form"), F.when(has, F.col("other_n")).alias("form_n"),
    )
    formed = written(formed, "forms")
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
