"""Removal of byte strings that occur earlier in the corpus, by hash-compared suffix sorting."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablelens.llm.common import in_pieces, mixed, pin_batches, utf8, written
from tablelens.llm.infilling import unused

WIDTH = 100  # bytes that must be repeated
GRAM = 24  # bytes of an anchor
SLICE = 1 << 20  # windows of a long text that are handled at once
BLOCK = 1 << 16  # bytes whose numbers are worked out at once, in the processor's cache
BUCKET_BYTES = 20_000_000  # of text whose segments one task compares: about half a million
HOT_LEAST = 4096  # segments of one anchor cell that are always compared together
CHUNK = 20_000  # segments that are compared at once, unless one class has more
SUFFIXES = 2_000_000  # suffixes of those that are sorted at once
WINDOW_LEAD = 255  # marks a single window of a frequent anchor
MADE = ("n_bytes", "n_removed", "spans", "kept")
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd number per byte, and the powers of the base and of its inverse modulo 2^64."""
    most = SLICE + 4 * WIDTH
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    bases = (_BASE, pow(_BASE, -1, 1 << 64))
    return values, *(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(most, base, np.uint64)])) for base in bases)


class Prefixes:
    """Prefix polynomial hashes of some bytes: the hash of any part in constant time.

    With ``local``, the place of each byte in its string, parts must lie within one string.
    """

    def __init__(self, raw: np.ndarray, local: np.ndarray | None = None):
        values, powers, self.inverse = _tables()
        self.local = local
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        for start in range(0, len(raw), BLOCK):
            stop = min(start + BLOCK, len(raw))
            weights = powers[start:stop] if local is None else powers[local[start:stop]]
            weights = values[raw[start:stop]] * weights
            weights[:1] += self.sums[start : start + 1]
            np.cumsum(weights, out=self.sums[start + 1 : stop + 1])

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.inverse[at if self.local is None else self.local[at]]

    def everywhere(self, length: int, start: int, stop: int) -> np.ndarray:
        return (self.sums[start + length : stop + length] - self.sums[start:stop]) * self.inverse[start:stop]

    def digest(self, at: np.ndarray, length) -> np.ndarray:
        """A second number for a part, from the hashes of its halves; it shares no equation with ``of``."""
        half = length // 2
        return mixed(mixed(self.of(at, half)) + self.of(at + half, length - half) * np.uint64(0x8CB92BA72F3D8DD7))


def segments(raw: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Cut the windows of ``width`` bytes of some texts into segments: neighbouring windows with the same anchor.

    The anchor of a window is its leftmost ``gram`` of least hash, which depends on the window's bytes alone, so equal windows
    have equal anchors at equal distance, wherever they occur. A segment has at most ``width - gram + 1`` windows.
    """
    count = len(raw) - width + 1
    if count <= 0:
        return {name: np.zeros(0, np.int64) for name in ("first", "windows", "lead")} | {
            name: np.zeros(0, np.uint64) for name in ("anchor", "digest")}
    prefixes = Prefixes(raw)
    span = width - gram + 1
    place = np.empty(count, np.int64)
    for start in range(0, count, BLOCK):
        stop = min(start + BLOCK, count)
        least = mixed(prefixes.everywhere(gram, start, stop + span - 1))
        least = (least & ~_PLACE) | np.arange(len(least), dtype=np.uint64)
        done = 1
        while 2 * done <= span:
            least = np.minimum(least[:-done], least[done:])
            done *= 2
        if span > done:
            least = np.minimum(least[: done - span], least[span - done :])
        np.add((least & _PLACE).view(np.int64), start, out=place[start:stop])
    for end in offsets[1:-1].tolist():  # windows that reach over the end of a text
        place[max(end - width + 1, 0) : end] = -1
    first = np.append(0, 1 + np.flatnonzero(place[1:] != place[:-1]))
    windows, place = np.diff(np.append(first, count)), place[first]
    first, windows, place = (values[place >= 0] for values in (first, windows, place))
    digest = prefixes.digest(first, windows + width - 1) + windows.astype(np.uint64)
    # anew: least hashes are small numbers, and anchors choose buckets
    anchor = mixed(mixed(prefixes.of(place, gram)) ^ np.uint64(_BASE))
    return {"first": first, "windows": windows, "lead": place - first, "anchor": anchor, "digest": digest}


def _cut(batch: pa.RecordBatch, width: int, gram: int, hot: np.ndarray | None, cells: int) -> dict[str, np.ndarray]:
    """The segments of a batch (doc, tie, text), those of hot anchors as single windows with their own hash as anchor."""
    found: list[dict[str, np.ndarray]] = []
    for base, texts in in_pieces(batch.column(2)):
        raw, offsets = utf8(texts)
        for start in range(0, max(len(raw) - width + 1, 1), SLICE) if len(texts) == 1 else (0,):
            piece = raw[start : start + SLICE + width - 1] if len(texts) == 1 else raw
            bounds = np.array([0, len(piece)]) if len(texts) == 1 else offsets
            part = segments(piece, bounds, width, gram)
            row = np.searchsorted(bounds, part["first"], side="right") - 1
            place = part["first"] - bounds[row]
            part |= {"row": row + base, "place": place + start}
            if hot is not None and len(hot) and len(row):
                often = np.isin((part["anchor"] % np.uint64(cells)).astype(np.int64), hot)
                times = part["windows"][often]
                step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                first = np.repeat(part["first"][often], times) + step
                prefixes = Prefixes(piece)
                single = {
                    "row": np.repeat(part["row"][often], times), "place": np.repeat(part["place"][often], times) + step,
                    "windows": np.ones(len(first), np.int64), "lead": np.full(len(first), WINDOW_LEAD),
                    "anchor": mixed(prefixes.of(first, width)), "digest": prefixes.digest(first, width),
                }
                part = {name: np.concatenate([part[name][~often], single[name]]) for name in single}
            part.pop("first", None)
            found.append(part)
    names = ("row", "place", "windows", "lead", "anchor", "digest")
    return {name: np.concatenate([part[name] for part in found]) if found else np.zeros(0, np.int64) for name in names}


def _ranks(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The place of each row's document in the order of documents; equal for rows of one document."""
    order = np.lexsort((tie, doc))
    new = np.ones(len(order), np.int64)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (tie[order][1:] != tie[order][:-1])
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def _firsts(groups: tuple[np.ndarray, ...], rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by groups and occurrence, where a group starts in it, and what is a later occurrence in its group.

    Entries of one place of one document (repeated rows) are one occurrence.
    """
    order = np.lexsort((place, rank, *reversed(groups)))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for key in groups:
            new[1:] |= key[order][1:] != key[order][:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
    later = (rank[order] != rank[order][head]) | (place[order] != place[order][head])
    return order, new, later


BUCKETS = ("bucket int, doc array<bigint>, tie array<bigint>, place array<int>, shape array<int>, anchor array<int>, "
           "digest array<bigint>")


def _lists(table: dict[str, np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
    """One row per bucket, with all its entries as lists."""
    order = np.argsort(bucket, kind="stable")
    values, starts = np.unique(bucket[order], return_index=True)
    offsets = pa.array(np.append(starts, len(order)), pa.int32())
    kinds = {"doc": np.int64, "tie": np.int64, "place": np.int32, "shape": np.int32, "anchor": np.int32, "digest": np.int64}
    columns = [pa.array(values.astype(np.int32))]
    for name, kind in kinds.items():
        flat = table[name][order]
        flat = flat.view(np.int64) if flat.dtype == np.uint64 else flat
        columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat.astype(kind))))
    return pa.RecordBatch.from_arrays(columns, names=["bucket", *kinds])


def _deal(width: int, gram: int, buckets: int, hot, cells: int):
    """Segments dealt to buckets by their anchor; of equal ones in a batch only the first, the others go as known repeats."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _cut(batch, width, gram, hot.value, cells)
            if not len(part["row"]):
                continue
            doc, tie = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            rank = _ranks(doc, tie)[part["row"]]
            order, new, later = _firsts((part["digest"], part["anchor"]), rank, part["place"])
            keep = order[new | later]
            repeat = later[new | later]
            part = {name: values[keep] for name, values in part.items()}
            anchor = part["anchor"].astype(np.uint64)
            table = {
                "doc": doc[part["row"]], "tie": tie[part["row"]], "place": part["place"],
                # 0: a known repeat
                "shape": np.where(repeat, 0, part["lead"] + 1) << 8 | part["windows"],
                "anchor": (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), "digest": part["digest"],
            }
            bucket = ((anchor >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            yield _lists(table, bucket.astype(np.int64))

    return deal


def _count_cells(width: int, gram: int, cells: int):
    """How many different segments of each batch have an anchor in each cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            part = _cut(batch, width, gram, None, cells)
            if len(part["row"]):
                _, first = np.unique(part["digest"] ^ part["anchor"], return_index=True)
                total += np.bincount((part["anchor"][first] % np.uint64(cells)).astype(np.int64), minlength=cells)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    return count


MARKS = "doc bigint, tie bigint, place int, shape int, class bigint"


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All segments of some buckets: later ones of equal segments (class null), and first ones that share an anchor with others."""
    names = ("bucket", "doc", "tie", "place", "shape", "anchor", "digest")
    parts: dict[str, list[np.ndarray]] = {name: [] for name in names}
    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        parts["bucket"].append(np.repeat(batch.column(0).to_numpy(), sizes))
        for k, name in enumerate(names[1:], 1):
            parts[name].append(batch.column(k).flatten().to_numpy())
    if not parts["bucket"]:
        return
    table = {name: np.concatenate(values) for name, values in parts.items()}
    known = table["shape"] < 256
    repeats = {name: values[known] for name, values in table.items()}
    table = {name: values[~known] for name, values in table.items()}
    kind = table["bucket"].astype(np.int64) << 32 | table["anchor"].view(np.uint32).astype(np.int64)
    rank = _ranks(table["doc"], table["tie"])
    order, new, later = _firsts((kind, table["digest"]), rank, table["place"])
    kind = kind[order]
    some = np.ones(len(order), bool)
    some[1:] = kind[1:] != kind[:-1]
    different = np.add.reduceat(new, np.flatnonzero(some)) if len(order) else np.zeros(0, np.int64)
    shared = different[np.cumsum(some) - 1] > 1
    single = (table["shape"][order] >> 8) - 1 == WINDOW_LEAD
    ask = np.flatnonzero(new & shared & ~single)
    for rows, classes in ((order[later], None), (order[ask], kind[ask])):
        yield from _marks(table, rows, classes)
    yield from _marks(repeats, np.arange(len(repeats["doc"])), None)


def _marks(table: dict[str, np.ndarray], rows: np.ndarray, classes: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), 100_000):
        some = rows[start : start + 100_000]
        columns = [pa.array(table[name][some]) for name in ("doc", "tie", "place", "shape")]
        last = pa.nulls(len(some), pa.int64()) if classes is None else pa.array(classes[start : start + 100_000])
        yield pa.RecordBatch.from_arrays([*columns, last], names=["doc", "tie", "place", "shape", "class"])


@F.arrow_udf(T.BinaryType())
def _packed(texts: pa.Array) -> pa.Array:
    compress = zstandard.ZstdCompressor(level=1).compress
    return pa.array([text if text is None else compress(text) for text in texts.cast(pa.binary()).to_pylist()], pa.binary())


def _unpacked(cells: pa.Array) -> Iterator[bytes | None]:
    expand = zstandard.ZstdDecompressor().decompress
    return (cell if cell is None else expand(cell) for cell in cells.to_pylist())


CONTENTS = "class bigint, doc bigint, tie bigint, place int, shape int, content binary"


def _contents(width: int):
    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            owner = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            place, shape, kind = (lists.flatten().field(k).to_numpy() for k in range(3))
            texts = list(_unpacked(batch.column(2)))
            stop = place + (shape & 255) + width - 1
            cells = [texts[o][a:b] for o, a, b in zip(owner.tolist(), place.tolist(), stop.tolist())]
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place), pa.array(shape), pa.array(cells, pa.binary())],
                names=["class", "doc", "tie", "place", "shape", "content"],
            )

    return contents


def common_extension(prefixes: Prefixes, one: np.ndarray, other: np.ndarray, width: int) -> np.ndarray:
    """How many first bytes (at most ``width``) two suffixes have in common, by binary search over prefix hashes."""
    low, high = np.zeros(len(one), np.int64), np.full(len(one), width, np.int64)
    whole = prefixes.of(one, width) == prefixes.of(other, width)
    low[whole] = width
    high[~whole] -= 1
    while True:
        rows = np.flatnonzero(low < high)
        if not len(rows):
            return low
        middle = (low[rows] + high[rows] + 1) // 2
        equal = prefixes.of(one[rows], middle) == prefixes.of(other[rows], middle)
        low[rows[equal]] = middle[equal]
        high[rows[~equal]] = middle[~equal] - 1


def _merged(raw: np.ndarray, prefixes: Prefixes, at: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The order of the suffixes within groups of ``sizes``, by merging runs.

    All groups are merged at once: the place of a suffix in the merged run is its own and the number of smaller ones in
    the neighbour run, found by binary search. Two suffixes are compared by their common extension and the
    byte behind it.
    """
    starts = np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(at)) - starts[group]
    order = np.arange(len(at))
    run = 1
    while run < (sizes.max() if len(sizes) else 0):
        rows = np.flatnonzero(sizes[group] > run)
        turn = inner[rows] // run
        low = np.minimum((turn ^ 1) * run, sizes[group[rows]])
        high = np.minimum(low + run, sizes[group[rows]])
        base, begin, right = starts[group[rows]], low.copy(), turn & 1 == 1
        own = at[order[rows]]
        while True:
            some = np.flatnonzero(low < high)
            if not len(some):
                break
            middle = (low[some] + high[some]) // 2
            mine, its = own[some], at[order[base[some] + middle]]
            common = common_extension(prefixes, mine, its, width)
            inside = np.minimum(common, width - 1)
            less = raw[its + inside] < raw[mine + inside]  # that one comes before this one
            before = np.where(common == width, right[some], less)
            low[some[before]] = middle[before] + 1
            high[some[~before]] = middle[~before]
        target = base + (turn & ~1) * run + (inner[rows] - turn * run) + (low - begin)
        moved = order.copy()
        moved[target] = order[rows]
        order = moved
        run *= 2
    return order


def sort_suffixes(
    raw: np.ndarray, prefixes: Prefixes, at: np.ndarray, sizes: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes at ``at`` by their first ``width`` bytes within groups of ``sizes``, stably.

    Of suffixes that share a hash of all ``width`` bytes one is merged (``_merged``) and the others follow it, so the work
    grows with the different suffixes of a group. Afterwards the bytes of neighbours are compared: a group that a hash
    collision put out of order is sorted by its bytes.

    Returns the order (indices into ``at``) and whether each sorted suffix equals the one before it in its group.
    """
    starts = np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(len(sizes)), sizes)
    whole = prefixes.of(at, width)
    alike = np.lexsort((whole, group))
    new = np.ones(len(at), bool)
    new[1:] = (group[alike][1:] != group[alike][:-1]) | (whole[alike][1:] != whole[alike][:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(at)))
    turn = _merged(raw, prefixes, at[alike[first]], np.bincount(group[alike[first]], minlength=len(sizes)), width)
    first, times = first[turn], times[turn]
    order = alike[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(len(at))]
    equal = np.zeros(len(at), bool)
    wrong: set[int] = set()
    span = np.arange(width)
    for start in range(1, len(at), 50_000):
        rows = np.arange(start, min(start + 50_000, len(at)))
        rows = rows[group[rows] == group[rows - 1]]
        before, after = raw[at[order[rows - 1]][:, None] + span], raw[at[order[rows]][:, None] + span]
        differ = before != after
        first = differ.argmax(axis=1)
        some = differ.any(axis=1)
        lines = np.arange(len(rows))
        equal[rows] = ~some
        wrong.update(group[rows[some & (before[lines, first] > after[lines, first])]].tolist())
    for g in wrong:
        rows = order[starts[g] : starts[g] + sizes[g]]
        text = {int(r): raw[at[r] : at[r] + width].tobytes() for r in rows}
        rows = np.array(sorted(text, key=lambda r: (text[r], r)), np.int64)
        order[starts[g] : starts[g] + sizes[g]] = rows
        equal[starts[g] : starts[g] + sizes[g]] = [k > 0 and text[int(r)] == text[int(rows[k - 1])] for k, r in enumerate(rows)]
    return order, equal


def _shared(values: np.ndarray) -> np.ndarray:
    """Where those values are, in order, that occur more than once."""
    order = np.argsort(values)
    again = values[order][1:] == values[order][:-1]
    some = np.zeros(len(values), bool)
    some[order[1:][again]] = some[order[:-1][again]] = True
    return np.flatnonzero(some)


def later_windows(
    contents: list[bytes], kind: np.ndarray, rank: np.ndarray, place: np.ndarray, lead: np.ndarray, windows: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of every window that an earlier segment of its class has too."""
    raw = np.frombuffer(b"".join(contents), np.uint8)
    lengths = np.fromiter(map(len, contents), np.int64, len(contents))
    offsets = np.cumsum(lengths) - lengths
    prefixes = Prefixes(raw, np.arange(len(raw)) - np.repeat(offsets, lengths))
    occurrence = np.lexsort((place, rank))
    new = np.ones(len(occurrence), np.int64)
    new[1:] = (rank[occurrence][1:] != rank[occurrence][:-1]) | (place[occurrence][1:] != place[occurrence][:-1])
    when = np.empty(len(occurrence), np.int64)
    when[occurrence] = np.cumsum(new)
    kind = np.unique(kind, return_inverse=True)[1]
    # windows can only be equal if their anchors are equally far: those distances in turn, as many as fit
    rounds = 1 + int(windows.sum()) // SUFFIXES
    found = []
    for turn in range(rounds):
        skipped = (lead - turn) % rounds
        times = np.maximum(0, -(-(windows - skipped) // rounds))
        segment = np.repeat(np.arange(len(windows)), times)
        step = skipped[segment] + rounds * (np.arange(len(segment)) - np.repeat(np.cumsum(times) - times, times))
        key = kind[segment] * 512 + (lead[segment] - step + 256)
        # a window whose hash no other one of its distance has is no repeat: only the others are sorted
        some = _shared(mixed(prefixes.of(offsets[segment] + step, width)) + key.astype(np.uint64))
        segment, step, key = segment[some], step[some], key[some]
        order = np.argsort(key, kind="stable")
        if not len(order):
            continue
        counts = np.diff(np.append(np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])), len(order)))
        sorted_, equal = sort_suffixes(raw, prefixes, (offsets[segment] + step)[order], counts, width)
        rows = order[sorted_]
        first = np.minimum.reduceat(when[segment[rows]], np.flatnonzero(~equal))[np.cumsum(~equal) - 1]
        rows = rows[when[segment[rows]] > first]
        found.append((segment[rows], step[rows]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    segment, step = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((step, segment))
    return segment[order], step[order]


REPEATS = "doc bigint, tie bigint, place int, windows int"


def _compare(width: int):
    """Windows that occur earlier, among segments of equal classes; rows come sorted by class."""
    names = ("class", "doc", "tie", "place", "shape", "content")

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        kind, doc, tie, place, shape = (table[name].to_numpy() for name in names[:-1])
        windows, lead = (shape & 255).astype(np.int64), (shape >> 8).astype(np.int64) - 1
        contents = table["content"].to_pylist()
        rank = _ranks(doc, tie)
        segment, step = later_windows(contents, kind, rank, place, lead, windows, width)
        new = np.ones(len(step), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (step[1:] != step[:-1] + 1)
        head = np.flatnonzero(new)
        rows = segment[head]
        length = np.diff(np.append(head, len(step))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[rows]), pa.array(tie[rows]), pa.array((place[rows] + step[head]).astype(np.int32)), pa.array(length)],
            names=["doc", "tie", "place", "windows"],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            if sum(map(len, held)) + len(batch) > CHUNK:
                last = batch.column(0)[len(batch) - 1].as_py()
                kinds = batch.column(0).to_numpy()
                cut = int(np.searchsorted(kinds, last))
                if cut or held and held[-1].column(0)[len(held[-1]) - 1].as_py() != kinds[0]:
                    if cut:
                        held.append(batch.slice(0, cut))
                    yield solve(held)
                    held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield solve(held)

    return compare


def cut_repeats(
    raws: list[bytes], owner: np.ndarray, places: np.ndarray, windows: np.ndarray, width: int
) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """What is left of each of ``raws``; where its maximal removed runs begin and end in the lists of their starts and lengths."""
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1  # runs of two texts never touch
    base = np.cumsum(sizes) - sizes
    starts = base[owner] + places
    order = np.argsort(starts)
    starts, ends = starts[order], np.maximum.accumulate((starts + windows + width - 1)[order])
    head = np.flatnonzero(np.append(True, starts[1:] > ends[:-1])[: len(starts)])
    starts, ends = starts[head], ends[np.append(head[1:], len(ends))[: len(head)] - 1]
    bounds = np.searchsorted(starts, np.append(base, sizes.sum()))
    row = np.repeat(np.arange(len(raws)), np.diff(bounds))
    starts, lengths = starts - base[row], ends - starts
    left, first, last, cuts = [], starts.tolist(), (starts + lengths).tolist(), bounds.tolist()
    for raw, a, b in zip(raws, cuts, cuts[1:]):
        left.append(b"".join(raw[x:y] for x, y in zip([0, *last[a:b]], [*first[a:b], len(raw)])) if a < b else raw)
    return left, bounds, starts, lengths


def remove_repeats(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    gram: int = GRAM,
    with_text: bool = True,
) -> DataFrame:
    """Remove every byte that is covered by a string of ``width`` bytes that also starts earlier in the corpus.

    Earlier means a smaller id, or the same text at a smaller start; strings are judged on the input, may overlap and never
    cross texts. Every window of ``width`` bytes has an anchor, its ``gram`` of least hash; neighbouring windows with one
    anchor make a segment, about every 40 bytes one. Segments, as numbers, are dealt to buckets by their anchor. Of equal segments all
    but the first are repeats. Of different segments with one anchor the bytes are fetched, and their suffixes (one per window) whose
    hash occurs more than once are sorted: mergesort, compared by binary search over prefix hashes, checked byte by byte. In each run
    of suffixes with ``width`` equal bytes all but the first are repeats.

    Hot passages: tasks send only the first of equal segments of a batch; anchors in cells of the hash space with over
    8 times the mean (and over 4,096) segments, which are counted before, are replaced by single windows, each dealt by its own hash, so no
    bucket or class grows with a frequent anchor. Only the list of those cells, at most an eighth of all cells, goes to the tasks.
    Segments and windows of frequent anchors are equal if two 64-bit hashes of them are (32 bits of the first, beside the bucket).

    Returns all columns of ``df`` and ``n_bytes`` (UTF-8), ``n_removed``, ``spans`` (array of start and length of the maximal
    removed runs) and ``kept`` (binary: a cut can fall inside a character); earlier columns with these names are replaced. Without
    ``with_text`` the text column is left out. A null text counts as empty. Rows without an id come before all others. Rows that share an id come in the order of a hash of
    their texts; repeated rows (equal id and text) are one text and get the same result. An empty table gives no rows.
    """
    if not 8 <= gram < width <= 200:
        raise ValueError("8 <= gram < width <= 200")
    spark = pin_batches(df.sparkSession)
    column = lambda c: F.col(f"`{c}`")
    kept = [c for c in df.columns if c.lower() not in MADE]
    own = [unused(name, df.columns) for name in ("doc", "tie", "body")]
    ids, body = column(id_column).cast("long"), F.coalesce(column(text_column).cast("string"), F.lit(""))
    total = df.agg(F.sum(F.octet_length(body))).first()[0] or 0
    several = not df.groupBy(ids.alias("id")).count().where("count > 1").isEmpty()
    tie = F.xxhash64(ids.isNull(), body) if several else F.lit(0).cast("long")
    rows = df.select(*[column(c) for c in kept], F.coalesce(ids, F.lit(-(1 << 63))).alias(own[0]), tie.alias(own[1]), body.alias(own[2]))
    texts = rows.select(column(own[0]).alias("doc"), column(own[1]).alias("tie"), column(own[2]).alias("text"))
    texts = texts.where(F.octet_length("text") >= width)

    expected = 2 * total // (width - gram + 2)
    cells = max(1 << 14, expected >> 17)
    counted = texts.mapInArrow(_count_cells(width, gram, cells), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    most = max(HOT_LEAST, 8 * expected // cells)
    hot = np.array([r["cell"] for r in counted.where(F.col("n") > most).select("cell").collect()], np.int64)
    sent = spark.sparkContext.broadcast(hot)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    dealt = texts.mapInArrow(_deal(width, gram, buckets, sent, cells), BUCKETS).repartitionById(buckets, "bucket")
    marks = written(dealt.mapInArrow(_match, MARKS), "repeat-marks")

    asked = marks.where("class IS NOT NULL").groupBy("doc", "tie").agg(F.collect_list(F.struct("place", "shape", "class")).alias("asked"))
    packed = texts.select("doc", "tie", _packed("text").alias("packed"))
    contents = packed.join(asked, ["doc", "tie"]).select("doc", "tie", "packed", "asked").mapInArrow(_contents(width), CONTENTS)
    parts = contents.repartition("class").sortWithinPartitions("class").mapInArrow(_compare(width), REPEATS)
    run = "shiftleft(CAST(place AS bigint), 8) | {} AS run"  # one number, which is gathered faster than a pair
    sure = marks.where("class IS NULL").selectExpr("doc", "tie", run.format("(shape & 255)"))
    repeats = sure.unionByName(parts.selectExpr("doc", "tie", run.format("windows")))
    repeats = repeats.groupBy("doc", "tie").agg(F.collect_list("run").alias("repeats"))
    carried, made = unused("repeats", df.columns), unused("made", df.columns)
    repeats = repeats.select(F.col("doc").alias(own[0]), F.col("tie").alias(own[1]), F.col("repeats").alias(carried))
    # the texts travel compressed, and once
    others = [c for c in kept if c.lower() != text_column.lower()]
    text = F.when(column(text_column).isNotNull(), column(own[2]))
    ready = rows.select(*[column(c) for c in others], column(own[0]), column(own[1]), _packed(text).alias(own[2]))
    ready = ready.join(repeats, own[:2], "left")
    ready = ready.withColumn(made, _finish(width, with_text)(column(own[2]), column(carried)))
    given = [column(c) if c in others else column(f"{made}`.`text").alias(c) for c in kept if with_text or c in others]
    return ready.select(*given, *[column(f"{made}`.`{name}").alias(name) for name in MADE])


def _finish(width: int, with_text: bool):
    fields = "n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,length:bigint>>, kept binary"
    made = T.StructType.fromDDL(fields + ", text string" * with_text)
    kind = pa.struct(to_arrow_schema(made))

    @F.arrow_udf(made)
    def finish(packed: pa.Array, lists: pa.Array) -> pa.Array:
        texts = list(_unpacked(packed))
        raws = [raw or b"" for raw in texts]
        runs = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(raws)), lists.value_lengths().fill_null(0).to_numpy())
        left, bounds, starts, lengths = cut_repeats(raws, owner, runs >> 8, runs & 255, width)
        sums = np.append(0, np.cumsum(lengths))[bounds]
        spans = kind.field("spans").type
        cells = pa.StructArray.from_arrays([pa.array(starts), pa.array(lengths)], fields=list(spans.value_type))
        columns = [
            pa.array([len(raw) for raw in raws], pa.int64()), pa.array(np.diff(sums)),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), cells, type=spans), pa.array(left, pa.binary()),
        ]
        if with_text:
            columns.append(pa.array([raw if raw is None else raw.decode("utf-8") for raw in texts], pa.string()))
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    return finish


def digest(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``remove_repeats`` rows with the number of spans and the SHA-256 of what is kept."""
    return df.select(
        F.col(f"`{id_column}`").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


REPEAT_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits, strlen(coalesce(text, '')) AS n_bytes FROM documents),
windows AS (
  SELECT doc_id, start, md5_number(substr(digits, 2 * start + 1, 200)) AS content
  FROM (SELECT doc_id, digits, unnest(range(0, n_bytes - 99)) AS start FROM docs)),
firsts AS (SELECT content, min((doc_id, start)) AS head FROM windows GROUP BY content HAVING count(*) > 1),
later AS (SELECT doc_id, start FROM windows JOIN firsts USING (content) WHERE (doc_id, start) > head),
marked AS (
  SELECT doc_id, start, coalesce(start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) > 100, true)::INT AS fresh FROM later),
spans AS (
  SELECT doc_id, min(start) AS a, max(start) + 100 AS b
  FROM (SELECT doc_id, start, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM marked)
  GROUP BY doc_id, island),
edges AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS open FROM spans),
kept AS (
  SELECT e.doc_id, string_agg(substr(digits, 2 * open + 1, 2 * (a - open)), '' ORDER BY a) AS parts, max(b) AS last,
    sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans
  FROM edges e JOIN docs USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(parts, '') || substr(digits, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""
