"""Exact order statistics of whole columns in bounded memory."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

BUFFER_VALUES = 4_000_000  # values, over all intervals, that may be sorted in one task (32 MB)
BINS = 1_024


@dataclass(frozen=True)
class Span:
    """Number of values of a column and its extremes."""

    count: int
    low: float | None
    high: float | None


@dataclass
class _Search:
    """One wanted rank: the interval its value lies in and the count of values below it."""

    column: str
    rank: int
    low: float
    high: float
    below: int
    inside: int
    value: float | None = None

    @property
    def interval(self) -> tuple[str, float, float]:
        return self.column, self.low, self.high


def values_at_ranks(
    df: DataFrame, wanted: Mapping[str, Sequence[int]], spans: Mapping[str, Span], buffer_values: int = BUFFER_VALUES
) -> dict[tuple[str, int], float]:
    """The value at each 0-based rank of each double column (nulls left out).

    The interval around each rank is narrowed by counting values in equal-width bins until
    few enough are left to sort. A pass is one aggregation whose map-side partials are at
    most ``BINS`` rows per column and task, so no task ever holds a column. Every pass splits
    the interval between its smallest and largest value, which bounds their number; on usual
    data two passes suffice for billions of rows.
    """
    searches = [
        _Search(c, rank, spans[c].low, spans[c].high, 0, spans[c].count)
        for c, ranks in wanted.items() for rank in sorted(set(ranks))
    ]
    open_searches = [s for s in searches if not _settled(s)]
    while open_searches:
        share = buffer_values // len(_slots(open_searches))
        large = [s for s in open_searches if s.inside > max(share, 1)]
        if not large:
            break
        _narrow(df, large)
        open_searches = [s for s in open_searches if not _settled(s)]
    if open_searches:
        _read(df, open_searches)
    return {(s.column, s.rank): s.value for s in searches}


def _settled(search: _Search) -> bool:
    # halves keep the width finite; it is 0 only between neighbouring subnormal numbers
    if search.high / 2 - search.low / 2 == 0:
        search.value = search.low
        return True
    return False


def _slots(searches: Sequence[_Search]) -> list[list[_Search]]:
    groups: dict[tuple, list[_Search]] = {}
    for search in searches:
        groups.setdefault(search.interval, []).append(search)
    return list(groups.values())


def _inside(slot: Sequence[_Search]) -> Column:
    column, low, high = slot[0].interval
    return (F.col(column) >= low) & (F.col(column) <= high)


def _narrow(df: DataFrame, searches: Sequence[_Search]) -> None:
    slots, records = _slots(searches), []
    for i, members in enumerate(slots):
        column, low, high = members[0].interval
        value = F.col(column)
        if math.isfinite(high - low):
            place = (value - low) / F.lit(high - low) * BINS
        else:
            place = (value / 2 - low / 2) / F.lit(high / 2 - low / 2) * BINS
        records.append(F.struct(
            F.lit(i).alias("slot"),
            F.when(_inside(members), value).alias("value"),
            F.least(F.floor(place), F.lit(BINS - 1)).cast("int").alias("bin"),
        ))
    # rows outside every interval go before cells are made of the rest
    touched = df.filter(reduce(or_, map(_inside, slots)))
    cells = touched.select(F.inline(F.array(*records))).filter(F.col("value").isNotNull())
    bins = cells.groupBy("slot", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    counted: dict[int, list] = {}
    for row in bins.collect():  # at most BINS rows per interval
        counted.setdefault(row["slot"], []).append(row)
    for i, members in enumerate(slots):
        for search in members:
            below = search.below
            for row in sorted(counted[i], key=lambda r: r["bin"]):
                if search.rank < below + row["n"]:
                    search.low, search.high, search.inside = row["low"], row["high"], row["n"]
                    break
                below += row["n"]
            search.below = below


def _read(df: DataFrame, searches: Sequence[_Search]) -> None:
    slots = _slots(searches)
    ordered = df.filter(reduce(or_, map(_inside, slots))).agg(*[
        F.sort_array(F.collect_list(F.when(_inside(members), F.col(members[0].column)))).alias(f"s{i}")
        for i, members in enumerate(slots)
    ])
    # plain element reads beside each other: inside a lambda the sort would be repeated per element
    row = ordered.select(*[
        F.array(*[F.element_at(f"s{i}", F.lit(s.rank - s.below + 1)) for s in members]).alias(f"v{i}")
        for i, members in enumerate(slots)
    ]).first()
    for i, members in enumerate(slots):
        for search, value in zip(members, row[f"v{i}"]):
            search.value = value


def column_spans(df: DataFrame, columns: Sequence[str]) -> dict[str, Span]:
    """Count and extremes of each column, from one aggregation."""
    if not columns:
        return {}
    row = df.agg(*[
        part.alias(f"{name}{i}")
        for i, c in enumerate(columns)
        for name, part in (("n", F.count(F.col(c))), ("low", F.min(c)), ("high", F.max(c)))
    ]).first()
    return {c: Span(row[f"n{i}"], row[f"low{i}"], row[f"high{i}"]) for i, c in enumerate(columns)}


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    method: str | Sequence[str] = "linear",
    spans: Mapping[str, Span] | None = None,
    buffer_values: int = BUFFER_VALUES,
) -> dict[str, list[float | None]]:
    """Exact quantiles of double columns, interpolated (``linear``) or the lower element (``lower``).

    ``method`` is one for all shares or one per share; ``spans`` saves a pass where they are known.
    """
    methods = [method] * len(shares) if isinstance(method, str) else list(method)
    if set(methods) - {"linear", "lower"}:
        raise ValueError("method must be 'linear' or 'lower'")
    spans = spans or column_spans(df, columns)
    wanted = {}
    for column in columns:
        last = spans[column].count - 1
        ranks = [int(last * share) for share in shares] if last >= 0 else []
        wanted[column] = [r for rank in ranks for r in (rank, min(rank + 1, last))]
    values = values_at_ranks(df, wanted, spans, buffer_values)
    result: dict[str, list[float | None]] = {}
    for column in columns:
        last = spans[column].count - 1
        if last < 0:
            result[column] = [None] * len(shares)
            continue
        found = []
        for share, how in zip(shares, methods):
            position = last * share
            rank = int(position)
            low = values[(column, rank)]
            if how == "lower" or position == rank:
                found.append(low)
            else:
                high = values[(column, min(rank + 1, last))]
                found.append(low + (high - low) * (position - rank))
        result[column] = found
    return result


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {column: values[0] for column, values in quantiles(df, columns, [0.5]).items()}
