"""Exact positions and ranks without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablelens.operators.columns import ref
from tablelens.session import reliable_checkpoint, small_table

BROADCAST_GROUPS = 10_000
HASH_PREFIX = 4  # hexadecimal digits: 65,536 buckets per group


def _hashable(df: DataFrame) -> list[Column]:
    return [F.to_json(ref(f.name)) if isinstance(f.dataType, T.MapType) else ref(f.name) for f in df.schema.fields]


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row in ``order_by`` order.

    The table is range-partitioned on the order columns, then on a hash of the row and a
    random tie-break, so neither a frequent key nor a large group of equal rows lands in one
    task (equal rows may swap places without changing the result). The sorted rows are
    checkpointed once; after that a per-partition count, one number per partition, turns
    local positions into global ones.
    """
    slot, place = "__slot", "__place"
    ties = [F.xxhash64(*_hashable(df)), F.rand(17)]
    ordered = df.orderBy(*[ref(c) for c in order_by], *ties).withColumn(slot, F.monotonically_increasing_id())
    ordered = reliable_checkpoint(ordered)
    located = ordered.withColumn(place, F.shiftright(slot, 33).cast("int"))
    totals = located.groupBy(place).count().orderBy(place).collect()
    offsets, running = [], 0
    for row in totals:
        offsets.append((row[place], running))
        running += row["count"]
    base = small_table(df.sparkSession, offsets or [(0, 0)], f"{place} int, __base long")
    local = F.col(slot).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        located.join(F.broadcast(base), place)
        .withColumn(name, F.col("__base") + local)
        .drop(slot, place, "__base")
    )


def bucket_edges(rows: int, buckets: int) -> list[int]:
    """Whole-number edges of ``buckets`` equal position ranges, ends included."""
    return [int(edge) for edge in np.linspace(0, rows, num=buckets + 1, dtype=int)]


def position_bucket(index: Column, edges: Sequence[int]) -> Column:
    """The 0-based position range that holds ``index``; a scaled guess corrected by its two edges."""
    buckets, rows = len(edges) - 1, edges[-1]
    table = F.array(*[F.lit(edge) for edge in edges])
    guess = F.least(F.floor(index * buckets / max(rows, 1)), F.lit(buckets - 1)).cast("int")
    return (
        F.when(index < F.element_at(table, guess + 1), guess - 1)
        .when(index >= F.element_at(table, guess + 2), guess + 1)
        .otherwise(guess)
    )


def sample_systematic(df: DataFrame, n: int, order_by: Sequence[str], method: str = "linspace") -> DataFrame:
    """``n`` evenly spaced rows: at ``linspace(0, N-1, n)``, or every ``floor(N/n)``-th row."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if method not in ("linspace", "step"):
        raise ValueError("method must be 'linspace' or 'step'")
    total = df.count()
    if total <= n:
        return df
    # ranks are found on the order columns and a hash of the row; the table itself is neither sorted nor written
    keys = [f"__key{i}" for i in range(len(order_by))]
    row = F.xxhash64(*_hashable(df))
    ranked = with_row_index(df.select(*[ref(c).alias(k) for c, k in zip(order_by, keys)], row.alias("__row")), keys)
    index = F.col("row_index")
    if method == "step":
        step = total // n
        kept = ranked.filter((index % step == 0) & (index < F.lit(step) * n))
    elif n == 1:
        kept = ranked.filter(index == 0)
    else:
        # a row is kept if some whole k has floor(k * spacing) == index
        spacing = (total - 1) / (n - 1)
        nearest = F.ceil(index / F.lit(spacing))
        hits = [F.floor((nearest + shift) * F.lit(spacing)) == index for shift in (-1, 0)]
        in_range = [(nearest + shift >= 0) & (nearest + shift <= n - 1) for shift in (-1, 0)]
        last = index == total - 1
        kept = ranked.filter((hits[0] & in_range[0]) | (hits[1] & in_range[1]) | last)
    wanted = kept.groupBy(*keys, "__row").agg(F.count(F.lit(1)).alias("__times"))
    same = row == F.col("__row")
    for name, key in zip(order_by, keys):
        same = same & ref(name).eqNullSafe(F.col(key))
    found = df.join(F.broadcast(wanted) if n <= BROADCAST_GROUPS else wanted, same)
    # of equal rows as many as were chosen; tasks forward only their own first ones
    turn = F.row_number().over(Window.partitionBy(*keys, "__row").orderBy("__times"))
    chosen = found.withColumn("__turn", turn).where(F.col("__turn") <= F.col("__times"))
    return chosen.select(*[ref(c) for c in df.columns])


def hash_order(key: Sequence[str], seed: int) -> Column:
    """A pseudo-random, reproducible sort key of a row."""
    return F.md5(F.concat_ws("|", *[ref(c).cast("string") for c in key], F.lit(str(seed))))


def hash_rank(
    df: DataFrame, key: Sequence[str], seed: int, by: Sequence[str] = (), name: str = "hash_rank"
) -> DataFrame:
    """Exact 0-based rank of each row in pseudo-random order, within each ``by`` group.

    ``key`` should identify rows. Groups are cut by the leading hash digits, ranked inside
    each cut and shifted by the counts before it, so a group holding most of the table is
    spread over 65,536 windows.
    """
    # one never-null group column: window and join then share one partitioning of the table
    group = F.to_json(F.struct(*[ref(c) for c in by])) if by else F.lit("all")
    keyed = df.withColumn("__order", hash_order(key, seed)).withColumns({
        "__group": group, "__cut": F.substring("__order", 1, HASH_PREFIX),
    })
    counts = keyed.groupBy("__group", "__cut").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__group").orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("__group", "__cut", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("__group", "__cut").orderBy("__order", *[ref(c) for c in key])
    ranked = keyed.withColumn("__local", F.row_number().over(inside) - 1)
    joined = ranked.join(shifts, ["__group", "__cut"])
    return joined.select(*[ref(c) for c in df.columns], (F.col("__shift") + F.col("__local")).alias(name))


def mark_lowest(
    df: DataFrame, key: Sequence[str], seed: int, quotas: DataFrame, by: str | None, groups: int, name: str
) -> DataFrame:
    """Flag exactly ``quota`` rows of each group: the first ones in pseudo-random order.

    ``quotas`` holds ``(__class, __quota)``, one row per group (``by=None``: one row). Only
    the sort key of the last wanted row is looked up, by counting rows per leading hash
    digits and ranking those of one cut; the table itself is then flagged by comparison,
    without being shuffled. ``groups`` is the counted number of groups; up to 10,000 their
    thresholds are broadcast, beyond that they are joined.
    """
    small = F.broadcast if groups <= BROADCAST_GROUPS else (lambda table: table)
    group = ref(by) if by else F.lit(0)
    order = F.struct(hash_order(key, seed).alias("hash"), *[ref(c).alias(f"k{i}") for i, c in enumerate(key)])
    keyed = df.select(group.alias("__class"), order.alias("__order"))
    keyed = keyed.withColumn("__cut", F.substring("__order.hash", 1, HASH_PREFIX))
    counts = keyed.groupBy("__class", "__cut").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy("__class").orderBy("__cut"))
    reached = counts.withColumn("__upto", upto)
    wanted = quotas.select(F.col("__class").alias("__wanted"), "__quota")
    edge = reached.join(wanted, F.col("__class").eqNullSafe(F.col("__wanted"))).filter(
        (F.col("__upto") >= F.col("__quota")) & (F.col("__upto") - F.col("__n") < F.col("__quota"))
    ).select(
        F.col("__class").alias("__edge_class"), F.col("__cut").alias("__edge_cut"),
        (F.col("__quota") - F.col("__upto") + F.col("__n")).alias("__left"),
    )
    same = F.col("__class").eqNullSafe(F.col("__edge_class")) & (F.col("__cut") == F.col("__edge_cut"))
    candidates = keyed.join(small(edge), same).select("__class", "__order", "__left")
    place = F.row_number().over(Window.partitionBy("__class").orderBy("__order"))
    last = candidates.withColumn("__place", place).filter(F.col("__place") == F.col("__left")).select(
        F.col("__class").alias("__group"), F.col("__order").alias("__last")
    )
    joined = df.join(small(last), group.eqNullSafe(F.col("__group")), "left")
    return joined.withColumn(name, F.coalesce(order <= F.col("__last"), F.lit(False))).drop("__group", "__last")
