"""One pass of facts about all columns, shared by the operators that need them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tablelens.operators.columns import columns_by_role, finite_numbers, finite_values, missing
from tablelens.operators.quantiles import Span, quantiles

SHARES = (0.25, 0.5, 0.75, 0.25, 0.75)
METHODS = ("linear", "linear", "linear", "lower", "lower")


@dataclass(frozen=True)
class NumericFacts:
    """Finite values of a numeric column: number, mean, population deviation, skewness, extremes, rough distinct count."""

    count: int
    mean: float | None
    std: float | None
    skewness: float | None
    low: float | None
    high: float | None
    rough_distinct: int | None

    @property
    def span(self) -> Span:
        return Span(self.count, self.low, self.high)


@dataclass(frozen=True)
class Quartiles:
    q1: float | None
    median: float | None
    q3: float | None
    lower_q1: float | None
    lower_q3: float | None


@dataclass
class TableSummary:
    """Row count, missing cells of every column and facts of the numeric ones; quartiles are read once, when first asked for."""

    table: DataFrame
    rows: int
    missing: dict[str, int]
    numbers: dict[str, NumericFacts]
    _quartiles: dict[str, Quartiles] = field(default_factory=dict)

    def spans(self) -> dict[str, Span]:
        return {name: facts.span for name, facts in self.numbers.items()}

    def quartiles(self) -> dict[str, Quartiles]:
        """Exact quartiles of all numeric columns, interpolated and as lower elements, from one search for all ranks."""
        if not self._quartiles and self.numbers:
            names = list(self.numbers)
            found = quantiles(finite_numbers(self.table, names), names, SHARES, METHODS, self.spans())
            self._quartiles.update({name: Quartiles(*values) for name, values in found.items()})
        return self._quartiles

    def varying(self) -> list[str]:
        """Numeric columns with more than one value."""
        return [name for name, facts in self.numbers.items() if facts.count and facts.low != facts.high]


def summarise(
    df: DataFrame, columns: list[str] | None = None, all_missing: bool = True, sketches: bool = False
) -> TableSummary:
    """Facts of all columns from one aggregation: every part is summed in the tasks and merged, so one row per task is shuffled.

    ``columns`` are the numeric columns looked at (all of them by default); ``sketches`` adds rough distinct counts. A table without numeric columns, without
    rows or without columns has a summary all the same.
    """
    names = list(columns) if columns is not None else columns_by_role(df, "numeric")
    gaps = df.columns if all_missing else []
    cells = df.select(
        *[missing(df, name).alias(f"m{i}") for i, name in enumerate(gaps)],
        *[value.alias(f"v{i}") for i, value in enumerate(finite_values(df, names))],
    )
    parts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(f"m{i}").alias(f"m{i}") for i in range(len(gaps))]]
    for i in range(len(names)):
        value = F.col(f"v{i}")
        parts += [
            F.count(value).alias(f"n{i}"), F.avg(value).alias(f"mean{i}"), F.stddev_pop(value).alias(f"std{i}"),
            F.skewness(value).alias(f"skew{i}"), F.min(value).alias(f"low{i}"), F.max(value).alias(f"high{i}"),
        ]
        if sketches:
            parts.append(F.approx_count_distinct(F.round(value, 8)).alias(f"rough{i}"))
    row = cells.agg(*parts).first()
    facts = {
        name: NumericFacts(
            *[row[f"{part}{i}"] for part in ("n", "mean", "std", "skew", "low", "high")], row[f"rough{i}"] if sketches else None
        )
        for i, name in enumerate(names)
    }
    return TableSummary(df, row["rows"], {name: row[f"m{i}"] for i, name in enumerate(gaps)}, facts)
