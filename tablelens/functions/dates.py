"""Date parsing, calendar parts and period arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# fixed values: the accepted text layouts in order of preference; day-first wins over month-first
# (shape of the text, layouts tried on that shape)
DATE_LAYOUTS = [
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,9})?$", ["yyyy-M-d H:m:s[.SSSSSSSSS]"]),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,9})?$", ["yyyy-M-d'T'H:m:s[.SSSSSSSSS]"]),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ["yyyy-M-d"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["d-M-yyyy", "M-d-yyyy"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["d/M/yyyy", "M/d/yyyy"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"]),
    (r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$", ["MMM d, yyyy", "MMMM d, yyyy"]),
    (r"^[A-Za-z]{3,9}-\d{4}$", ["MMM-yyyy", "MMMM-yyyy"]),
    (r"^[A-Za-z]{3,9} \d{4}$", ["MMM yyyy", "MMMM yyyy"]),
    (r"^\d{4}-\d{1,2}$", ["yyyy-M"]),
    (r"^\d{1,2}-\d{4}$", ["M-yyyy"]),
]

PERIODS = ("day", "week", "month", "quarter", "year")


def parse_datetime(value: Column, dtype: T.DataType | None = None) -> Column:
    """First layout that fits the trimmed text, else null. Temporal input is only cast.

    The shape test runs before the formatter, so each row pays for at most two parse
    attempts instead of one failing attempt per layout.
    """
    if dtype is not None and isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp")
    text = F.trim(value.cast("string"))
    parsed: Column | None = None
    for shape, layouts in DATE_LAYOUTS:
        source = F.initcap(text) if "A-Za-z" in shape else text
        attempt = F.coalesce(*[F.try_to_timestamp(source, F.lit(layout)) for layout in layouts])
        parsed = F.when(text.rlike(shape), attempt) if parsed is None else parsed.when(text.rlike(shape), attempt)
    return parsed


def _label(label: Column | str) -> Column:
    return F.lit(label) if isinstance(label, str) else label


def format_period(period: Column, label: Column | str) -> Column:
    """Display text of a period start."""
    label = _label(label)
    return (
        F.when(label == "day", F.date_format(period, "yyyy-MM-dd"))
        .when(label == "week", F.concat(F.lit("Week of "), F.date_format(period, "yyyy-MM-dd")))
        .when(label == "month", F.date_format(period, "yyyy-MM"))
        .when(label == "quarter", F.concat(F.year(period).cast("string"), F.lit("-Q"), F.quarter(period).cast("string")))
        .otherwise(F.date_format(period, "yyyy"))
    )


def period_start(moment: Column, label: Column | str) -> Column:
    """Truncate to the start of the period; weeks start on Monday."""
    return F.call_function("date_trunc", _label(label), moment)


def add_periods(period: Column, label: Column | str, steps: Column | int) -> Column:
    """The period start ``steps`` periods later."""
    steps = F.lit(steps) if isinstance(steps, int) else steps
    steps = steps.cast("int")
    label = _label(label)
    day = F.to_date(period)
    return (
        F.when(label == "day", F.date_add(day, steps))
        .when(label == "week", F.date_add(day, steps * 7))
        .when(label == "month", F.add_months(day, steps))
        .when(label == "quarter", F.add_months(day, steps * 3))
        .otherwise(F.add_months(day, steps * 12))
        .cast("timestamp")
    )


def periods_between(start: Column, end: Column, label: Column | str) -> Column:
    """Number of whole periods from one period start to another."""
    label = _label(label)
    days = F.datediff(end, start)
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return (
        F.when(label == "day", days)
        .when(label == "week", (days / 7).cast("int"))
        .when(label == "month", months)
        .when(label == "quarter", (months / 3).cast("int"))
        .otherwise((months / 12).cast("int"))
        .cast("int")
    )


def calendar_parts(moment: Column, week_start: str = "sunday") -> dict[str, Column]:
    """Calendar features of a date. ``day_of_week`` counts from 0 on ``week_start``."""
    weekday = F.weekday(moment) if week_start == "monday" else F.dayofweek(moment) - 1
    return {
        "iso_date": F.date_format(moment, "yyyy-MM-dd"),
        "month": F.month(moment),
        "quarter": F.quarter(moment),
        "day_of_week": weekday,
        "is_weekend": F.when(F.dayofweek(moment).isin(1, 7), 1).otherwise(0),
        "year": F.year(moment),
    }
