"""Column expressions: pure functions from Column to Column, no jobs."""

from tablelens.functions.dates import (
    PERIODS,
    add_periods,
    calendar_parts,
    format_period,
    parse_datetime,
    period_start,
    periods_between,
)
from tablelens.functions.numbers import finite, half_even, half_up, safe_numeric, two_sided_normal_p
from tablelens.functions.text import blank_to_null, is_blank, quote_name

__all__ = [
    "PERIODS",
    "add_periods", "blank_to_null", "calendar_parts", "finite", "format_period", "half_even", "half_up",
    "is_blank", "parse_datetime", "period_start", "periods_between", "quote_name", "safe_numeric",
    "two_sided_normal_p",
]
