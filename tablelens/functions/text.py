"""Text column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANK = r"^\s*$"


def is_blank(value: Column) -> Column:
    return value.rlike(BLANK)


def blank_to_null(value: Column) -> Column:
    return F.when(~is_blank(value), value)


def quote_name(name: str) -> str:
    """A column name as a SQL identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"
