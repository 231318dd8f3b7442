"""Column expressions with the missing-value rules the sales data needs.

All of them are built-in expressions and stay inside generated code. Coercions
use the ``try_`` forms, so a bad value becomes NULL while ANSI mode stays on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATE_FORMATS = ("MM-dd-yy", "MM-dd-yyyy", "MM/dd/yyyy", "M/d/yyyy")


def contains_ci(text: Column, part: str) -> Column:
    """Case-insensitive substring test; a missing text does not contain anything."""
    return F.coalesce(F.contains(F.lower(text), F.lit(part.lower())), F.lit(False))


def is_cancelled(status: Column) -> Column:
    return contains_ci(status, "cancel")


def to_number(text: Column) -> Column:
    """Decimal text to double, anything else (also infinities) to NULL."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def to_timestamp(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Text to a zone-free timestamp; the first format that fits wins, else NULL."""
    tries = [F.try_to_date(text, f).cast("timestamp_ntz") for f in formats]
    return F.coalesce(text.try_cast("timestamp_ntz"), *tries)


def to_flag(condition: Column) -> Column:
    """Comparison to 0/1, with an unknown comparison counting as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, otherwise 0."""
    return F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(0.0))


def sum0(value: Column) -> Column:
    """Sum that is 0, not NULL, when there is nothing to add."""
    return F.coalesce(F.sum(value), F.lit(0))


def lookup(value: Column, mapping: dict, default=None) -> Column:
    """Dictionary lookup as one CASE; unknown and missing values get the default."""
    out = None
    for key, val in mapping.items():
        out = F.when(value == key, val) if out is None else out.when(value == key, val)
    return out.otherwise(default)


def weekday(date: Column) -> Column:
    """Day of the week with Monday = 0."""
    return F.weekday(date)


def is_weekend(date: Column) -> Column:
    return to_flag(F.weekday(date).isin(5, 6))


def month_period(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded down: twelve hours back are -1."""
    span = end - start
    days = F.extract(F.lit("DAY"), span)
    return F.when(F.make_dt_interval(days) > span, days - 1).otherwise(days)


def days_after(date: Column, days: int) -> Column:
    return date + F.expr(f"INTERVAL '{int(days)}' DAY")


def finite_or_zero(value: Column) -> Column:
    """Missing, not-a-number and infinite values become 0."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def hash_fraction(keys: list[str], seed: int) -> Column:
    """Uniform number in [0, 1) fixed by the row key and the seed.

    md5 is used because every SQL engine has it, so a split or a sample can be
    checked from outside. No state, no order and no shuffle are involved.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(4294967296.0)
