"""Ratings, rounding and count formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxboard.functions.text import strip_ws
from voxboard.model import LOW_STAR, NULL_RATING_SORT

_FLOAT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def coerce_rating(c: Column) -> Column:
    """A number from 1 to 5, else null. Never raises, whatever the text."""
    text = strip_ws(c.cast("string"))
    value = F.when(text.rlike(_FLOAT), text.try_cast("double"))
    return F.when(value.between(1.0, 5.0), value)


def rating_sort(c: Column) -> Column:
    """Sort value of a rating: no rating comes last."""
    return F.coalesce(c, F.lit(NULL_RATING_SORT))


def is_low_star(c: Column) -> Column:
    return F.coalesce(c <= LOW_STAR, F.lit(False))


def round_half_even(c: Column, digits: int) -> Column:
    """Correctly rounded on the exact binary value, ties to even.

    ``round`` and ``bround`` work on the printed decimals and differ in the last
    digit at ties; the decimal formatter looks at the double itself.
    """
    pattern = "0." + "0" * digits
    return F.call_function("format_number", c, F.lit(pattern)).cast("double")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, half up; 0 when there is nothing to divide by."""
    return F.when(whole > 0, F.floor(F.lit(100.0) * (part / whole) + 0.5).cast("int")).otherwise(
        F.lit(0)
    )


def group_digits_indian(c: Column) -> Column:
    """1234567 as 12,34,567."""
    digits = c.cast("string")
    return F.regexp_replace(digits, r"(?<=\d)(?=(?:\d\d)*\d{3}$)", ",")


def estimate_tokens(c: Column) -> Column:
    """About four characters per token; empty text costs nothing."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.ceil(n / F.lit(4)).cast("int")
