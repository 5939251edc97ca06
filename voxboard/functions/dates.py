"""Dates: raw export forms, ISO weeks, display forms and window arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxboard.functions.text import bind, strip_ws
from voxboard.model import MAX_WEEKS, MIN_WEEKS

_CLOCK = (
    r"(?:[01]\d|2[0-3])"
    r"(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?|[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)?"
)
_OFFSET = r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?)?"
_TIME = rf"(?:(?s:.){_CLOCK}{_OFFSET})?"
_ISO_EXTENDED = rf"^(\d{{4}})-(\d{{2}})-(\d{{2}}){_TIME}$"
_ISO_BASIC = rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_TIME}$"
_ISO_WEEK = rf"^(\d{{4}})(-?)W(\d{{2}})(?:\2([1-7]))?{_TIME}$"
_DAY = r"(0?[1-9]|[12]\d|3[01])"
_MONTH = r"(0?[1-9]|1[0-2])"
_LOOSE_CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]?\d:(?:[0-5]?\d|6[01])"

MIN_EPOCH = -62135596800.0
MAX_EPOCH = 253402300800.0


def _by_iso_week(text: Column) -> Column:
    """Date of ``2026-W37`` or ``2026-W37-2``; null for weeks a year does not have."""

    def monday_of(t: Column) -> Column:
        year = F.regexp_extract(t, _ISO_WEEK, 1)
        first = F.trunc(F.try_to_date(F.concat(year, F.lit("-01-04")), "yyyy-MM-dd"), "week")
        week = F.regexp_extract(t, _ISO_WEEK, 3).cast("int")
        day = F.coalesce(F.regexp_extract(t, _ISO_WEEK, 4).try_cast("int"), F.lit(1))
        return F.struct(
            F.date_add(first, (week - 1) * 7).alias("monday"),
            week.alias("week"),
            day.alias("day"),
            year.cast("int").alias("year"),
        )

    def settle(w: Column) -> Column:
        in_year = (w["week"] >= 1) & (F.extract(F.lit("YEAROFWEEK"), w["monday"]) == w["year"])
        return F.when(in_year, F.date_add(w["monday"], w["day"] - 1))

    return bind(text, lambda t: F.when(t.rlike(_ISO_WEEK), bind(monday_of(t), settle)))


# Each accepted form and the year-month-day text it is rewritten to. The loose
# forms look at the first 19 characters only.
_EXACT_FORMS = [(_ISO_EXTENDED, "$1-$2-$3"), (_ISO_BASIC, "$1-$2-$3")]
_LOOSE_FORMS = [
    (rf"^(\d{{4}})-{_MONTH}-{_DAY}(?:T|\s+){_LOOSE_CLOCK}$", "$1-$2-$3"),
    (rf"^(\d{{4}})/{_MONTH}/{_DAY}$", "$1-$2-$3"),
    (rf"^{_DAY}-{_MONTH}-(\d{{4}})$", "$3-$2-$1"),
    (rf"^{_MONTH}/{_DAY}/(\d{{4}})$", "$3-$1-$2"),
]


def parse_date_text(c: Column) -> Column:
    """The written local date of a date string; an offset never shifts the day.

    The forms rewrite the text one after the other, so each is tried once and
    a text that fits none of them is no date.
    """
    text = strip_ws(c)
    plain = text
    for pattern, form in _EXACT_FORMS:
        plain = F.regexp_replace(plain, pattern, form)
    plain = F.substring(plain, 1, 19)
    for pattern, form in _LOOSE_FORMS:
        plain = F.regexp_replace(plain, pattern, form)
    return F.coalesce(F.try_to_date(plain, "yyyy-M-d"), _by_iso_week(text))


def parse_date_number(c: Column) -> Column:
    """UTC date of epoch seconds, or of milliseconds above 1e12."""
    seconds = c.cast("double")
    seconds = F.when(seconds > 1e12, seconds / 1000.0).otherwise(seconds)
    valid = (seconds >= MIN_EPOCH) & (seconds < MAX_EPOCH)
    days = F.floor(F.when(valid, seconds) / F.lit(86400.0)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def parse_review_date(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    if isinstance(dtype, T.NumericType):
        return parse_date_number(c)
    return parse_date_text(c.cast("string"))


def iso_week_key(c: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), c), F.weekofyear(c))


def clamp_weeks(weeks: int) -> int:
    return max(MIN_WEEKS, min(MAX_WEEKS, weeks))


def clamp_weeks_col(weeks: Column) -> Column:
    return F.greatest(F.lit(MIN_WEEKS), F.least(F.lit(MAX_WEEKS), weeks))


def display_date(c: Column) -> Column:
    """``2026-09-08`` as ``8 Sep 2026``; anything that is no date stays as it is."""
    return F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "d MMM yyyy"), c)


def report_title(
    product: Column, week_key: Column, week_ending: Column, name: str = "Weekly Review"
) -> Column:
    return F.format_string(
        f"%s {name} - %s (week ending %s)", product, week_key, week_ending.cast("string")
    )
