"""Date windows: fixed, adaptive, and how the adaptive one was settled."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxboard.functions.dates import clamp_weeks
from voxboard.model import MAX_WEEKS, SPARSE_THRESHOLD
from voxboard.operators.joins import join_small


def as_date(value: str | dt.date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def filter_window(df: DataFrame, weeks: int, as_of: str | dt.date | Column) -> DataFrame:
    """Rows of the last ``weeks`` (8 to 12) up to ``as_of``; a plain date range."""
    end = as_date(as_of)
    return df.filter(F.col("date").between(F.date_sub(end, 7 * clamp_weeks(weeks)), end))


def resolve_window(
    df: DataFrame,
    preferred_weeks: int,
    as_of: str | dt.date | Column,
    keys: list[str],
    min_rows: int = SPARSE_THRESHOLD,
    count: str | None = None,
) -> DataFrame:
    """One row per group: the narrowest window with enough rows, and its flags.

    Counts only grow with the width, so counting all widths in one pass gives
    what widening week by week would. A row counts once, or as often as its
    column ``count`` says, so that counts per day serve as well as reviews.
    """
    end = as_date(as_of)
    preferred = clamp_weeks(preferred_weeks)
    widths = list(range(preferred, MAX_WEEKS + 1))
    inside = F.col("date") <= end
    counts = df.groupBy(*keys).agg(
        *[
            (F.count_if(near) if count is None else F.coalesce(F.sum(F.when(near, F.col(count))), F.lit(0))).alias(f"__w{w}")
            for w, near in [(w, inside & (F.col("date") >= F.date_sub(end, 7 * w))) for w in widths]
        ]
    )
    used = n = None
    for w in widths:
        enough = F.col(f"__w{w}") >= min_rows
        used = F.when(enough, w) if used is None else used.when(enough, w)
        n = F.when(enough, F.col(f"__w{w}")) if n is None else n.when(enough, F.col(f"__w{w}"))
    return counts.select(
        *keys,
        used.otherwise(MAX_WEEKS).alias("weeks_used"),
        n.otherwise(F.col(f"__w{MAX_WEEKS}")).alias("in_window"),
    ).select(
        *keys,
        "weeks_used",
        "in_window",
        F.date_sub(end, F.col("weeks_used") * 7).alias("window_start"),
        end.alias("as_of"),
        (F.col("weeks_used") > preferred).alias("window_widened"),
        (F.col("in_window") < min_rows).alias("insufficient_signal"),
    )


def adaptive_window(
    df: DataFrame,
    preferred_weeks: int,
    as_of: str | dt.date | Column,
    keys: list[str],
    min_rows: int = SPARSE_THRESHOLD,
    with_flags: bool = False,
    choice: DataFrame | None = None,
) -> DataFrame:
    """Rows inside the window settled for their group.

    ``choice`` is the result of ``resolve_window`` where it is at hand already.
    """
    widest = filter_window(df, MAX_WEEKS, as_of)
    if choice is None:
        choice = resolve_window(widest, preferred_weeks, as_of, keys, min_rows)
    rows = join_small(widest, choice, keys).filter(F.col("date") >= F.col("window_start"))
    flags = [
        "weeks_used",
        "in_window",
        "window_start",
        "as_of",
        "window_widened",
        "insufficient_signal",
    ]
    return rows if with_flags else rows.drop(*flags)
