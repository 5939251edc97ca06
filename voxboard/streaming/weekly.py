"""Weekly theme counts over a stream of labelled reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxboard.functions.dates import iso_week_key
from voxboard.functions.numbers import is_low_star
from voxboard.streaming.intake import LATENESS

# The epoch was a Thursday; four days on, weeks start on Monday.
ISO_WEEK = ("7 days", "7 days", "4 days")


def weekly_theme_counts(
    labelled: DataFrame, keys: list[str] = ("product_id",), delay: str | None = LATENESS
) -> DataFrame:
    """Reviews, rating sum and low-star reviews per ISO week and theme.

    Works on a batch DataFrame as well. Late rows fall behind the watermark and
    leave the counts as they were.
    """
    rows = labelled.withWatermark("ts", delay) if labelled.isStreaming and delay else labelled
    counted = rows.groupBy(*keys, F.window("ts", *ISO_WEEK).alias("week"), "theme_id").agg(
        F.count("*").alias("review_count"),
        F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("rated"),
        F.count_if(is_low_star(F.col("rating"))).alias("low_star_count"),
    )
    start = F.col("week.start").cast("date")
    return counted.select(
        *keys,
        iso_week_key(start).alias("week_key"),
        start.alias("week_start"),
        "theme_id",
        "review_count",
        "rating_sum",
        "rated",
        "low_star_count",
    )
