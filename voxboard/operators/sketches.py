"""Counts per day that add up to any range: mergeable sketches beside the exact queries.

A row per group and day holds exact counts and extremes, a quantile sketch of the word
lengths and a distinct-count sketch of the sources. Rows of any days, products or batches
merge, so a summary of a range reads a few rows per day instead of the reviews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxboard.functions.numbers import is_low_star, percent
from voxboard.functions.text import count_words

#: Quantiles lie within this share of the rows of the wanted rank, with 99 % confidence.
RANK_ERROR = 0.0133
#: k of the quantile sketch and lg k of the distinct sketch that go with the stated errors.
QUANTILE_K = 200
DISTINCT_LG_K = 12
#: Distinct counts are within this share (three standard errors of 1.04 / sqrt(4096)).
DISTINCT_ERROR = 0.05


def day_sketches(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group and day out of reviews; sketches combine before rows meet."""
    rows = df.select(
        *keys, "date", "source", "rating", count_words(F.col("text")).cast("long").alias("words")
    )
    return rows.groupBy(*keys, "date").agg(
        F.count("*").alias("review_count"),
        F.count_if(is_low_star(F.col("rating"))).alias("low_star_count"),
        F.sum("words").alias("words"),
        F.min("words").alias("min_words"),
        F.max("words").alias("max_words"),
        F.kll_sketch_agg_bigint("words", F.lit(QUANTILE_K)).alias("word_sketch"),
        F.hll_sketch_agg("source", F.lit(DISTINCT_LG_K)).alias("source_sketch"),
    )


def roll_up(days: DataFrame, keys: list[str]) -> DataFrame:
    """Summary and length profile of each group out of the rows of its days.

    ``median_words`` and ``distinct_sources`` are estimates within RANK_ERROR and
    DISTINCT_ERROR; everything else is exact.
    """
    merged = days.groupBy(*keys).agg(
        F.sum("review_count").alias("review_count"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.min("min_words").alias("min_words"),
        F.max("max_words").alias("max_words"),
        (F.sum("words") / F.sum("review_count")).alias("avg_words"),
        percent(F.sum("low_star_count"), F.sum("review_count")).alias("low_star_share"),
        F.kll_merge_agg_bigint("word_sketch", F.lit(QUANTILE_K)).alias("__words"),
        F.hll_union_agg("source_sketch").alias("__sources"),
    )
    return merged.select(
        "*",
        F.kll_sketch_get_quantile_bigint("__words", F.lit(0.5)).alias("median_words"),
        F.hll_sketch_estimate("__sources").alias("distinct_sources"),
    ).drop("__words", "__sources")
