"""Counts and shares for dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxboard.functions.keywords import keyword_scores
from voxboard.functions.numbers import group_digits_indian, is_low_star, percent
from voxboard.functions.text import count_words
from voxboard.model import TOP_K, VOCABULARY, WORD_LIMIT, Vocabulary
from voxboard.operators.joins import join_on

STARS = [1, 2, 3, 4, 5]


def rating_histogram(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Reviews per whole star, missing ratings in a bucket ``null``."""
    stars = F.coalesce(F.col("rating").cast("int").cast("string"), F.lit("null"))
    return df.groupBy(*keys, stars.alias("stars")).agg(F.count("*").alias("n"))


def histogram_array(df: DataFrame, keys: list[str]) -> DataFrame:
    """Five counts, one per star, and the share of each in percent."""
    stars = F.col("rating").cast("int")
    slots = df.groupBy(*keys).agg(
        F.array(*[F.count_if(stars == s) for s in STARS]).alias("rating_histogram")
    )
    total = F.aggregate("rating_histogram", F.lit(0).cast("long"), lambda a, x: a + x)
    whole = F.greatest(total, F.lit(1)).cast("double")
    return slots.withColumn(
        "rating_shares", F.transform("rating_histogram", lambda x: x / whole * 100.0)
    )


def corpus_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Size, date range and distinct sources of each corpus."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("review_count"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    ).withColumn("columns", F.array(*[F.lit(c) for c in sorted(df.columns)]))


def week_ending(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max("date").alias("week_ending"))


def _low_share(low: Column, total: Column) -> Column:
    return percent(low, total)


def kpis(df: DataFrame, keys: list[str]) -> DataFrame:
    """Reviews and low-star share per group, with the display form of the count.

    Only whole one and two stars count as low here, as in the histogram.
    """
    stars = F.col("rating").cast("int")
    agg = df.groupBy(*keys).agg(
        F.count("*").alias("review_count"), F.count_if(stars.isin(1, 2)).alias("low_star_count")
    )
    return agg.select(
        *keys,
        "review_count",
        group_digits_indian(F.col("review_count")).alias("review_count_display"),
        "low_star_count",
        _low_share(F.col("low_star_count"), F.col("review_count")).alias("low_star_share"),
    )


def kpi_strip(reports: DataFrame) -> DataFrame:
    """Length and delivery state of a report, next to its figures."""
    state = F.when(F.col("delivery_skipped"), "Local only").otherwise("Doc appended · Draft ready")
    return reports.select(
        "*",
        F.format_string(f"%d / {WORD_LIMIT}", "word_count").alias("length_display"),
        state.alias("delivery"),
    )


def theme_shares(themes: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the corpus and share of low-star reviews of each theme, in percent."""
    rows = join_on(themes, totals.select(*keys, F.col("review_count").alias("__total")), keys)
    severe = percent(F.col("low_star_count"), F.col("review_count"))
    return rows.select(
        *themes.columns,
        percent(F.col("review_count"), F.col("__total")).alias("share"),
        severe.alias("severity"),
        (F.lit(100) - severe).alias("rest"),
    )


def featured_themes(themes: DataFrame, top: DataFrame, keys: list[str]) -> DataFrame:
    """Top themes in rank order, the others after them without a rank."""
    ranks = top.select(*keys, "theme_id", "rank")
    return join_on(themes, ranks, [*keys, "theme_id"], "left").withColumn(
        "featured", F.col("rank").isNotNull() & (F.col("rank") <= TOP_K)
    )


def length_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """Word lengths and low-star share of each corpus.

    Lengths are counted first, so the median is taken over the distinct lengths
    and their counts and no group is gathered.
    """
    lengths = df.select(*keys, count_words(F.col("text")).alias("__w"), "rating")
    counted = lengths.groupBy(*keys, "__w").agg(
        F.count("*").alias("__n"), F.count_if(is_low_star(F.col("rating"))).alias("__low")
    )
    return counted.groupBy(*keys).agg(
        F.sum("__n").alias("review_count"),
        F.min("__w").alias("min_words"),
        F.percentile("__w", 0.5, F.col("__n")).alias("median_words"),
        (F.sum(F.col("__w") * F.col("__n")) / F.sum("__n")).alias("avg_words"),
        F.max("__w").alias("max_words"),
        percent(F.sum("__low"), F.sum("__n")).alias("low_star_share"),
    )


def keyword_probe(df: DataFrame, keys: list[str], vocab: Vocabulary = VOCABULARY) -> DataFrame:
    """Reviews with any hit per theme, not exclusive, and reviews without any hit."""
    scored = df if "scores" in df.columns else df.withColumn("scores", keyword_scores(F.col("text"), vocab))
    low = is_low_star(F.col("rating"))
    hit = {i: F.col("scores")[i] > 0 for i in vocab.ids}
    none = ~F.array_max(F.array(*[F.col("scores")[i] for i in vocab.ids])).cast("boolean")
    tests = {**hit, "unmatched": none}
    wide = scored.groupBy(*keys).agg(
        *[
            F.struct(
                F.lit(name).alias("theme_id"),
                F.count_if(test).alias("hits"),
                F.count_if(test & low).alias("low_star_hits"),
            ).alias(name)
            for name, test in tests.items()
        ]
    )
    return wide.select(*keys, F.inline(F.array(*tests)))


def eval_score(scores: DataFrame, keys: list[str], compliance: list[str], quality: list[str]) -> DataFrame:
    """All compliance checks passed, and the mean of the quality scores."""
    passed = F.lit(True)
    for name in compliance:
        passed = passed & F.col(name)
    total = sum((F.col(q) for q in quality[1:]), F.col(quality[0]))
    return scores.select(
        *keys, passed.alias("compliance"), (total / F.lit(len(quality))).alias("quality")
    )
