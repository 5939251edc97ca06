"""Raw exports to the cleaned corpus, with the funnel of rejected rows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxboard.functions.privacy import redact_pii
from voxboard.model import MAX_WEEKS, MIN_WEEKS, MIN_WORDS, SPARSE_THRESHOLD
from voxboard.operators.barrier import compute_once
from voxboard.operators.intake import BAD_DATE, EMPTY_TEXT, WRONG_PACKAGE, classify_rows
from voxboard.operators.joins import join_on
from voxboard.operators.quality import filter_quality, quality_reason
from voxboard.operators.sampling import dedupe_reviews
from voxboard.operators.scrub import scrub
from voxboard.operators.windows import adaptive_window, as_date, filter_window, resolve_window
from voxboard.plans.staging import Stage, shared


@dataclass
class Intake:
    reviews: DataFrame
    classified: DataFrame
    parsed: DataFrame


def clean_reviews(
    parsed: DataFrame,
    as_of: str | dt.date | Column,
    weeks: int = MIN_WEEKS,
    keys: list[str] = ("product_id",),
    detector: Column | None = None,
    min_rows: int = SPARSE_THRESHOLD,
) -> DataFrame:
    """Window, scrub and quality filter over deduplicated reviews."""
    windowed = adaptive_window(parsed, weeks, as_of, list(keys), min_rows)
    return filter_quality(scrub(windowed), detector)


def ingest(
    raw: DataFrame,
    as_of: str | dt.date,
    product_id: str | None = None,
    weeks: int = MIN_WEEKS,
    detector: Column | None = None,
    stage: Stage | None = None,
) -> Intake:
    """Normalise, dedupe, window, scrub and filter.

    Reviews are shuffled once, to drop copies, and staged, since the width of
    the window depends on what is left, and the funnel counts the same rows.
    """
    stage = stage or shared(raw.sparkSession)
    classified = classify_rows(raw, product_id)
    usable = classified.filter(F.col("reason").isNull()).drop("reason")
    parsed = stage(dedupe_reviews(usable), "parsed")
    reviews = clean_reviews(parsed, as_of, weeks, detector=detector)
    return Intake(reviews.drop("src_file", "src_pos"), classified, parsed)


def ingest_stats(
    classified: DataFrame,
    parsed: DataFrame,
    as_of: str | dt.date | Column,
    weeks: int = MIN_WEEKS,
    keys: list[str] = ("product_id",),
    detector: Column | None = None,
    min_rows: int = SPARSE_THRESHOLD,
) -> DataFrame:
    """The funnel of each corpus: rows read, kept at each step, dropped and why."""
    keys = list(keys)
    reasons = classified.groupBy(*keys).agg(
        F.count("*").alias("raw_rows"),
        F.count_if(F.col("reason") == WRONG_PACKAGE).alias("dropped_wrong_package"),
        F.count_if(F.col("reason") == EMPTY_TEXT).alias("dropped_empty_text"),
        F.count_if(F.col("reason") == BAD_DATE).alias("dropped_bad_date"),
    )
    counted = parsed.groupBy(*keys).agg(F.count("*").alias("parsed"))
    recent = filter_window(parsed, MAX_WEEKS, as_of)
    choice = resolve_window(recent, weeks, as_of, keys, min_rows)
    inside = adaptive_window(recent, weeks, as_of, keys, min_rows, choice=choice)
    scrubbed = compute_once(inside, {"text": redact_pii(F.col("text"))})
    # One pass over the text gives the step at which each review leaves.
    why = F.when(F.col("text").isNotNull(), quality_reason(F.col("text"), detector, MIN_WORDS))
    steps = compute_once(scrubbed, {"why": why}).withColumn("has_text", F.col("text").isNotNull())
    left = steps.groupBy(*keys).agg(
        F.count_if("has_text").alias("after_scrub"),
        F.count_if(F.col("why") == "short_text").alias("dropped_short_text"),
        F.count_if(F.col("why") == "non_english").alias("dropped_non_english"),
        F.count_if(F.col("has_text") & F.col("why").isNull()).alias("after_quality"),
    )
    joined = (
        join_on(join_on(join_on(reasons, counted, keys, "left"), choice, keys, "left"), left, keys, "left")
    )
    zero = F.lit(0).cast("long")
    counts = [
        "raw_rows",
        "dropped_wrong_package",
        "dropped_empty_text",
        "dropped_bad_date",
        "parsed",
        "in_window",
        "after_scrub",
        "dropped_short_text",
        "dropped_non_english",
        "after_quality",
    ]
    return joined.select(
        *keys,
        *[F.coalesce(c, zero).alias(c) for c in counts],
        F.coalesce("weeks_used", F.lit(MAX_WEEKS)).alias("weeks_used"),
        F.coalesce("window_start", F.date_sub(as_date(as_of), MAX_WEEKS * 7)).alias("window_start"),
    )
