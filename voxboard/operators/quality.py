"""Length and language of review texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxboard.functions.text import count_words, strip_ws, whole_words
from voxboard.model import MIN_WORDS

# Scripts that rule out English, and the share of other letters allowed.
NON_LATIN_SCRIPT = (
    r"[\u0900-\u097F\u0980-\u09FF\u0A00-\u0A7F\u0A80-\u0AFF\u0B00-\u0B7F\u0B80-\u0BFF"
    r"\u0C00-\u0C7F\u0C80-\u0CFF\u0D00-\u0D7F\u0600-\u06FF\u4E00-\u9FFF\u3040-\u30FF\uAC00-\uD7AF]"
)
MAX_OTHER_LETTERS = 0.15

# Function words for the built-in language vote.
STOP_WORDS = {
    "en": "the|and|is|to|of|it|in|for|this|that|not|with|my|on|was|are|you|have|but|very|they|your",
    "de": "der|die|das|und|ist|nicht|ein|eine|mit|auf|ich|sie|es|zu|für|von|den|dem|sehr",
    "es": "el|la|los|las|que|de|y|es|una|un|por|con|para|no|muy|se|del|lo|como",
    "fr": "le|la|les|et|est|une|un|des|pour|pas|que|dans|avec|je|vous|il|du|très|ce",
}


def min_words(df: DataFrame, n: int = MIN_WORDS) -> DataFrame:
    return df.filter(count_words(F.col("text")) >= n)


def is_latin_text(c: Column) -> Column:
    """No foreign script, some Latin letters, few others; no Latin letter divides by zero."""
    body = strip_ws(c)
    letters = F.length(F.regexp_replace(body, r"[^\p{L}]+", ""))
    latin = letters - F.length(F.regexp_replace(body, r"[\P{L}A-Za-z]+", ""))
    others = F.length(F.regexp_replace(body, r"[[^\p{L}\p{Nl}\p{No}]A-Za-z]+", ""))
    return F.coalesce(
        ~body.rlike(NON_LATIN_SCRIPT) & (F.try_divide(others, latin) <= MAX_OTHER_LETTERS),
        F.lit(False),
    )


def english_vote(c: Column) -> Column:
    """More English function words than of any other language listed."""
    hits = {k: F.regexp_count(c, F.lit(whole_words(v))) for k, v in STOP_WORDS.items()}
    rest = F.greatest(*[v for k, v in hits.items() if k != "en"])
    return (hits["en"] > 0) & (hits["en"] >= rest)


def is_english(c: Column, detector: Column | None = None) -> Column:
    """Script test, then a language detector on what is left.

    ``detector`` is any boolean column: a language tag compared with ``en``, what
    ``language.detect_language`` finds by profiles learned from labelled texts, or a
    pandas UDF around a detector library. Without one, and so without anything learned,
    the function-word vote stands in.
    """
    vote = english_vote(c) if detector is None else detector
    return F.when(is_latin_text(c), F.coalesce(vote, F.lit(False))).otherwise(F.lit(False))


def quality_reason(text: Column, detector: Column | None = None, n: int = MIN_WORDS) -> Column:
    """Why a text fails the quality filter; null if it passes."""
    return F.when(count_words(text) < n, "short_text").when(
        ~is_english(text, detector), "non_english"
    )


def filter_quality(
    df: DataFrame, detector: Column | None = None, n: int = MIN_WORDS
) -> DataFrame:
    """Long enough English reviews, marked as such.

    The cheap length test is a filter of its own, so the language test sees
    survivors only.
    """
    kept = min_words(df, n).filter(is_english(F.col("text"), detector))
    return kept.withColumn("language", F.lit("en"))
