"""Language of texts by ranked letter trigrams, learned from labelled texts.

A profile is the ranked list of a language's most frequent trigrams of letters, words
padded with blanks. A text speaks for a language by the ranks of its trigrams in that
profile: the higher the rank, the more. Trigrams are exploded and joined with the few
hundred rows of the profiles, and added up per text in the task that made them, so texts
are not shuffled; one narrow row per text and language is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE_SIZE = 400
#: Shares of the points that the best language must have, else a text has no language.
MIN_SHARE = 0.3


def trigrams(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per trigram of the lower-case letters of ``text``, one blank around each word.

    A text is cut into letters once and laid beside itself, shifted by one and by two.
    """
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+", " ")
    padded = F.concat(F.lit(" "), F.btrim(letters), F.lit(" "))
    chars = df.select(*keep, F.inline(F.array(F.struct(F.split(padded, "").alias("c")))))
    from_second = F.slice("c", 2, F.size("c"))
    from_third = F.slice("c", 3, F.size("c"))
    zipped = F.arrays_zip(F.col("c").alias("a"), from_second.alias("b"), from_third.alias("d"))
    grams = chars.filter(F.size("c") > 2).select(*keep, F.inline(zipped)).filter("d <> ''")
    return grams.select(*keep, F.concat("a", "b", "d").alias("gram"))


def fit_profiles(labelled: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """(gram, lang, points): the ``size`` most frequent trigrams of each ``lang``.

    The first has ``size`` points, the last one point; ties go by the trigram. All labelled
    texts count. Counts are added up in the tasks first, so a language that holds most
    texts is as many rows per task as it has trigrams.
    """
    counts = trigrams(labelled.filter("lang is not null"), ["lang"]).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size)
    return ranked.select("gram", "lang", (F.lit(size + 1) - F.col("rank")).cast("long").alias("points"))


def detect_language(
    df: DataFrame, profiles: DataFrame, key: str, min_share: float = MIN_SHARE
) -> DataFrame:
    """(``key``, lang_pred, share): the language with the most points of each text.

    ``key`` names a row. Equal points go to the language that comes first. Without a
    trigram of any profile, or with less than ``min_share`` of all points for the best
    language, ``lang_pred`` is null; null and empty texts are among them.
    """
    grams = trigrams(df, [key]).join(F.broadcast(profiles), "gram")
    points = grams.groupBy(key, "lang").agg(F.sum("points").alias("points"))
    best = points.groupBy(key).agg(
        F.min(F.struct((-F.col("points")).alias("less"), "lang")).alias("b"),
        F.sum("points").alias("total"),
    )
    found = best.select(F.col(key).alias("__key"), F.col("b.lang").alias("lang"), (-F.col("b.less") / F.col("total")).alias("share"))
    joined = df.select(key).join(found, F.col(key) == F.col("__key"), "left")
    return joined.select(
        key,
        F.when(F.col("share") >= min_share, F.col("lang")).alias("lang_pred"),
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )
