"""Theme labels, theme aggregates and the severity ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxboard.functions.keywords import (
    confident_from_scores,
    heuristic_from_scores,
    hint_from_scores,
    keyword_scores,
)
from voxboard.functions.numbers import estimate_tokens, is_low_star, rating_sort, round_half_even
from voxboard.model import (
    LABEL_BATCH,
    MAX_LABEL_QUEUE,
    NULL_RATING_RANK,
    REVIEW_TEXT_CHARS,
    SAMPLE_LIMIT,
    TOP_K,
    VOCABULARY,
    Vocabulary,
)
from voxboard.operators.barrier import compute_once
from voxboard.operators.joins import join_on, join_small
from voxboard.operators.ranking import top_ranked

OUTPUT_RESERVE = 400


def score_reviews(df: DataFrame, vocab: Vocabulary = VOCABULARY) -> DataFrame:
    """Add ``scores``, the keyword hits per theme; every later step reads these."""
    return compute_once(df, {"scores": keyword_scores(F.col("text"), vocab)})


def label_heuristic(df: DataFrame, vocab: Vocabulary = VOCABULARY) -> DataFrame:
    scored = df if "scores" in df.columns else score_reviews(df, vocab)
    return scored.withColumn("theme_id", heuristic_from_scores(F.col("scores"), vocab))


def fold_unknown(df: DataFrame, vocab: Vocabulary = VOCABULARY, column: str = "theme_id") -> DataFrame:
    """Theme ids outside the vocabulary, or none at all, become the default."""
    known = vocab.contains(F.col(column))
    return df.withColumn(column, F.when(known, F.col(column)).otherwise(F.lit(vocab.default)))


def attach_assignments(
    reviews: DataFrame, assignments: DataFrame, keys: list[str] = (), vocab: Vocabulary = VOCABULARY
) -> DataFrame:
    """Reviews with the theme assigned to their id; the default where there is none."""
    return fold_unknown(join_on(reviews, assignments, [*keys, "id"], "left"), vocab)


def label_payload(df: DataFrame) -> DataFrame:
    """What an outside labeller gets to see of a review, as one JSON object."""
    hint = F.col("hint") if "hint" in df.columns else F.lit(None).cast("string")
    item = ["id", "rating", F.substring("text", 1, REVIEW_TEXT_CHARS).alias("text")]
    keep_nulls = {"ignoreNullFields": "false"}
    # A missing rating is written out, a missing hint is not.
    with_hint = F.to_json(F.struct(*item, hint.alias("hint")), keep_nulls)
    payload = F.when(hint.isNull(), F.to_json(F.struct(*item), keep_nulls)).otherwise(with_hint)
    return df.withColumn("payload", payload)


def split_label_queue(
    df: DataFrame,
    keys: list[str],
    max_n: int = MAX_LABEL_QUEUE,
    min_score: int = 1,
    vocab: Vocabulary = VOCABULARY,
    batch_size: int = LABEL_BATCH,
) -> DataFrame:
    """Route every review: ``confident``, ``queue`` or ``heuristic``.

    Of the reviews without a single clear winner the ``max_n`` worst rated of
    each group are queued for an outside labeller, in batches. Only the queue
    itself is ranked; the other rows never leave their partition order.
    """
    scored = df if "scores" in df.columns else score_reviews(df, vocab)
    routed = scored.withColumn(
        "confident", confident_from_scores(F.col("scores"), min_score, vocab)
    ).withColumn("hint", hint_from_scores(F.col("scores"), vocab))
    unsure = routed.filter(F.col("confident").isNull()).select(*keys, "id", "rating")
    order = [rating_sort(F.col("rating")), F.col("id")]
    if max_n > 0:
        queue = top_ranked(unsure, keys, order, max_n, "queue_rank").select(
            *keys, "id", "queue_rank"
        )
        routed = join_small(routed, queue, [*keys, "id"], "left")
    else:
        routed = routed.withColumn("queue_rank", F.lit(None).cast("int"))
    route = (
        F.when(F.col("confident").isNotNull(), "confident")
        .when(F.col("queue_rank").isNotNull(), "queue")
        .otherwise("heuristic")
    )
    theme = F.coalesce("confident", F.when(route == "heuristic", heuristic_from_scores(F.col("scores"), vocab)))
    return routed.select(
        "*",
        route.alias("route"),
        theme.alias("theme_id"),
        assign_batch(F.col("queue_rank"), batch_size).alias("batch"),
    )


def assign_batch(rank: Column, size: int = LABEL_BATCH) -> Column:
    return F.floor((rank - 1) / size).cast("int")


def merge_labels(
    routed: DataFrame, labels: DataFrame, keys: list[str] = (), vocab: Vocabulary = VOCABULARY
) -> DataFrame:
    """Labels from outside for the queue: label, else hint, else the default.

    A label outside the vocabulary counts as none. ``labels`` holds one
    ``theme_id`` per id; rows that were not queued keep the theme they have.
    """
    given = labels.select(*keys, "id", F.col("theme_id").alias("__given"))
    joined = join_on(routed, given, [*keys, "id"], "left")
    outside = F.when(vocab.contains(F.col("__given")), F.col("__given"))
    theme = F.when(
        F.col("route") == "queue", F.coalesce(outside, F.col("hint"), F.lit(vocab.default))
    ).otherwise(F.col("theme_id"))
    return joined.withColumn("theme_id", theme).drop("__given")


def batch_payloads(queue: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON list per batch of the queue, at most a batch size of reviews each."""
    rows = label_payload(queue.filter(F.col("route") == "queue"))
    batches = rows.groupBy(*keys, "batch").agg(
        F.array_sort(F.collect_list(F.struct("queue_rank", "payload"))).alias("items")
    )
    return batches.select(
        *keys,
        "batch",
        F.size("items").alias("n"),
        F.concat(F.lit("["), F.array_join("items.payload", ", "), F.lit("]")).alias("payload"),
    )


def batch_tokens(batches: DataFrame, system_prompt: str = "", human_prefix: str = "") -> DataFrame:
    """Estimated tokens of one request per batch."""
    human = F.concat(F.lit(human_prefix), F.col("payload"))
    tokens = estimate_tokens(F.lit(system_prompt)) + estimate_tokens(human) + F.lit(OUTPUT_RESERVE)
    return batches.withColumn("tokens", tokens)


def theme_counts(df: DataFrame, keys: list[str], vocab: Vocabulary = VOCABULARY) -> DataFrame:
    """Reviews, average rating and low-star reviews per theme that occurs."""
    agg = df.groupBy(*keys, "theme_id").agg(
        F.count("*").alias("review_count"),
        F.avg("rating").alias("__avg"),
        F.count_if(is_low_star(F.col("rating"))).alias("low_star_count"),
    )
    return agg.select(
        *keys,
        "theme_id",
        vocab.label_of(F.col("theme_id")).alias("label"),
        "review_count",
        round_half_even(F.col("__avg"), 3).alias("avg_rating"),
        "low_star_count",
        F.format_string("%d reviews; %d rated ≤2★", "review_count", "low_star_count").alias(
            "summary"
        ),
    )


def sample_ids(df: DataFrame, keys: list[str], n: int = SAMPLE_LIMIT) -> DataFrame:
    """First ids per theme, worst rated first."""
    order = [rating_sort(F.col("rating")), F.col("id")]
    picked = top_ranked(df.select(*keys, "theme_id", "id", "rating"), [*keys, "theme_id"], order, n)
    rows = F.array_sort(F.collect_list(F.struct("rn", "id")))
    return picked.groupBy(*keys, "theme_id").agg(rows.alias("__s")).select(
        *keys, "theme_id", F.col("__s.id").alias("sample_ids")
    )


def aggregate_themes(
    df: DataFrame, keys: list[str], n_samples: int = SAMPLE_LIMIT, vocab: Vocabulary = VOCABULARY
) -> DataFrame:
    """The theme table of each group: counts, average, summary and sample ids."""
    folded = fold_unknown(df, vocab)
    counts, samples = theme_counts(folded, keys, vocab), sample_ids(folded, keys, n_samples)
    return join_on(counts, samples, [*keys, "theme_id"])


def severity(df: DataFrame, keys: list[str], vocab: Vocabulary = VOCABULARY) -> DataFrame:
    """Low-star reviews of all themes of the vocabulary, zeros kept."""
    low = [
        F.count_if((F.col("theme_id") == i) & is_low_star(F.col("rating"))).alias(i)
        for i in vocab.ids
    ]
    wide = fold_unknown(df, vocab).groupBy(*keys).agg(*low)
    return wide.unpivot(list(keys), vocab.ids, "theme_id", "low_star_count")


def severity_order() -> list[Column]:
    return [
        F.col("low_star_count").desc(),
        F.col("review_count").desc(),
        F.coalesce(F.col("avg_rating"), F.lit(NULL_RATING_RANK)).asc(),
        F.col("theme_id").asc(),
    ]


def rank_themes(themes: DataFrame, keys: list[str], k: int = TOP_K) -> DataFrame:
    """Top themes by low-star reviews, then volume, then worse average, then id."""
    return top_ranked(themes, keys, severity_order(), k, "rank")


def display_ranks(themes: DataFrame, keys: list[str], k: int = TOP_K) -> DataFrame:
    """All themes; a rank for the top ones, null for those merely clustered."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*severity_order()))
    return themes.withColumn("__r", rank).select(
        *themes.columns, F.when(F.col("__r") <= k, F.col("__r")).alias("rank")
    )


def themes_report(
    themes: DataFrame,
    top: DataFrame,
    low: DataFrame,
    runs: DataFrame,
    keys: list[str],
    mode: str = "heuristic",
    vocab: Vocabulary = VOCABULARY,
) -> DataFrame:
    """The theme artifact: one nested row per group."""
    position = F.array_position(F.array(*[F.lit(i) for i in vocab.ids]), F.col("theme_id"))
    rows = themes.groupBy(*keys).agg(
        F.sum("review_count").alias("labeled_reviews"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    position.alias("ordinal"),
                    F.col("theme_id").alias("id"),
                    "label",
                    "review_count",
                    "avg_rating",
                    "summary",
                    "sample_ids",
                )
            )
        ).alias("themes"),
    )
    tops = top.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "theme_id"))), lambda x: x["theme_id"]
        ).alias("top_3")
    )
    lows = low.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("theme_id", "low_star_count")))).alias(
            "severity"
        )
    )
    vocabulary = F.map_from_entries(
        F.transform(vocab.as_array(), lambda t: F.struct(t["theme_id"], t["label"]))
    )
    for part in (tops, lows, runs):
        rows = join_on(rows, part, keys, "left")
    return rows.withColumn("mode", F.lit(mode)).withColumn("vocabulary", vocabulary)
