"""Duplicate removal and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxboard.functions.numbers import rating_sort
from voxboard.operators.joins import join_on, join_small
from voxboard.operators.ranking import first_per, group_rank, order_buckets


def fingerprint(date: Column, rating: Column, text: Column) -> Column:
    """Full SHA-256 over date, rating and text; safe at any number of rows."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (date, rating, text)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def dedupe_reviews(
    df: DataFrame,
    keys: list[str] = ("product_id",),
    order: list[Column] | None = None,
) -> DataFrame:
    """Keep the first copy in file order and give it its content id.

    Copies are cut inside each input task before the shuffle, so a text that
    makes up a third of the corpus reaches its task once per input task.
    """
    order = order or [F.col("src_file"), F.col("src_pos")]
    marked = df.withColumn("__fp", fingerprint(F.col("date"), F.col("rating"), F.col("text")))
    return (
        first_per(marked, [*keys, "date", "__fp"], order)
        .withColumn("id", F.concat(F.lit("play-"), F.substring("__fp", 1, 16)))
        .drop("__fp")
    )


def stratified_sample(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Round robin over the ratings: first of each rating, then second, until n.

    The place of a row in the round robin follows from its rank within its
    rating and the number of rows of each rating, so no second sort is needed.
    """
    if n <= 0:
        return df
    strata = df.groupBy(*keys, "rating").agg(F.count("*").alias("n"))
    sizes = strata.groupBy(*keys).agg(
        F.collect_list(F.struct(rating_sort(F.col("rating")).alias("r"), "n")).alias("__sizes")
    )
    # Null-safe grouping: a missing rating is a stratum of its own, sorted last.
    marked = df.withColumn("__r", rating_sort(F.col("rating")))
    by = [*keys, "__r"]
    buckets = {"__b": order_buckets(df, "id")}
    ranked = group_rank(marked, by, buckets, [F.col("id")], "__rn").drop("group_size")
    ranked = ranked.filter(F.col("__rn") <= n)
    rn, r = F.col("__rn").cast("long"), F.col("__r")
    place = F.aggregate(
        "__sizes",
        F.lit(0).cast("long"),
        lambda acc, s: acc
        + F.least(s["n"], rn - 1)
        + F.when((s["r"] <= r) & (s["n"] >= rn), 1).otherwise(0),
    )
    return (
        join_on(ranked, sizes, keys)
        .withColumn("pick", place)
        .filter(F.col("pick") <= n)
        .drop("__sizes", "__r", "__rn")
    )


def systematic_sample(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Every ``size // n``-th row by (rating, id), first n of them.

    Only ids and ratings are ranked; the chosen rows are then looked up by id,
    which is unique within a group after ``dedupe_reviews``.
    """
    narrow = df.select(*keys, "id", rating_sort(F.col("rating")).alias("__r"))
    ranked = group_rank(
        narrow,
        list(keys),
        {"__b1": F.col("__r"), "__b2": order_buckets(df, "id")},
        [F.col("id")],
        "__rank",
    )
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("group_size") / F.lit(n)))
    place = F.col("__rank") - 1
    chosen = ranked.filter((place % step == 0) & (F.floor(place / step) < n)).select(
        *keys, "id", (F.floor(place / step) + 1).alias("pick")
    )
    return join_small(df, chosen, [*keys, "id"])
