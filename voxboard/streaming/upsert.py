"""Micro-batches into the run ledger, at most once per week and state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxboard.functions.numbers import round_half_even
from voxboard.model import VOCABULARY, Vocabulary
from voxboard.operators.joins import join_on
from voxboard.operators.ledger import latest_runs, undelivered
from voxboard.operators.themes import rank_themes
from voxboard.sources.artifacts import run_ledger, run_rows


def runs_from_counts(counts: DataFrame, vocab: Vocabulary = VOCABULARY) -> DataFrame:
    """Ledger rows out of weekly theme counts: the top themes of each week."""
    keys = ["product_id", "week_key"]
    table = counts.select(
        *keys,
        "week_start",
        "theme_id",
        vocab.label_of(F.col("theme_id")).alias("label"),
        "review_count",
        round_half_even(F.col("rating_sum") / F.nullif(F.col("rated"), F.lit(0)), 3).alias("avg_rating"),
        "low_star_count",
    )
    totals = table.groupBy(*keys).agg(
        F.sum("review_count").alias("review_count"),
        F.date_add(F.max("week_start"), 6).alias("week_ending"),
    )
    top = rank_themes(table, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "theme_id")))["theme_id"].alias("top_3")
    )
    return join_on(totals, top, keys)


def ledger_upsert(
    path: str, keys: list[str] = ("product_id", "week_key"), writer: str = "stream"
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that skips delivered weeks and rows already there.

    Each batch is committed to the ledger as a whole and once: one that is replayed
    adds nothing, and of one that fails half-way nothing is seen.
    """
    keys = list(keys)
    same = [*keys, "review_count", "top_3"]

    def write(batch: DataFrame, batch_id: int) -> None:
        ledger = run_ledger(batch.sparkSession, path)
        runs = runs_from_counts(batch)
        latest = latest_runs(ledger.read(), keys)
        fresh = undelivered(runs, latest, keys)
        known = latest.select(*same)
        new = join_on(fresh, known, same, "left_anti").withColumn("finished_at", F.current_timestamp())
        ledger.commit(run_rows(new), writer, batch_id)

    return write
