"""The weekly report of every product in one plan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxboard.functions.dates import iso_week_key
from voxboard.model import (
    MAX_LABEL_QUEUE,
    MAX_PER_THEME,
    MAX_WEEKS,
    MIN_WEEKS,
    SAMPLE_LIMIT,
    SPARSE_THRESHOLD,
    VOCABULARY,
    Vocabulary,
)
from voxboard.operators import evidence, gates, report, themes
from voxboard.operators.joins import join_on, join_small
from voxboard.operators.sampling import stratified_sample
from voxboard.operators.scrub import scrub
from voxboard.operators.windows import adaptive_window, filter_window, resolve_window
from voxboard.plans.staging import Stage, shared


@dataclass
class Weekly:
    labelled: DataFrame
    themes: DataFrame
    top: DataFrame
    quotes: DataFrame
    actions: DataFrame
    reports: DataFrame
    gates: DataFrame

    def results(self, keys: list[str]) -> DataFrame:
        """Reports with the outcome of their gates."""
        outcome = gates.gate_report(self.gates, keys, self.reports)
        checked = outcome.select(*keys, F.col("ok").alias("validation_ok"), "n_failed", "errors", "warnings")
        return join_on(self.reports, checked, keys, "left")

    def run_rows(self, keys: list[str], finished_at: Column) -> DataFrame:
        """Rows for the run ledger."""
        rows = self.results(keys)
        return rows.withColumn("finished_at", finished_at)


def weekly_reports(
    reviews: DataFrame,
    as_of: str | dt.date,
    preferred_weeks: int = MIN_WEEKS,
    keys: list[str] = ("product_id",),
    vocab: Vocabulary = VOCABULARY,
    labels: DataFrame | None = None,
    limit: int | None = None,
    min_rows: int = SPARSE_THRESHOLD,
    report_name: str = report.REPORT_NAME,
    stage: Stage | None = None,
    loose_space: bool = False,
    extra: list[Column] = (),
    label_queue: int = MAX_LABEL_QUEUE,
    candidates_per_theme: int = MAX_PER_THEME,
    sample_ids: int = SAMPLE_LIMIT,
) -> Weekly:
    """Window, scrub, label, rank, quote, compose and check.

    ``labels`` are themes from an outside labeller for queued reviews; without
    them every review gets its keyword theme. The labelled reviews, with their
    scores, are the one large table that several steps read. It is staged, as are
    the small tables per group that follow, by default in the shared folder.

    ``loose_space`` and ``extra`` go to the gates. The bounds of the specification
    are parameters: reviews queued for a labeller per group, quote candidates per
    theme, and sample ids per theme.
    """
    keys = list(keys)
    stage = stage or shared(reviews.sparkSession)
    choice = stage(
        resolve_window(filter_window(reviews, MAX_WEEKS, as_of), preferred_weeks, as_of, keys, min_rows),
        "windows",
    )
    rows = adaptive_window(reviews, preferred_weeks, as_of, keys, min_rows, choice=choice)
    if limit:
        rows = stratified_sample(rows, limit, keys).drop("pick")
    scored = themes.score_reviews(scrub(rows), vocab)
    if labels is None:
        labelled = themes.label_heuristic(scored, vocab)
    else:
        # The queue is settled before it is joined; both read the scores.
        scored = stage(scored, "scored")
        routed = themes.split_label_queue(scored, keys, label_queue, vocab=vocab)
        labelled = themes.merge_labels(routed, labels, keys, vocab).select(*scored.columns, "theme_id")
    labelled = stage(themes.fold_unknown(labelled, vocab), "labelled")

    groups = labelled.groupBy(*keys).agg(
        F.max("date").alias("week_ending"), F.count("*").alias("review_count")
    )
    flags = choice.select(*keys, "weeks_used", "window_widened", "insufficient_signal")
    groups = join_on(groups, flags, keys).withColumn("week_key", iso_week_key(F.col("week_ending")))
    groups = stage(groups, "groups")
    theme_table = stage(themes.aggregate_themes(labelled, keys, sample_ids, vocab), "themes")
    top = themes.rank_themes(theme_table, keys)
    candidates = evidence.quote_candidates(labelled, top, keys, candidates_per_theme)
    picked = stage(evidence.select_quotes(candidates, keys, vocab=vocab), "picked")
    quotes = evidence.pad_quotes(picked, labelled, groups, keys)
    padded = report.pad_themes(top, groups, keys, vocab=vocab)
    actions = report.pad_actions(report.default_actions(top, keys, vocab), top, groups, keys, vocab=vocab)
    reports = stage(
        report.assemble(groups, padded, quotes, actions, keys, report_name=report_name), "reports"
    )
    checks = gates.evaluate_gates(
        labelled, theme_table, reports, keys, vocab=vocab, extra=extra, loose_space=loose_space
    )
    return Weekly(labelled, theme_table, top, quotes, actions, reports, checks)


def report_payload(weekly: Weekly, keys: list[str], history: DataFrame | None = None) -> DataFrame:
    """One nested row per report for a viewer."""
    from voxboard.operators.metrics import histogram_array

    outcome = gates.gate_report(weekly.gates, keys)
    theme_rows = weekly.themes.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(
                F.struct("theme_id", "label", "review_count", "avg_rating", "low_star_count")
            )
        ).alias("theme_rows")
    )
    shown = weekly.themes.select(*keys, "theme_id", F.explode("sample_ids").alias("id"))
    texts = weekly.labelled.select(*keys, "id", "theme_id", "rating", "date", "text")
    snippets = join_small(texts, shown, [*keys, "theme_id", "id"])
    snippet_rows = snippets.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("theme_id", "rating", "id", "date", "text"))).alias("snippets")
    )
    out = weekly.reports
    passed = outcome.select(*keys, F.col("ok").alias("validation_ok"), "gates")
    for part in (histogram_array(weekly.labelled, keys), theme_rows, snippet_rows, passed):
        out = join_on(out, part, keys, "left")
    if history is not None:
        past = history.groupBy("product_id").agg(
            F.sort_array(
                F.collect_list(
                    F.struct("week_key", "week_ending", "top_theme", "word_count", "gates_ok", "loaded")
                ),
                asc=False,
            ).alias("history")
        )
        out = join_on(out, past, ["product_id"], "left")
    return out
