"""The weekly job: fresh corpus, reports, ledger, publish queue."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxboard.model import MIN_WEEKS, VOCABULARY, Vocabulary
from voxboard.operators.joins import join_on
from voxboard.operators.ledger import latest_runs, publish_queue, require_fresh
from voxboard.operators.themes import severity, themes_report
from voxboard.plans.staging import Stage, shared
from voxboard.plans.weekly import Weekly, weekly_reports
from voxboard.sources.artifacts import append_run, read_runs, write_gates, write_themes_report
from voxboard.sources.raw import require_nonempty

EXIT_OK, EXIT_VALIDATE = 0, 1


def weekly_job(
    spark: SparkSession,
    reviews: DataFrame,
    ledger_path: str,
    as_of: str | dt.date,
    started: dt.datetime,
    preferred_weeks: int = MIN_WEEKS,
    allow_sparse: bool = False,
    gates_path: str | None = None,
    themes_path: str | None = None,
    vocab: Vocabulary = VOCABULARY,
    stage: Stage | None = None,
) -> tuple[Weekly, DataFrame]:
    """Run the reports, append them to the ledger and say what is to be published."""
    keys = ["product_id"]
    stage = stage or shared(spark)
    require_nonempty(reviews, "cleaned reviews")
    if "ingested_at" in reviews.columns:
        require_fresh(reviews, started, keys)
        reviews = reviews.drop("ingested_at")
    week = ["product_id", "week_key"]
    prior = read_runs(spark, ledger_path)
    weekly = weekly_reports(
        reviews, as_of, preferred_weeks, keys, vocab=vocab, stage=stage
    )
    # The run ends when its rows are written; its id settles runs that end together.
    run_id = f"{started:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    rows = weekly.run_rows(keys, F.current_timestamp()).withColumn("run_id", F.lit(run_id))
    runs = stage(rows, "runs")
    queue = stage(publish_queue(runs, prior, week, allow_sparse), "queue")
    if gates_path is not None:
        write_gates(
            join_on(weekly.gates, weekly.reports.select(*week), keys).withColumn("run", F.lit(run_id)),
            gates_path,
        )
    if themes_path is not None:
        flags = ["week_ending", "weeks_used", "window_widened", "insufficient_signal"]
        shown = weekly.reports.select(*week, *flags).withColumn("run", F.lit(run_id))
        low = severity(weekly.labelled, keys, vocab)
        write_themes_report(themes_report(weekly.themes, weekly.top, low, shown, keys, vocab=vocab), themes_path)
    # Ids of an earlier delivery stay on the week's latest row. The queue is
    # staged, hence settled, before the ledger grows: it must not see its own run.
    delivered = latest_runs(prior, week).select(*week, "doc_id", "doc_url", "draft_id", "sent_id")
    append_run(join_on(runs, delivered, week, "left"), ledger_path)
    return weekly, queue
