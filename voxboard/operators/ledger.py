"""The run ledger: latest runs, delivery state, publish queue and history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxboard.operators.joins import join_on
from voxboard.operators.ranking import first_per

FRESH_SLACK_SECONDS = 5


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def latest_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The last finished run of each week; of runs that ended together the last run id.

    Ledgers without run ids are settled by a hash of what the rows hold.
    """
    plain = [f.name for f in runs.schema.fields if not isinstance(f.dataType, T.MapType)]
    held = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(plain)])
    last = F.col("run_id") if "run_id" in runs.columns else F.lit(None)
    return first_per(runs, keys, [F.col("finished_at").desc(), last.desc(), held.desc()])


def delivery_state(runs: DataFrame) -> DataFrame:
    """Whether a week is fully delivered, and whether its document exists."""
    ok = F.coalesce("validation_ok", F.lit(False))
    doc, draft = _given(F.col("doc_id")), _given(F.col("draft_id"))
    return runs.select(
        "*",
        (ok & doc & draft).alias("already_delivered"),
        doc.alias("doc_published"),
    )


def undelivered(weeks: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Weeks that are not fully delivered yet."""
    done = delivery_state(ledger).filter("already_delivered")
    return join_on(weeks, done.select(*keys), keys, "left_anti")


def partial_deliveries(ledger: DataFrame) -> DataFrame:
    """Weeks whose document exists while the draft is missing."""
    return delivery_state(ledger).filter(F.col("doc_published") & ~_given(F.col("draft_id")))


def publish_queue(
    runs: DataFrame,
    ledger: DataFrame,
    keys: list[str],
    allow_sparse: bool = False,
    email_mode: str = "link",
) -> DataFrame:
    """Reports that may be published and what is left to do for each.

    Reports must have passed their gates, and have enough signal unless sparse
    ones are allowed. Weeks already delivered are left out; weeks with a
    document only need their draft. Without a document address a draft carries
    the whole report.
    """
    sparse = F.coalesce("insufficient_signal", F.lit(False))
    passed = runs.filter(F.coalesce("validation_ok", F.lit(False)) & (~sparse | F.lit(allow_sparse)))
    prior = delivery_state(latest_runs(ledger, keys)).select(
        *keys,
        F.col("already_delivered").alias("__done"),
        F.col("doc_published").alias("__doc"),
        F.col("doc_id").alias("prior_doc_id"),
        F.col("doc_url").alias("prior_doc_url"),
    )
    rows = join_on(passed, prior, keys, "left").filter(~F.coalesce("__done", F.lit(False)))
    draft_only = F.coalesce("__doc", F.lit(False))
    url = F.when(draft_only, F.col("prior_doc_url"))
    # With no prior document a new one is made first; its address then exists.
    mode = F.when(draft_only & ~_given(url) & F.lit(email_mode == "link"), "full").otherwise(email_mode)
    return rows.select(
        *runs.columns,
        draft_only.alias("draft_only"),
        F.when(draft_only, F.col("prior_doc_id")).alias("prior_doc_id"),
        url.alias("prior_doc_url"),
        mode.alias("email_mode"),
    )


def history(runs: DataFrame, keys: list[str], loaded_week: str | None = None) -> DataFrame:
    """One row per week from its last run."""
    last = latest_runs(runs, keys)
    return last.select(
        *keys,
        "week_ending",
        F.get("top_3", F.lit(0)).alias("top_theme"),
        "word_count",
        F.col("validation_ok").alias("gates_ok"),
        (F.col("week_key") == F.lit(loaded_week) if loaded_week else F.lit(True)).alias("loaded"),
    )


def freshness(df: DataFrame, started: str | dt.datetime, keys: list[str]) -> DataFrame:
    """Is the newest intake of each corpus at least as new as the run."""
    start = F.lit(str(started)).cast("timestamp")
    newest = df.groupBy(*keys).agg(F.max("ingested_at").alias("ingested_at"))
    slack = F.expr(f"INTERVAL {FRESH_SLACK_SECONDS} SECONDS")
    return newest.withColumn("fresh", F.col("ingested_at") + slack >= start)


def require_fresh(df: DataFrame, started: str | dt.datetime, keys: list[str]) -> DataFrame:
    if not freshness(df, started, keys).filter(~F.col("fresh")).isEmpty():
        raise ValueError("cleaned corpus is older than this run; refusing a stale corpus")
    return df
