"""The run ledger, publish queue and call budget, over weeks and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxboard.catalogue.adapters import table
from voxboard.catalogue.registry import query
from voxboard.functions.dates import iso_week_key
from voxboard.operators import ledger
from voxboard.operators.budget import rolling_budget

KEYS = ["product_id", "week_key"]


def user_weeks(spark, sf):
    """One run row per user and week: each user is a product of its own."""
    events = table(spark, sf, "events").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("product_id"),
        iso_week_key(F.to_date("ts")).alias("week_key"),
        F.to_date("ts").alias("day"),
        "event_type",
        "ts",
    )
    rows = events.groupBy(*KEYS).agg(
        F.count("*").alias("review_count"),
        F.max("day").alias("week_ending"),
        F.max("ts").alias("finished_at"),
        F.max("event_type").alias("last_type"),
        F.min("event_type").alias("first_type"),
    )
    return with_ids(rows)


def with_ids(rows):
    has_doc = F.col("review_count") % 3 != 0
    has_draft = F.col("review_count") % 2 == 0
    return rows.select(
        *KEYS,
        "review_count",
        "week_ending",
        "finished_at",
        (F.col("review_count") > 2).alias("validation_ok"),
        (F.col("review_count") < 5).alias("insufficient_signal"),
        F.array("last_type", "first_type").alias("top_3"),
        (F.col("review_count") * 10).cast("int").alias("word_count"),
        F.when(has_doc, F.concat(F.lit("doc_"), "week_key")).alias("doc_id"),
        F.when(has_doc & (F.col("review_count") % 5 != 0), F.concat(F.lit("https://example.com/"), "week_key")).alias("doc_url"),
        F.when(has_draft, F.concat(F.lit("draft_"), "week_key")).alias("draft_id"),
    )


def daily_runs(spark, sf):
    """Several runs per user and week, one per day."""
    rows = (
        table(spark, sf, "events")
        .groupBy(
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("product_id"),
            iso_week_key(F.to_date("ts")).alias("week_key"),
            F.to_date("ts").alias("day"),
        )
        .agg(
            F.count("*").alias("review_count"),
            F.max("ts").alias("finished_at"),
            F.max("event_type").alias("last_type"),
            F.min("event_type").alias("first_type"),
        )
        .withColumn("week_ending", F.col("day"))
    )
    return with_ids(rows)


IDS = """count(*) AS review_count, max(CAST(ts AS DATE)) AS week_ending, max(ts) AS finished_at,
         max(event_type) AS last_type, min(event_type) AS first_type"""
FLAGS = """product_id, week_key, review_count, week_ending, finished_at,
         review_count > 2 AS validation_ok, review_count < 5 AS insufficient_signal, last_type,
         CAST(review_count * 10 AS INTEGER) AS word_count,
         CASE WHEN review_count % 3 <> 0 THEN 'doc_' || week_key END AS doc_id,
         CASE WHEN review_count % 3 <> 0 AND review_count % 5 <> 0 THEN 'https://example.com/' || week_key END AS doc_url,
         CASE WHEN review_count % 2 = 0 THEN 'draft_' || week_key END AS draft_id"""
RUNS = f"""uw AS (
  SELECT 'user' || user_id AS product_id, strftime(CAST(ts AS DATE), '%G-W%V') AS week_key, {IDS}
  FROM events GROUP BY 1, 2),
runs AS (SELECT {FLAGS} FROM uw),
dw AS (
  SELECT 'user' || user_id AS product_id, strftime(CAST(ts AS DATE), '%G-W%V') AS week_key, {IDS}
  FROM events GROUP BY 1, 2, CAST(ts AS DATE)),
daily AS (SELECT {FLAGS} FROM dw),
latest AS (
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY product_id, week_key
    ORDER BY finished_at DESC) AS n FROM daily) WHERE n = 1)"""


@query(
    "latest_runs",
    f"WITH {RUNS} SELECT product_id, week_key, review_count, week_ending, doc_id, draft_id FROM latest",
)
def latest_runs(spark, sf):
    rows = ledger.latest_runs(daily_runs(spark, sf), KEYS)
    return rows.select(*KEYS, "review_count", "week_ending", "doc_id", "draft_id")


@query(
    "undelivered_weeks",
    f"""WITH {RUNS} SELECT product_id, week_key, review_count FROM runs r WHERE NOT EXISTS (
  SELECT 1 FROM latest l WHERE l.product_id = r.product_id AND l.week_key = r.week_key
  AND l.validation_ok AND l.doc_id IS NOT NULL AND l.draft_id IS NOT NULL)""",
)
def undelivered_weeks(spark, sf):
    prior = ledger.latest_runs(daily_runs(spark, sf), KEYS)
    return ledger.undelivered(user_weeks(spark, sf), prior, KEYS).select(*KEYS, "review_count")


@query(
    "partial_deliveries",
    f"WITH {RUNS} SELECT product_id, week_key, doc_id FROM latest WHERE doc_id IS NOT NULL AND draft_id IS NULL",
)
def partial_deliveries(spark, sf):
    prior = ledger.latest_runs(daily_runs(spark, sf), KEYS)
    return ledger.partial_deliveries(prior).select(*KEYS, "doc_id")


def _queue(sparse: str) -> str:
    return f"""WITH {RUNS}, j AS (
  SELECT r.*, l.validation_ok AND l.doc_id IS NOT NULL AND l.draft_id IS NOT NULL AS done,
         l.doc_id AS prior_doc_id, l.doc_url AS prior_doc_url
  FROM runs r LEFT JOIN latest l ON l.product_id = r.product_id AND l.week_key = r.week_key
  WHERE r.validation_ok AND {sparse})
SELECT product_id, week_key, review_count, prior_doc_id IS NOT NULL AS draft_only, prior_doc_id, prior_doc_url,
       CASE WHEN prior_doc_id IS NOT NULL AND prior_doc_url IS NULL THEN 'full' ELSE 'link' END AS email_mode
FROM j WHERE NOT coalesce(done, false)"""


def publish(spark, sf, allow_sparse):
    rows = ledger.publish_queue(user_weeks(spark, sf), daily_runs(spark, sf), KEYS, allow_sparse)
    return rows.select(
        *KEYS, "review_count", "draft_only", "prior_doc_id", "prior_doc_url", "email_mode"
    )


@query("publish_queue", _queue("NOT r.insufficient_signal"))
def publish_queue(spark, sf):
    return publish(spark, sf, False)


@query("publish_queue_sparse", _queue("true"))
def publish_queue_sparse(spark, sf):
    return publish(spark, sf, True)


@query(
    "history",
    f"""WITH {RUNS} SELECT product_id, week_key, week_ending, last_type AS top_theme, word_count,
       validation_ok AS gates_ok, week_key = '2024-W03' AS loaded FROM latest""",
)
def history(spark, sf):
    return ledger.history(daily_runs(spark, sf), KEYS, "2024-W03")


@query(
    "freshness",
    """SELECT event_type, max(ts) AS ingested_at, max(ts) + INTERVAL 5 SECONDS >= TIMESTAMP '2024-01-30 23:40:00' AS fresh
FROM events GROUP BY event_type""",
)
def freshness(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("ts", "ingested_at")
    return ledger.freshness(events, "2024-01-30 23:40:00", ["event_type"])


BUDGET = """SELECT event_id, provider, requests_60s, tokens_60s, requests_60s > 25 AS over_requests,
       tokens_60s > 6800 AS over_tokens
FROM (SELECT event_id, {key} AS provider, count(*) OVER w AS requests_60s,
             CAST(sum(CAST(floor(value * 100) AS INTEGER)) OVER w AS BIGINT) AS tokens_60s
      FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts
        RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW))"""


def budget(spark, sf, key):
    calls = table(spark, sf, "events").select(
        "event_id", key.alias("provider"), "ts", F.floor(F.col("value") * 100).alias("tokens")
    )
    return rolling_budget(calls).drop("ts", "tokens")


@query("rolling_budget", BUDGET.format(key="user_id"))
def rolling_budget_query(spark, sf):
    return budget(spark, sf, F.col("user_id"))


# All calls to one provider: the hottest key there can be.
@query("rolling_budget_one_provider", BUDGET.format(key="'one'"))
def rolling_budget_one_provider(spark, sf):
    return budget(spark, sf, F.lit("one"))
