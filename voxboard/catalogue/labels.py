"""Keyword scores, theme labels and the queue for an outside labeller, over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxboard.catalogue.adapters import (
    DOCS,
    SCORED,
    TEST_VOCABULARY,
    TEST_WORDS,
    document_reviews,
    table,
)
from voxboard.catalogue.registry import query
from voxboard.functions import keywords, numbers
from voxboard.model import VOCABULARY
from voxboard.operators import metrics, themes

KEYS = ["product_id"]
IDS = list(TEST_WORDS)


def scored(spark, sf):
    return themes.score_reviews(document_reviews(spark, sf), TEST_VOCABULARY)


@query(
    "keyword_scores",
    f"WITH {DOCS}, {SCORED} SELECT doc_id, {', '.join(f's_{i} AS {i}' for i in IDS)} FROM lab",
)
def keyword_scores(spark, sf):
    return scored(spark, sf).select("doc_id", "scores.*")


@query("keyword_hint", f"WITH {DOCS}, {SCORED} SELECT doc_id, hint FROM lab")
def keyword_hint(spark, sf):
    hint = keywords.keyword_hint(F.col("text"), TEST_VOCABULARY)
    return document_reviews(spark, sf).select("doc_id", hint.alias("hint"))


@query("heuristic_theme", f"WITH {DOCS}, {SCORED} SELECT doc_id, theme_id FROM lab")
def heuristic_theme(spark, sf):
    return themes.label_heuristic(document_reviews(spark, sf), TEST_VOCABULARY).select("doc_id", "theme_id")


# Sentences with words of the trading vocabulary, dealt out by document id.
TRADING_SENTENCES = [
    "buy sell stop-loss stop loss f&o SL-M",
    "orders crashes fees are no words of it",
    "no  response from customer care, call centre",
    "average buy price wrong price",
    "doesnt work; worst app",
    "UPI deposit and withdraw, hidden charge",
    "limit order market order order",
]


def _trading_hits() -> str:
    counts = []
    for t in VOCABULARY.themes:
        pattern = t.pattern.replace("'", "''")
        counts.append(
            f"CAST(len(regexp_extract_all(text, '(?i)\\b(?:{pattern})\\b')) AS INTEGER) AS {t.theme_id}"
        )
    # Word bounds are ASCII there: other letters become x, other signs blanks.
    ascii_text = (
        r"regexp_replace(regexp_replace(text, '[^\x00-\x7f\p{L}\p{N}]', ' ', 'g'), '[^\x00-\x7f]', 'x', 'g')"
    )
    listed = ", ".join(f"'{s}'" for s in TRADING_SENTENCES)
    added = f"[{listed}][doc_id % {len(TRADING_SENTENCES)} + 1]"
    source = f"(SELECT doc_id, {ascii_text} || ' ' || {added} AS text FROM documents)"
    return "SELECT doc_id, " + ", ".join(counts) + f" FROM {source}"


# The trading vocabulary itself, on texts that end with some of its words.
@query("trading_vocabulary_hits", _trading_hits())
def trading_vocabulary_hits(spark, sf):
    sentences = F.array(*[F.lit(s) for s in TRADING_SENTENCES])
    added = F.get(sentences, (F.col("doc_id") % len(TRADING_SENTENCES)).cast("int"))
    docs = document_reviews(spark, sf).withColumn("text", F.concat_ws(" ", "text", added))
    return docs.select("doc_id", keywords.keyword_scores(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("confident_theme", f"WITH {DOCS}, {SCORED} SELECT doc_id, confident FROM lab")
def confident_theme(spark, sf):
    rows = scored(spark, sf)
    return rows.select(
        "doc_id", keywords.confident_from_scores(F.col("scores"), 1, TEST_VOCABULARY).alias("confident")
    )


QUEUE = """uns AS (
  SELECT product_id, id, CAST(row_number() OVER (PARTITION BY product_id
         ORDER BY coalesce(rating, 99.0), id) AS INTEGER) AS queue_rank FROM lab WHERE confident IS NULL),
routed AS (
  SELECT l.*, CASE WHEN l.confident IS NULL AND u.queue_rank <= 12 THEN u.queue_rank END AS queue_rank,
         CASE WHEN l.confident IS NOT NULL THEN 'confident'
              WHEN u.queue_rank <= 12 THEN 'queue' ELSE 'heuristic' END AS route
  FROM lab l LEFT JOIN uns u ON l.product_id = u.product_id AND l.id = u.id)"""


def routed(spark, sf):
    return themes.split_label_queue(scored(spark, sf), KEYS, max_n=12, vocab=TEST_VOCABULARY, batch_size=5)


@query(
    "split_label_queue",
    f"""WITH {DOCS}, {SCORED}, {QUEUE}
SELECT doc_id, product_id, route, queue_rank, CAST((queue_rank - 1) // 5 AS INTEGER) AS batch,
       CASE route WHEN 'confident' THEN confident WHEN 'heuristic' THEN theme_id END AS theme_id
FROM routed""",
)
def split_label_queue(spark, sf):
    return routed(spark, sf).select("doc_id", "product_id", "route", "queue_rank", "batch", "theme_id")


# Quality marks stand in for labels from outside: good ones name a theme, bad
# ones something unknown, and most documents have none.
@query(
    "merge_labels",
    f"""WITH {DOCS}, {SCORED}, {QUEUE}
SELECT r.doc_id, r.route, CASE r.route WHEN 'confident' THEN confident WHEN 'heuristic' THEN theme_id
       ELSE coalesce(CASE WHEN l.quality = 1 THEN 'fees_funding' END, r.hint, 'app_reliability') END AS theme_id
FROM routed r LEFT JOIN labels l USING (doc_id)""",
)
def merge_labels(spark, sf):
    given = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "fees_funding").otherwise("onboarding").alias("theme_id")
    )
    rows = routed(spark, sf)
    labels = given.join(document_reviews(spark, sf).select("doc_id", "id", "product_id"), "doc_id")
    merged = themes.merge_labels(rows, labels.drop("doc_id"), KEYS, TEST_VOCABULARY)
    return merged.select("doc_id", "route", "theme_id")


@query(
    "label_payload",
    f"""WITH {DOCS}, {SCORED}
SELECT doc_id, id, rating, substr(text, 1, 350) AS text, hint FROM lab""",
)
def label_payload(spark, sf):
    rows = scored(spark, sf).withColumn(
        "hint", keywords.hint_from_scores(F.col("scores"), TEST_VOCABULARY)
    )
    parsed = F.from_json("payload", "id string, rating double, text string, hint string")
    return themes.label_payload(rows).select("doc_id", parsed.alias("p")).select("doc_id", "p.*")


@query(
    "label_batches",
    f"""WITH {DOCS}, {SCORED}, {QUEUE}
SELECT product_id, CAST((queue_rank - 1) // 5 AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS n,
       string_agg(id, ',' ORDER BY queue_rank) AS ids
FROM routed WHERE route = 'queue' GROUP BY 1, 2""",
)
def label_batches(spark, sf):
    batches = themes.batch_payloads(routed(spark, sf), KEYS)
    items = F.from_json("payload", "array<struct<id:string>>")
    return batches.select(*KEYS, "batch", "n", F.array_join(items["id"], ",").alias("ids"))


@query(
    "estimate_tokens",
    """SELECT conv_id, turn, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END
       AS INTEGER) AS tokens FROM conversations""",
)
def estimate_tokens(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", numbers.estimate_tokens(F.col("text")).alias("tokens")
    )


@query(
    "batch_tokens",
    f"""WITH {DOCS}, {SCORED}, {QUEUE},
items AS (SELECT product_id, queue_rank, (queue_rank - 1) // 5 AS batch,
    CASE WHEN hint IS NULL THEN to_json({{'id': id, 'rating': rating, 'text': substr(text, 1, 350)}})
         ELSE to_json({{'id': id, 'rating': rating, 'text': substr(text, 1, 350), 'hint': hint}}) END AS item
  FROM routed WHERE route = 'queue'),
requests AS (SELECT product_id, CAST(batch AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS n,
    '[' || string_agg(CAST(item AS VARCHAR), ', ' ORDER BY queue_rank) || ']' AS payload
  FROM items GROUP BY ALL)
SELECT product_id, batch, n, CAST((length(payload) + 3) // 4 + 400 AS INTEGER) AS tokens FROM requests""",
)
def batch_tokens(spark, sf):
    """Estimated tokens per request."""
    return themes.batch_tokens(themes.batch_payloads(routed(spark, sf), KEYS)).drop("payload")


@query(
    "keyword_probe",
    f"WITH {DOCS}, {SCORED} "
    + " UNION ALL ".join(
        f"SELECT product_id, '{name}' AS theme_id, count(*) FILTER ({test}) AS hits, "
        f"count(*) FILTER (({test}) AND rating <= 2) AS low_star_hits FROM lab GROUP BY product_id"
        for name, test in [*[(i, f"s_{i} > 0") for i in IDS], ("unmatched", "best = 0")]
    ),
)
def keyword_probe(spark, sf):
    return metrics.keyword_probe(scored(spark, sf), KEYS, TEST_VOCABULARY)
