"""Quote candidates, selection, padding and verbatim checks, over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxboard.catalogue.adapters import (
    CANDIDATES,
    DOCS,
    SCORED,
    TEST_VOCABULARY,
    VOCAB,
    document_reviews,
    sql_needle,
    sql_truncate,
    table,
)
from voxboard.catalogue.registry import query
from voxboard.operators import evidence, themes
from voxboard.operators.report import default_actions
from voxboard.plans.staging import persisted
from voxboard.sources.scan import spread

KEYS = ["product_id"]
CHAIN = f"WITH {VOCAB}, {DOCS}, {SCORED}, {CANDIDATES}"


def labelled(spark, sf):
    return themes.label_heuristic(document_reviews(spark, sf), TEST_VOCABULARY)


def ranked(reviews):
    return themes.rank_themes(themes.theme_counts(reviews, KEYS, TEST_VOCABULARY), KEYS)


def candidates(reviews, top=None):
    return evidence.quote_candidates(reviews, top or ranked(reviews), KEYS)


def picked(reviews, top=None):
    return evidence.select_quotes(candidates(reviews, top), KEYS, vocab=TEST_VOCABULARY)


@query(
    "quote_candidates",
    f"""{CHAIN} SELECT product_id, id, theme_id, rating, CAST(candidate_rank AS INTEGER) AS candidate_rank,
       theme_rank FROM cand""",
)
def quote_candidates(spark, sf):
    rows = candidates(labelled(spark, sf))
    return rows.select("product_id", "id", "theme_id", "rating", "candidate_rank", "theme_rank")


@query(
    "limit_candidates",
    f"""{CHAIN} SELECT product_id, id, CAST(n AS INTEGER) AS list_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY coalesce(rating, 99.0), id) AS n FROM cand)
WHERE n <= 10""",
)
def limit_candidates(spark, sf):
    rows = evidence.limit_candidates(candidates(labelled(spark, sf)), KEYS, 10)
    return rows.select("product_id", "id", "list_rank")


@query(
    "quote_features",
    f"{CHAIN} SELECT product_id, id, theme_hits, signal, CAST(capped_length AS INTEGER) AS capped_length FROM feat",
)
def quote_features(spark, sf):
    rows = evidence.quote_features(candidates(labelled(spark, sf)), TEST_VOCABULARY)
    return rows.select("product_id", "id", "theme_hits", "signal", "capped_length")


@query("select_quotes", f"{CHAIN} SELECT * FROM picked")
def select_quotes(spark, sf):
    return picked(labelled(spark, sf))


PADDING = f"""pool AS (
  SELECT l.product_id, l.id, l.theme_id, l.rating, l.wc, {sql_truncate('text')} AS quote FROM lab l
  WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.product_id = l.product_id AND f.id = l.id)),
need AS (SELECT p.*, {sql_needle('quote')} AS needle FROM pool p),
fresh AS (
  SELECT *, row_number() OVER (PARTITION BY product_id, needle ORDER BY coalesce(rating, 99.0), wc DESC, id) AS copy
  FROM need n WHERE needle <> '' AND NOT EXISTS (
    SELECT 1 FROM first f WHERE f.product_id = n.product_id AND {sql_needle('f.quote')} = n.needle)),
placed AS (
  SELECT f.*, row_number() OVER (PARTITION BY product_id ORDER BY coalesce(rating, 99.0), wc DESC, id) AS place,
         (SELECT count(*) FROM first x WHERE x.product_id = f.product_id) AS have
  FROM fresh f WHERE copy = 1),
padded AS (
  SELECT * FROM first
  UNION ALL SELECT product_id, CAST(have + place AS INTEGER), id, theme_id, rating, quote
  FROM placed WHERE place <= 3 - have)"""
# Padding alone: it starts from the best-ranked quote of each product, if rated low.
PADDED = f"first AS (SELECT * FROM picked WHERE quote_rank = 1 AND rating < 2), {PADDING}"
# What reports are composed of: all picked quotes, padded where they are too few.
CHOSEN = f"first AS (SELECT * FROM picked), {PADDING}"


def padded(reviews, top=None):
    """Padding starts from part of the picked quotes; few rows, read several times."""
    first = persisted(picked(reviews, top).filter("quote_rank = 1 AND rating < 2"), "first")
    return evidence.pad_quotes(first, reviews, reviews.select(*KEYS), KEYS)


def chosen(reviews, top=None):
    first = persisted(picked(reviews, top), "first")
    return evidence.pad_quotes(first, reviews, reviews.select(*KEYS), KEYS)


@query("pad_quotes", f"{CHAIN}, {PADDED} SELECT * FROM padded")
def pad_quotes(spark, sf):
    return padded(labelled(spark, sf))


@query(
    "verbatim_corpus",
    f"""SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, {sql_needle('b.text')})) AS verbatim
FROM benchmark b""",
)
def verbatim_corpus(spark, sf):
    items = table(spark, sf, "benchmark").withColumnRenamed("text", "needle")
    rows = evidence.verbatim_in_corpus(items, spread(table(spark, sf, "documents")), id_column="doc_id")
    return rows.select("item_id", "verbatim")


@query(
    "verbatim_semi",
    f"""SELECT item_id FROM benchmark b
WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, {sql_needle('b.text')}))""",
)
def verbatim_semi(spark, sf):
    return verbatim_corpus(spark, sf).filter("verbatim").select("item_id")


@query(
    "verbatim_anti",
    f"""SELECT item_id FROM benchmark b
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, {sql_needle('b.text')}))""",
)
def verbatim_anti(spark, sf):
    return verbatim_corpus(spark, sf).filter(~F.col("verbatim")).select("item_id")


# Short needles: three words out of each item, some of them in many texts.
@query(
    "verbatim_short",
    r"""SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.needle)) AS verbatim
FROM (SELECT item_id, array_to_string(string_split(text, ' ')[2:4], ' ') AS needle FROM benchmark) b""",
)
def verbatim_short(spark, sf):
    items = table(spark, sf, "benchmark").select(
        "item_id", F.array_join(F.slice(F.split("text", " "), 2, 3), " ").alias("needle")
    )
    rows = evidence.verbatim_in_corpus(items, spread(table(spark, sf, "documents")), id_column="doc_id")
    return rows.select("item_id", "verbatim")


# Every benchmark item as a quote that cites a document; few cite the right one.
@query(
    "resolve_picks",
    f"""WITH {DOCS}, pick AS (
  SELECT b.item_id, d.id, d.product_id, b.text AS quote FROM benchmark b
  JOIN docs d ON d.doc_id = b.item_id),
ok AS (SELECT * FROM pick p WHERE EXISTS (
  SELECT 1 FROM docs d WHERE d.product_id = p.product_id AND contains(d.text, {sql_needle('p.quote')}))),
num AS (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY item_id) AS INTEGER) AS quote_rank FROM ok)
SELECT product_id, quote_rank, id, {sql_truncate('quote')} AS quote FROM num WHERE quote_rank <= 3""",
)
def resolve_picks(spark, sf):
    reviews = document_reviews(spark, sf)
    picks = (
        table(spark, sf, "benchmark")
        .select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("pick_rank"), F.col("text").alias("quote"))
        .join(reviews.select("doc_id", "id", "product_id"), "doc_id")
        .drop("doc_id")
    )
    rows = evidence.resolve_picks(picks, reviews, KEYS)
    return rows.select("product_id", "quote_rank", "id", "quote")


@query(
    "evidence_top3",
    f"""{CHAIN} SELECT l.doc_id, l.theme_id FROM lab l
WHERE EXISTS (SELECT 1 FROM top t WHERE t.product_id = l.product_id AND t.theme_id = l.theme_id)""",
)
def evidence_top3(spark, sf):
    reviews = labelled(spark, sf)
    rows = evidence.filter_evidence(reviews, "top3", ranked(reviews), KEYS)
    return rows.select("doc_id", "theme_id")


@query(
    "evidence_theme",
    f"WITH {DOCS}, {SCORED} SELECT doc_id FROM lab WHERE theme_id = 'fees_funding'",
)
def evidence_theme(spark, sf):
    return evidence.filter_evidence(labelled(spark, sf), "fees_funding").select("doc_id")


@query(
    "ground_actions",
    f"""{CHAIN}, q AS (
  SELECT product_id, theme_id, quote, row_number() OVER (PARTITION BY product_id, theme_id ORDER BY quote_rank) AS n
  FROM picked)
SELECT t.product_id, t.rank AS action_rank, t.theme_id, v.action, q.quote AS grounded_in
FROM top t JOIN vocab v ON v.theme_id = t.theme_id
LEFT JOIN q ON q.product_id = t.product_id AND q.theme_id = t.theme_id AND q.n = 1""",
)
def ground_actions(spark, sf):
    reviews = labelled(spark, sf)
    actions = default_actions(ranked(reviews), KEYS, TEST_VOCABULARY)
    return evidence.ground_actions(actions, picked(reviews), KEYS)
