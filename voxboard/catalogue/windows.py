"""Date windows, duplicate removal and samples, over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxboard.catalogue.adapters import AS_OF, DOCS, document_reviews, event_reviews, EV
from voxboard.catalogue.registry import query
from voxboard.operators import gates, sampling, windows

KEYS = ["product_id"]

WINDOW = """cnt AS (
  SELECT product_id, """ + ", ".join(
    f"count(*) FILTER (date BETWEEN DATE '2024-03-31' - {7 * w} AND DATE '2024-03-31') AS w{w}"
    for w in range(8, 13)
) + """ FROM docs GROUP BY product_id),
win AS (
  SELECT product_id, CASE WHEN w8 >= 30 THEN 8 WHEN w9 >= 30 THEN 9 WHEN w10 >= 30 THEN 10
                          WHEN w11 >= 30 THEN 11 ELSE 12 END AS weeks_used,
         CASE WHEN w8 >= 30 THEN w8 WHEN w9 >= 30 THEN w9 WHEN w10 >= 30 THEN w10
              WHEN w11 >= 30 THEN w11 ELSE w12 END AS in_window FROM cnt)"""


@query(
    "fixed_window",
    f"""WITH {DOCS} SELECT doc_id, product_id, date FROM docs
WHERE date BETWEEN DATE '2024-03-31' - 63 AND DATE '2024-03-31'""",
)
def fixed_window(spark, sf):
    rows = windows.filter_window(document_reviews(spark, sf), 9, AS_OF)
    return rows.select("doc_id", "product_id", "date")


@query(
    "resolve_window",
    f"""WITH {DOCS}, {WINDOW}
SELECT product_id, weeks_used, in_window, DATE '2024-03-31' - 7 * weeks_used AS window_start,
       DATE '2024-03-31' AS as_of, weeks_used > 8 AS window_widened, in_window < 30 AS insufficient_signal
FROM win""",
)
def resolve_window(spark, sf):
    return windows.resolve_window(document_reviews(spark, sf), 8, AS_OF, KEYS)


@query(
    "adaptive_window",
    f"""WITH {DOCS}, {WINDOW}
SELECT d.doc_id, d.product_id, d.date, w.weeks_used
FROM docs d JOIN win w USING (product_id)
WHERE d.date BETWEEN DATE '2024-03-31' - 7 * w.weeks_used AND DATE '2024-03-31'""",
)
def adaptive_window(spark, sf):
    narrow = document_reviews(spark, sf).select("doc_id", "product_id", "date")
    rows = windows.adaptive_window(narrow, 8, AS_OF, KEYS, with_flags=True)
    return rows.select("doc_id", "product_id", "date", "weeks_used")


@query(
    "window_gate",
    f"""WITH {DOCS}, p AS (
  SELECT product_id, count(*) AS n, min(date) AS lo, max(date) AS hi FROM docs GROUP BY product_id),
o AS (SELECT d.product_id, count(*) FILTER (d.date < p.hi - 86 OR d.date > p.hi + 2) AS n_outside
      FROM docs d JOIN p USING (product_id) GROUP BY d.product_id)
SELECT product_id, n_outside = 0 AND hi - lo <= 86 AS ok,
       strftime(lo, '%Y-%m-%d') || ' -> ' || strftime(hi, '%Y-%m-%d') || ' (' || n || ' reviews)' AS detail,
       concat_ws('; ',
         CASE WHEN n_outside > 0 THEN n_outside || ' review(s) outside 12-week window ending ' ||
              strftime(hi, '%Y-%m-%d') || ' (oldest allowed ' || strftime(hi - 86, '%Y-%m-%d') || ')' END,
         CASE WHEN hi - lo > 86 THEN 'date span ' || (hi - lo) || ' days exceeds 12-week cap (84 days)' END
       ) AS errors
FROM p JOIN o USING (product_id)""",
)
def window_gate(spark, sf):
    profile = gates.review_profile(document_reviews(spark, sf), KEYS)
    rows = profile.select(*KEYS, F.inline(F.array(gates.window_gate())))
    return rows.select(*KEYS, "ok", "detail", F.array_join("errors", "; ").alias("errors"))


@query(
    "dedupe_reviews",
    f"""WITH {DOCS}, m AS (
  SELECT *, row_number() OVER (PARTITION BY product_id, date, rating, text ORDER BY doc_id) AS rn FROM docs)
SELECT doc_id, product_id, 'play-' || substr(sha256(concat_ws('|', strftime(date, '%Y-%m-%d'),
       coalesce(CAST(rating AS VARCHAR), ''), text)), 1, 16) AS id
FROM m WHERE rn = 1""",
)
def dedupe_reviews(spark, sf):
    rows = sampling.dedupe_reviews(document_reviews(spark, sf), KEYS, [F.col("doc_id")])
    return rows.select("doc_id", "product_id", "id")


@query(
    "dedupe_whole_corpus",
    f"""WITH {DOCS}, m AS (
  SELECT *, row_number() OVER (PARTITION BY date, rating, text ORDER BY doc_id) AS rn FROM docs)
SELECT doc_id, language, product_id FROM m WHERE rn = 1""",
)
def dedupe_whole_corpus(spark, sf):
    rows = sampling.dedupe_reviews(document_reviews(spark, sf), [], [F.col("doc_id")])
    return rows.select("doc_id", "language", "product_id")


def _stratified(n: int, source: str, key: str) -> str:
    return f"""m AS (
  SELECT *, row_number() OVER (PARTITION BY {key}, rating ORDER BY id) AS rn FROM {source}),
k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY rn, coalesce(rating, 99.0)) AS pick FROM m)
SELECT id, {key}, rating, pick FROM k WHERE pick <= {n}"""


@query("stratified_sample", f"WITH {DOCS}, {_stratified(20, 'docs', 'product_id')}")
def stratified_sample(spark, sf):
    rows = sampling.stratified_sample(document_reviews(spark, sf), 20, KEYS)
    return rows.select("id", "product_id", "rating", "pick")


# Above the group limit the rank within a rating comes from bucket counts.
@query("stratified_sample_large", f"WITH {EV}, {_stratified(1500, 'ev', 'product_id')}")
def stratified_sample_large(spark, sf):
    rows = sampling.stratified_sample(event_reviews(spark, sf), 1500, KEYS)
    return rows.select("id", "product_id", "rating", "pick")


@query(
    "systematic_sample",
    f"""WITH {EV}, m AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY coalesce(rating, 99.0), id) - 1 AS pos,
         count(*) OVER (PARTITION BY product_id) AS n FROM ev),
s AS (SELECT *, greatest(1, n // 300) AS step FROM m)
SELECT id, product_id, rating, pos // step + 1 AS pick FROM s WHERE pos % step = 0 AND pos // step < 300""",
)
def systematic_sample(spark, sf):
    rows = sampling.systematic_sample(event_reviews(spark, sf), 300, KEYS)
    return rows.select("id", "product_id", "rating", "pick")
