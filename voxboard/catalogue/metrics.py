"""Dashboard figures, over events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxboard.catalogue.adapters import DOCS, EV, document_reviews, event_reviews
from voxboard.catalogue.registry import query
from voxboard.functions.dates import iso_week_key
from voxboard.functions.text import count_words
from voxboard.operators import metrics, sketches

KEYS = ["product_id"]
WEEKLY = ["product_id", "week_key"]


@query(
    "rating_histogram",
    f"""WITH {EV} SELECT coalesce(CAST(CAST(floor(rating) AS INTEGER) AS VARCHAR), 'null') AS stars,
       count(*) AS n FROM ev GROUP BY 1""",
)
def rating_histogram(spark, sf):
    return metrics.rating_histogram(event_reviews(spark, sf))


@query(
    "histogram_array",
    f"""WITH {EV}, s AS (SELECT unnest([1, 2, 3, 4, 5]) AS stars),
w AS (SELECT product_id, week_key, count(rating) AS total FROM ev GROUP BY ALL)
SELECT w.product_id, w.week_key, CAST(s.stars AS INTEGER) AS stars, count(ev.id) AS n,
       count(ev.id)::DOUBLE / greatest(any_value(w.total), 1) * 100.0::DOUBLE AS share
FROM w JOIN s ON true LEFT JOIN ev ON ev.product_id = w.product_id AND ev.week_key = w.week_key
     AND ev.rating = s.stars GROUP BY w.product_id, w.week_key, s.stars""",
)
def histogram_array(spark, sf):
    rows = metrics.histogram_array(event_reviews(spark, sf), WEEKLY)
    pairs = F.arrays_zip(F.col("rating_histogram").alias("n"), F.col("rating_shares").alias("share"))
    return rows.select(*WEEKLY, F.posexplode(pairs).alias("at", "p")).select(
        *WEEKLY, (F.col("at") + 1).alias("stars"), "p.n", "p.share"
    )


@query(
    "corpus_summary",
    f"""WITH {DOCS} SELECT product_id, count(*) AS review_count, min(date) AS date_min, max(date) AS date_max,
       string_agg(DISTINCT source, ',') AS sources FROM docs GROUP BY product_id""",
)
def corpus_summary(spark, sf):
    rows = metrics.corpus_summary(document_reviews(spark, sf), KEYS)
    return rows.select(
        *KEYS, "review_count", "date_min", "date_max", F.array_join("sources", ",").alias("sources")
    )


@query(
    "week_summary",
    f"""WITH {EV} SELECT product_id, week_key, count(*) AS review_count, max(date) AS week_ending,
       strftime(max(date), '%G-W%V') AS ending_week FROM ev GROUP BY ALL""",
)
def week_summary(spark, sf):
    reviews = event_reviews(spark, sf)
    counts = reviews.groupBy(*WEEKLY).agg(
        F.count("*").alias("review_count"), F.max("date").alias("week_ending")
    )
    return counts.withColumn("ending_week", iso_week_key(F.col("week_ending")))


@query("week_ending", f"WITH {DOCS} SELECT product_id, max(date) AS week_ending FROM docs GROUP BY 1")
def week_ending(spark, sf):
    return metrics.week_ending(document_reviews(spark, sf), KEYS)


@query(
    "kpis",
    f"""WITH {EV}, k AS (
  SELECT product_id, week_key, count(*) AS review_count, count(*) FILTER (rating IN (1, 2)) AS low_star_count
  FROM ev GROUP BY ALL)
SELECT product_id, week_key, review_count,
       regexp_replace(CAST(review_count AS VARCHAR), '^(\\d*?)(\\d{{3}})$',
                      CASE WHEN review_count > 999 THEN '\\1,\\2' ELSE '\\1\\2' END) AS review_count_display,
       low_star_count,
       CAST(floor(100.0 * (low_star_count::DOUBLE / review_count) + 0.5) AS INTEGER) AS low_star_share
FROM k""",
)
def kpis(spark, sf):
    return metrics.kpis(event_reviews(spark, sf), WEEKLY)


@query(
    "length_profile",
    f"""WITH {DOCS}, w AS (
  SELECT product_id, rating, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z]+)?')) AS n FROM docs)
SELECT product_id, count(*) AS review_count, CAST(min(n) AS INTEGER) AS min_words,
       CAST(median(n) AS DOUBLE) AS median_words, sum(n)::DOUBLE / count(*) AS avg_words, CAST(max(n) AS INTEGER) AS max_words,
       CAST(floor(100.0 * (count(*) FILTER (rating <= 2)::DOUBLE / count(*)) + 0.5) AS INTEGER) AS low_star_share
FROM w GROUP BY product_id""",
)
def length_profile(spark, sf):
    return metrics.length_profile(document_reviews(spark, sf), KEYS)


# Languages stand for products, so that there are many sources in each. What is estimated
# is compared as what it must be: the rank of the median and the distinct count in bounds.
@query(
    "sketched_summary",
    f"""WITH {DOCS}, w AS (
  SELECT language, date, rating, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z]+)?')) AS n FROM docs
  WHERE date > DATE '2024-02-01')
SELECT language, count(*) AS review_count, min(date) AS date_min, max(date) AS date_max, CAST(min(n) AS BIGINT) AS min_words,
       CAST(max(n) AS BIGINT) AS max_words, sum(n)::DOUBLE / count(*) AS avg_words,
       CAST(floor(100.0 * (count(*) FILTER (rating <= 2)::DOUBLE / count(*)) + 0.5) AS INTEGER) AS low_star_share,
       true AS median_in_bounds, true AS distinct_in_bounds
FROM w GROUP BY language""",
)
def sketched_summary(spark, sf):
    """Summaries of a range of days out of rows per day, with the estimates held against the reviews."""
    reviews = document_reviews(spark, sf).withColumn("source", F.col("product_id"))
    days = sketches.day_sketches(reviews, ["language"])
    found = sketches.roll_up(days.filter("date > '2024-02-01'"), ["language"])
    recent = reviews.filter("date > '2024-02-01'").withColumn("n", count_words(F.col("text")))
    held = recent.join(F.broadcast(found.select(F.col("language").alias("l"), "median_words")), F.col("language") == F.col("l"))
    ranks = held.groupBy("l").agg(
        F.avg((F.col("n") < F.col("median_words")).cast("int")).alias("below"),
        F.avg((F.col("n") <= F.col("median_words")).cast("int")).alias("up_to"),
        F.count_distinct("source").alias("sources"),
    )
    off = F.abs(F.col("distinct_sources") - F.col("sources"))
    return found.join(ranks, F.col("language") == F.col("l")).select(
        "language", "review_count", "date_min", "date_max", "min_words", "max_words", "avg_words", "low_star_share",
        ((F.col("below") <= 0.5 + sketches.RANK_ERROR) & (F.col("up_to") >= 0.5 - sketches.RANK_ERROR)).alias("median_in_bounds"),
        (off <= F.greatest(F.lit(1.0), F.col("sources") * sketches.DISTINCT_ERROR)).alias("distinct_in_bounds"),
    )
