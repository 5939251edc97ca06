"""Theme aggregates, severity ranking and their views, over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxboard.catalogue.adapters import EV, VOCAB, agg_sql, event_reviews, rank_sql, table
from voxboard.catalogue.registry import query
from voxboard.functions.numbers import is_low_star
from voxboard.model import VOCABULARY
from voxboard.operators import metrics, themes

KEYS = ["product_id"]
WEEKLY = ["product_id", "week_key"]
AGG = agg_sql("ev", "product_id")
SAMPLES = """smp AS (
  SELECT product_id, theme_id, string_agg(id, ',' ORDER BY rn) AS sample_ids FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, theme_id
                                 ORDER BY coalesce(rating, 99.0), id) AS rn FROM ev)
  WHERE rn <= 12 GROUP BY product_id, theme_id)"""


@query(
    "theme_aggregate",
    f"""WITH {VOCAB}, {EV}, {AGG}, {SAMPLES}
SELECT a.product_id, a.theme_id, label, review_count, avg_rating, low_star_count,
       review_count || ' reviews; ' || low_star_count || ' rated ≤2★' AS summary, sample_ids
FROM agg a JOIN smp s ON a.product_id = s.product_id AND a.theme_id = s.theme_id""",
)
def theme_aggregate(spark, sf):
    table_ = themes.aggregate_themes(event_reviews(spark, sf), KEYS)
    return table_.withColumn("sample_ids", F.array_join("sample_ids", ","))


@query(
    "theme_top3",
    f"""WITH {VOCAB}, {EV}, {AGG}, {rank_sql('product_id')}
SELECT product_id, rank, theme_id, label, review_count, low_star_count, avg_rating
FROM ranked WHERE rank <= 3""",
)
def theme_top3(spark, sf):
    counts = themes.theme_counts(event_reviews(spark, sf), KEYS)
    return themes.rank_themes(counts, KEYS).drop("summary")


@query(
    "theme_severity",
    f"""WITH {VOCAB}, {EV}
SELECT p.product_id, v.theme_id, count(ev.id) FILTER (ev.rating <= 2) AS low_star_count
FROM (SELECT DISTINCT product_id FROM ev) p JOIN vocab v ON true
LEFT JOIN ev ON ev.product_id = p.product_id AND ev.theme_id = v.theme_id
GROUP BY p.product_id, v.theme_id""",
)
def theme_severity(spark, sf):
    return themes.severity(event_reviews(spark, sf), KEYS)


@query(
    "sample_ids",
    f"""WITH {EV} SELECT product_id, theme_id, id, CAST(rn AS INTEGER) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id, theme_id
                               ORDER BY coalesce(rating, 99.0), id) AS rn FROM ev)
WHERE rn <= 12""",
)
def sample_ids(spark, sf):
    rows = themes.sample_ids(event_reviews(spark, sf), KEYS)
    return rows.select(*KEYS, "theme_id", F.posexplode("sample_ids").alias("at", "id")).select(
        *KEYS, "theme_id", "id", (F.col("at") + 1).alias("rn")
    )


@query(
    "theme_shares",
    f"""WITH {VOCAB}, {EV}, {AGG}
SELECT product_id, theme_id, review_count,
       CAST(floor(100.0 * (review_count::DOUBLE / (SELECT count(*) FROM ev)) + 0.5) AS INTEGER) AS share,
       CAST(floor(100.0 * (low_star_count::DOUBLE / review_count) + 0.5) AS INTEGER) AS severity,
       CAST(100 - floor(100.0 * (low_star_count::DOUBLE / review_count) + 0.5) AS INTEGER) AS rest
FROM agg""",
)
def theme_shares(spark, sf):
    reviews = event_reviews(spark, sf)
    counts = themes.theme_counts(reviews, KEYS)
    totals = counts.groupBy(*KEYS).agg(F.sum("review_count").alias("review_count"))
    return metrics.theme_shares(counts, totals, KEYS).select(
        *KEYS, "theme_id", "review_count", "share", "severity", "rest"
    )


@query(
    "display_ranks",
    f"""WITH {VOCAB}, {EV}, {AGG}, {rank_sql('product_id')}
SELECT product_id, theme_id, CASE WHEN rank <= 3 THEN rank END AS rank FROM ranked""",
)
def display_ranks(spark, sf):
    counts = themes.theme_counts(event_reviews(spark, sf), KEYS)
    return themes.display_ranks(counts, KEYS).select(*KEYS, "theme_id", "rank")


@query(
    "featured_themes",
    f"""WITH {VOCAB}, {EV}, {agg_sql('ev', 'product_id, week_key')},
{rank_sql('product_id, week_key')}
SELECT product_id, week_key, theme_id, review_count,
       CASE WHEN rank <= 3 THEN rank END AS rank, rank <= 3 AS featured FROM ranked""",
)
def featured_themes(spark, sf):
    counts = themes.theme_counts(event_reviews(spark, sf), WEEKLY)
    top = themes.rank_themes(counts, WEEKLY)
    return metrics.featured_themes(counts, top, WEEKLY).select(
        *WEEKLY, "theme_id", "review_count", "rank", "featured"
    )


@query(
    "top3_by_week",
    f"""WITH {VOCAB}, {EV}, {agg_sql('ev', 'product_id, week_key')},
{rank_sql('product_id, week_key')}
SELECT product_id, week_key, rank, theme_id, review_count, low_star_count, avg_rating
FROM ranked WHERE rank <= 3""",
)
def top3_by_week(spark, sf):
    counts = themes.theme_counts(event_reviews(spark, sf), WEEKLY)
    return themes.rank_themes(counts, WEEKLY).drop("summary", "label")


# Event types stand in for labels a labeller made up: only two are known ids.
@query(
    "fold_unknown_themes",
    f"""WITH {EV}, raw AS (
  SELECT ev.id, CASE event_type WHEN 'purchase' THEN 'trading_orders'
                WHEN 'signup' THEN 'customer_support' WHEN 'error' THEN NULL
                ELSE event_type END AS theme_id
  FROM ev JOIN events USING (event_id))
SELECT CASE WHEN theme_id IN ('trading_orders', 'customer_support') THEN theme_id
            ELSE 'app_reliability' END AS theme_id, count(*) AS n
FROM raw GROUP BY 1""",
)
def fold_unknown_themes(spark, sf):
    kind = F.col("event_type")
    raw = table(spark, sf, "events").select(
        F.when(kind == "purchase", "trading_orders")
        .when(kind == "signup", "customer_support")
        .when(kind != "error", kind)
        .alias("theme_id")
    )
    return themes.fold_unknown(raw).groupBy("theme_id").agg(F.count("*").alias("n"))


# Half of the events have an assignment; the rest falls back to the default.
@query(
    "attach_assignments",
    f"""WITH {EV}, asg AS (SELECT id, theme_id FROM ev WHERE rating >= 3)
SELECT coalesce(a.theme_id, 'app_reliability') AS theme_id, count(*) AS n,
       count(*) FILTER (e.rating <= 2) AS low_star_count
FROM ev e LEFT JOIN asg a USING (id) GROUP BY 1""",
)
def attach_assignments(spark, sf):
    reviews = event_reviews(spark, sf)
    assignments = reviews.filter("rating >= 3").select("id", "theme_id")
    joined = themes.attach_assignments(reviews.drop("theme_id"), assignments)
    return joined.groupBy("theme_id").agg(
        F.count("*").alias("n"), F.count_if(is_low_star(F.col("rating"))).alias("low_star_count")
    )


@query(
    "assigned_low_stars",
    f"""WITH {EV}, asg AS (SELECT id, theme_id FROM ev WHERE theme_id <> 'fees_funding')
SELECT a.theme_id, count(*) AS low_star_count
FROM asg a JOIN ev e USING (id) WHERE e.rating <= 2 GROUP BY 1""",
)
def assigned_low_stars(spark, sf):
    """Events of one type have no assignment; unmatched ids do not count."""
    reviews = event_reviews(spark, sf)
    assignments = reviews.filter(F.col("theme_id") != "fees_funding").select("id", "theme_id")
    return (
        assignments.join(reviews.select("id", "rating"), "id")
        .filter(is_low_star(F.col("rating")))
        .groupBy("theme_id")
        .agg(F.count("*").alias("low_star_count"))
    )


@query(
    "observed_or_known_themes",
    f"""WITH {VOCAB} SELECT event_type AS theme_id FROM events
UNION SELECT theme_id FROM vocab""",
)
def observed_or_known_themes(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_type").alias("theme_id")).distinct()
    known = spark.range(1).select(F.explode(F.lit(VOCABULARY.ids)).alias("theme_id"))
    return events.union(known).distinct()


@query(
    "unknown_themes",
    f"""WITH {VOCAB} SELECT DISTINCT event_type AS theme_id FROM events
WHERE event_type NOT IN (SELECT theme_id FROM vocab)""",
)
def unknown_themes(spark, sf):
    seen = table(spark, sf, "events").select(F.col("event_type").alias("theme_id")).distinct()
    return seen.filter(~VOCABULARY.contains(F.col("theme_id")))


WEEK_AGG = agg_sql("ev", "product_id, week_key")
WEEK_RANK = rank_sql("product_id, week_key")


@query(
    "themes_report",
    f"""WITH {VOCAB}, {EV}, {WEEK_AGG}, {WEEK_RANK},
ending AS (SELECT product_id, week_key, max(date) AS week_ending FROM ev GROUP BY ALL),
tops AS (SELECT product_id, week_key, string_agg(theme_id, ',' ORDER BY rank) AS top_3
         FROM ranked WHERE rank <= 3 GROUP BY ALL)
SELECT r.product_id, r.week_key, week_ending, top_3, CAST(sum(review_count) AS BIGINT) AS labeled_reviews,
       string_agg(r.theme_id || ':' || review_count, ',' ORDER BY v.ordinal) AS themes,
       string_agg(r.theme_id || ':' || low_star_count, ',' ORDER BY r.theme_id) AS severity
FROM ranked r JOIN vocab v ON r.theme_id = v.theme_id
JOIN ending e ON r.product_id = e.product_id AND r.week_key = e.week_key
JOIN tops t ON r.product_id = t.product_id AND r.week_key = t.week_key GROUP BY ALL""",
)
def themes_report(spark, sf):
    """The nested theme artifact of each week, its lists written out."""
    pairs = F.transform("themes", lambda t: F.concat_ws(":", t["id"], t["review_count"]))
    low = F.transform(
        F.array_sort(F.map_entries("severity")), lambda e: F.concat_ws(":", e["key"], e["value"])
    )
    return _themes_report(spark, sf).select(
        *WEEKLY, "week_ending", F.array_join("top_3", ",").alias("top_3"), "labeled_reviews",
        F.array_join(pairs, ",").alias("themes"), F.array_join(low, ",").alias("severity"),
    )


def _themes_report(spark, sf):
    reviews = event_reviews(spark, sf)
    table_ = themes.aggregate_themes(reviews, WEEKLY)
    ending = metrics.week_ending(reviews, WEEKLY)
    return themes.themes_report(
        table_, themes.rank_themes(table_, WEEKLY), themes.severity(reviews, WEEKLY), ending, WEEKLY
    )
