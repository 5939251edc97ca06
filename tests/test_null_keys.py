"""Reviews without a product are a group like any other, in every keyed operator."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from voxboard.operators import evidence, gates, ledger, metrics, report, sampling, themes, windows
from voxboard.operators.joins import join_on
from voxboard.plans.ingest import ingest, ingest_stats
from voxboard.plans.weekly import report_payload, weekly_reports
from voxboard.sources.artifacts import read_runs

KEYS = ["product_id"]
AS_OF = "2024-03-31"
NAMED, UNNAMED = "com.example.app", None


@pytest.fixture(scope="module")
def reviews(spark):
    """The same thirty reviews under a product and under none, two of them copies."""
    words = "the app crashes on login every single time that i want to buy a stock today number"
    rows = []
    for product in (NAMED, UNNAMED):
        for i in range(30):
            text = f"{words} {i} {'order' if i % 3 else 'chart chart'} and support"
            rows.append((product, f"play-{i:04x}", "play", float(1 + i % 5) if i % 7 else None, text, dt.date(2024, 3, 1 + i % 28), "en"))
    return spark.createDataFrame(
        rows, "product_id string, id string, source string, rating double, text string, date date, language string"
    ).withColumn("title", F.lit(None).cast("string"))


def halves(df):
    """What was made of either group, without the key."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    sides = {}
    for r in rows:
        sides.setdefault(r.pop("product_id"), []).append(str(sorted(r.items())))
    assert set(sides) == {NAMED, UNNAMED}
    return sorted(sides[NAMED]), sorted(sides[UNNAMED])


def same(df):
    named, unnamed = halves(df)
    assert named and named == unnamed


def test_join_on(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([("r1", None), ("r2", "a")], "y string, k string")
    rows = {tuple(r) for r in join_on(left, right, ["k"], "left").collect()}
    assert rows == {(None, 1, "r1"), ("a", 2, "r2"), ("b", 3, None)}
    assert [r.x for r in join_on(left, right, ["k"], "left_anti").collect()] == [3]
    assert join_on(left, right, ["k"]).columns == ["k", "x", "y"]


def test_windows_and_samples(reviews):
    same(windows.adaptive_window(reviews, 8, AS_OF, KEYS, 30, with_flags=True))
    for n in (7, 5000):
        same(sampling.stratified_sample(reviews, n, KEYS))
    same(sampling.systematic_sample(reviews, 7, KEYS))


def test_themes_and_labels(reviews):
    labelled = themes.label_heuristic(themes.score_reviews(reviews))
    table = themes.aggregate_themes(labelled, KEYS)
    top = themes.rank_themes(table, KEYS)
    same(table)
    totals = reviews.groupBy(*KEYS).agg(F.count("*").alias("review_count"))
    same(metrics.theme_shares(table, totals, KEYS))
    same(metrics.featured_themes(table, top, KEYS))
    routed = themes.split_label_queue(reviews, KEYS, max_n=5)
    same(routed.select("product_id", "id", "route", "queue_rank", "batch"))
    labels = routed.filter("route = 'queue'").select("product_id", "id", F.lit("fees_funding").alias("theme_id"))
    same(themes.merge_labels(routed, labels, KEYS).select("product_id", "id", "theme_id"))


def test_quotes(reviews):
    labelled = themes.label_heuristic(themes.score_reviews(reviews))
    top = themes.rank_themes(themes.aggregate_themes(labelled, KEYS), KEYS)
    candidates = evidence.quote_candidates(labelled, top, KEYS)
    same(candidates)
    picked = evidence.select_quotes(candidates, KEYS)
    same(evidence.verbatim_in_group(picked, reviews, KEYS))
    one = picked.filter("quote_rank = 1")
    same(evidence.pad_quotes(one, labelled, labelled, KEYS).select("product_id", "quote_rank", "id", "quote"))
    picks = picked.withColumnRenamed("quote_rank", "pick_rank").select("product_id", "pick_rank", "id", "quote")
    same(evidence.resolve_picks(picks, reviews, KEYS).select("product_id", "quote_rank", "id", "quote"))
    few = picks.withColumn("quote", F.when(F.col("pick_rank") > 1, F.lit("never said")).otherwise(F.col("quote")))
    fallen = evidence.resolve_picks(few, reviews, KEYS, fallback=picked)
    same(fallen)
    assert sorted(r.quote for r in fallen.collect()) == sorted(r.quote for r in picked.collect())
    same(evidence.filter_evidence(labelled, "top3", top, KEYS).select("product_id", "id"))
    actions = report.default_actions(top, KEYS)
    same(evidence.ground_actions(actions, picked, KEYS).select("product_id", "theme_id", "grounded_in"))


def test_weekly_plan(spark, reviews, tmp_path):
    weekly = weekly_reports(reviews, AS_OF, loose_space=True)
    same(weekly.reports.drop("body", "title", "word_count"))
    assert weekly.reports.filter("title is null or body is null or word_count < 100").count() == 0
    same(weekly.gates.drop("detail"))
    same(weekly.results(KEYS).drop("body", "title", "word_count"))
    same(report_payload(weekly, KEYS).drop("body", "title", "word_count", "gates"))
    runs = weekly.run_rows(KEYS, F.lit("2024-04-01 00:00:00").cast("timestamp"))
    prior = read_runs(spark, str(tmp_path / "no ledger yet"))
    queue = ledger.publish_queue(runs, prior, ["product_id", "week_key"], True)
    same(queue.drop("body", "title", "word_count"))
    gone = gates.missing_report_gates(reviews, weekly.reports.limit(0), KEYS)
    same(gone)


def test_ingest(spark, reviews):
    raw = reviews.select(
        F.col("product_id").alias("package"), "text", F.col("date").cast("string").alias("date"),
        F.col("rating").cast("string").alias("rating"), F.lit("en").alias("lang"), F.lit("f").alias("src_file"),
        F.monotonically_increasing_id().alias("src_pos"),
    )
    done = ingest(raw, AS_OF, detector=F.lit(True))
    same(done.reviews)
    named, unnamed = halves(ingest_stats(done.classified, done.parsed, AS_OF, detector=F.lit(True)))
    assert named == unnamed and "('parsed', 30)" in named[0] and "('after_quality', 30)" in named[0]
