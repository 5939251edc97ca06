"""Sketches per day: rolled up from days, batches and products as if from the reviews."""

import datetime as dt
import random
import statistics

from voxboard.operators import sketches


def test_rolled_up_days_are_within_the_stated_errors(spark):
    rnd = random.Random(2)
    rows = [
        (f"p{rnd.randrange(2)}", dt.date(2024, 1, 1 + rnd.randrange(20)), f"s{rnd.randrange(3000)}",
         float(rnd.randint(1, 5)), "w " * int(rnd.paretovariate(0.7) % 400))
        for _ in range(20_000)
    ]
    df = spark.createDataFrame(rows, "product_id string, date date, source string, rating double, text string")
    # Two batches give two rows for the same day; they merge all the same.
    days = sketches.day_sketches(df.filter("rating < 3"), ["product_id"]).unionByName(
        sketches.day_sketches(df.filter("rating >= 3"), ["product_id"])
    )
    for r in sketches.roll_up(days.filter("date < '2024-01-11'"), ["product_id"]).collect():
        own = [x for x in rows if x[0] == r.product_id and x[1] < dt.date(2024, 1, 11)]
        words = sorted(len(x[4].split()) for x in own)
        assert (r.review_count, r.min_words, r.max_words) == (len(own), words[0], words[-1])
        assert abs(r.avg_words - statistics.mean(words)) < 1e-9
        below, up_to = (sum(w < r.median_words for w in words) / len(words), sum(w <= r.median_words for w in words) / len(words))
        assert below <= 0.5 + sketches.RANK_ERROR and up_to >= 0.5 - sketches.RANK_ERROR
        sources = len({x[2] for x in own})
        assert abs(r.distinct_sources - sources) <= sketches.DISTINCT_ERROR * sources


def test_empty(spark):
    df = spark.createDataFrame([], "product_id string, date date, source string, rating double, text string")
    assert sketches.roll_up(sketches.day_sketches(df, ["product_id"]), ["product_id"]).count() == 0
