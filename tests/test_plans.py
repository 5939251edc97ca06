"""Files in, reports and ledger out, and the streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from voxboard.model import REVIEW_COLUMNS
from voxboard.operators.intake import normalise, require_product
from voxboard.plans.ingest import ingest, ingest_stats
from voxboard.plans.job import weekly_job
from voxboard.plans.weekly import report_payload, weekly_reports
from voxboard.sources import artifacts, clean, raw
from voxboard.streaming.intake import stream_dedupe, stream_raw, stream_reviews
from voxboard.streaming.weekly import weekly_theme_counts

AS_OF = "2026-09-08"
TEXTS = [
    "The app crashes every time I open the holdings page today, please fix it now.",
    "I cannot sell my order and the stop-loss does not fire when the market moves.",
    "Support never answers tickets about failed UPI deposits, it is a very long wait.",
]


def write(path, content, encoding="utf-8"):
    path.write_bytes(content.encode(encoding))


@pytest.fixture
def exports(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    row = {"text": TEXTS[0], "date": "2026-09-01", "rating": 1, "package": "app"}
    write(folder / "a.json", json.dumps([row, 7, {**row, "text": TEXTS[1], "date": "2026-09-02"}]))
    write(folder / "b.json", json.dumps({"reviews": [{"content": TEXTS[2], "at": 1788300000000, "score": "2"}], "n": 1}))
    write(folder / "c.json", json.dumps({**row, "title": "single", "text": "  "}))
    head = "Package Name\tReview Text\tReview Submit Date and Time\tStar Rating\tReviewer Language\n"
    write(folder / "d.csv", head + f'app\t"{TEXTS[0]}"\t2026-09-01\t1\ten\nother\tx\t2026-09-01\t1\ten\n', "utf-16")
    write(folder / "e.csv", "text;date;stars\n\"semi;colon, a\nnew line\";01-09-2026;9\nno date;;3\n", "utf-8-sig")
    write(folder / "f.tsv", "text\tdate\ncaf\xe9 is nice\t2026/9/3\n", "latin-1")
    write(folder / "notes.txt", "not an export")
    return str(folder)


def test_all_export_forms(spark, exports):
    df = raw.scan_raw(spark, exports)
    rows = {r.text: r for r in normalise(df, "app").collect()}
    assert set(rows) == {
        *TEXTS, "single", 'semi;colon, a\nnew line', "café is nice",
    }
    assert rows[TEXTS[2]].date == dt.date(2026, 9, 1) and rows[TEXTS[2]].rating == 2.0
    assert rows["single"].title is None
    assert rows['semi;colon, a\nnew line'].rating is None
    assert rows["café is nice"].date == dt.date(2026, 9, 3)
    quoted = exports + "/../quoted.csv"
    with open(quoted, "w") as out:
        out.write('text;date\n"a ""quote"" here";2026-09-01\n')
    assert raw.scan_csv(spark, quoted, "UTF-8", ";").first().text == 'a "quote" here'
    with pytest.raises(ValueError):
        require_product(df, "nobody")
    require_product(df, "app")
    with pytest.raises(ValueError):
        raw.scan_raw(spark, [exports + "/notes.txt"])


def test_ingest_funnel_and_clean_files(spark, exports, tmp_path):
    intake = ingest(raw.scan_raw(spark, exports), AS_OF, "app", detector=F.lit(True))
    kept = intake.reviews.collect()
    assert {r.text for r in kept} >= set(TEXTS) and all(r.language == "en" for r in kept)
    stats = ingest_stats(intake.classified, intake.parsed, AS_OF, detector=F.lit(True)).first()
    assert (stats.raw_rows, stats.dropped_wrong_package, stats.dropped_bad_date) == (9, 1, 1)
    assert stats.parsed == 6 and stats.in_window == 6 and stats.weeks_used == 12
    assert stats.after_scrub == stats.dropped_short_text + stats.dropped_non_english + stats.after_quality
    assert stats.after_quality == len(kept)

    path = str(tmp_path / "clean.parquet")
    clean.write_clean(intake.reviews, path)
    back = clean.scan_clean(spark, path)
    assert back.count() == len(kept) and {"product_id", "week_key"} <= set(back.columns)
    mirror = str(tmp_path / "clean.csv")
    clean.write_csv(intake.reviews, mirror)
    rows = clean.scan_clean(spark, mirror)
    assert rows.columns == REVIEW_COLUMNS
    assert sorted(r.text for r in rows.collect()) == sorted(r.text for r in kept)
    assert clean.scan_clean_preferred(spark, str(tmp_path / "none.json"), mirror).count() == len(kept)
    with pytest.raises(ValueError):
        clean.write_clean(intake.reviews.withColumn("email", F.lit("x")), path)
    with pytest.raises(ValueError):
        raw.require_nonempty(rows.limit(0))


def corpus(spark, n):
    rows = [
        ("p", f"play-{i:016x}", "play", float(1 + i % 2), None, f"{TEXTS[i % 3]} Case {i}.", dt.date(2026, 9, 1 + i % 8), "en")
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "product_id string, id string, source string, rating double, title string, text string, date date, language string"
    )


def test_sparse_week(spark):
    weekly = weekly_reports(corpus(spark, 3), AS_OF)
    row = weekly.results(["product_id"]).first()
    assert row.insufficient_signal and row.window_widened and row.validation_ok, row.errors
    assert row.body.count("\n## ") == 3 and "only 3 Play Store reviews in the last 12 weeks" in row.body
    assert row.word_count <= 250 and len(row.quotes) == 3 and len(row.themes) == 3


def test_weekly_job_and_ledger(spark, tmp_path):
    ledger, gates = str(tmp_path / "runs"), str(tmp_path / "gates")
    started = dt.datetime(2026, 9, 8, 8)
    folder = str(tmp_path / "themes")
    weekly, queue = weekly_job(
        spark, corpus(spark, 45), ledger, AS_OF, started, gates_path=gates, themes_path=folder
    )
    artifact = spark.read.json(folder).first()
    assert artifact.labeled_reviews == 45 and artifact.week_key == "2026-W37" and len(artifact.top_3) == 3
    assert [r.week_key for r in queue.collect()] == ["2026-W37"]
    run = artifacts.read_runs(spark, ledger).first()
    assert run.validation_ok and run.review_count == 45 and run.top_3[0] and run.doc_id is None
    assert spark.read.json(gates).count() == 7
    payload = report_payload(weekly, ["product_id"]).first()
    assert sum(payload.rating_histogram) == 45 and len(payload.gates) == 7 and payload.snippets
    # A delivered week is left out of the next queue.
    done = artifacts.read_runs(spark, ledger).withColumns(
        {"doc_id": F.lit("d"), "draft_id": F.lit("m"), "finished_at": F.lit("2099-09-08 09:00:00").cast("timestamp")}
    )
    artifacts.append_run(spark.createDataFrame(done.collect(), done.schema), ledger)
    _, again = weekly_job(spark, corpus(spark, 45), ledger, AS_OF, dt.datetime(2026, 9, 8, 10))
    assert again.count() == 0
    with pytest.raises(ValueError):
        weekly_job(spark, corpus(spark, 0), ledger, AS_OF, started)


def test_sampled_and_labelled_reports(spark):
    reviews = corpus(spark, 60)
    labels = reviews.select("product_id", "id", F.lit("fees_funding").alias("theme_id"))
    weekly = weekly_reports(reviews, AS_OF, labels=labels, limit=40)
    assert weekly.labelled.count() == 40
    assert weekly.results(["product_id"]).first().review_count == 40


def test_stream_intake_drops_copies_and_late_rows(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()

    def land(name, rows):
        write(landing / name, "\n".join(json.dumps(r) for r in rows))

    one = {"text": "first copy", "date": "2026-09-01", "rating": "1", "package": "app"}
    land("1.json", [one, one, {**one, "text": "other"}])
    schema = "text string, date string, rating string, package string"
    stream = stream_reviews(stream_raw(spark, str(landing), spark.createDataFrame([], schema).schema))
    counts = weekly_theme_counts(
        stream_dedupe(stream, "7 days").withColumn("theme_id", F.lit("fees_funding")), delay=None
    )
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        (
            counts.writeStream.outputMode("append")
            .format("parquet")
            .option("checkpointLocation", state)
            .option("path", out)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )

    go()
    # Time moves on; the week closes, and a row from before it comes too late.
    land("2.json", [{**one, "text": "new", "date": "2026-10-20"}])
    go()
    land("3.json", [{**one, "text": "late"}, {**one, "text": "newer", "date": "2026-12-20"}])
    go()
    rows = {r.week_key: r.review_count for r in spark.read.parquet(out).collect()}
    assert rows["2026-W36"] == 2 and rows.get("2026-W43", 1) == 1
